"""Toxicity by compression distance: two zstandard dictionaries, compared over windows of a text.

One zstandard dictionary is made of toxic and another one, of the same bounds, of ordinary texts. Both kinds share their language, so of every labelled text
counts what tells its kind: pieces of 7 bytes that several of its kind's texts hold and hardly any of the other kind's. The pieces of
whole texts are counted on the executors. zstandard leaves a window as it is unless it gets three bytes shorter, which takes a match of ten; so a dictionary is
strings of that length, picked to cover as many as they can of the windows that hold a piece which tells beyond chance. Where the texts are too few for such pieces,
zstandard trains a dictionary on the runs that telling pieces make up. A text is cut into windows of three words, all of them; a window that the toxic
dictionary shortens more than the ordinary one speaks for toxicity. From how many bytes on that counts as a hit is calibrated on ordinary windows, and a logistic regression turns a text's
windows into a score. Both are fitted crosswise: each half of the labelled texts by dictionaries trained on the other half; the dictionaries that score are trained on both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import kept, let_go, materialise, text_slices

_ENTROPY_END = b"\x01\x00\x00\x00\x04\x00\x00\x00\x08\x00\x00\x00"  # the repeat offsets that end a dictionary's header
_STEPS = 12  # a window's difference counts up to so many bytes
_UNDER = (2, 4, 6)
_PIECE = 7  # bytes: eight with a zero before them are a long, and zstandard's longest least match
_FITS = {"0": ("0",), "2": ("2",), "all": ("0", "2")}  # dictionaries by the halves they are trained on
_ROWS = 1 << 16  # of a batch of counts
_PART = 1 << 13  # windows that are cut into strings at once
_MATCH = 10  # bytes: the least match that makes a window shorter by itself


@dataclass(frozen=True)
class Settings:
    """The fit sees at most `rows` labelled rows of each label and half, of these all of their texts."""

    rows: int = 3000
    words: int = 3  # of a window
    own_bytes: int = 4 << 10  # of a trained dictionary
    segment: int = 16  # bytes of a run that the trainer picks
    cover_bytes: int = 28_000  # of a dictionary of strings: 15 bits reach all of it, so a match takes four bytes
    least_texts: int = 3  # a piece tells its kind that so many texts of it hold,
    least_ratio: float = 20.0  # and so many times as large a share of them as of the other kind's
    texts_a_window: int = 100  # a string covers a window for every so many texts of its kind
    false_windows: float = 0.002  # the share of ordinary windows that are hits


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    step: int
    weights: tuple[float, ...]
    settings: Settings = field(default_factory=Settings)


def plain(text: str | None) -> str:
    """A text's words, lower-cased, between single blanks."""
    return f" {' '.join((text or '').lower().split())} "


def windows(text: str | None, words: int) -> list[str]:
    """A text's words, so many at a time, between blanks; one empty window for a text without words."""
    own = plain(text).split(" ")[1:-1]
    return [" ".join(["", *own[i : i + words], ""]) for i in range(0, len(own), words)]


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def pieces(text: str | None) -> np.ndarray:
    """The numbers of the pieces of a text, by where they begin."""
    b = np.frombuffer(_bytes(plain(text)), np.uint8)
    n = len(b) - _PIECE + 1
    out = np.zeros(max(n, 0), np.int64)
    for j in range(_PIECE if n > 0 else 0):
        out <<= 8
        out |= b[j : j + n]
    return out


def runs(text: str | None, telling: np.ndarray) -> list[bytes]:
    """The runs of a text that pieces in telling (sorted) cover."""
    own, raw = pieces(text), _bytes(plain(text))
    if not len(telling) or not len(own):
        return []
    met = telling[np.minimum(np.searchsorted(telling, own), len(telling) - 1)] == own
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(met), 1)
    np.add.at(edge, np.flatnonzero(met) + _PIECE, -1)
    inside = np.concatenate([[0], np.cumsum(edge)[:-1] > 0, [0]])
    turns = np.flatnonzero(np.diff(inside)).reshape(-1, 2)
    return [raw[i:j] for i, j in turns.tolist()]


def _count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """piece, kind, n: how many texts of each half and label hold each piece, by slices of a batch that hold a bounded amount of text."""
    let_go()
    for batch in (part for whole in batches for part in text_slices(whole, "text", 1 << 20)):
        held: dict[int, list[np.ndarray]] = {}
        for kind, text in zip(batch["kind"].to_pylist(), batch["text"], strict=True):
            held.setdefault(kind, []).append(np.unique(pieces(text.as_py())))
        while held:
            kind, found = held.popitem()
            piece, n = np.unique(np.concatenate(found), return_counts=True)
            for i in range(0, len(piece), _ROWS):
                part = piece[i : i + _ROWS]
                yield pa.RecordBatch.from_pydict({"piece": part, "kind": np.full(len(part), kind, np.int8), "n": n[i : i + _ROWS].astype(np.int32)})


def telling_pieces(texts: DataFrame, settings: Settings) -> dict[tuple[str, int], np.ndarray]:
    """(fit, label) -> the sorted pieces that tell texts of the label, from texts(part, toxic, text), each text once."""
    return _told(texts, settings)[0]


def _told(texts: DataFrame, settings: Settings) -> tuple[dict[tuple[str, int], np.ndarray], dict[tuple[str, int], np.ndarray]]:
    """(fit, label) -> the pieces that tell, and of these the sure ones, of which chance would not bring one forth among all pieces of a half's texts."""
    kinds = [f"{part}{toxic}" for part in ("0", "2") for toxic in (0, 1)]
    number = F.array_position(F.array(*map(F.lit, kinds)), F.concat("part", F.col("toxic").cast("string"))) - 1
    rows = texts.select(number.cast("byte").alias("kind"), "text")
    total = {kinds[r.kind]: r["count"] for r in rows.groupBy("kind").count().collect()}
    n = rows.mapInArrow(_count_pieces, "piece long, kind byte, n int").groupBy("piece").agg(*[F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)).alias(k) for i, k in enumerate(kinds)])
    tests, sides = {}, {}
    for fit, halves in _FITS.items():
        for toxic in (0, 1):
            own, other = (sum((F.col(f"`{h}{k}`") for h in halves), F.lit(0)) for k in (toxic, 1 - toxic))
            n_own, n_other = (max(1, sum(total.get(f"{h}{k}", 0) for h in halves)) for k in (toxic, 1 - toxic))
            tests[fit, toxic] = (own >= settings.least_texts) & (own / n_own >= settings.least_ratio * (other + 0.5) / n_other)
            sides[fit, toxic] = [f"{h}{toxic}" for h in halves], [f"{h}{1 - toxic}" for h in halves], n_own / (n_own + n_other)
    every = Observation()
    flags = n.observe(every, F.count(F.lit(1)).alias("pieces")).select("piece", *[F.col(f"`{k}`").cast("int").alias(k) for k in kinds], *[t.alias(f"t{i}") for i, t in enumerate(tests.values())])
    some = flags.where(" OR ".join(f"t{i}" for i in range(len(tests)))).toArrow()
    piece, held = some["piece"].to_numpy(), {k: some[k].to_numpy() for k in kinds}
    telling, sure = {}, {}
    for i, (k, (own, other, share)) in enumerate(sides.items()):
        tells = some[f"t{i}"].to_numpy(zero_copy_only=False)
        beyond = beyond_chance(sum(held[c] for c in own)[tells], sum(held[c] for c in other)[tells], share, every.get["pieces"])
        telling[k], sure[k] = np.sort(piece[tells]), np.sort(piece[tells][beyond])
    for toxic in (0, 1):  # twice the texts make sure of more near copies; step and weights are fitted on pieces that one half makes sure of
        sure["all", toxic] = np.intersect1d(telling["all", toxic], np.union1d(sure["0", toxic], sure["2", toxic]))
    return telling, sure


def beyond_chance(own: np.ndarray, other: np.ndarray, share: float, tries: int) -> np.ndarray:
    """Where so many of a piece's texts are of a kind that has `share` of all texts that chance brings forth less than one such piece in `tries` (Chernoff's bound)."""
    n, part = own + other, own / np.maximum(own + other, 1)
    rest = np.where(part < 1, 1 - part, 1)
    divergence = part * np.log(np.where(part > 0, part, 1) / share) + np.where(part < 1, rest * np.log(rest / (1 - share)), 0)
    return (part > share) & (n * divergence >= np.log(max(tries, 1)))


def telling_windows(text: str | None, sure: np.ndarray, words: int) -> list[bytes]:
    """Every run of so many words of a text, between blanks, that holds a piece in sure (sorted), wherever a text's windows begin."""
    own, raw = pieces(text), _bytes(plain(text))
    if not len(sure) or not len(own):
        return []
    met = np.flatnonzero(sure[np.minimum(np.searchsorted(sure, own), len(sure) - 1)] == own)
    blanks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    begin = blanks[:-1]
    end = blanks[np.minimum(np.arange(len(begin)) + words, len(blanks) - 1)] + 1
    first = np.searchsorted(met, begin)
    holds = (first < len(met)) & (np.append(met, len(raw))[first] + _PIECE <= end)
    return [raw[i:j] for i, j in zip(begin[holds].tolist(), end[holds].tolist(), strict=True)]


def cover(held: list[bytes], sure: np.ndarray, settings: Settings, least: int = 1) -> bytes:
    """A dictionary of strings of _MATCH bytes: one after the other the string that most windows hold of those that hold none yet, around a piece in sure (sorted), down to `least` windows.

    The matcher looks up _PIECE bytes and knows one place of them, so each string begins with others. The most frequent ones come last, nearest to the text.
    """
    heads, tails, owner = [], [], []
    for start in range(0, len(held), _PART):
        part = held[start : start + _PART]
        b, ends = np.frombuffer(b"".join(part), np.uint8).astype(np.int64), np.cumsum(list(map(len, part)))
        if len(b) < _MATCH:
            continue
        own = np.zeros(len(b) - _PIECE + 1, np.int64)
        for j in range(_PIECE):
            own = (own << 8) | b[j : j + len(own)]
        met, n = sure[np.minimum(np.searchsorted(sure, own), len(sure) - 1)] == own, len(b) - _MATCH + 1
        at = np.flatnonzero(np.logical_or.reduce([met[j : j + n] for j in range(_MATCH - _PIECE + 1)]))
        window = np.searchsorted(ends, at, "right")
        at, window = at[inside := at + _MATCH <= ends[window]], window[inside]
        heads.append(own[at])
        tails.append(((b[at + 7] << 16) | (b[at + 8] << 8) | b[at + 9]).astype(np.int32))
        owner.append((start + window).astype(np.int32))
    head, tail, window = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (heads, tails, owner))
    if not len(head):
        return b""
    order = np.lexsort((window, tail, head))
    head, tail, window = head[order], tail[order], window[order]
    new = np.append(True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]))
    once = new | np.append(True, window[1:] != window[:-1])  # a window counts once for a string
    head, tail, window, new = head[once], tail[once], window[once], new[once]
    string, starts = (np.cumsum(new) - 1).astype(np.int32), np.append(np.flatnonzero(new), len(head))
    head, tail = head[new], tail[new]
    order = np.argsort(window, kind="stable")
    of_window, window_at = string[order], np.searchsorted(window[order], np.arange(len(held) + 1))
    left, done, out = np.diff(starts), np.zeros(len(held), bool), []
    while (len(out) + 1) * (_MATCH + 1) <= settings.cover_bytes:
        x = int(left.argmax())
        if left[x] < least:
            break
        out.append(int(head[x]).to_bytes(_PIECE, "big") + int(tail[x]).to_bytes(_MATCH - _PIECE, "big"))
        for k in window[starts[x] : starts[x + 1]].tolist():
            if not done[k]:
                done[k] = True
                left[of_window[window_at[k] : window_at[k + 1]]] -= 1
        left[np.searchsorted(head, head[x]) : np.searchsorted(head, head[x], "right")] = -len(held)
    return b"\n".join(reversed(out))


def train(samples: list[bytes], settings: Settings) -> bytes:
    """The content of a dictionary trained on runs; the distinct runs themselves where they are too few to train on."""
    import zstandard

    try:
        raw = zstandard.train_dictionary(settings.own_bytes, samples, k=settings.segment, d=6).as_bytes()
        at = raw.find(_ENTROPY_END)
        return raw[at + len(_ENTROPY_END) :] if at >= 0 else raw
    except zstandard.ZstdError:
        return b"\n".join(sorted(set(samples)))[-settings.own_bytes :]


class Comparer:
    def __init__(self, ordinary: bytes, toxic: bytes, settings: Settings):
        import zstandard

        # The fast strategy with a target length keeps literals as they are: a window's length then tells its matches alone.
        options = zstandard.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=_PIECE, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.pair = [zstandard.ZstdCompressor(compression_params=options, dict_data=zstandard.ZstdCompressionDict(b"\n" * 8 + d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for d in (ordinary, toxic)]
        self.words = settings.words

    def gains(self, text: str | None) -> list[float]:
        """What a text's windows gain by the toxic dictionary: the most, the mean of the best three, the mean difference, how many windows there are, in
        how many of them the difference is 1, 2, ... bytes at least, and in how many the ordinary one gains 2, 4 and 6."""
        plain_, toxic = (c.compress for c in self.pair)
        saved = np.array([len(plain_(w)) - len(toxic(w)) for w in map(_bytes, windows(text, self.words))] or [0], float)
        best = np.sort(saved)[::-1]
        return [float(best[0]), float(best[:3].mean()), float(saved.mean()), float(len(saved)), *[float((saved >= k).sum()) for k in range(1, _STEPS + 1)], *[float((saved <= -k).sum()) for k in _UNDER]]


def features(gains: np.ndarray, step: int) -> np.ndarray:
    """Rows of gains as input of the regression; hits are the windows that gain `step` bytes at least."""
    n, counts = gains[:, 3:4], gains[:, 4:]
    hits = counts[:, step - 1 : step]
    return np.concatenate([np.ones_like(n), np.minimum(gains[:, :2], _STEPS), gains[:, 2:3], np.log1p(n), hits >= 1, hits >= 2, 10 * counts / n, np.log1p(counts)], axis=1)


def calibrated(gains: np.ndarray, share: float) -> int:
    """The least step that `share` of the windows of some texts reach at most."""
    reached = gains[:, 4 : 4 + _STEPS].sum(axis=0) / max(1.0, gains[:, 3].sum())
    return int(np.argmax(reached <= share)) + 1 if (reached <= share).any() else _STEPS


def fit_weights(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; weight is what each row counts for."""
    weight = np.ones(len(y)) if weight is None else weight
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> ToxicityModel | None:
    """Fit on docs(doc_id, text) and labels(doc_id, toxic): rows whose crc32(doc_id as text) mod 3 is 0 or 2 are the two halves, those of 1 are never read.

    A doc_id that is labelled both ways is left out. None without labelled rows of both kinds in both halves.
    """
    settings = settings or Settings()
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    clear = labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    groups = [(part, toxic) for part in (0, 2) for toxic in (0, 1)]

    def sample(df: DataFrame, part: int, toxic: int, *order: str) -> DataFrame:
        return df.where((F.col("part") == part) & (F.col("toxic") == toxic)).orderBy(F.xxhash64(*order), *order).limit(settings.rows)

    def every(df: DataFrame, *order: str) -> DataFrame:
        parts = [sample(df, part, toxic, *order) for part, toxic in groups]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

    # Ids first, so that the texts of 4 x rows of them alone are looked up; then rows, as a doc_id may be there many times. Equal texts count once.
    ids = every(clear.select("doc_id", fold.alias("part"), "toxic").where("part <> 1"), "doc_id").withColumnRenamed("doc_id", "label_id")
    found = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("label_id")).select("doc_id", "part", "toxic", "text")
    rows = materialise(every(found, "doc_id", "text").select(F.col("part").cast("string").alias("part"), "toxic", F.coalesce("text", F.lit("")).alias("text")).distinct().repartition(32), "toxicity-sample")
    if rows.select("part", "toxic").distinct().count() < len(groups):
        return None
    telling, sure = _told(rows, settings)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part, toxic, text in zip(*(batch[c].to_pylist() for c in ("part", "toxic", "text")), strict=True):
                for name, halves in _FITS.items():
                    if part in halves:
                        own = runs(text, telling[name, toxic]), telling_windows(text, sure[name, toxic], settings.words)
                        yield pa.RecordBatch.from_pydict({"fit": [name], "toxic": pa.array([toxic], pa.int32()), **{c: pa.array([x], pa.list_(pa.binary())) for c, x in zip(("runs", "windows"), own, strict=True)}})

    def dictionary(found: pa.Table) -> pa.Table:
        let_go()
        name, toxic = found["fit"][0].as_py(), found["toxic"][0].as_py()
        held = found["windows"].combine_chunks()
        enough = 2 * sum(n > 0 for n in held.value_lengths().to_pylist()) >= len(held)
        trained = train(sorted(r for x in found["runs"].to_pylist() for r in x), settings)
        # Equal windows count once, so near copies of a text don't bring in their other words.
        covering = cover(sorted(set(held.flatten().to_pylist())), sure[name, toxic], settings, -(-len(held) // settings.texts_a_window)) if len(sure[name, toxic]) else b""
        return pa.table({"fit": [name], "toxic": pa.array([toxic], pa.int32()), "enough": [enough], "trained": [trained], "covering": [covering]})

    # What tells a kind in the sample's texts; one of the six dictionaries a group.
    cuts = rows.mapInArrow(cut, "fit string, toxic int, runs array<binary>, windows array<binary>").groupBy("fit", "toxic")
    made = {(r.fit, r.toxic): r for r in cuts.applyInArrow(dictionary, "fit string, toxic int, enough boolean, trained binary, covering binary").collect()}
    # Both of a pair are made in one way: by strings where half of the toxic texts hold a sure piece, as lengths are compared.
    pairs = {name: [bytes(made[name, toxic].covering if made[name, 1].enough else made[name, toxic].trained) for toxic in (0, 1)] for name in _FITS}
    gains, steps, y = [], [], []
    for own, other in (("0", "2"), ("2", "0")):
        got = rows.where(F.col("part") == own).select("toxic", _gains(*pairs[other], settings)("text").alias("g")).collect()
        kind = np.array([r.toxic for r in got])
        gains.append(np.array([r.g for r in got]))
        steps.append(calibrated(gains[-1][kind == 0], settings.false_windows))
        y.append(kind.astype(float))
    x = np.concatenate([features(g, s) for g, s in zip(gains, steps, strict=True)])
    ordinary, toxic = pairs["all"]
    # The sample holds as many rows of either kind as it may; each kind counts for its share of all labels, so that a score means the same at every size.
    kinds, of = np.concatenate(y), {r.toxic: r["count"] for r in clear.where(fold != 1).groupBy("toxic").count().collect()}
    weight = np.where(kinds == 1, of[1] / (kinds == 1).sum(), of[0] / (kinds == 0).sum())
    weights = fit_weights(x, kinds, weight * len(kinds) / weight.sum())
    return ToxicityModel(ordinary, toxic, round(sum(steps) / 2), tuple(weights.tolist()), settings)


def _gains(ordinary: bytes, toxic: bytes, settings: Settings):
    @F.arrow_udf("array<double>")
    def gains(texts: pa.Array) -> pa.Array:
        comparer = _comparer(ordinary, toxic, settings)
        return pa.array([comparer.gains(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return gains


def score(docs: DataFrame, model: ToxicityModel | None, column: str = "toxicity") -> DataFrame:
    """docs with a column (0 to 1) from the whole text alone; without a model 0 for every row.

    A null text counts as empty. All other columns come back; one of the same name is replaced.
    """
    if model is None:
        return docs.withColumn(column, F.lit(0.0))

    # One text of a batch at a time is a Python string.
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        comparer = _comparer(model.ordinary, model.toxic, model.settings)
        if not len(texts):
            return pa.array([], pa.float64())
        x = features(np.array([comparer.gains(t.as_py()) for t in texts]), model.step)
        return pa.array(1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30))))

    return docs.withColumn(column, scored("text"))


def _comparer(ordinary: bytes, toxic: bytes, settings: Settings) -> Comparer:
    return kept(("comparer", ordinary, toxic, settings), lambda: Comparer(ordinary, toxic, settings))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text).

    held_out marks rows whose crc32(doc_id as text) mod 3 is 1, which the fit never reads (null doc_id: false). Null and
    empty texts are scored as one empty window; repeated rows each come back; other columns are not read.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, settings), "score")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
