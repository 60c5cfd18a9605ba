"""Near duplicates by SetSketch registers: band, estimate by likelihood, verify on whole shingle sets, connect.

Every shingle of a set gives each register an exponential variate; a register keeps the least, as the truncated
logarithm floor(1 - log_b(x)) (Ertl, "SetSketch", 2021). Sketches of sets merge by maxima, and two registers agree about as often
as the sets are alike. Texts whose registers agree over a whole band are candidates; a likelihood over greater, smaller
and equal registers and both set sizes estimates their Jaccard similarity, and what may reach the threshold is verified on the texts.

Equal texts are one class with one representative. In a bucket of more than PAIRS_TO members the candidates are the links to one
centre. If its members don't all get connected, an exact prefix filter over their shingles lists what pairs may still be links. So a group of near
copies costs as many rows as it has members, not their square, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import let_go, lower_ascii, materialise, text_slices
from .graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BANDS, ROWS = 64, 6
REGISTERS, BASE, RATE = BANDS * ROWS, 1.08, 20.0
PAIRS_TO = 8
#: An estimate this far below the threshold is six standard deviations off.
MARGIN = 0.13
_M = np.uint64


def words(text: str | None) -> list[str]:
    return WORD.findall(lower_ascii(text or ""))


def shingles(tokens: list[str], size: int) -> set[tuple[str, ...]]:
    """Distinct runs of `size` words; all words as one run where there are fewer; none without words."""
    if not tokens:
        return set()
    return set(zip(*(tokens[k:] for k in range(size)), strict=False)) if len(tokens) >= size else {tuple(tokens)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, from the hashes of the words in order."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    out = np.full(n - size + 1, size, _M)
    for k in range(size):
        out = _mix(out * _M(0x9E3779B97F4A7C15) + hashes[k : n - size + 1 + k])
    return np.unique(out)


def set_sketch(elements: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit hashes. Each element visits the registers in an order of its own with ascending variates
    (sums of exponentials), so most elements stop after a few visits, when no register could still take their value."""
    m = REGISTERS
    best = np.full(m, np.inf)
    if not len(elements):
        return np.zeros(m, np.uint16)
    step = 6 * (elements % _M(m // 6)).astype(np.int64) + np.where(elements >> _M(63), 1, 5)  # prime to m = 2**7 * 3
    place = (_mix(elements ^ _M(0xA5A5A5A5A5A5A5A5)) % _M(m)).astype(np.int64)
    x, r = np.zeros(len(elements)), 0
    while r < m and len(elements):
        k = min(m - r, max(2, 3500 // len(elements)))
        rounds = np.arange(r, r + k)
        u = _mix(elements[:, None] + (rounds + 1).astype(_M) * _M(0x9E3779B97F4A7C15))
        gaps = -np.log(((u >> _M(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / (m - rounds)
        values = x[:, None] + np.cumsum(gaps, axis=1)
        places = (place[:, None] + step[:, None] * rounds) % m
        np.minimum.at(best, places.ravel(), values.ravel())
        x, r = values[:, -1], r + k
        on = x < best.max()
        elements, step, place, x = elements[on], step[on], place[on], x[on]
    # The variates above have rate 1; RATE is a register's.
    return np.clip(np.floor(1 - np.log(best / RATE) / np.log(BASE)), 0, 1 << 15).astype(np.uint16)


def to_bytes(registers: np.ndarray) -> bytes:
    """A byte a register, above a base of two bytes: registers of a set lie within some 150 of each other."""
    low = max(0, int(np.median(registers)) - 100)
    return np.uint16(low).tobytes() + np.clip(registers.astype(np.int64) - low, 0, 255).astype(np.uint8).tobytes()


def from_bytes(raw: list[bytes]) -> np.ndarray:
    table = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, REGISTERS + 2)
    return table[:, 2:].astype(np.int64) + np.ascontiguousarray(table[:, :2]).view("<u2").astype(np.int64)


def band_values(registers: np.ndarray) -> np.ndarray:
    """A 64-bit value for each band of registers."""
    parts = registers.reshape(BANDS, ROWS).astype(_M)
    out = np.arange(BANDS, dtype=_M)
    for k in range(ROWS):
        out = _mix(out * _M(0x9E3779B97F4A7C15) + parts[:, k])
    return out.view(np.int64)


def explode_bands(sketches: DataFrame) -> DataFrame:
    """rep, band: a row for each band of registers, dealt by band."""

    def explode(batches):
        let_go()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                values = [band_values(r) for r in from_bytes(part["registers"].to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part["rep"].to_numpy(), BANDS)), pa.array(np.concatenate(values))], names=["rep", "band"])

    return sketches.select("rep", "registers").mapInArrow(explode, "rep long, band long").repartition("band")


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of the greatest likelihood, for rows of registers and set sizes."""
    above, below = (left > right).sum(axis=1), (left < right).sum(axis=1)
    u, v = n_left / (n_left + n_right), n_right / (n_left + n_right)
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)[:, None]

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    more, less = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    fit = above[:, None] * np.log(more) + below[:, None] * np.log(less) + (REGISTERS - above - below)[:, None] * np.log(np.clip(1 - more - less, 1e-12, 1))
    return j[np.arange(len(j)), fit.argmax(axis=1)]


def sketch_texts(rows: DataFrame, size: int) -> DataFrame:
    """doc_id, raw (a hash of the text), digest (of the words in order), n_shingles, registers for each row of rows(doc_id, text)."""

    def sketch(batches):
        let_go()
        known: dict[str, int] = {}
        for batch in batches:
            for piece in text_slices(batch, "text"):
                out = []
                for doc_id, raw, text in zip(piece["doc_id"].to_pylist(), piece["raw"].to_pylist(), piece["text"].to_pylist(), strict=True):
                    tokens = words(text)
                    digest = hashlib.md5(" ".join(tokens).encode("utf-8", "surrogatepass")).digest()
                    hashes = np.fromiter(map(known.__getitem__, _learn(tokens, known)), _M, len(tokens))
                    elements = shingle_hashes(hashes, size)
                    out.append((doc_id, raw, digest, len(elements), to_bytes(set_sketch(elements))))
                types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "raw", "digest", "n_shingles", "registers"])
                if len(known) > 400_000:
                    known.clear()

    return rows.mapInArrow(sketch, "doc_id long, raw long, digest binary, n_shingles long, registers binary")


def _learn(tokens: list[str], known: dict[str, int]) -> list[str]:
    import xxhash

    for w in tokens:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return tokens


def _estimated(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs(u, v) whose estimate is at `least` at least."""
    one = lambda c: sketches.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))

    def judge(batches):
        let_go()
        for batch in batches:
            if batch.num_rows:
                a, b = (from_bytes(batch[c].to_pylist()) for c in ("r_u", "r_v"))
                near = estimate(a, b, *(batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("n_u", "n_v"))) >= least
                yield pa.RecordBatch.from_arrays([batch["u"].filter(pa.array(near)), batch["v"].filter(pa.array(near))], names=["u", "v"])

    return pairs.join(one("u"), "u").join(one("v"), "v").mapInArrow(judge, "u long, v long")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """The pairs(u, v) that are links on their whole sets: 100 * common >= threshold * all."""

    def judge(batches):
        let_go()
        for batch in batches:
            keep = []
            for a, b in zip(batch["t_u"].to_pylist(), batch["t_v"].to_pylist(), strict=True):
                x, y = shingles(words(a), size), shingles(words(b), size)
                common = len(x & y)
                keep.append(100 * common >= threshold * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(keep, pa.bool_())) for c in ("u", "v")], names=["u", "v"])

    one = lambda c: texts.select(F.col("rep").alias(c), F.col("text").alias(f"t_{c}"))
    return pairs.join(one("u"), "u").join(one("v"), "v").mapInArrow(judge, "u long, v long")


#: Texts of one shingle that one key of the prefix filter's join holds, about.
_SALTED = 2048


def prefix_pairs(texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """u, v of texts(rep, text, component) in different components whose shingle sets may reach the threshold.

    Sets are ordered by how many texts hold a shingle, rarest first. Two sets that share `need` shingles share one of the first
    n - need + 1 of each; n and need depend on both sizes, so each pair is held to its own places.
    """

    def explode(batches):
        let_go()
        import xxhash

        for batch in batches:
            for piece in text_slices(batch, "text", 1 << 20):
                for rep, component, text in zip(piece["rep"].to_pylist(), piece["component"].to_pylist(), piece["text"].to_pylist(), strict=True):
                    hashes = shingle_hashes(np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words(text)], _M), size).view(np.int64)
                    n, own = len(hashes), xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) >> 1
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, x, np.int64)) for x in (rep, own, component, n)), pa.array(hashes)], names=["rep", "own", "component", "n", "h"])

    rows = materialise(texts.select("rep", "component", "text").mapInArrow(explode, "rep long, own long, component long, n long, h long"), "shingles")
    counts = rows.groupBy("h").agg(F.count("*").alias("texts"))
    place = F.row_number().over(Window.partitionBy("rep", "own").orderBy("texts", "h")) - 1
    first = rows.join(counts, "h").withColumn("place", place).where((F.col("texts") > 1) & (F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold / 100)))
    first = materialise(first.select("rep", "component", "n", "h", "place"), "prefixes")
    # Of each shingle's texts those of its largest component are not compared with each other, only with the rest.
    sizes = first.groupBy("h", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("h").agg(F.max(F.struct("k", "component")).alias("m"), F.count("*").alias("components"), F.ceil(F.sum("k") / _SALTED).cast("int").alias("salts")).where("components > 1")
    # A shingle that very many texts hold is dealt to several keys: each text to one of them, and those that it is compared with to all.
    listed = first.join(main.select("h", F.col("m.component").alias("main"), "salts"), "h")
    rest = listed.where("component <> main").withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("main", "salts")
    other = listed.select("h", F.pmod(F.xxhash64("rep"), "salts").cast("int").alias("salt"), *[F.col(c).alias(f"{c}_v") for c in ("rep", "component", "n", "place")])
    need = F.ceil((F.col("n") + F.col("n_v")) * threshold / (100 + threshold))
    met = (F.col("component") != F.col("component_v")) & (F.col("place") <= F.col("n") - need) & (F.col("place_v") <= F.col("n_v") - need)
    both = rest.join(other, ["h", "salt"]).where(met)
    return both.select(F.least("rep", "rep_v").alias("u"), F.greatest("rep", "rep_v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text).

    Texts are linked whose sets of `size`-word shingles have 100 * intersection >= threshold * union; component_id is the smallest
    doc_id that links reach. Texts without words (null, empty, blank) have no shingles and link with nothing, as do rows without a doc_id
    (component_id null, kept true). Repeated rows each come back; rows that share a doc_id are one document, linked through any of its texts. Columns
    other than doc_id and text are not read; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw"), "text")
    sketched = materialise(sketch_texts(rows, size), "sketches")
    live = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = live.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    member = materialise(live.select("doc_id", "raw", "digest").join(classes, "digest"), "classes")
    own = (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("rep"))
    first = live.join(classes.withColumnRenamed("digest", "d"), own).dropDuplicates(["digest"]).select("rep", "n_shingles", "registers")
    sketches = materialise(first, "representatives")

    bands = explode_bands(sketches)
    buckets = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("centre")).where("n > 1")
    held = materialise(bands.join(buckets, "band"), "buckets")
    few = held.where(F.col("n") <= PAIRS_TO)
    lists = few.groupBy("band").agg(F.sort_array(F.collect_list("rep")).alias("m"))  # PAIRS_TO at most
    pairs = lists.select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x AS u, y AS v))))")).alias("p")).select("p.u", "p.v")
    stars = held.where((F.col("n") > PAIRS_TO) & (F.col("rep") != F.col("centre"))).select(F.col("centre").alias("u"), F.col("rep").alias("v"))
    pairs = materialise(pairs.union(stars).where("u <> v").groupBy("u", "v").agg(F.count("*").alias("shared")), "candidates")

    near = held.select(F.col("rep").alias("doc_id")).distinct()
    # one text of each representative and class; its row is known by doc_id and raw hash
    wanted = member.where("doc_id = rep").groupBy("digest", "doc_id").agg(F.min("raw").alias("raw")).join(near, "doc_id").select("doc_id", "raw").distinct()
    texts = rows.join(wanted, ["doc_id", "raw"]).select(F.col("doc_id").alias("rep"), "text")
    texts = materialise(texts.dropDuplicates(["rep", "text"]), "texts")

    shared_id = member.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("high")).where("u <> high")
    links = materialise(member.join(shared_id, "doc_id").where("rep <> u").select("u", F.col("rep").alias("v")).distinct(), "shared-ids")

    def judged(some: DataFrame) -> DataFrame:
        likely = materialise(_estimated(some.select("u", "v"), sketches, threshold / 100 - MARGIN), "likely")
        return materialise(_verified(likely, texts, size, threshold), "links")

    # First each text's best candidate alone; what is then still apart, by all its candidates.
    best = pairs.groupBy("v").agg(F.max(F.struct("shared", "u")).alias("b")).select(F.col("b.u").alias("u"), "v")
    links = links.unionByName(judged(best))
    found = components(links)

    def apart(some: DataFrame, labels: DataFrame) -> DataFrame:
        label = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
        both = some.join(label("u"), "u", "left").join(label("v"), "v", "left")
        return both.where(F.coalesce("c_u", "u") != F.coalesce("c_v", "v")).select("u", "v")

    more = judged(apart(pairs.join(best, ["u", "v"], "left_anti"), found))
    if not more.isEmpty():
        links = links.unionByName(more)
        found = components(links)

    # Large buckets whose members are not all connected: every pair that may still be a link, by an exact prefix filter.
    labels = found.select(F.col("node").alias("rep"), "component")
    placed = held.where(F.col("n") > PAIRS_TO).join(labels, "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("band")
    some = materialise(placed.join(mixed, "band").select("rep", "component").distinct(), "mixed")
    if not some.isEmpty():
        more = judged(prefix_pairs(texts.join(some, "rep"), size, threshold).join(pairs.select("u", "v"), ["u", "v"], "left_anti"))
        if not more.isEmpty():
            links = links.unionByName(more)
            found = components(links)
    found = materialise(found, "components")
    of_class = member.select("digest", "rep").distinct().join(found, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    result = sketched.select("doc_id", "digest", "n_shingles").join(of_class, "digest", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
