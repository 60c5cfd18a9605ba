"""Benchmark decontamination: pigeonhole edit matching.

An item may be met with at most `budget` edits. Cut into budget + 1 pieces, one piece of it must then stand unedited, so an
automaton of all pieces lists every candidate place. Places are verified by growing parts: where m neighbouring pieces stand with less than m
edits, one of the part's halves does too, so a place goes on from a piece to two, four, ... pieces only while the part around it stands
within its own budget, and Myers' bit-parallel distance decides each part and at last the whole item. No place within the budget is lost.
Texts are compared as lower-case words with single blanks between them, so marks and line breaks don't hide a copy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, materialise, text_slices

_WORDS = re.compile(r"[^\W_]+")
#: Code points of one block of items: what a task holds of the benchmark at a time.
BLOCK_CHARS = 4 << 20


def plain(text: str | None) -> str:
    return " ".join(_WORDS.findall((text or "").lower()))


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best match of the whole pattern inside text (the first of equals), None beyond `most`."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    plus, minus, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        if score <= most and (best is None or score < best[0]):
            best = score, j + 1
    return best


class ItemBlock:
    """The pieces of some items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], share: float, shortest: int = 1):
        import ahocorasick

        self.items, self.automaton = [], ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = plain(text)
            if not text:
                continue
            budget = max(0, min(int(share * len(text)), len(text) // shortest - 1))
            k, n = len(self.items), budget + 1
            self.items.append((item_id, text, budget))
            cuts = [len(text) * i // n for i in range(n + 1)]
            for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                at.setdefault(text[a:b], []).append((k, j))
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def _grown(self, text: str, k: int, j: int, at: int, tried: dict[tuple[int, int, int, int], bool]) -> int | None:
        """The least edits of item k around its piece j, which stands at `at`; None if a part is beyond its budget or was tried before."""
        _, item, budget = self.items[k]
        n, size = budget + 1, len(item)
        origin, width, last = at - size * j // n, 1, (j, j + 1)
        while True:
            low = j // width * width
            part = low, min(low + width, n)
            whole = part == (0, n)
            width *= 2
            if part == last and not whole:
                continue
            last = part
            a, b, most = size * part[0] // n, size * part[1] // n, part[1] - part[0] - 1
            if most == 1 and not whole:
                # one edit at most beside an unedited piece: one half of the other piece stands where it must, or the other half within a place
                c = size * (part[0] + 1) // n
                if part[0] == j:
                    h = (c + b) // 2
                    if not (text.startswith(item[c:h], origin + c) or text.find(item[h:b], max(0, origin + h - 1), origin + b + 1) >= 0):
                        return None
                else:
                    h = (a + c) // 2
                    if not ((origin + h >= 0 and text.startswith(item[h:c], origin + h)) or text.find(item[a:h], max(0, origin + a - 1), max(0, origin + h + 1)) >= 0):
                        return None
            key = (k, *part, origin)
            if whole and key in tried:
                return None
            if key not in tried:
                got = myers(item[a:b], text[max(0, origin + a - most) : origin + b + most], most)
                tried[key] = got is not None
                if whole:
                    return None if got is None else got[0]
            if not tried[key]:
                return None

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        """(item_id, least edits) of each item in a text that `plain` has made."""
        if not len(self.automaton):
            return
        best: dict[int, int] = {}
        tried: dict[tuple[int, int, int, int], bool] = {}
        for end, (size, places) in self.automaton.iter(text):
            for k, j in places:
                if best.get(k) == 0:
                    continue
                got = self._grown(text, k, j, end + 1 - size, tried)
                if got is not None and got < best.get(k, 1 << 60):
                    best[k] = got
        for k, edits in best.items():
            yield self.items[k][0], edits


def _blocks(items: DataFrame) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items in blocks of about BLOCK_CHARS, and whether another one follows; one block at least."""
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_CHARS))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield [(r.item_id, r.text) for r in part.select("item_id", "text").collect()], block + 1 < blocks


def find_items(docs: DataFrame, items: DataFrame, share: float = 0.1, shortest: int = 1) -> DataFrame:
    """doc_id, hash, item_id, n_edits, item_chars: the items(item_id, text) that stand in docs(doc_id, hash, text), each once a text.

    An item's budget is `share` of its length, rounded down; only a `shortest` above 1 lowers it, so that no piece is shorter. Items are
    read in blocks of bounded size, one job each, and a block's result is written before the next is read, so the benchmark
    may grow; a single item longer than a block is a block of its own. Null or wordless items and texts meet nothing.
    """
    rows, out = docs.select("doc_id", "hash", "text"), None
    for held, more in _blocks(items):

        def scan(batches, held=held):
            let_go()
            index = ItemBlock(held, share, shortest)
            for batch in batches:
                for piece in text_slices(batch, "text"):
                    found = []
                    for doc_id, hash_, text in zip(piece["doc_id"].to_pylist(), piece["hash"].to_pylist(), piece["text"].to_pylist(), strict=True):
                        found += [(doc_id, hash_, item, edits) for item, edits in index.find(plain(text))]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "hash", "item_id", "n_edits"])

        got = rows.mapInArrow(scan, "doc_id long, hash long, item_id long, n_edits int")
        if more:
            got = materialise(got, "found-items")
        out = got if out is None else out.unionByName(got)
    return out


def contaminated(docs: DataFrame, items: DataFrame, share: float = 0.1, shortest: int = 1) -> DataFrame:
    """doc_id, item_id, n_edits for each row of docs(doc_id, text) and each item that it holds; clean rows give none.

    Repeated rows each give their own; null texts are clean; null doc_ids are kept; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    return find_items(rows, items, share, shortest).drop("hash")


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = 0.1, shortest: int = 1) -> DataFrame:
    """The rows of docs(text, ...) that hold no item, with all their columns; found as in find_items, without a shuffle of the rows."""
    for held, more in _blocks(items):

        def clean(batches, held=held):
            let_go()
            index = ItemBlock(held, share, shortest)
            for batch in batches:
                for piece in text_slices(batch, "text"):
                    yield piece.filter(pa.array([next(index.find(plain(t)), None) is None for t in piece["text"].to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
        if more:
            docs = materialise(docs, "without-items")
    return docs
