"""Token-id files: a concatenated id array whose document boundaries and document ids are Elias-Fano encoded.

A segment is a byte string: header, the Elias-Fano list of the documents' ends, the list of their ids, then the token ids
(2 bytes each where the vocabulary allows it, else 4). Spark's own writer stores segments as rows of a Parquet table, so a
retried task replaces its output whole and any store that Spark reaches will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices
from .encoding import default_tokenizer, encoder

_BLOCK = 512  # bits of the upper part for which one count is kept


class EliasFano:
    """A non-decreasing list of integers in [0, 2**63): low bits packed, high parts in unary, with counts for select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.add.reduceat(np.unpackbits(high), np.arange(0, len(high) * 8, _BLOCK)) if len(high) else np.zeros(0)
        self.before = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        shifts = np.arange(low_bits)
        low = np.packbits(((values[:, None] >> shifts) & 1).astype(np.uint8).ravel())
        places = (values >> low_bits) + np.arange(n)
        bits = np.zeros(-(-(int(places[-1]) + 1) // 8) * 8, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low, np.packbits(bits))

    def _lower(self, i: int) -> int:
        bits = np.unpackbits(self.low[i * self.low_bits // 8 : -(-(i + 1) * self.low_bits // 8)])
        at = i * self.low_bits % 8
        return int(sum(int(b) << k for k, b in enumerate(bits[at : at + self.low_bits])))

    def __getitem__(self, i: int) -> int:
        """Select: the block by its count of ones before it, then the place inside the block."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.high[block * _BLOCK // 8 : (block + 1) * _BLOCK // 8]))
        place = block * _BLOCK + int(inside[i - self.before[block]])
        return ((place - i) << self.low_bits) | self._lower(i)

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.high)) - np.arange(self.n)
        bits = np.unpackbits(self.low)[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (high << self.low_bits) | (bits << np.arange(self.low_bits)).sum(axis=1, dtype=np.int64)

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b = struct.unpack_from("<QBQQ", raw, at)
        at += 25
        low, high = (np.frombuffer(raw, np.uint8, k, o) for k, o in ((a, at), (b, at + a)))
        return cls(n, low_bits, low, high), at + a + b


def pack_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment of documents in ascending doc_id order, null ids first."""
    known = [x for x in doc_ids if x is not None]
    base = known[0] if known else 0
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    # ids further apart than 2**63 don't fit one list; such a segment keeps them plain
    plain = bool(known) and known[-1] - base >= 1 << 63
    head = struct.pack("<4sBBqQQ", b"QTS1", 4 if wide else 2, plain, base, len(doc_ids) - len(known), len(ids))
    names = np.array(known, "<i8").tobytes() if plain else EliasFano.of(np.array([x - base for x in known], np.int64)).to_bytes()
    return head + EliasFano.of(np.cumsum(counts)).to_bytes() + names + ids.astype("<u4" if wide else "<u2").tobytes()


class Segment:
    """Reads a segment; document k's ids are ids[start(k):end(k)]."""

    def __init__(self, raw: bytes):
        magic, width, plain, base, nulls, n_ids = struct.unpack_from("<4sBBqQQ", raw)
        if magic != b"QTS1":
            raise ValueError("not a token segment")
        self.ends, at = EliasFano.from_bytes(raw, struct.calcsize("<4sBBqQQ"))
        if plain:
            k = self.ends.n - nulls
            names, at = np.frombuffer(raw, "<i8", k, at).tolist(), at + 8 * k
        else:
            listed, at = EliasFano.from_bytes(raw, at)
            names = (listed.all() + base).tolist()
        self.doc_ids = [None] * nulls + names
        self.ids = np.frombuffer(raw, "<u4" if width == 4 else "<u2", n_ids, at)

    def start(self, k: int) -> int:
        return self.ends[k - 1] if k else 0

    def end(self, k: int) -> int:
        return self.ends[k]

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.start(k) : self.end(k)].astype("<u4")


_SEGMENTS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("payload", T.BinaryType())])


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, segment_ids: int = 1 << 19) -> None:
    """Encode docs(doc_id, text) and write their ids to `path` in ascending doc_id order, end_id after each document.

    Null text counts as empty; null doc_ids come first; rows with equal doc_id are all kept, in the order of a hash of
    their text, by which a doc_id that very many rows share is also dealt over several partitions. An empty table gives an empty file set.
    Columns other than doc_id and text are not read. A segment ends after `segment_ids` ids, so a task holds one segment and one batch.
    """
    tokenizer = tokenizer or default_tokenizer()

    def segments(batches):
        part, started = TaskContext.get().partitionId(), 0
        names, counts, ids, held = [], [], [], 0

        def flush():
            nonlocal started, names, counts, ids, held
            raw = pack_segment(names, np.concatenate(counts), np.concatenate(ids))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.int64()) for x in (started, len(names), held)), pa.array([raw], pa.binary())], names=_SEGMENTS.names)
            started, names, counts, ids, held = started + held, [], [], [], 0
            return row

        for batch in batches:
            for piece in text_slices(batch, "text", 4 << 20):
                got, sizes = encoder(tokenizer).encode(piece["text"])
                sizes = sizes + 1
                whole = np.full(int(sizes.sum()), end_id, "<u4")
                keep = np.ones(len(whole), bool)
                keep[np.cumsum(sizes) - 1] = False
                whole[keep] = got
                names += piece["doc_id"].to_pylist()
                counts.append(sizes)
                ids.append(whole)
                held += len(whole)
                if held >= segment_ids:
                    yield flush()
        if names:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(segments, _SEGMENTS).write.parquet(path)


def _read(spark: SparkSession, path: str, schema: str, value: Callable[[memoryview], object]) -> DataFrame:
    """doc_id, start, n_tokens and a value of each document's ids. Each end is a select on its segment's list: no table of offsets is made."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64() if schema.endswith("long") else pa.binary())
    names = [part.split()[0] for part in schema.split(", ")]

    def documents(batches):
        for batch in batches:
            for raw, first in zip(batch["payload"], batch["start"].to_pylist(), strict=True):
                segment, rows, start = Segment(raw.as_py()), [], 0
                ids = memoryview(segment.ids.astype("<u4").tobytes())
                for k, doc_id in enumerate(segment.doc_ids):
                    end = segment.end(k)
                    rows.append((doc_id, first + start, end - start, value(ids[4 * start : 4 * end])))
                    start = end
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return _with_starts(spark, path).mapInArrow(documents, schema)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a document: doc_id, start (ids of all documents before it), n_tokens and ids (little-endian, 4 bytes each)."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids binary", bytes)


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """As read_token_files, with the unsigned crc32 of each document's ids in their place."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", zlib.crc32)


def _with_starts(spark: SparkSession, path: str) -> DataFrame:
    """Segments with their first id's place among all ids. One row a written partition is summed and broadcast, never one a document."""
    from pyspark.sql import Window

    table = spark.read.schema(_SEGMENTS).parquet(path)
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return table.join(F.broadcast(parts), "part").select((F.col("before") + F.col("part_start")).alias("start"), "payload")
