"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Hashable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.sources.sinks import shared_path

#: A-Z and a-z for ``translate``: lower-casing that leaves all other characters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(UPPER, LOWER)


def lower_ascii(text: str) -> str:
    return text.translate(_ASCII_LOWER)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share."""
    return shared_path(spark, label)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df to a table in the shared folder and read it back, so a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]):
    """What a Python worker keeps from task to task, such as a tokenizer and its cache. One thing at a time: Spark uses workers again, stage after stage."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Drop what tasks of an earlier stage keep in this Python worker, and give its memory back; a stage that keeps nothing itself begins its tasks with it."""
    if _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every system's C library can
            ctypes.CDLL(None).malloc_trim(0)


#: The bytes of whole texts that an Arrow batch holds, about (one row at least).
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Have the session hand whole texts to Python in batches of BATCH_BYTES at most, by bytes and not by rows alone; a smaller limit of its own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name)
    if not held.isdecimal() or int(held) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return spark


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Cut a record batch so that each slice holds about `limit` bytes of text at most (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
