"""Edit and view events, in batch; streams.py has their streaming forms. A log has doc, ts, event_id (a tie-break), op, and more."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["ts", "event_id"]


def recent(events: DataFrame, owner: str, identity: str, k: int = 10) -> DataFrame:
    """The k identities an owner used last, each once, the newest first."""
    last = events.groupBy(owner, identity).agg(F.max(F.struct(*ORDER)).alias("at"))
    n = F.row_number().over(Window.partitionBy(owner).orderBy(F.col("at").desc(), identity))
    return last.withColumn("nth", n).where(F.col("nth") <= k).select(owner, identity, "nth")


def latest_state(events: DataFrame) -> DataFrame:
    """doc, op, value of the last event: later ones overwrite."""
    return events.groupBy("doc").agg(F.max(F.struct(*ORDER, "op", "value")).alias("s")).select("doc", "s.op", "s.value")


def prune_missing(recent_rows: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    return recent_rows.join(sources.select(key).distinct(), key, "left_semi")


def changed_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc, change: changed where the signature(stamp, size) differs, gone, or new."""
    side = lambda df, n: df.select("doc", F.struct("stamp", "size").alias(f"s{n}"))
    both = side(a, 1).join(side(b, 2), "doc", "full_outer").where(~F.col("s1").eqNullSafe(F.col("s2")))
    return both.select("doc", F.when(F.col("s2").isNull(), "gone").when(F.col("s1").isNull(), "new").otherwise("changed").alias("change"))


def debounce(events: DataFrame, seconds: int) -> DataFrame:
    """The last event of each burst: those that no other of the document follows within the gap."""
    after = F.lead("ts").over(Window.partitionBy("doc").orderBy(*ORDER))
    gap = F.unix_micros(after) - F.unix_micros("ts")
    return events.where(F.lit(True)).withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") >= seconds * 1_000_000)).drop("gap")


def coalesce_repeats(log: DataFrame) -> DataFrame:
    """doc, first_id, op, n, delta: a tap starts a step, held-key repeats of the same op go on with it."""
    w = Window.partitionBy("doc").orderBy(*ORDER)
    new = ~F.col("auto_repeat") | ~F.col("op").eqNullSafe(F.lag("op").over(w))
    rows = log.withColumn("step", F.sum(new.cast("int")).over(w))
    return rows.groupBy("doc", "step").agg(F.min("event_id").alias("first_id"), F.first("op").alias("op"), F.count("*").alias("n"), F.sum("delta").alias("delta")).drop("step")


def macro_steps(log: DataFrame) -> DataFrame:
    """doc, macro_id, n, ops: commands of one macro are one step."""
    return log.groupBy("doc", "macro_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("op")), ",").alias("ops"))


def undo_levels(log: DataFrame) -> DataFrame:
    """The log with depth, how many edits are live after each event, and level, which of them an edit is (null for undo and redo).

    An edit lies on top of those that are live and drops what could be redone; undo takes the top one away, redo puts it back. The events are sorted
    within partitions by document and read in one pass that holds two numbers a document, so a long history needs no memory.
    """

    def scan(batches):
        doc, depth, top = object(), 0, 0
        for batch in batches:
            depths, levels = [], []
            for now, op in zip(batch["doc"].to_pylist(), batch["op"].to_pylist(), strict=True):
                if now != doc:
                    doc, depth, top = now, 0, 0
                level = None
                if op == "undo":
                    depth = max(depth - 1, 0)
                elif op == "redo":
                    depth = min(depth + 1, top)
                else:
                    depth = top = level = depth + 1
                depths.append(depth)
                levels.append(level)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(depths, pa.int64()), pa.array(levels, pa.int64())], names=["doc", "event_id", "ts", "op", "depth", "level"])

    rows = log.select("doc", "event_id", "ts", "op").repartition("doc").sortWithinPartitions("doc", *ORDER)
    return rows.mapInArrow(scan, "doc long, event_id long, ts timestamp, op string, depth long, level long")


def effective_log(log: DataFrame) -> DataFrame:
    """The edits that are live after all undo and redo events of a document: of each level up to the last depth the last edit that lay there."""
    rows = undo_levels(log)
    at = F.struct(*ORDER, "op", "depth")
    last = rows.groupBy("doc").agg(F.max(at)["depth"].alias("last"))
    top = rows.where("level IS NOT NULL").groupBy("doc", "level").agg(F.max(at).alias("e"))
    return top.join(last, "doc").where("level <= last").select("doc", "e.event_id", "e.ts", "e.op")


def as_of(log: DataFrame, ts: str) -> DataFrame:
    """The edits that were live at a time."""
    return effective_log(log.where(F.col("ts") <= F.lit(ts).cast("timestamp")))


def open_once(events: DataFrame) -> DataFrame:
    """The first event of each document: one window an identity."""
    return events.groupBy("doc").agg(F.min(F.struct(*ORDER)).alias("a")).select("doc", F.col("a.event_id").alias("event_id"))


def dirty_docs(log: DataFrame, save: str) -> DataFrame:
    """Documents whose last edit is after their last save, or that were never saved."""
    at = F.struct(*ORDER)
    rows = log.groupBy("doc").agg(F.max(F.when(F.col("op") == save, at)).alias("saved"), F.max(F.when(F.col("op") != save, at)).alias("edited"))
    return rows.where(F.col("edited").isNotNull() & (F.col("saved").isNull() | (F.col("edited") > F.col("saved")))).select("doc")


def invalidate_results(searches: DataFrame, edits: DataFrame, structural: list[str]) -> DataFrame:
    """event_id of each search and whether a later structural edit of its document voids it."""
    last = edits.where(F.col("op").isin(structural)).groupBy("doc").agg(F.max(F.struct(*ORDER)).alias("edited"))
    rows = searches.join(last, "doc", "left")
    return rows.select("doc", "event_id", F.coalesce(F.col("edited") > F.struct(*ORDER), F.lit(False)).alias("void"))
