"""Streams against their batch forms, over several batches of shuffled files."""

import uuid

import pytest
from pyspark.sql import functions as F

from quire.sources.sinks import read_committed
from quire.streaming import history as H
from quire.streaming import streams as St

PATH = "/root/testdata/sf0.001/events.parquet"
LAST = -1  # the document of an event far behind all others, which lets the watermark pass them


def renamed(raw):
    return raw.select(F.col("user_id").alias("doc"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("op"), "value")


def batch(spark):
    return renamed(spark.read.parquet(PATH))


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Six files: five of them a shuffle of all events, which one watermark covers; then one with a single late event. One file is a batch."""
    path = str(tmp_path_factory.mktemp("events") / "events")
    raw = spark.read.parquet(PATH).limit(2000)
    squeezed = (F.lit(1_600_000_000_000_000) + (F.col("event_id") * 7919 % 2000) * 250_000).alias("us")  # 500 seconds, shorter than the watermark's delay
    rows = raw.withColumn("ts", F.timestamp_micros(squeezed).cast(raw.schema["ts"].dataType))
    for k in range(5):
        rows.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == k).coalesce(1).write.mode("append").parquet(path)
    end = rows.limit(1).withColumns({"user_id": F.lit(LAST).cast(raw.schema["user_id"].dataType), "event_id": F.lit(1 << 40).cast(raw.schema["event_id"].dataType), "ts": F.timestamp_micros(F.lit(1_700_000_000_000_000)).cast(raw.schema["ts"].dataType)})
    end.coalesce(1).write.mode("append").parquet(path)
    return path, renamed(rows)


def stream(spark, files):
    return St.read_events(spark, files[0], 1)


def drain(df, mode="append"):
    name = f"t{uuid.uuid4().hex}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert len([p for p in q.recentProgress if p.numInputRows]) >= 6
    return df.sparkSession.table(name)


def history():
    return F.when(F.col("event_id") % 4 == 1, "undo").when(F.col("event_id") % 7 == 2, "redo").otherwise(F.col("op"))


def test_live_edits_equal_the_batch_rows(spark, files):
    got = St.live_edits(drain(St.effective_log_stream(stream(spark, files).withColumn("op", history())))).where(f"doc <> {LAST}")
    want = H.effective_log(files[1].withColumn("op", history())).select("doc", "event_id", "op")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_steps_equal_the_batch_rows_and_idle_keys_leave(spark, files):
    log = lambda e: e.withColumns({"auto_repeat": F.col("event_id") % 2 == 0, "delta": F.col("event_id"), "op": F.when(F.col("event_id") % 9 < 7, "a").otherwise("b")})
    name = f"t{uuid.uuid4().hex}"
    q = St.coalesce_repeats_stream(log(stream(spark, files)), idle=3600).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = spark.table(name).where(f"doc <> {LAST}")
    want = H.coalesce_repeats(log(files[1])).select("doc", "first_id", "op", "n", "delta")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_one_row_a_document_for_ever(spark, files):
    got = drain(St.open_once_stream(stream(spark, files))).where(f"doc <> {LAST}").select("doc", "event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, H.open_once(files[1]).collect()))


def shots(spark, tmp_path, rows):
    """A file for each row of (doc, seconds, stamp)."""
    path = str(tmp_path / "shots")
    for i, (doc, at, stamp) in enumerate(rows):
        spark.createDataFrame([(doc, i, at, stamp)], "doc long, event_id long, t long, stamp long").select("doc", "event_id", F.timestamp_seconds("t").alias("ts"), "stamp", F.lit(1).cast("long").alias("size")).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_changed_and_gone(spark, tmp_path):
    rows = [(1, 1000, 5), (1, 1200, 6), (1, 1100, 5), (2, 1300, 1), (1, 9000, 6), (2, 30000, 1), (3, 90000, 0)]
    name = f"t{uuid.uuid4().hex}"
    q = St.changed_sources_stream(shots(spark, tmp_path, rows), gone_after=5000).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = sorted((r.doc, r["at"] // 1_000_000, r.change) for r in spark.table(name).collect())
    assert got == [(1, 1000, "new"), (1, 1200, "changed"), (1, 1200, "gone"), (1, 9000, "gone"), (1, 9000, "new"), (2, 1300, "gone"), (2, 1300, "new"), (2, 30000, "gone"), (2, 30000, "new")]
    left = sum(s.numRowsTotal for s in q.lastProgress.stateOperators)
    assert left <= 4  # document 3 alone: its waiting row, timer and their index


def test_late_rows_are_counted(spark, tmp_path):
    rows = [(1, 10_000, 1), (1, 20_000, 2), (1, 30_000, 3), (1, 5, 9), (2, 6, 9), (1, 40_000, 4), (1, 7, 9), (1, 39_999, 5)]
    late, name = St.LateRows(), f"t{uuid.uuid4().hex}"
    spark.streams.addListener(late)
    try:
        q = St.changed_sources_stream(shots(spark, tmp_path, rows)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert late.of[name] == 3 == sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators)
    finally:
        spark.streams.removeListener(late)


def test_latest_state(spark, files):
    got = drain(St.latest_state_stream(stream(spark, files)), "complete").where(f"doc <> {LAST}")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in H.latest_state(files[1]).collect()}


def test_debounce(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.read.parquet(PATH).repartitionByRange(4, "ts").write.parquet(path)
    name = f"t{uuid.uuid4().hex}"
    St.debounce_stream(St.read_events(spark, path, 10), 3600).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(240)
    got, want = {r.event_id for r in spark.table(name).collect()}, {r.event_id for r in H.debounce(batch(spark), 3600).collect()}
    assert got <= want and len(got) >= len(want) - 30  # bursts that the last watermark has not passed are still open


def test_upserts_equal_the_batch_forms(spark, files, tmp_path):
    St.upsert_latest(stream(spark, files), str(tmp_path / "latest"), str(tmp_path / "c1"), buckets=4).awaitTermination(240)
    got = read_committed(spark, str(tmp_path / "latest")).where(f"doc <> {LAST}")
    assert {(r.doc, r.op, r.value) for r in got.collect()} == {tuple(r) for r in H.latest_state(files[1]).collect()}
    St.recent_upserts(stream(spark, files).where(f"doc <> {LAST}"), "op", "doc", str(tmp_path / "recent"), str(tmp_path / "c2"), k=3, buckets=2).awaitTermination(240)
    table = read_committed(spark, str(tmp_path / "recent"))
    assert {tuple(r) for r in St.recent_of(table, "op", "doc").collect()} == {tuple(r) for r in H.recent(files[1], "op", "doc", 3).collect()}
    assert table.groupBy("op").count().where("count > 3").isEmpty()


def test_undo_and_redo(spark):
    ops = ["a", "b", "undo", "redo", "undo", "c", "redo", "undo", "undo", "undo", "d"]
    log = spark.createDataFrame([(1, i, i, op) for i, op in enumerate(ops)], "doc long, event_id long, t long, op string").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r.op for r in H.effective_log(log).collect()) == ["d"]
    assert sorted(r.op for r in H.as_of(log, "1970-01-01 00:00:05").collect()) == ["a", "c"]
