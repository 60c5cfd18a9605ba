"""Structured Streaming forms of the history operators.

Events reach a stream in any order. The operators that depend on order keep what has come for a key until the watermark has passed it, and take it in order of
time then; so their rows equal the batch forms' over what the watermark has passed, whatever the files' order. A key that stays idle leaves the state. Events
later than the watermark are dropped, and counted (`LateRows`).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WATERMARK = "10 minutes"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of event files with the schema of those that are there."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return events.select(F.col("user_id").alias("doc"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("op"), "value")


class LateRows(StreamingQueryListener):
    """Counts the rows that streams drop as later than their watermark: `spark.streams.addListener(late)`; late.of[query name] is the count so far.

    Exact for the operators here that take rows one by one (in order, once, recent); a windowed aggregation counts rows of its partial sums.
    """

    def __init__(self) -> None:
        self.of: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.of.setdefault(event.name, 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.of[p.name] = self.of.get(p.name, 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class InOrder(StatefulProcessor):
    """Takes a key's rows in order of (at, event_id), at in microseconds, once the watermark has passed them; a timer releases them where no new row comes.

    A subclass says what a row does (`take`) and what is left to say when a key has been idle for `idle` seconds of event time (`finish`), after which its state is gone.
    idle of None keeps it.
    """

    columns = "at long, event_id long, op string"  # what is kept of a row, at and event_id first

    def __init__(self, idle: int | None = None):
        self.idle = None if idle is None else idle * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        self.last = handle.getValueState("last", "at long")
        self.start()

    def start(self) -> None:
        """Make the states of a subclass."""

    def take(self, key: tuple, row: tuple) -> Iterator[Row]:
        raise NotImplementedError

    def finish(self, key: tuple) -> Iterator[Row]:
        yield from ()

    def clear(self) -> None:
        """Clear the states of a subclass."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = [c.split()[0] for c in self.columns.split(", ")]
        self.waiting.appendList([tuple(r[n] for n in names) for r in rows])
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def _release(self, key, watermark: int) -> Iterator[Row]:
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        ready = [r for r in rows if r[0] // 1000 < watermark]
        for r in ready:
            if self.idle is not None and self.last.exists() and r[0] // 1000 - self.last.get()[0] // 1000 > self.idle:
                yield from self._end(key)
            yield from self.take(key, r)
            self.last.update((r[0],))
        rest = rows[len(ready) :]
        self.waiting.put(rest) if rest else self.waiting.clear()
        due = rest[0][0] // 1000 + 1 if rest else None
        if not rest and self.idle is not None and self.last.exists():
            due = self.last.get()[0] // 1000 + self.idle + 1
            if due <= watermark:
                yield from self._end(key)
                due = None
        for t in list(self.handle.listTimers()):
            if t != due:
                self.handle.deleteTimer(t)
        if due is not None:
            self.handle.registerTimer(max(due, watermark + 1))

    def _end(self, key) -> Iterator[Row]:
        yield from self.finish(key)
        self.last.clear()
        self.clear()

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, processor: InOrder, schema: str) -> DataFrame:
    """rows(doc, ts, event_id, ...) through a processor, by doc. Lists and timers need the RocksDB state store, which is set for the session."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    placed = rows.withWatermark("ts", WATERMARK).withColumn("at", F.unix_micros("ts"))
    return placed.groupBy("doc").transformWithState(processor, schema, "Append", "EventTime")


class _UndoStack(InOrder):
    """The undo stack as a map from level to edit: how many are live, and up to where redo goes."""

    def start(self) -> None:
        self.depth = self.handle.getValueState("depth", "depth long, top long")
        self.edits = self.handle.getMapState("edits", "level long", "event_id long, op string")

    def take(self, key, row) -> Iterator[Row]:
        depth, top = self.depth.get() if self.depth.exists() else (0, 0)
        _, event_id, op = row
        if op == "undo":
            if depth:
                yield Row(doc=key[0], event_id=self.edits.getValue((depth,))[0], op=self.edits.getValue((depth,))[1], change=-1, at=row[0])
            depth = max(depth - 1, 0)
        elif op == "redo":
            if depth < top:
                depth += 1
                yield Row(doc=key[0], event_id=self.edits.getValue((depth,))[0], op=self.edits.getValue((depth,))[1], change=1, at=row[0])
        else:
            for level in range(depth + 2, top + 1):
                self.edits.removeKey((level,))
            depth = top = depth + 1
            self.edits.updateValue((depth,), (event_id, op))
            yield Row(doc=key[0], event_id=event_id, op=op, change=1, at=row[0])
        self.depth.update((depth, top))

    def clear(self) -> None:
        self.depth.clear()
        self.edits.clear()


def effective_log_stream(events: DataFrame, idle: int | None = None) -> DataFrame:
    """doc, event_id, op, change, at: +1 when an edit comes alive (made, or redone), -1 when it is undone, in order of time; `live_edits` sums them up.

    idle: seconds after which a document's stack is dropped; its edits stand, and what comes then starts a new stack.
    """
    return _in_order(events, _UndoStack(idle), "doc long, event_id long, op string, change int, at long")


def live_edits(changes: DataFrame) -> DataFrame:
    """doc, event_id, op of the edits that are live after all changes."""
    return changes.groupBy("doc", "event_id", "op").agg(F.sum("change").alias("n")).where("n = 1").drop("n")


class _Steps(InOrder):
    columns = "at long, event_id long, op string, auto_repeat boolean, delta long"

    def start(self) -> None:
        self.open = self.handle.getValueState("open", "first_id long, op string, n long, delta long")

    def take(self, key, row) -> Iterator[Row]:
        _, event_id, op, auto_repeat, delta = row
        step = self.open.get() if self.open.exists() else None
        if step is not None and auto_repeat and step[1] == op:
            self.open.update((min(step[0], event_id), op, step[2] + 1, step[3] + delta))
            return
        yield from self.finish(key)
        self.open.update((event_id, op, 1, delta))

    def finish(self, key) -> Iterator[Row]:
        if self.open.exists():
            first_id, op, n, delta = self.open.get()
            yield Row(doc=key[0], first_id=first_id, op=op, n=n, delta=delta)

    def clear(self) -> None:
        self.open.clear()


def coalesce_repeats_stream(log: DataFrame, idle: int | None = None) -> DataFrame:
    """doc, first_id, op, n, delta of each step of log(doc, ts, event_id, op, auto_repeat, delta) once it is closed, by the next step or by idle seconds.

    A repeat that comes after the document was idle so long starts a step of its own, so idle is longer than any key is held.
    """
    return _in_order(log, _Steps(idle), "doc long, first_id long, op string, n long, delta long")


class _Signatures(InOrder):
    columns = "at long, event_id long, stamp long, size long"

    def start(self) -> None:
        self.seen = self.handle.getValueState("seen", "stamp long, size long")

    def take(self, key, row) -> Iterator[Row]:
        now, last = (row[2], row[3]), tuple(self.seen.get()) if self.seen.exists() else None
        if now != last:
            yield Row(doc=key[0], change="new" if last is None else "changed", at=row[0])
        self.seen.update(now)

    def finish(self, key) -> Iterator[Row]:
        yield Row(doc=key[0], change="gone", at=self.last.get()[0])

    def clear(self) -> None:
        self.seen.clear()


def changed_sources_stream(snapshots: DataFrame, gone_after: int | None = None) -> DataFrame:
    """doc, change, at of snapshots(doc, ts, event_id, stamp, size): new at the first signature of a document, changed when one differs from the last, gone when none
    has come for gone_after seconds (at: when it was seen last); one that comes back then is new."""
    return _in_order(snapshots, _Signatures(gone_after), "doc long, change string, at long")


class _First(InOrder):
    def start(self) -> None:
        self.opened = self.handle.getValueState("opened", "yes boolean")

    def take(self, key, row) -> Iterator[Row]:
        if not self.opened.exists():
            self.opened.update((True,))
            yield Row(doc=key[0], event_id=row[1], at=row[0])

    def clear(self) -> None:
        self.opened.clear()


def open_once_stream(events: DataFrame, idle: int | None = None) -> DataFrame:
    """doc, event_id, at of the first event of each document, once and for all; with idle, once more after a document was idle so many seconds."""
    return _in_order(events, _First(idle), "doc long, event_id long, at long")


def debounce_stream(events: DataFrame, seconds: int) -> DataFrame:
    """doc, ts, event_id, op of the last event of each burst, once the watermark has passed it."""
    burst = events.withWatermark("ts", WATERMARK).groupBy("doc", F.session_window("ts", f"{seconds} seconds"))
    last = burst.agg(F.max(F.struct("ts", "event_id", "op")).alias("l"))
    return last.select("doc", "l.ts", "l.event_id", "l.op")


def latest_state_stream(events: DataFrame) -> DataFrame:
    """doc and its last event's op and value, in update mode."""
    return events.groupBy("doc").agg(F.max(F.struct("ts", "event_id", "op", "value")).alias("s")).select("doc", "s.op", "s.value")


def recent_upserts(events: DataFrame, owner: str, identity: str, path: str, checkpoint: str, k: int = 10, buckets: int = 64):
    """Keep a table of owner, identity, ts, event_id at `path` that holds the k identities each owner used last; `recent_of` numbers them.

    Of each batch only an owner's k last identities can count, so no more rows than k an owner are kept or read again, and only the buckets that a batch touches are
    written. A batch that is run again changes nothing.
    """
    from pyspark.sql import Window

    from quire.sources.sinks import merge_buckets

    def fold(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(owner, identity).agg(F.max(F.struct("ts", "event_id")).alias("at"))
        n = F.row_number().over(Window.partitionBy(owner).orderBy(F.col("at").desc(), identity))
        return last.withColumn("n", n).where(F.col("n") <= k).select(owner, identity, "at.ts", "at.event_id")

    def merge(batch: DataFrame, number: int) -> None:
        merge_buckets(fold(batch.select(owner, identity, "ts", "event_id")), path, owner, fold, buckets)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_of(table: DataFrame, owner: str, identity: str) -> DataFrame:
    """owner, identity, nth of a table that recent_upserts keeps."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(owner).orderBy(F.struct("ts", "event_id").desc(), identity))
    return table.select(owner, identity, n.alias("nth"))


def upsert_latest(events: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Keep a table of each document's last state at `path`: each batch is merged into the buckets that it touches, and published.

    A batch that is run again, or a new checkpoint, changes nothing: the last state of equal events is the same.
    """
    from quire.sources.sinks import merge_buckets

    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc").agg(F.max(F.struct("ts", "event_id", "op", "value")).alias("s")).select("doc", "s.*")

    def merge(batch: DataFrame, number: int) -> None:
        merge_buckets(fold(batch.select("doc", "ts", "event_id", "op", "value")), path, "doc", fold, buckets)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
