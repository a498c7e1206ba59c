"""Flushing of items by count or time, each item once: the same batches on a stream and on a replay of its events.

A key's batch opens with its first item and is flushed with its ``most``-th item, or when ``seconds`` have passed since
it was opened, whichever comes first in event time.  An item that comes again is passed over.  Items stand by time, then id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.evidence import islands
from ..session import cut

SCHEMA = "key string, opened long, closed long, n long, reason string, items string"
#: State stores with timers need this provider.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Batch:
    """The open batch of one key; times in microseconds."""

    def __init__(self, most: int, micros: int, opened: int | None = None, items: list[str] | None = None):
        self.most, self.micros, self.opened, self.items = most, micros, opened, items or []

    def _flush(self, closed: int, reason: str) -> tuple:
        out = self.opened, closed, len(self.items), reason, ",".join(self.items)
        self.opened, self.items = None, []
        return out

    def pass_time(self, now: int) -> Iterator[tuple]:
        if self.opened is not None and now >= self.opened + self.micros:
            yield self._flush(self.opened + self.micros, "time")

    def add(self, at: int, item: str) -> Iterator[tuple]:
        yield from self.pass_time(at)
        self.opened = at if self.opened is None else self.opened
        self.items.append(item)
        if len(self.items) >= self.most:
            yield self._flush(at, "count")


def _fold(batches: Iterator[pa.RecordBatch], most: int, micros: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, run, at, item), sorted: all flushed batches.  A run's end is more than the time limit before the next one's start."""
    out: list[tuple] = []
    name, batch = None, None

    def flush() -> pa.RecordBatch:
        types = [pa.string(), *[pa.int64()] * 3, pa.string(), pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [c.split()[0] for c in SCHEMA.split(", ")])
        out.clear()
        return made

    def finish(last: bool) -> None:
        if batch and batch.opened is not None:
            out.append((name[0], *batch._flush(batch.opened + micros, "open" if last else "time")))

    for rows in batches:
        for key, run, last, at, item in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if name is None or (key, run) != name[:2]:
                if name:
                    finish(name[2])
                name, batch = (key, run, last), Batch(most, micros)
            out += [(key, *b) for b in batch.add(at, item)]
        if len(out) >= 1000:
            yield flush()
    if name:
        finish(name[2])
    yield flush()


def replay(events: DataFrame, key: str, at: str, item: str, most: int, seconds: int) -> DataFrame:
    """key, opened, closed, n, reason (count, time, or open: not flushed yet), items (joined by commas); times in microseconds.

    Events with a null key, time or item take no part.  A key's time line is cut wherever no item comes for ``seconds``:
    the pieces are folded on their own, each streamed through a task in constant memory."""
    micros = seconds * 1_000_000
    once = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(item).cast("string").alias("item")).dropna()
    once = once.groupBy("key", "item").agg(F.min("at").alias("at"))
    times = islands(once.select("key", "at").distinct(), ["key"], "at", micros - 1, "run")
    last = times.groupBy("key").agg(F.max("run").alias("_last"))
    runs = cut(times.join(last, "key").select("key", "at", "run", (F.col("run") == F.col("_last")).alias("last")), "runs")
    rows = once.join(runs, ["key", "at"]).select("key", "run", "last", "at", "item")
    dealt = rows.repartition("key", "run").sortWithinPartitions("key", "run", "at", "item")
    return dealt.mapInArrow(lambda b: _fold(b, most, micros), SCHEMA)


class Flusher(StatefulProcessor):
    """Items wait in state until the watermark has passed them, so that batches don't depend on micro-batches; a timer a time."""

    def __init__(self, most: int, micros: int):
        self.most, self.micros = most, micros

    def init(self, handle) -> None:
        pair = StructType([StructField("at", LongType()), StructField("item", StringType())])
        self.handle = handle
        self.waiting = handle.getListState("waiting", pair)
        self.seen = handle.getMapState("seen", "item string", "at long")
        self.open = handle.getListState("open", pair)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r.at, r.item)):
            if not self.seen.containsKey((r.item,)):
                self.seen.updateValue((r.item,), (r.at,))
                self.waiting.appendValue((r.at, r.item))
                self.handle.registerTimer(-(-r.at // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # Nothing up to the watermark can come any more: all of it is passed at once, deadlines included.
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted((r[0], r[1]) for r in self.waiting.get()) if self.waiting.exists() else []
        held = sorted((r[0], r[1]) for r in self.open.get()) if self.open.exists() else []
        batch = Batch(self.most, self.micros, held[0][0] if held else None, [i for _, i in held])
        out, times = [], dict((i, t) for t, i in held)
        for at, item in [d for d in due if d[0] <= now]:
            times[item] = at
            out += batch.add(at, item)
        out += batch.pass_time(now)
        left = [d for d in due if d[0] > now]
        self.waiting.clear()
        if left:
            self.waiting.put(left)
        self.open.clear()
        if batch.items:
            self.open.put([(times[i], i) for i in batch.items])
            self.handle.registerTimer(-(-(batch.opened + self.micros) // 1000))
        return iter([Row(key=key[0], opened=o, closed=c, n=n, reason=r, items=i) for o, c, n, r, i in out])

    def close(self) -> None:
        pass


def stream_flushes(events: DataFrame, key: str, at: str, item: str, most: int, seconds: int, late: str, out: str, checkpoint: str):
    """Append the flushed batches of a stream to ``out``; events later than ``late`` behind the newest are dropped.

    The state of a key is its open batch, what waits for the watermark, and the ids seen."""
    spark = events.sparkSession
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("_time"), F.col(item).cast("string").alias("item")).dropna()
    rows = rows.withWatermark("_time", late).withColumn("at", F.unix_micros("_time"))
    made = rows.groupBy("key").transformWithState(Flusher(most, seconds * 1_000_000), SCHEMA, "Append", "EventTime")
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        return made.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:  # the query has taken the setting over
        spark.conf.set(PROVIDER[0], before) if before else spark.conf.unset(PROVIDER[0])
