"""Event folding that gives the same result on a batch and on a stream of the same events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fold_status(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """The last status of each key by ``order``, with how many events it has: one partial aggregation, no sort."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status), F.count("*").alias("events"))


def tumbling(events: DataFrame, at: str, length: str, aggregates: list[Column], slide: str | None = None, start: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates per window of ``length``; windows start every ``slide`` (default: length), shifted by ``start``."""
    window = F.window(at, length, slide or length, start or "0 seconds")
    return events.groupBy(window.alias("w"), *by).agg(*aggregates).select(F.col("w.start").alias("window_start"), "*").drop("w")


def stream_status(events: DataFrame, key: str, order: list[str], status: str, out: str, checkpoint: str, available_now: bool = True):
    """Keep the folded state of a stream as Parquet, a new folder ``out/batch=N`` for each micro-batch; the last whole one counts.

    A reader never meets a half-written state, and a batch that is repeated after a crash replaces its own folder only.

    Aggregation in complete mode holds one row a key in the state store; out-of-order events are folded by ``order``,
    so the state equals the batch fold over the same events."""
    def replace(state: DataFrame, batch: int) -> None:
        state.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    writer = fold_status(events, key, order, status).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(replace)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def last_state(spark: SparkSession, out: str) -> DataFrame:
    """The newest state that stream_status() finished (its folder has Spark's mark of success)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    newest = max(int(str(f.getPath().getParent().getName()).split("=")[1]) for f in found)
    return spark.read.parquet(f"{out}/batch={newest}")


def stream_windows(events: DataFrame, at: str, late: str, length: str, aggregates: list[Column], out: str, checkpoint: str):
    """Append each window once it is closed by the watermark ``late``; rows of closed windows that come after it are dropped."""
    made = tumbling(events.withWatermark(at, late), at, length, aggregates)
    return made.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
