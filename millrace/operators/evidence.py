"""Evidence of tracks: runs of frames as time intervals, merged, and snapped to the nearest sampled time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .order import placed, running, running_max


def islands(rows: DataFrame, by: list[str], at: str, max_gap: float, name: str) -> DataFrame:
    """``rows`` with the number (from 1) of their run: a run ends where the next ``at`` is more than ``max_gap`` away.

    ``by`` and ``at`` have no nulls and no ties.  Places and run numbers are taken over range partitions."""
    here = cut(placed(rows, by, [F.col(at)], "_place"), "places")
    before = here.select(*by, (F.col("_place") + 1).alias("_place"), F.col(at).alias("_prior"))
    marked = here.join(before, [*by, "_place"], "left")
    starts = F.col("_prior").isNull() | (F.col(at) - F.col("_prior") > max_gap)
    return running(marked, by, [F.col(at)], {name: starts.cast("long")}).drop("_place", "_prior")


def snapped(points: DataFrame, samples: DataFrame, by: list[str], at: str, name: str) -> DataFrame:
    """``points`` with ``name``: the sampled time of its ``by`` nearest to ``at`` (ties: the earlier), null where there is none."""
    s = samples.select(*by, F.col(at).alias("_t")).dropDuplicates().dropna()
    each = points.select(*by, F.col(at).alias("_t")).dropDuplicates().dropna()
    # One time line of samples and points; samples stand before points of the same time, in both directions.
    line = s.withColumn("_s", F.lit(0)).unionByName(each.withColumn("_s", F.lit(1)))
    sampled = F.when(F.col("_s") == 0, F.col("_t"))
    line = cut(running_max(line, by, [F.col("_t"), F.col("_s")], sampled, "_earlier"), "earlier")
    line = line.withColumn("_back", -F.col("_t"))
    line = running_max(line, by, [F.col("_back"), F.col("_s")], F.when(F.col("_s") == 0, F.col("_back")), "_later").filter("_s = 1")
    after = -F.col("_later")
    near = F.when(after - F.col("_t") < F.col("_t") - F.col("_earlier"), after).otherwise(F.coalesce("_earlier", after))
    found = cut(line.select(*by, F.col("_t").alias(at), near.alias(name)), "snapped")
    return points.join(found, [*by, at], "left")


def tubes(frames: DataFrame, track: str, frame: str, time: str, area: str, corners: list[str], digits: int | None = None) -> DataFrame:
    """A row a track: its frames with an area, union box, key frame (largest area, the first of equal ones) and area statistics.

    With ``digits``, areas have at most so many decimals and their mean is that of decimals, rounded once: the same in any
    order of the frames, where a sum of doubles may fall on either side of a tie."""
    seen = frames.filter((F.col(area) > 0) & F.col(track).isNotNull())
    x1, y1, x2, y2 = corners
    key = F.max_by(F.struct(frame, time), F.struct(area, (-F.col(frame)).alias("f")))
    mean = F.avg(area) if digits is None else F.avg(F.col(area).cast(f"decimal(30,{digits + 6})")).cast("double")
    boxes = [F.min(x1).alias("x1"), F.min(y1).alias("y1"), F.max(x2).alias("x2"), F.max(y2).alias("y2")]
    out = seen.groupBy(track).agg(F.count("*").alias("n_frames"), *boxes, key.alias("_k"), F.min(area).alias("area_min"), F.max(area).alias("area_max"), mean.alias("area_mean"))
    empty = frames.filter(F.col(track).isNotNull()).groupBy(track).agg(F.count_if(~F.coalesce(F.col(area) > 0, F.lit(False))).alias("n_empty"))
    return empty.join(out, track, "left").select(track, F.coalesce("n_frames", F.lit(0)).alias("n_frames"), "n_empty", "x1", "y1", "x2", "y2", F.col(f"_k.{frame}").alias("key_frame"), F.col(f"_k.{time}").alias("key_time"), "area_min", "area_max", "area_mean")


def intervals(frames: DataFrame, track: str, frame: str, time: str, area: str, max_gap: int, merge: float) -> DataFrame:
    """track, interval (from 1), first_frame, last_frame, start, end, n_runs: runs of frames with an area at most ``max_gap``
    frames apart, those merged that are at most ``merge`` of time apart.  Frames without time take no part."""
    known = frames.filter((F.col(area) > 0) & F.col(track).isNotNull() & F.col(frame).isNotNull() & F.col(time).isNotNull())
    one = known.groupBy(track, frame).agg(F.min(time).alias(time))
    runs = islands(one, [track], frame, max_gap, "_run").groupBy(track, "_run").agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.min(time).alias("start"), F.max(time).alias("end"))
    runs = cut(runs, "runs")
    before = runs.select(track, (F.col("_run") + 1).alias("_run"), F.col("end").alias("_end"))
    joined = runs.join(before, [track, "_run"], "left")
    apart = F.col("_end").isNull() | (F.col("start") - F.col("_end") > merge)
    numbered = running(joined, [track], [F.col("_run")], {"interval": apart.cast("long")})
    return numbered.groupBy(track, "interval").agg(F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_runs"))
