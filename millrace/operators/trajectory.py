"""Features of trajectories of vectors: step distances and turning angles, the first ones and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .order import placed

#: Distances and angles that are given one by one, and the least length a vector is divided by.
DISTANCES, ANGLES, TINY = 7, 6, 1e-8
STATISTICS = ("mean", "min", "max", "var")
COLUMNS = [*[f"d{i}" for i in range(DISTANCES)], *[f"a{i}" for i in range(ANGLES)], *[f"distance_{s}" for s in STATISTICS], *[f"angle_{s}" for s in STATISTICS]]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; a vector shorter than TINY over TINY."""
    return F.transform(F.array(v), lambda w: F.transform(w, lambda x: x / F.greatest(F.sqrt(dot(w, w)), F.lit(TINY))))[0]


def trajectory_features(rows: DataFrame, track: str, order: list[Column], vector: str) -> DataFrame:
    """``track``, n and the 21 columns COLUMNS: cosine distances of neighbours in ``order``, turning angles (1 - cosine of neighbouring
    steps) and their mean, least, largest and population variance; 0 where a track has none.

    Rows with a null track or vector take no part; tracks of one row have no features and are left out, as are neighbours of other
    length (null distances count in no statistic).  Neighbours are met by place, over range partitions: a track is in no one task.  Give an order without ties."""
    x = rows.filter(F.col(track).isNotNull() & F.col(vector).isNotNull())
    x = placed(x.withColumn("_u", unit(F.col(vector).cast("array<double>"))), [track], order, "_p").select(track, "_p", "_u")
    x = cut(x, "units")
    before = x.select(track, (F.col("_p") + 1).alias("_p"), F.col("_u").alias("_w"))
    step = F.zip_with("_u", "_w", lambda a, b: a - b)
    same = F.size("_u") == F.size("_w")
    steps = x.join(before, [track, "_p"]).select(track, "_p", F.when(same, 1 - dot(F.col("_u"), F.col("_w"))).alias("_d"), F.when(same, unit(step)).alias("_s"))
    steps = cut(steps, "steps")
    earlier = steps.select(track, (F.col("_p") + 1).alias("_p"), F.col("_s").alias("_r"))
    turned = steps.join(earlier, [track, "_p"], "left").select(track, "_p", "_d", F.when(F.size("_s") == F.size("_r"), 1 - dot(F.col("_s"), F.col("_r"))).alias("_a"))
    at = lambda c, p: F.coalesce(F.max(F.when(F.col("_p") == p, F.col(c))), F.lit(0.0))
    stats = lambda c: [F.coalesce(f(c), F.lit(0.0)) for f in (F.avg, F.min, F.max, F.var_pop)]
    values = [*[at("_d", i + 2) for i in range(DISTANCES)], *[at("_a", i + 3) for i in range(ANGLES)], *stats("_d"), *stats("_a")]
    return turned.groupBy(track).agg((F.count("*") + 1).alias("n"), *[v.alias(c) for v, c in zip(values, COLUMNS, strict=True)])
