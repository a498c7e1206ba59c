"""Ordered-series functions: runs, rolling means, steps, slopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, by: list[str], at: str, max_gap: int = 1) -> DataFrame:
    """Runs of distinct integer positions no further apart than ``max_gap``: by, run, first, last, n."""
    w = Window.partitionBy(*by).orderBy(at)
    step = rows.select(*by, at).distinct().withColumn("_new", (F.coalesce(F.col(at) - F.lag(at).over(w), F.lit(max_gap + 1)) > max_gap).cast("int"))
    return step.withColumn("run", F.sum("_new").over(w)).groupBy(*by, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def longest_run(rows: DataFrame, by: list[str], at: str, max_gap: int = 1) -> DataFrame:
    """The longest run of each group; the earliest of equal ones."""
    best = runs(rows, by, at, max_gap).groupBy(*by).agg(F.max(F.struct("n", (-F.col("first")).alias("_f"), "last")).alias("_b"))
    return best.select(*by, F.col("_b.n").alias("n"), (-F.col("_b._f")).alias("first"), F.col("_b.last").alias("last"))


def rolling_mean(rows: DataFrame, by: list[str], at: str, value: str, width: int, name: str) -> DataFrame:
    """Mean over a centred window of ``width`` rows; shorter at the ends."""
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(-(width // 2), (width - 1) // 2)
    return rows.withColumn(name, F.avg(value).over(w))


def series_stats(rows: DataFrame, by: list[str], at: str, value: str, edge: int) -> DataFrame:
    """First and last value, means of the first and last ``edge`` rows, extremes with their place, linear slope."""
    up = F.row_number().over(Window.partitionBy(*by).orderBy(at))
    down = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(at)))
    r = rows.withColumns({"_up": up, "_down": down})
    v = F.col(value)
    return r.groupBy(*by).agg(
        F.count("*").alias("n"), F.min_by(v, at).alias("first_value"), F.max_by(v, at).alias("last_value"),
        F.avg(F.when(F.col("_up") <= edge, v)).alias("head_mean"), F.avg(F.when(F.col("_down") <= edge, v)).alias("tail_mean"),
        F.min(v).alias("min_value"), F.min(F.struct(v, F.col(at)))[at].alias("min_at"), F.max(v).alias("max_value"),
        (-F.max(F.struct(v, (-F.col(at)).alias("_n")))["_n"]).alias("max_at"), F.regr_slope(v, F.col(at).cast("double")).alias("slope"),
    )


def cosine_steps(rows: DataFrame, by: list[str], at: str, vector: str) -> DataFrame:
    """1 - cosine between each vector and the one before it in its group."""
    a, b = F.col("_before"), F.col(vector)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    w = Window.partitionBy(*by).orderBy(at)
    return rows.withColumn("_before", F.lag(vector).over(w)).filter("_before IS NOT NULL").select(*by, at, (1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))).alias("cosine_distance"))
