"""Places and running sums in an order, without one task holding a whole group.

Rows are dealt to range partitions of (group, order), each partition sums what it holds of a group, and what stands
before it is added: at most one row per group and partition is sorted by itself.  Orders by a hash need no dealing:
the first digits of the hash are ranges of nearly equal size.  Nulls in groups and orders come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows up to which a table of sums is broadcast.
BROADCAST_ROWS = 100_000
#: Leading hex digits of a hash that name its range.
DIGITS = 3


def sent(small: DataFrame) -> DataFrame:
    """``small`` marked for broadcast where it was counted and is small; as it is otherwise."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


#: Rows that a task sorts or hashes at a time, about.
ROWS_A_TASK = 250_000
#: Rows below which a further task isn't worth its start.
LEAST_ROWS = 20_000


def tasks(rows: DataFrame) -> int:
    """Tasks to which ``rows`` are dealt: one for ROWS_A_TASK rows, all cores at least where these have LEAST_ROWS each.

    The rows are counted, so give tables.  A number that is given is kept by adaptive execution, which otherwise joins
    partitions up to a size in compressed bytes: millions of narrow rows, in several sorts and hash tables of a task."""
    n = rows.count()
    return max(1, -(-n // ROWS_A_TASK), min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to ``tasks(rows)``: what a task holds stays the same as tables grow.  For keys of few rows each."""
    return rows.repartition(tasks(rows), *keys)


def with_totals(rows: DataFrame, by: list[str], totals: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``totals``, which has one row for each value of ``by``; nulls meet nulls."""
    renamed = totals.select(*[F.col(b).alias(f"_t_{b}") for b in by], *[c for c in totals.columns if c not in by])
    if not by:
        return rows.crossJoin(F.broadcast(renamed))  # one row
    same = [F.col(b).eqNullSafe(F.col(f"_t_{b}")) for b in by]
    return rows.join(sent(renamed), same, "left").drop(*[f"_t_{b}" for b in by])


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums (the row included) in ``order`` within ``by``; null sums count as 0.

    Rows that are equal in ``order`` stand in one partition, in no set sequence: give an order without ties."""
    dealt = rows.repartitionByRange(*[F.col(b).asc_nulls_last() for b in by], *order).withColumn("_part", F.spark_partition_id())
    values = {f"_v{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())}
    dealt = cut(dealt.withColumns(values), "dealt")
    each = dealt.groupBy(*by, "_part").agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select(*by, "_part", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_b{v}") for v in values])
    here = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = with_totals(dealt, [*by, "_part"], cut(before, "before"))
    out = out.withColumns({name: F.sum(v).over(here) + F.col(f"_b{v}") for name, v in zip(sums, values, strict=True)})
    return out.drop("_part", *values, *[f"_b{v}" for v in values])


#: Rows of a group up to which a task may hold it.
GROUP_ROWS = 100_000


def small_groups(rows: DataFrame, by: list[str]) -> bool:
    """Has no value of ``by`` more than GROUP_ROWS rows?  They are counted: only then may a window hold whole groups."""
    most = rows.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0]
    return (most or 0) <= GROUP_ROWS


def running_max(rows: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with the largest ``value`` so far (the row included) in ``order`` within ``by``; nulls don't count.

    Rows that are equal in ``order`` must have equal values, or give an order without ties."""
    dealt = rows.withColumn("_v", value).repartitionByRange(*[F.col(b).asc_nulls_last() for b in by], *order).withColumn("_part", F.spark_partition_id())
    dealt = cut(dealt, "dealt")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(*by, "_part").agg(F.max("_v").alias("_m")).select(*by, "_part", F.max("_m").over(earlier).alias("_before"))
    here = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = with_totals(dealt, [*by, "_part"], cut(before, "before"))
    return out.withColumn(name, F.greatest(F.max("_v").over(here), "_before")).drop("_v", "_part", "_before")


def placed(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place from 1 in ``order`` within ``by``."""
    return running(rows, by, order, {name: F.lit(1).cast("long")})


def hash_placed(rows: DataFrame, by: list[str], hexes: Column, key: str, name: str) -> DataFrame:
    """``rows`` with their place from 1 by a hex hash, then ``key``, within ``by``."""
    marked = rows.withColumn("_hash", hexes).withColumn("_range", F.coalesce(F.substring("_hash", 1, DIGITS), F.lit("~")))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    each = marked.groupBy(*by, "_range").agg(F.count("*").alias("_m"))
    before = each.select(*[F.col(b).alias(f"_t_{b}") for b in by], F.col("_range").alias("_t_range"), F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_before"))
    same = [F.col(b).eqNullSafe(F.col(f"_t_{b}")) for b in by] + [F.col("_range") == F.col("_t_range")]
    here = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_hash", key))
    out = marked.withColumn("_here", here).join(before, same).withColumn(name, F.col("_here") + F.col("_before"))
    return out.drop("_hash", "_range", "_here", "_before", "_t_range", *[f"_t_{b}" for b in by])
