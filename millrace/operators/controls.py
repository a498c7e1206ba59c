"""Row generators: variants of a row, swapped and flipped controls, interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import placed, with_totals


def variants(rows: DataFrame, made: dict[str, Column], name: str = "variant", value: str = "value") -> DataFrame:
    """A row per variant: its name and its value beside all columns."""
    return rows.withColumn("_v", F.explode(F.array(*[F.struct(F.lit(n).alias(name), c.alias(value)) for n, c in made.items()]))).select(*rows.columns, f"_v.{name}", f"_v.{value}")


def swap_in_pairs(rows: DataFrame, pair: str, side: str, payload: str) -> DataFrame:
    """Rows of complete pairs with the payload of the other side."""
    other = rows.select(pair, F.col(side).alias("_side"), F.col(payload).alias(f"other_{payload}"))
    return rows.join(other, pair).filter(F.col(side) != F.col("_side")).drop("_side")


def cycle_in_group(rows: DataFrame, group: str, key: str, by: int = 1) -> DataFrame:
    """(key, group, other): each row with the one ``by`` places further in its group, around the end."""
    inside = placed(rows.select(group, key), [group], [F.asc(key)], "_at").withColumn("_at", F.col("_at") - 1)
    stood = with_totals(inside, [group], inside.groupBy(group).agg(F.count("*").alias("_n")))
    other = stood.select(group, F.col("_at").alias("_to"), F.col(key).alias("other"))
    return stood.withColumn("_to", F.pmod(F.col("_at") + by, F.col("_n"))).join(other, [group, "_to"]).select(key, group, "other")


def interleave(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Union with ``side`` and ``place``: the n-th rows of both sides stand together."""
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    return placed(both, ["side"], [F.asc(key)], "place")
