"""Turns of conversations in order, without one task holding a whole conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import placed
from .common import cut

#: Order of a conversation's rows: by turn, nulls first, then by role and text, so that repeated turns have a set place.
ORDER = ("turn", "role", "text")


def in_turn_order(rows: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """conv_id, pos (from 0 in its conversation) and the columns ``keep`` of each row.

    Rows (with columns conv_id, turn, role, text) are sorted over range partitions and numbered there; only ``keep`` is
    written, and places within a conversation are running counts of those numbers.  Texts are shuffled once."""
    order = [F.col("conv_id").asc_nulls_last(), *[F.col(c).asc_nulls_first() for c in ORDER]]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    slim = cut(dealt.select("conv_id", F.monotonically_increasing_id().alias("_seq"), *[c.alias(n) for n, c in keep.items()]), "turns")
    return placed(slim, ["conv_id"], [F.col("_seq")], "pos").withColumn("pos", F.col("pos") - 1).drop("_seq")
