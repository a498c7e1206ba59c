"""Keyed joins with a stated duplicate policy, and nearest, prefix and ancestor joins as equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .order import dealt, placed, sent, with_totals


def deduplicate(rows: DataFrame, keys: list[str], order: list[Column], keep: str = "last") -> DataFrame:
    """One row a key: the first or last by ``order``, or an error where a key repeats (``keep='error'``)."""
    if keep == "error":
        if not rows.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"{keys} repeats")
        return rows
    pick = F.min_by if keep == "first" else F.max_by
    whole = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(pick(whole, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_r")).select("_r.*")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keys only in left, keys only in right."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti"), b.join(a, keys, "left_anti")


def precedence_join(left: DataFrame, sources: list[tuple[DataFrame, list[str]]], values: list[str]) -> DataFrame:
    """Left join with several lookups; the first that has the row's key gives all ``values``, and ``matched_by`` its number."""
    out, found = left, []
    for i, (source, keys) in enumerate(sources):
        packed = source.select(*[F.col(k).alias(f"_k{i}_{k}") for k in keys], F.struct(*values).alias(f"_v{i}"))
        out = out.join(packed, [out[k] == packed[f"_k{i}_{k}"] for k in keys], "left").drop(*packed.columns[:-1])
        found.append(f"_v{i}")
    by = F.coalesce(*[F.when(F.col(v).isNotNull(), F.lit(i)) for i, v in enumerate(found)])
    one = F.coalesce(*found)
    return out.withColumn("_one", one).withColumn("matched_by", by).select(*left.columns, *[F.col(f"_one.{v}").alias(v) for v in values], "matched_by")


def unanimous_fallback(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value) of groups that agree on one non-null value."""
    agreed = rows.filter(F.col(value).isNotNull()).groupBy(group).agg(F.min(value).alias(value), F.max(value).alias("_hi"))
    return agreed.filter(F.col(value) == F.col("_hi")).drop("_hi")


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, tolerance: float, value: str, id_col: str) -> DataFrame:
    """For each left row the right ``value`` nearest in ``at`` within tolerance (ties: earlier, then smaller value).

    Times fall into cells as wide as the tolerance, so a match lies in the same or a neighbouring cell: an equi join
    on keys and cell instead of a range join over all pairs.  A cell itself is still paired in full."""
    cell = lambda c: F.floor(c / tolerance)
    r = right.select(*keys, F.col(at).alias("_rt"), F.col(value).alias("_rv")).withColumn("_cell", F.explode(F.array(*[cell(F.col("_rt")) + d for d in (-1, 0, 1)])))
    near = left.withColumn("_cell", cell(F.col(at))).join(r, [*keys, "_cell"]).filter(F.abs(F.col(at) - F.col("_rt")) <= tolerance)
    best = near.groupBy(id_col).agg(F.min(F.struct(F.abs(F.col(at) - F.col("_rt")).alias("d"), F.col("_rt").alias("t"), F.col("_rv").alias("v"))).alias("_b"))
    return left.join(best.select(id_col, F.col("_b.d").alias("distance"), F.col("_b.v").alias(f"nearest_{value}")), id_col, "left")


def ancestors(path: Column, most: int = 4) -> Column:
    """Array of (depth, prefix): the path itself and up to ``most`` of its parents."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.least(F.lit(most), F.size(parts) - 1)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - d), "/").alias("prefix")))


def ancestor_join(rows: DataFrame, path: str, lookup: DataFrame, value: str, id_col: str, most: int = 4) -> DataFrame:
    """The value of the nearest ancestor path in ``lookup(path, value)``, and how far up it is."""
    up = rows.select(id_col, F.explode(ancestors(F.col(path), most)).alias("_a")).select(id_col, "_a.depth", "_a.prefix")
    found = up.join(lookup.select(F.col("path").alias("prefix"), F.col(value)), "prefix").groupBy(id_col).agg(F.min("depth").alias("depth"), F.min_by(value, "depth").alias(value))
    return rows.select(id_col, path).join(found, id_col, "left")


def longest_prefix_join(rows: DataFrame, text: str, rules: DataFrame, value: str, id_col: str) -> DataFrame:
    """The value of the longest rule(prefix, value) that ``text`` equals or continues at a slash.

    A text has few prefixes that end at a slash, so it is an equi join on these, whatever the number of rules.  Rules are
    broadcast where they are few; rows never are, and tasks get about the same number of them, however many there are."""
    parts = F.split(F.col(text), "/")
    fronts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = dealt(cut(rows.select(*dict.fromkeys([id_col, text])), "texts"), id_col)
    found = rows.select(id_col, F.explode(fronts).alias("prefix")).join(sent(rules), "prefix").groupBy(id_col).agg(F.max_by(value, F.length("prefix")).alias(value), F.max(F.length("prefix")).alias("prefix_length"))
    return rows.join(found, id_col, "left")


def positional_join(left: DataFrame, right: DataFrame, by: list[str], left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Pair the n-th left row with the n-th right row of each group."""
    return placed(left, by, left_order, "rn").join(placed(right, by, right_order, "rn"), [*by, "rn"])


def upsert(old: DataFrame, new: DataFrame, group: str, requested: DataFrame) -> DataFrame:
    """Merge by group: a requested group with new rows is replaced, without them kept and marked; others are kept; new rows nobody asked for are ignored.

    Returns old/new rows with ``merge_status``: replaced, added, missing or kept."""
    asked = requested.select(group).distinct().withColumn("_asked", F.lit(True))
    fresh = new.join(asked.select(group), group, "left_semi")
    has_new = fresh.select(group).distinct().withColumn("_new", F.lit(True))
    has_old = old.select(group).distinct().withColumn("_old", F.lit(True))
    kept = old.join(asked, group, "left").join(has_new, group, "left").filter("_new IS NULL").withColumn("merge_status", F.when(F.col("_asked"), "missing").otherwise("kept")).drop("_asked", "_new")
    taken = fresh.join(has_old, group, "left").withColumn("merge_status", F.when(F.col("_old"), "replaced").otherwise("added")).drop("_old")
    return kept.unionByName(taken)


def nearest_in_block(rows: DataFrame, block: list[str], id_col: str, value: str, k: int, digits: int = 4) -> DataFrame:
    """block, ``id_col``, other, score, rank: the ``k`` rows of a row's block nearest to it in ``value``.

    The score is the negative distance rounded to ``digits``; ties go to the lesser id.  Ids are distinct; rows with a
    null id, value or block column and rows alone in their block are left out.  A block is reduced to its different values with their
    k + 1 least ids; a value's nearest lie among the k values before and behind it by place, so no pairs of a block are made."""
    known = rows.dropna(subset=[*block, id_col, value]).select(*block, id_col, value)
    least = F.row_number().over(Window.partitionBy(*block, value).orderBy(id_col))
    few = known.withColumn("_r", least).filter(F.col("_r") <= k + 1)
    levels = few.groupBy(*block, value).agg(F.array_sort(F.collect_list(id_col)).alias("_ids"))
    levels = cut(placed(levels, block, [F.col(value)], "_p"), "levels")
    around = levels.select(*block, F.col(value).alias("_v"), F.explode(F.sequence(F.col("_p") - k, F.col("_p") + k)).alias("_p"))
    met = around.join(levels.select(*block, "_p", F.col(value).alias("_w"), "_ids"), [*block, "_p"])
    score = F.round(-F.abs(F.col("_v") - F.col("_w")), digits)
    found = met.groupBy(*block, "_v").agg(F.flatten(F.collect_list(F.transform("_ids", lambda i: F.struct((-score).alias("d"), i.alias("id"))))).alias("_near"))
    nearest = cut(found.select(*block, F.col("_v").alias(value), F.slice(F.array_sort("_near"), 1, k + 1).alias("_near")), "nearest")
    others = F.slice(F.filter("_near", lambda x: x["id"] != F.col(id_col)), 1, k)
    out = known.join(nearest, [*block, value]).select(*block, id_col, F.posexplode(others).alias("_i", "_x"))
    return out.select(*block, id_col, F.col("_x.id").alias("other"), (-F.col("_x.d")).alias("score"), (F.col("_i") + 1).cast("int").alias("rank"))


def least_sharing(rows: DataFrame, block: list[str], id_col: str, words: str) -> DataFrame:
    """block, ``id_col``, other: the least id of another row of the block that shares one of the array ``words``; rows without one are left out.

    The two least ids of each word are all that rows meet, never the rows of a word; null and empty words count for nothing."""
    each = rows.select(*block, id_col, F.explode(F.array_distinct(words)).alias("_w")).filter("_w != ''")
    least = cut(each.groupBy(*block, "_w").agg(F.min(id_col).alias("_least")), "least")
    met = with_totals(each, [*block, "_w"], least)
    second = met.filter(F.col(id_col) != F.col("_least")).groupBy(*block, "_w").agg(F.min(id_col).alias("_second"))
    met = with_totals(met, [*block, "_w"], cut(second, "second"))
    other = F.when(F.col(id_col) != F.col("_least"), F.col("_least")).otherwise(F.col("_second"))
    return met.groupBy(*block, id_col).agg(F.min(other).alias("other")).filter("other IS NOT NULL")


def best_by_tiers(rows: DataFrame, block: list[str], id_col: str, tiers: list[tuple[str, int]], rest: int, words: tuple[str, int] | None = None) -> DataFrame:
    """The partner (``other``, ``score``) of each row among the other rows of its block: of equal value in the first tier
    that has one, else one that shares a word (``words``: array column, score), else any (score ``rest``); the least id.
    Ids are distinct.  Rows alone in their block are left out.

    The partner by a column is the least id of its value, or the second least for that row itself: the two least ids of a
    value are all that is joined, never pairs of rows.  A null value has no partner in its tier."""
    out, found = rows, []
    for i, (value, score) in enumerate([*tiers, (None, rest)]):
        if value is None and words:
            near = cut(least_sharing(rows, block, id_col, words[0]), "sharing").withColumnRenamed("other", "_pw")
            out = out.join(near, [*block, id_col], "left")
            found.append(("_pw", words[1]))
        by = [*block, value] if value else block
        least = rows.groupBy(*by).agg(F.min(id_col).alias("_least"))
        second = rows.join(least, by).filter(F.col(id_col) != F.col("_least")).groupBy(*by).agg(F.min(id_col).alias("_second"))
        two = least.join(second, by)
        out = out.join(two, by, "left").withColumn(f"_p{i}", F.when(F.col(id_col) == F.col("_least"), F.col("_second")).otherwise(F.col("_least"))).drop("_least", "_second")
        found.append((f"_p{i}", score))
    score = F.coalesce(*[F.when(F.col(p).isNotNull(), F.lit(s)) for p, s in found])
    out = out.withColumn("other", F.coalesce(*[p for p, _ in found])).withColumn("score", score)
    return out.filter("other IS NOT NULL").drop(*[p for p, _ in found])
