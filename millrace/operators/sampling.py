"""Samplers and splits ordered by a salted hash, so that they repeat exactly and need no random state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import hash_placed, placed, with_totals


#: Limits from here on are not pushed into tasks by Spark (its default of spark.sql.optimizer.windowGroupLimitThreshold).
RANKED_IN_TASKS = 1000


def hash_key(seed: str, *cols: Column) -> Column:
    """Hex SHA-256 of seed and values joined by colons: the order of all samplers."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols]), 256)


def hash_unit(key: Column) -> Column:
    """[0, 1) from the first 52 bits of a hex hash."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / float(1 << 52)


def hash_shard(key: Column, shards: int) -> Column:
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def ranked(rows: DataFrame, by: list[str], seed: str, key: str, name: str = "rn") -> DataFrame:
    """``rows`` with their place in hash order within ``by``; no task holds a whole group."""
    return hash_placed(rows, by, hash_key(seed, F.col(key)), key, name)


def first_n(rows: DataFrame, by: list[str], seed: str, key: str, n: int) -> DataFrame:
    """The n first of each group in hash order.  Spark ranks small n within tasks before the shuffle; larger ones are places over ranges of the hash."""
    if n >= RANKED_IN_TASKS:
        return ranked(rows, by, seed, key).filter(F.col("rn") <= n)
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(hash_key(seed, F.col(key)), key))).filter(F.col("rn") <= n)


def round_robin(rows: DataFrame, strata: list[str], seed: str, key: str, n: int) -> DataFrame:
    """n rows taken in turn from the strata: all firsts, then all seconds, and so on."""
    return first_n(rows, strata, seed, key, n).orderBy("rn", *strata).limit(n)


def _quotas(groups: DataFrame, by: list[str], n: int) -> DataFrame:
    """``by`` and _take: n divided evenly over the groups, the remainder one each to the first; ``groups`` has a row a group."""
    count = groups.count()
    place = F.col("_place") - 1
    return placed(groups, [], [F.col(b).asc_nulls_last() for b in by], "_place").select(*[F.col(b).alias(f"_q_{b}") for b in by], (F.lit(n // max(count, 1)) + (place < n % max(count, 1)).cast("int")).alias("_take"))


def label_balanced(rows: DataFrame, label: str, strata: list[str], seed: str, key: str, n: int) -> DataFrame:
    """n rows, evenly from the labels and within each from its strata in turn; fewer where a label has too few."""
    quota = _quotas(rows.select(label).distinct(), [label], n)
    firsts = first_n(rows, [label, *strata], seed, key, n)
    turns = Window.partitionBy(label).orderBy("rn", *[F.col(s).asc_nulls_last() for s in strata])
    x = firsts.withColumn("_at", F.row_number().over(turns)).join(quota, F.col(label).eqNullSafe(F.col(f"_q_{label}")))
    return x.filter("_at <= _take").select(*rows.columns)


def quota_with_fill(rows: DataFrame, by: list[str], seed: str, key: str, n: int) -> DataFrame:
    """n rows: an even quota of each group in hash order, and what small groups lack from the remaining rows in hash order."""
    quota = _quotas(rows.select(*by).distinct(), by, n)
    same = [F.col(b).eqNullSafe(F.col(f"_q_{b}")) for b in by]
    # No group gives more than n rows, and Spark ranks within tasks before the shuffle.
    own = first_n(rows, by, seed, key, n).join(quota, same).withColumn("_own", F.col("rn") <= F.col("_take"))
    taken = own.filter("_own").select(*rows.columns)
    rest = own.filter("NOT _own").withColumn("_h", hash_key(seed, F.col(key))).orderBy("_h", key).limit(max(0, n - taken.count()))
    return taken.unionByName(rest.select(*rows.columns))


def min_class_balance(rows: DataFrame, by: list[str], label: str, seed: str, key: str) -> DataFrame:
    """Within ``by``, as many rows of each label as the rarest label there has (labels that don't occur there don't count)."""
    least = rows.groupBy(*by, label).count().groupBy(*by).agg(F.min("count").alias("_least"))
    return with_totals(ranked(rows, [*by, label], seed, key), by, least).filter("rn <= _least").drop("_least")


def largest_remainder(sizes: DataFrame, strata: list[str], share: float) -> DataFrame:
    """(strata, n, take): share of each stratum, rounded so that the total is right; at least 1 and at most n - 1, and 0 of a stratum of one.

    ``sizes`` has a row a stratum."""
    exact = F.col("n") * share
    base = sizes.withColumn("_floor", F.when(F.col("n") <= 1, 0).otherwise(F.least(F.greatest(F.floor(exact), F.lit(1)), F.col("n") - 1))).withColumn("_rest", exact - F.floor(exact))
    goal, have = base.agg(F.round(F.sum("n") * share), F.sum("_floor")).first()
    short = int((goal or 0) - (have or 0))
    can = base.filter((F.col("n") > 1) & (F.col("_floor") < F.col("n") - 1)) if short > 0 else base.filter(F.col("_floor") > 1)
    order = [F.desc("_rest"), *strata] if short > 0 else [F.asc("_rest"), *strata]
    extra = can.orderBy(*order).limit(abs(short)).select(*[F.col(s).alias(f"_x_{s}") for s in strata], F.lit(1 if short > 0 else -1).alias("_extra"))
    same = [F.col(s).eqNullSafe(F.col(f"_x_{s}")) for s in strata]
    return base.join(extra, same, "left").select(*strata, "n", (F.col("_floor") + F.coalesce("_extra", F.lit(0))).cast("long").alias("take"))


def largest_shares(sizes: DataFrame, stratum: str, count: int) -> DataFrame:
    """(stratum, take): ``count`` dealt in proportion to ``n``, rounded by largest remainder; at least 1 each if there is room for all.

    ``sizes`` has a row a stratum."""
    total, strata = sizes.agg(F.sum("n"), F.count("*")).first()
    exact = F.col("n") * F.lit(count) / F.lit(max(total or 0, 1))
    base = sizes.withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.floor(exact))
    short = count - (base.agg(F.sum("_floor")).first()[0] or 0)
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), F.col(stratum).asc_nulls_last()))  # a row a stratum only
    take = F.col("_floor") + (place <= short).cast("int")
    return base.select(stratum, F.when(F.lit(count >= strata), F.greatest(take, F.lit(1))).otherwise(take).cast("long").alias("take"))


def stratified_split(rows: DataFrame, strata: list[str], share: float, seed: str, key: str) -> DataFrame:
    """``rows`` with ``split``: test for the first ``take`` of each stratum in hash order, else train."""
    quota = largest_remainder(rows.groupBy(*strata).agg(F.count("*").alias("n")), strata, share)
    picked = with_totals(ranked(rows, strata, seed, key), strata, quota.select(*strata, "take"))
    return picked.withColumn("split", F.when(F.col("rn") <= F.col("take"), "test").otherwise("train")).select(*rows.columns, "split")


def evenly_spaced(values: Column, k: int) -> Column:
    """k elements of an array at even steps with both ends, rounding half to even; all of a shorter array."""
    n = F.size(values)
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.element_at(values, (F.bround(i * (n - 1) / F.lit(float(k - 1)), 0) + 1).cast("int")))
    return F.when(n <= k, values).when(F.lit(k == 1), F.slice(values, 1, 1)).otherwise(spread)


def rotation(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(key, other): a derangement in which no row meets one of its own group, where the largest group allows it.

    Rows stand in order of descending group size; each meets the one a largest group's length further."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size"))
    shift, total = sizes.agg(F.max("_size"), F.sum("_size")).first()
    if not total:
        return rows.select(key, F.col(key).alias("other"))
    # Place = rows of groups before it + place in its group: the window over groups is one row a group.
    order = Window.orderBy(F.desc("_size"), F.col(group).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(order), F.lit(0))).drop("_size")
    inside = placed(rows.select(key, group), [group], [F.asc(key)], "_in")
    stood = with_totals(inside, [group], starts).withColumn("_at", F.col("_start") + F.col("_in") - 1)
    other = stood.select(F.pmod(F.col("_at") - shift, F.lit(total)).alias("_at"), F.col(key).alias("other"), F.col(group).alias("other_group"))
    return stood.join(other, "_at").select(key, group, "other", "other_group")


def cycle_pad(rows: DataFrame, seed: str, key: str, count: int) -> DataFrame:
    """``count`` rows with ``repeat_index`` from 0: the rows in hash order, over and over; none from an empty table."""
    n = rows.count()
    if n == 0:
        return rows.withColumn("repeat_index", F.lit(0).cast("long"))
    at = hash_placed(rows, [], hash_key(seed, F.col(key)), key, "_at").withColumn("_at", F.col("_at") - 1).filter(F.col("_at") < count)
    return at.withColumn("repeat_index", F.explode(F.sequence("_at", F.lit(count - 1).cast("long"), F.lit(n).cast("long")))).drop("_at")


def epoch_draws(rows: DataFrame, seed: str, key: str, epochs: int, world: int) -> DataFrame:
    """``rows`` once an epoch with ``epoch``, ``draw`` and ``rank``: each epoch in a hash order of its own, dealt in turn to the ranks.

    Draws go on through the epochs: draw * world + rank = epoch * rows + place."""
    n = rows.count()
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    at = hash_placed(each, ["epoch"], hash_key(seed, F.col("epoch"), F.col(key)), key, "_at")
    place = F.col("epoch") * F.lit(n) + F.col("_at") - 1
    return at.withColumn("draw", F.floor(place / world)).withColumn("rank", F.pmod(place, F.lit(world))).drop("_at")


def manifest_order(rows: DataFrame, manifest: DataFrame, key: str, ordinal: str, name: str = "place") -> DataFrame:
    """``rows`` with their place from 1: in the order of the manifest (a row a key), rows it doesn't name at the end by key."""
    named = rows.join(manifest.select(key, F.col(ordinal).alias("_ordinal")), key, "left")
    return placed(named, [], [F.col("_ordinal").asc_nulls_last(), F.asc(key)], name).drop("_ordinal")


def resolved_split(rows: DataFrame, explicit: DataFrame, seed: str, key: str, share: float) -> DataFrame:
    """``rows`` with ``split``: what ``explicit`` (key, split) says, the other of train and test for rows of a half-given split, else by hash.

    Where explicit names only test rows all others are train, and the other way round; where it names neither, ``share`` goes to train.
    A key with two different splits is an error."""
    given = explicit.groupBy(key).agg(F.min("split").alias("_given"), F.max("split").alias("_other"))
    given = given.withColumn("_given", F.when(F.col("_given") == F.col("_other"), F.col("_given")).otherwise(F.raise_error(F.concat(F.lit("in both splits: "), F.col(key).cast("string"))))).drop("_other")
    kinds = {r[0] for r in explicit.select("split").distinct().limit(3).collect()}
    rest = {frozenset({"test"}): F.lit("train"), frozenset({"train"}): F.lit("test")}.get(frozenset(kinds), F.when(hash_unit(hash_key(seed, F.col(key))) < share, "train").otherwise("test"))
    return rows.join(given, key, "left").withColumn("split", F.coalesce("_given", rest)).drop("_given")
