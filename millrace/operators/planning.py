"""Plans of cases: weighted draws, repair by tiers, validation, continuation, pair manifests, score fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import metrics
from .order import with_totals
from .sampling import hash_key, hash_unit


def weighted_choice(rows: DataFrame, by: list[str], key: str, weight: str, seed: str) -> DataFrame:
    """One row a group, with probability in proportion to its weight: the least -ln(u) / w of hash fractions u.

    Groups without a positive weight choose evenly."""
    u = F.greatest(hash_unit(hash_key(seed, *[F.col(b) for b in by], F.col(key))), F.lit(1e-16))
    w = F.greatest(F.col(weight).cast("double"), F.lit(0.0))
    total = rows.groupBy(*by).agg(F.sum(w).alias("_total"))
    drawn = rows.join(total, by).withColumn("_w", F.when(F.col("_total") > 0, w).otherwise(1.0)).filter("_w > 0")
    best = drawn.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), F.struct((-F.ln(u) / F.col("_w")).alias("d"), F.col(key))).alias("_r"))
    return best.select("_r.*")


def _best(candidates: DataFrame, target: str, tiers: list[tuple[str, Column]], score: str, donor: str) -> DataFrame:
    """(target, _b): the least struct of tier number, negative score, donor and tier."""
    number, name = None, None
    for i, (n, c) in enumerate(tiers):
        number = F.when(c, i) if number is None else number.when(c, i)
        name = F.when(c, n) if name is None else name.when(c, n)
    ranked = candidates.withColumns({"_tier": number, "tier": name}).filter("_tier IS NOT NULL")
    return ranked.groupBy(target).agg(F.min(F.struct("_tier", (-F.col(score)).alias("_s"), F.col(donor).alias("_d"), "tier")).alias("_b"))


def repair(candidates: DataFrame, target: str, tiers: list[tuple[str, Column]], score: str, donor: str) -> DataFrame:
    """(target, donor, tier): the best donor of the first tier that any candidate reaches; tiers are (name, condition) in order."""
    return _best(candidates, target, tiers, score, donor).select(target, F.col("_b._d").alias(donor), "_b.tier")


def repair_by_class(targets: DataFrame, target: str, traits: list[str], donors: DataFrame, on: list[str], tiers: list[tuple[str, Column]], score: str, donor: str) -> DataFrame:
    """``repair`` of ``targets`` whose candidates are the ``donors`` equal in ``on`` and whose tiers read no target columns but ``traits``.

    Targets with equal traits have the same best donor, so candidates are made for each different tuple of traits (``on``
    are among them), not for each target; targets with a null in ``on`` have no candidate."""
    own = F.struct(*traits)
    each = targets.select(*traits).distinct().withColumn("_class", own)
    best = _best(each.join(donors, on), "_class", tiers, score, donor)
    mine = targets.select(target, own.alias("_class")).join(best, "_class").groupBy(target).agg(F.min("_b").alias("_b"))
    return mine.select(target, F.col("_b._d").alias(donor), "_b.tier")


def _marked(rows: DataFrame, key: str, most: int, name: str) -> DataFrame:
    """``rows`` with ``name``, true where more than ``most`` of them have their ``key``: counts that are joined, so that no task
    holds all rows of a key."""
    over = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("_k", F.lit(True).alias(name))
    return rows.join(over, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def validate_plan(plan: DataFrame, case: str, target: str, donor: str, needs_donor: Column, donor_cap: int) -> DataFrame:
    """A row (case, error) for each fault: case repeated, target reused, donor missing, donor is the target, donor over its cap."""
    x = plan.withColumn("_needs", needs_donor).select(case, target, donor, "_needs")
    x = _marked(_marked(_marked(x, donor, donor_cap, "_donors"), target, 1, "_targets"), case, 1, "_cases")
    known = F.col(donor).isNotNull()
    errors = F.array_compact(F.array(
        F.when(F.col("_cases"), "case_repeated"), F.when(F.col("_targets"), "target_reused"), F.when(F.col("_needs") & ~known, "donor_missing"),
        F.when(F.col(donor) == F.col(target), "donor_is_target"), F.when(F.col("_donors") & known, "donor_limit_exceeded"),
    ))
    return x.select(case, F.explode(errors).alias("error"))


def runnable(plan: DataFrame, errors: DataFrame, case: str) -> tuple[DataFrame, DataFrame]:
    """The cases without an error, and those with (their errors joined in order)."""
    bad = errors.groupBy(case).agg(F.array_join(F.array_sort(F.collect_set("error")), ",").alias("errors"))
    return plan.join(bad.select(case), case, "left_anti"), plan.join(bad, case)


def continuation(cases: DataFrame, case: str, video: str, ordinal: str, done_cases: DataFrame, done_videos: DataFrame) -> DataFrame:
    """``decision`` for each case: completed_case, completed_video, keep for the first open case of a video, else reserve."""
    x = cases.join(done_cases.select(case).distinct().withColumn("_dc", F.lit(True)), case, "left").join(done_videos.select(video).distinct().withColumn("_dv", F.lit(True)), video, "left")
    open_ = F.col("_dc").isNull() & F.col("_dv").isNull()
    first = F.row_number().over(Window.partitionBy(video, open_).orderBy(ordinal, case)) == 1
    return x.withColumn("decision", F.when(F.col("_dc"), "completed_case").when(F.col("_dv"), "completed_video").when(first, "keep").otherwise("reserve")).select(*cases.columns, "decision")


def continue_by_strategy(cases: DataFrame, case: str, video: str, ordinal: str, done_cases: DataFrame, done_videos: DataFrame, selected: Column, strategies: list[tuple[str, Column]]) -> DataFrame:
    """``decision`` for each case: completed_case, completed_video, no_selection, rerun where no strategy holds, reserve where
    an earlier open case (by ordinal, then case) with a strategy takes the video, else the first strategy that holds.

    ``selected`` says whether the video has a selection; null conditions don't hold.  Cases are distinct; a case without a
    video has no selection.  The case that takes a video is one aggregate, no window over a video's cases."""
    name = F.coalesce(*[F.when(c, F.lit(n)) for n, c in strategies])
    early = F.when(F.col("_dc"), "completed_case").when(F.col("_dv"), "completed_video").when(~F.coalesce(selected, F.lit(False)) | F.col(video).isNull(), "no_selection").when(name.isNull(), "rerun")
    mark = lambda done, key, flag: done.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    x = with_totals(with_totals(cases, [case], mark(done_cases, case, "_dc")), [video], cut(mark(done_videos, video, "_dv"), "done"))
    x = cut(x.withColumns({"_early": early, "_name": name}), "cases")
    takes = x.filter("_early IS NULL").groupBy(video).agg(F.min(F.struct(ordinal, case)).alias("_f")).select(video, F.col(f"_f.{case}").alias("_taker"))
    x = with_totals(x, [video], cut(takes, "takers"))
    decision = F.coalesce("_early", F.when(F.col(case) == F.col("_taker"), F.col("_name")).otherwise("reserve"))
    return x.select(*cases.columns, decision.alias("decision"))


def pair_label_status(pairs: DataFrame, pair: str, side: str, label: str) -> DataFrame:
    """both_known_consistent, both_known_mismatch, one_sided or missing, for pairs that have both sides."""
    g = pairs.groupBy(pair).agg(F.count_distinct(side).alias("sides"), F.count(label).alias("known"), F.min(label).alias("lo"), F.max(label).alias("hi")).filter("sides = 2")
    return g.select(pair, F.when((F.col("known") == 2) & (F.col("lo") == F.col("hi")), "both_known_consistent").when(F.col("known") == 2, "both_known_mismatch").when(F.col("known") == 1, "one_sided").otherwise("missing").alias("status"))


def fuse_scores(rows: DataFrame, a: str, b: str, label: str, alphas: list[float]) -> DataFrame:
    """(alpha, auc) of the smallest alpha for which z(a) + alpha z(b) has the best AUC.  Moments are one aggregate; the grid is exploded per row."""
    m = rows.agg(*[f(c).alias(n) for c, n in ((a, "a"), (b, "b")) for f, n in ((F.avg, f"m{n}"), (F.stddev_pop, f"s{n}"))]).first()
    z = lambda c, mean, sd: (F.col(c) - float(mean or 0)) / float(sd or 1.0)
    grid = rows.select(label, z(a, m.ma, m.sa).alias("za"), z(b, m.mb, m.sb).alias("zb"), F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    auc = metrics.roc_auc(grid.withColumn("s", F.round(F.col("za") + F.col("alpha") * F.col("zb"), 9)), ["alpha"], "s", label)
    return auc.select(F.max(F.struct(F.round("auc", 9).alias("auc"), (-F.col("alpha")).alias("n"))).alias("x")).select((-F.col("x.n")).alias("alpha"), F.col("x.auc").alias("auc"))
