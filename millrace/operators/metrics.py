"""Evaluation metrics as grouped aggregations and windows.

A tie in scores always counts as one step: ranks are averaged (AUC) and tied rows
enter a curve together (average precision, threshold sweeps), so curves are first
reduced to one row per group and score, which is what is sorted and accumulated.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .order import placed, running, with_totals


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, and ``empty`` where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def confusion(rows: DataFrame, by: list[str], gold: Column, predicted: Column) -> DataFrame:
    """tp, fp, tn, fn, unknown (no prediction) and the rates from them; an unknown on a positive counts against recall."""
    g, p = gold.cast("boolean"), predicted.cast("boolean")
    agg = rows.groupBy(*by).agg(
        F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(~g & ~p).alias("tn"),
        F.count_if(g & (~p | p.isNull())).alias("fn"), F.count_if(p.isNull()).alias("unknown"), F.count_if(g).alias("pos"), F.count_if(~g).alias("neg"),
    )
    c = F.col
    agg = agg.withColumns({
        "accuracy": ratio(c("tp") + c("tn"), c("pos") + c("neg")), "precision": ratio(c("tp"), c("tp") + c("fp")),
        "recall": ratio(c("tp"), c("pos")), "specificity": ratio(c("tn"), c("neg")),
    })
    return agg.withColumns({"balanced_accuracy": (c("recall") + c("specificity")) / 2, "f1": ratio(2 * c("precision") * c("recall"), c("precision") + c("recall"))})


def _steps(rows: DataFrame, by: list[str], score: str, label: str, times: str | None = None) -> DataFrame:
    """One row per group and score: positives and negatives there; non-finite scores and other labels are left out.

    A row counts ``times`` times, once without it."""
    w = F.lit(1) if times is None else F.col(times)
    s = F.col(score).cast("double")
    ok = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")) & F.col(label).isin(0, 1)
    return rows.filter(ok).groupBy(*by, s.alias("_s")).agg(F.sum(w * F.col(label)).cast("long").alias("_p"), F.sum(w * (1 - F.col(label))).cast("long").alias("_n"))


def roc_auc(rows: DataFrame, by: list[str], score: str, label: str, empty: str = "null") -> DataFrame:
    """``by``, pos, neg, auc by average ranks; ``empty`` is what a missing class gives: nan, zero or null."""
    steps = running(_steps(rows, by, score, label), by, [F.asc("_s")], {"_upto": F.col("_n")}).withColumn("_wins", F.col("_p") * (F.col("_upto") - F.col("_n") / 2))
    agg = steps.groupBy(*by).agg(F.sum("_p").alias("pos"), F.sum("_n").alias("neg"), F.sum("_wins").alias("_w"))
    missing = {"nan": float("nan"), "zero": 0.0, "null": None}[empty]
    return agg.select(*by, "pos", "neg", ratio(F.col("_w"), F.col("pos") * F.col("neg"), missing).alias("auc"))


def average_precision(rows: DataFrame, by: list[str], score: str, label: str, times: str | None = None) -> DataFrame:
    """``by``, pos, ap: sum over scores from the top of precision times the gain in recall; 0 without positives."""
    steps = running(_steps(rows, by, score, label, times), by, [F.desc("_s")], {"_tp": F.col("_p"), "_all": F.col("_p") + F.col("_n")})
    agg = steps.groupBy(*by).agg(F.sum("_p").alias("pos"), F.sum(F.col("_p") * F.col("_tp") / F.col("_all")).alias("_a"))
    return agg.select(*by, "pos", ratio(F.col("_a"), F.col("pos")).alias("ap"))


def _cuts(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """0, 1 and all scores of each group with what stands at or above them (``_tp``, ``_fp``), how many candidates do (``_down``), and totals."""
    ends = F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("_s")
    each = _steps(rows, by, score, label)
    none = each.select(*by).distinct().select(*by, ends, F.lit(0).cast("long").alias("_p"), F.lit(0).cast("long").alias("_n"))
    each = each.unionByName(none).groupBy(*by, "_s").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    steps = running(each, by, [F.desc("_s")], {"_tp": F.col("_p"), "_fp": F.col("_n"), "_down": F.lit(1).cast("long")})
    return with_totals(steps, by, steps.groupBy(*by).agg(F.sum("_p").alias("_pos"), F.sum("_n").alias("_neg"), F.count("*").alias("_m")))


def _on_grid(steps: DataFrame, by: list[str], grid: int) -> DataFrame:
    """``steps`` of groups with at most ``grid`` candidates; of larger ones the ``grid`` evenly spaced quantiles, linear between two candidates.

    A threshold between two candidates counts as the upper one does.  The candidate at place j from 0 is the upper end of
    at most one quantile and the lower end of at most one, so quantiles are grouped from their two ends."""
    few, many = steps.filter(F.col("_m") <= grid), steps.filter(F.col("_m") > grid)
    at, span, parts = F.col("_m") - F.col("_down"), F.col("_m") - 1, grid - 1
    up, low = F.floor(at * parts / span), F.ceil(at * parts / span)
    ends = F.array(
        F.when(F.ceil(up * span / parts) == at, F.struct(up.alias("i"), F.lit(True).alias("up"))),
        F.when(F.floor(low * span / parts) == at, F.struct(low.alias("i"), F.lit(False).alias("up"))),
    )
    each = many.withColumn("_e", F.explode(F.array_compact(ends)))
    upper = lambda c: F.max(F.when(F.col("_e.up"), F.col(c))).alias(c)
    made = each.groupBy(*by, F.col("_e.i").alias("_i")).agg(F.max(F.when(~F.col("_e.up"), F.col("_s"))).alias("_lo"), *[upper(c) for c in ("_s", "_tp", "_fp", "_pos", "_neg", "_m")])
    place = F.col("_i") * (F.col("_m") - 1) / parts
    made = made.withColumn("_s", F.col("_lo") + (F.col("_s") - F.col("_lo")) * (place - F.floor(place)))
    names = [*by, "_s", "_tp", "_fp", "_pos", "_neg"]
    return few.select(*names).unionByName(made.select(*names))


def threshold_sweep(rows: DataFrame, by: list[str], score: str, label: str, goal: str = "balanced_accuracy", grid: int | None = None) -> DataFrame:
    """Best threshold of ``score >= t`` by ``goal`` (balanced_accuracy or f1); ties go to the nearest 0.5, then the larger.

    Candidates are 0, 1 and all scores of the group, however many; with ``grid`` and more of them, their ``grid`` even quantiles."""
    steps = _cuts(rows, by, score, label)
    if grid:
        steps = _on_grid(cut(steps, "steps"), by, grid)
    value = {
        "balanced_accuracy": (ratio(F.col("_tp"), F.col("_pos")) + 1 - ratio(F.col("_fp"), F.col("_neg"))) / 2,
        "f1": ratio(2 * F.col("_tp"), F.col("_tp") + F.col("_fp") + F.col("_pos")),
    }[goal]
    best = steps.withColumn("_v", F.round(value, 12)).groupBy(*by).agg(F.max(F.struct("_v", (-F.abs(F.col("_s") - 0.5)).alias("_d"), "_s")).alias("_b"))
    return best.select(*by, F.col("_b._s").alias("threshold"), F.col("_b._v").alias(goal))


def two_level_variance(rows: DataFrame, outer: list[str], inner: list[str], value: str, tiny: float = 1e-12) -> DataFrame:
    """Per outer group: inner groups, the share of them whose population deviation is (nearly) 0, and their mean deviation."""
    each = rows.groupBy(*outer, *inner).agg(F.stddev_pop(value).alias("_sd"))
    return each.groupBy(*outer).agg(F.count("*").alias("groups"), F.avg((F.col("_sd") <= tiny).cast("double")).alias("zero_variance_rate"), F.avg("_sd").alias("mean_std"))


def order_statistics(rows: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each group the values that stand at ``places``, functions of the group's count n to a place from 0; nulls don't count.

    Values are counted first and places are running counts over range partitions: no task holds a group's values."""
    each = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    upto = cut(running(each, by, [F.col(value)], {"_upto": F.col("_n")}), "upto")
    placed = with_totals(upto, by, upto.groupBy(*by).agg(F.sum("_n").alias("_all")))
    at = {name: place(F.col("_all")) for name, place in places.items()}
    return placed.groupBy(*by).agg(*[F.max(F.when((F.col("_upto") - F.col("_n") <= a) & (a < F.col("_upto")), F.col(value))).alias(name) for name, a in at.items()])


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each group the exact quantiles of ``value``, linear between the two values around the place share * (n - 1)."""
    places = {}
    for name, share in shares.items():
        places[f"{name}_lo"] = lambda n, p=share: F.floor(p * (n - 1))
        places[f"{name}_hi"] = lambda n, p=share: F.ceil(p * (n - 1))
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("_all"))
    found = with_totals(order_statistics(rows, by, value, places), by, counted)
    part = lambda p: F.lit(p) * (F.col("_all") - 1) - F.floor(F.lit(p) * (F.col("_all") - 1))
    return found.select(*by, *[(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * part(p)).alias(n) for n, p in shares.items()])


def set_f1(gold: Column, predicted: Column) -> Column:
    """F1 of two label arrays; 1 where both are empty."""
    common = F.size(F.array_intersect(gold, predicted))
    total = F.size(F.array_distinct(gold)) + F.size(F.array_distinct(predicted))
    return F.when(total == 0, F.lit(1.0)).otherwise(ratio(2 * common, total))


def poisson_steps(most: int = 8) -> list[float]:
    """Cumulative Poisson(1) probabilities of 0, 1, ...: a uniform draw counts the ones it reaches."""
    out, term, at = [], math.exp(-1.0), 0.0
    for k in range(most):
        at += term
        out.append(at)
        term /= k + 1
    return out


def bootstrap_counts(ids: DataFrame, key: str, repeats: int, seed: str) -> DataFrame:
    """(repeat, key, times): how often each id is drawn in each resample, as Poisson(1) weights from a keyed hash.

    Each row decides by itself, so nothing is shuffled and no index of all ids is needed."""
    text = F.concat_ws(":", F.lit(seed), F.col("repeat").cast("string"), F.col(key).cast("string"))
    u = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)
    times = sum(((u >= c).cast("int") for c in poisson_steps()), F.lit(0))
    return ids.select(key).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("times", times).filter("times > 0")


def bootstrap_draws(ids: DataFrame, key: str, repeats: int, seed: str) -> DataFrame:
    """(repeat, key, times): n draws with replacement from n distinct ids in each resample, by a keyed hash of repeat and draw.

    Draws are made by a range over repeats x n, counted by place before they are shuffled, and meet the ids by their
    place in order; ids that a resample doesn't draw have no row there."""
    at = cut(placed(ids.select(key).filter(F.col(key).isNotNull()).distinct(), [], [F.asc(key)], "_at"), "places")
    n = at.count()
    if not n:
        return at.select(F.lit(0).cast("long").alias("repeat"), key, F.lit(0).cast("long").alias("times"))
    draw = F.concat_ws(":", F.lit(seed), F.floor(F.col("id") / n).cast("string"), F.pmod("id", F.lit(n)).cast("string"))
    u = F.conv(F.substring(F.sha2(draw, 256), 1, 13), 16, 10).cast("long")
    drawn = ids.sparkSession.range(repeats * n).select(F.floor(F.col("id") / n).alias("repeat"), (F.pmod(u, F.lit(n)) + 1).alias("_at"))
    return drawn.groupBy("repeat", "_at").agg(F.count("*").alias("times")).join(at, "_at").select("repeat", key, "times")
