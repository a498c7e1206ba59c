"""Gates that compute their own metrics from items: each returns its metrics, the checks that fail and a status.

Thresholds are those of ``gates.NAMED``; statuses beyond passed and failed are stated with each gate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .gates import NAMED, OPS
from .metrics import average_precision, confusion, quantiles, ratio

#: Pairs that a local control needs to be judged at all.
LEAST_PAIRS = 30


def check(gate: str, name: str, value: Column) -> Column:
    """Whether ``value`` passes the named check of a gate; false where it is null or not a number."""
    _, _, op, threshold = next(c for c in NAMED[gate] if c[0] == name)
    return F.coalesce(OPS[op](F.nanvl(value.cast("double"), F.lit(None).cast("double")), F.lit(float(threshold))), F.lit(False))


def failing(checks: dict[str, Column]) -> Column:
    """Names of the checks that are false; those that are null are undecided."""
    return F.array_compact(F.array(*[F.when(~ok, name) for name, ok in checks.items()]))


def joined(parts: list[DataFrame]) -> DataFrame:
    """One-row tables side by side."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # a row each


def transfer_gate(items: DataFrame, control: str, candidate: str, gain: str, moving: tuple[str, ...] = ("minor-motion", "complex-motion")) -> DataFrame:
    """comparison, own_gain, external_accuracy, external_f1, moving_gain, failed, status: what ``candidate`` gains over ``control``.

    ``items`` has branch, part (own or external), bucket, truth and predicted (true for the positive class; null: no valid
    answer, which counts as wrong).  The own gain is the larger one of balanced accuracy and F1, checked against the named check ``gain``
    of the transfer gate; the moving gain is the largest of both over the ``moving`` buckets that both branches have (-1 where there are none)."""
    both = items.filter(F.col("branch").isin(control, candidate))
    truth, said = F.col("truth"), F.coalesce(F.col("predicted"), ~F.col("truth"))
    whole = confusion(both, ["branch", "part"], truth, said)
    each = confusion(both.filter((F.col("part") == "own") & F.col("bucket").isin(*moving)), ["branch", "bucket"], truth, said)

    def change(part: str, metric: str) -> Column:
        at = lambda b: F.max(F.when((F.col("branch") == b) & (F.col("part") == part), F.col(metric)))
        return at(candidate) - at(control)

    of = lambda b, metric: F.max(F.when(F.col("branch") == b, F.col(metric)))
    buckets = each.groupBy("bucket").agg((of(candidate, "balanced_accuracy") - of(control, "balanced_accuracy")).alias("a"), (of(candidate, "f1") - of(control, "f1")).alias("b"))
    moved = buckets.agg(F.coalesce(F.max(F.greatest("a", "b")), F.lit(-1.0)).alias("moving_gain"))
    x = joined([whole.agg(F.greatest(change("own", "balanced_accuracy"), change("own", "f1")).alias("own_gain"), change("external", "accuracy").alias("external_accuracy"), change("external", "f1").alias("external_f1")), moved])
    checks = {
        "own_gain": check("transfer", gain, F.col("own_gain")), "external_accuracy": check("transfer", "external_drop", -F.col("external_accuracy")),
        "external_f1": check("transfer", "external_drop", -F.col("external_f1")), "moving_gain": check("transfer", "moving_bucket_gain", F.col("moving_gain")),
    }
    x = x.withColumn("failed", failing(checks)).withColumn("status", F.when(F.size("failed") == 0, "passed").otherwise("failed"))
    return x.select(F.lit(f"{candidate} over {control}").alias("comparison"), "own_gain", "external_accuracy", "external_f1", "moving_gain", "failed", "status")


def signal_gate(pairs: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and the metrics of localised signals with failed and status: passed, failed, or diagnostic_only where too few pairs
    have true masks to decide formally.

    ``pairs`` has valid, true_mask, labelled, consistent (null: unknown), inside and outside (mean differences; null: no measure).
    Medians and ratios are of the valid pairs; a pair without outside difference has no ratio."""
    good = pairs.filter("valid").withColumn("ratio", F.try_divide("inside", "outside"))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    rates = pairs.groupBy(*by).agg(
        F.count("*").alias("n"), share(F.col("valid")).alias("valid_rate"), share(F.col("valid") & F.col("true_mask")).alias("mask_rate"), share(F.col("labelled")).alias("label_rate"),
        ratio(F.count_if("consistent"), F.count("consistent")).alias("consistent_rate"), ratio(F.count_if(F.col("valid") & (F.col("inside") > F.col("outside"))), F.count_if("valid")).alias("inside_rate"))
    medians = [quantiles(good, by, c, {f"median_{c}": 0.5}) for c in ("ratio", "outside")]
    x = reduce(lambda a, b: a.join(b, by, "left"), [rates, *medians])
    eligible = check("local_signal", "true_masks", F.col("mask_rate"))
    checks = {
        "valid_pairs": check("local_signal", "valid_pairs", F.col("valid_rate")), "true_masks": eligible, "label_coverage": check("local_signal", "label_coverage", F.col("label_rate")),
        "camera_consistency": check("local_signal", "camera_consistency", F.col("consistent_rate")), "median_ratio": check("local_signal", "median_ratio", F.col("median_ratio")),
        "median_outside": check("local_signal", "median_outside", F.col("median_outside")), "inside_over_outside": check("local_signal", "inside_over_outside", F.col("inside_rate")),
    }
    x = x.withColumn("failed", failing(checks))
    return x.withColumn("status", F.when(~eligible, "diagnostic_only").when(F.size("failed") == 0, "passed").otherwise("failed"))


def judge_gate(scores: DataFrame, expected: DataFrame, frames: str, local: tuple[str, ...], original: str = "original") -> DataFrame:
    """coverage, valid_rate, a row's count and rate for each control, its check (true, false, or null below LEAST_PAIRS pairs) and the status.

    ``scores`` has record, variant and score (null: not readable), a row each; ``expected`` record and variant.  A control's rate is
    the share of its records, with both scores readable, whose original scores higher.  The judge passes if coverage, validity, the
    ``frames`` control and at least one decided ``local`` control do."""
    wanted = expected.select("record", "variant").distinct()
    had = wanted.join(scores.select("record", "variant", "score", F.lit(1).alias("_had")), ["record", "variant"], "left")
    base = had.agg(ratio(F.count("_had"), F.count("*")).alias("coverage"), ratio(F.count("score"), F.count("_had")).alias("valid_rate"))
    first = scores.filter(F.col("variant") == original).select("record", F.col("score").alias("_o"))
    pairs = scores.filter(F.col("variant").isin(frames, *local)).join(first, "record").filter("score IS NOT NULL AND _o IS NOT NULL")
    each = pairs.groupBy("variant").agg(F.count("*").alias("n"), F.count_if(F.col("_o") > F.col("score")).alias("higher"))
    names = {v: f"n_{i}" for i, v in enumerate((frames, *local))}
    flat = each.agg(*[F.coalesce(F.max(F.when(F.col("variant") == v, F.col("n"))), F.lit(0)).alias(c) for v, c in names.items()], *[F.max(F.when(F.col("variant") == v, F.try_divide(F.col("higher").cast("double"), F.col("n")))).alias(f"rate_{c[2:]}") for v, c in names.items()])
    x = joined([base, flat])
    enough = {v: F.col(c) >= LEAST_PAIRS for v, c in names.items()}
    seen = enough[frames] & check("judge", "frame_dependence", F.col("rate_0"))
    locals_ = {v: F.when(enough[v], check("judge", "sensitive_to_shifted_box", F.col(f"rate_{names[v][2:]}"))) for v in local}
    any_local = F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in locals_.values()]), F.lit(False))
    required = check("judge", "prediction_coverage", F.col("coverage")) & check("judge", "format_valid", F.col("valid_rate")) & seen & any_local
    rows = [F.struct(F.lit(v).alias("control"), F.col(names[v]).cast("long").alias("n"), F.col(f"rate_{names[v][2:]}").alias("rate"), c.alias("passed")) for v, c in ({frames: seen} | locals_).items()]
    return x.select("coverage", "valid_rate", F.when(required, "passed").otherwise("failed").alias("status"), F.explode(F.array(*rows)).alias("c")).select("c.*", "coverage", "valid_rate", "status")


def condition_metrics(items: DataFrame, least: int = 1) -> DataFrame:
    """condition, coverage, balanced_accuracy, macro_ap, labels, paired_accuracy of yes and no questions.

    ``items`` has condition, question, label, truth and score (null: no answer, which is wrong and scores 0); an answer is yes
    from a score of 0.5 on.  Labels count that have at least ``least`` items of either truth; paired questions share question
    and condition, and are right if all of them are."""
    right = _said(F.col("score")) == F.col("truth")
    pairs = items.groupBy("condition", "question").agg(F.min(right).alias("ok"), F.count("score").alias("m"), F.count("*").alias("n"))
    paired = pairs.groupBy("condition").agg(F.avg(F.col("ok").cast("double")).alias("paired_accuracy"), ratio(F.sum("m"), F.sum("n")).alias("coverage"))
    return _of_cells(items.groupBy("condition", "label", "truth", "score").agg(F.count("*").alias("times")), paired, least)


def metrics_of_conditions(rows: DataFrame, scores: dict[str, Column], least: int = 1) -> DataFrame:
    """``condition_metrics`` of items that have the ``scores`` of all conditions beside question, label and truth.

    Each row is read twice, for its question and for its scores, and no row is made for an item and condition."""
    x = rows.select("question", "label", "truth", *[c.alias(f"_s{i}") for i, c in enumerate(scores.values())])
    all_ = [(i, name, F.col(f"_s{i}")) for i, name in enumerate(scores)]
    each = x.groupBy("question").agg(F.count("*").alias("n"), *[F.min(_said(s) == F.col("truth")).alias(f"ok{i}") for i, _, s in all_], *[F.count(s).alias(f"m{i}") for i, _, s in all_])
    sums = each.agg(*[F.struct(F.lit(name).alias("condition"), F.avg(F.col(f"ok{i}").cast("double")).alias("paired_accuracy"), ratio(F.sum(f"m{i}"), F.sum("n")).alias("coverage")).alias(f"p{i}") for i, name, _ in all_])
    paired = sums.select(F.explode(F.array(*[f"p{i}" for i, _, _ in all_])).alias("p")).select("p.*")
    cells = x.groupBy("label", "truth", *[f"_s{i}" for i, _, _ in all_]).agg(F.count("*").alias("times"))
    cells = cells.select("label", "truth", "times", F.explode(F.array(*[F.struct(F.lit(name).alias("condition"), s.alias("score")) for _, name, s in all_])).alias("c")).select("c.*", "label", "truth", "times")
    return _of_cells(cells, paired, least)


def _said(score: Column) -> Column:
    return F.coalesce(score >= 0.5, ~F.col("truth"))


def _of_cells(cells: DataFrame, paired: DataFrame, least: int) -> DataFrame:
    """The metrics of ``cells`` (condition, label, truth, score, times), beside those of ``paired``."""
    cells = cut(cells.groupBy("condition", "label", "truth", "score").agg(F.sum("times").alias("times")), "cells")
    truth, said = F.col("truth"), _said(F.col("score"))
    n = lambda c: F.sum(F.when(c, F.col("times")).otherwise(0))
    c = cells.groupBy("condition").agg(((ratio(n(truth & said), n(truth)) + ratio(n(~truth & ~said), n(~truth))) / 2).alias("balanced_accuracy"))
    ap = average_precision(cells.withColumns({"_s": F.coalesce("score", F.lit(0.0)), "_t": truth.cast("int")}), ["condition", "label"], "_s", "_t", "times")
    sides = cells.groupBy("condition", "label").agg(n(truth).alias("p"), n(~truth).alias("q")).filter(F.least("p", "q") >= least)
    macro = sides.join(ap, ["condition", "label"]).groupBy("condition").agg(F.avg("ap").alias("macro_ap"), F.count("*").alias("labels"))
    return cut(c.join(paired, "condition").join(macro, "condition", "left").na.fill(0, ["macro_ap", "labels"]), "metrics")


def _flat(metrics: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """One row with a column ``<name>_<metric>`` for each named condition."""
    names = [c for c in metrics.columns if c != "condition"]
    return metrics.agg(*[F.max(F.when(F.col("condition") == c, F.col(m))).alias(f"{n}_{m}") for n, c in conditions.items() for m in names])


def question_gate(metrics: DataFrame, epochs: float, base: str, middle: str, final: str, opposite: str, nothing: str) -> DataFrame:
    """failed and status (passed, failed) of learning binary questions, from ``condition_metrics``; absent conditions fail their checks."""
    conditions = {"base": base, "middle": middle, "final": final, "opposite": opposite, "nothing": nothing}
    x = _flat(metrics, conditions)
    over = lambda m, a: F.col(f"final_{m}") - F.col(f"{a}_{m}")
    present = reduce(lambda a, b: a & b, [F.col(f"{n}_coverage").isNotNull() for n in conditions])
    g = lambda name, v: check("binary_questions", name, v)
    checks = {
        "coverage": present & g("coverage", F.least(*[F.col(f"{n}_coverage") for n in conditions])), "enough_labels": g("enough_labels", F.col("final_labels")), "trained_an_epoch": g("trained_an_epoch", F.lit(epochs)),
        "macro_ap": g("macro_ap", F.col("final_macro_ap")), "balanced_accuracy": g("balanced_accuracy", F.col("final_balanced_accuracy")), "paired_accuracy": g("paired_accuracy", F.col("final_paired_accuracy")),
        "learned_over_base": g("learned_over_base", over("macro_ap", "base")), "uses_payload": g("uses_payload", over("balanced_accuracy", "nothing")), "responds_to_opposite": g("responds_to_opposite", over("balanced_accuracy", "opposite")),
    }
    return x.withColumn("failed", failing(checks)).withColumn("status", F.when(F.size("failed") == 0, "passed").otherwise("failed")).select("failed", "status")


def joint_gate(metrics: DataFrame, ready: bool, correct: str, shuffled: str, opposite: str, nothing: str) -> DataFrame:
    """failed and status of joint training: passed_for_short_rl, borderline_short_rl_only (all but coverage and the gain over flipped
    targets hold) or not_ready_for_rl.  Either gain over flipped targets and either drop without the right frames is enough."""
    x = _flat(metrics, {"c": correct, "s": shuffled, "o": opposite, "n": nothing})
    g = lambda name, v: check("joint_training", name, v)
    ba = F.col("c_balanced_accuracy")
    checks = {
        "coverage": check("binary_questions", "coverage", F.col("c_coverage")), "enough_labels": g("supported_labels", F.col("c_labels")),
        "beats_flipped": g("macro_ap_over_shuffled", F.col("c_macro_ap") - F.col("s_macro_ap")) | g("balanced_over_shuffled", ba - F.col("s_balanced_accuracy")),
        "depends_on_frames": g("opposite_drop", ba - F.col("o_balanced_accuracy")) | g("no_frame_drop", ba - F.col("n_balanced_accuracy")), "exploration": F.lit(ready),
    }
    short = checks["depends_on_frames"] & checks["exploration"] & checks["enough_labels"]
    x = x.withColumn("failed", failing(checks))
    return x.select("failed", F.when(F.size("failed") == 0, "passed_for_short_rl").when(short, "borderline_short_rl_only").otherwise("not_ready_for_rl").alias("status"))


def improvement_gate(changes: DataFrame) -> DataFrame:
    """least, best, failed, status from the changes (metric, change) of a checkpoint's primary metrics: none may fall, one must rise.  No change known: failed."""
    x = changes.agg(F.min("change").alias("least"), F.max("change").alias("best"))
    checks = {"no_regression": check("improvement", "no_regression", F.col("least")), "gain": check("improvement", "gain", F.col("best"))}
    return x.withColumn("failed", failing(checks)).withColumn("status", F.when(F.size("failed") == 0, "passed").otherwise("failed"))
