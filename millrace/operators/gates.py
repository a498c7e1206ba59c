"""Decision tables, reasoned filters and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "==": lambda a, b: a == b}


# The thresholds of the named gates, as (check, metric, op, threshold).
NAMED = {
    "pair_choice": [
        ("pair_choice_accuracy", "accuracy", ">=", 0.70), ("swap_consistency", "consistent", ">=", 0.85), ("chose_a_lower", "chose_a", ">=", 0.45),
        ("chose_a_upper", "chose_a", "<=", 0.55), ("choice_format_valid", "valid_rate", ">=", 0.95),
    ],
    "pair_localisation": [("mean_box_iou", "mean_iou", ">=", 0.30), ("box_format_valid", "box_valid_rate", ">=", 0.95)],
    "transfer": [
        ("pair_gain", "pair_gain", ">=", 0.03), ("camera_extra_gain", "camera_extra_gain", ">=", 0.01), ("external_drop", "external_drop", "<=", 0.01),
        ("moving_bucket_gain", "moving_bucket_gain", ">=", 0.01),
    ],
    "local_signal": [
        ("valid_pairs", "valid_pair_rate", ">=", 0.90), ("true_masks", "true_mask_rate", ">=", 0.90), ("camera_consistency", "camera_consistency", ">=", 0.98),
        ("label_coverage", "label_coverage", ">=", 0.90), ("median_ratio", "median_ratio", ">=", 2.0), ("median_outside", "median_outside", "<=", 0.03),
        ("inside_over_outside", "inside_over_outside", ">=", 0.70),
    ],
    "judge": [
        ("prediction_coverage", "coverage", ">=", 0.98), ("format_valid", "valid_rate", ">=", 0.95), ("frame_dependence", "over_shuffled_frames", ">=", 0.70),
        ("sensitive_to_shifted_box", "over_shifted_box", ">=", 0.65), ("sensitive_to_shifted_time", "over_shifted_time", ">=", 0.65),
        ("sensitive_to_swapped_type", "over_swapped_type", ">=", 0.65),
    ],
    "pair_ranking": [
        ("coverage", "coverage", ">=", 0.99), ("auc_delta", "auc_delta", ">=", 0.03), ("pair_accuracy_delta", "pair_accuracy_delta", ">=", 0.05),
        ("complex_auc_delta", "complex_auc_delta", ">=", 0.03), ("source_auc_drop", "worst_source_auc_drop", "<=", 0.02),
    ],
    "pretext_stage_1": [
        ("coverage", "coverage", ">=", 0.99), ("format_valid", "valid_rate", ">=", 0.95), ("macro_f1_beats_base", "macro_f1_over_base", ">=", 0.10),
        ("macro_f1_beats_shuffled", "macro_f1_over_shuffled", ">=", 0.10), ("bucket_not_collapsed", "bucket_accuracy", ">=", 0.50),
        ("bucket_balanced_accuracy", "bucket_balanced_accuracy", ">=", 0.45), ("all_buckets_predicted", "predicted_buckets", ">=", 3),
    ],
    "visual_dependence": [
        ("bucket_balanced_accuracy", "bucket_balanced_accuracy", ">=", 0.45), ("buckets_predicted", "predicted_buckets", ">=", 3),
        ("micro_f1_drop", "micro_f1_drop", ">=", 0.05), ("macro_f1_drop", "macro_f1_drop", ">=", 0.03), ("bucket_balanced_drop", "bucket_balanced_drop", ">=", 0.10),
    ],
    "pretext_stage_2": [
        ("coverage", "coverage", ">=", 0.99), ("auc_delta", "auc_delta", ">=", 0.02), ("pair_accuracy_delta", "pair_accuracy_delta", ">=", 0.03),
        ("complex_auc_delta", "complex_auc_delta", ">=", 0.02), ("positive_sources", "positive_sources", ">=", 2),
    ],
    "binary_questions": [
        ("coverage", "least_coverage", ">=", 0.99), ("enough_labels", "supported_labels", ">=", 20), ("trained_an_epoch", "epochs", ">=", 1.0),
        ("macro_ap", "macro_ap", ">=", 0.65), ("balanced_accuracy", "balanced_accuracy", ">=", 0.60), ("paired_accuracy", "paired_accuracy", ">=", 0.35),
        ("learned_over_base", "macro_ap_over_base", ">=", 0.08), ("uses_payload", "balanced_over_no_payload", ">=", 0.08),
        ("responds_to_opposite", "balanced_over_opposite", ">=", 0.15),
    ],
    "joint_training": [
        ("supported_labels", "supported_labels", ">=", 20), ("macro_ap_over_shuffled", "macro_ap_over_shuffled", ">=", 0.03),
        ("balanced_over_shuffled", "balanced_over_shuffled", ">=", 0.05), ("opposite_drop", "opposite_drop", ">=", 0.10), ("no_frame_drop", "no_frame_drop", ">=", 0.08),
    ],
    "retention": [
        ("coverage", "coverage", ">=", 0.99), ("format_valid", "valid_rate", ">=", 0.95), ("balanced_accuracy_drop", "balanced_accuracy_drop", "<=", 0.03),
        ("fake_f1_drop", "fake_f1_drop", "<=", 0.03), ("pair_accuracy_drop", "pair_accuracy_drop", "<=", 0.03),
    ],
    "readiness": [
        ("coverage", "coverage", ">=", 0.99), ("expected_samples", "complete_rate", ">=", 1.0), ("format_exploration", "format_pass_at_k", ">=", 0.90),
        ("correct_exploration", "correct_pass_at_k", ">=", 0.50), ("both_answers", "both_answers_rate", ">=", 0.10), ("reward_varies", "reward_variance_rate", ">=", 0.20),
    ],
    "improvement": [("no_regression", "least_primary_gain", ">=", -0.001), ("gain", "best_primary_gain", ">=", 0.005)],
    "feature_audit": [
        ("coverage", "coverage", ">=", 0.95), ("positive_masks", "positive_mask_rate", ">=", 0.90), ("aligned_cases", "aligned_valid_rate", ">=", 0.95),
        ("inlier_rate", "median_inlier_rate", ">=", 0.50), ("pair_error", "median_pair_error", "<=", 0.02), ("no_invalid_files", "invalid_files", "<=", 0),
    ],
    "probe": [
        ("coverage", "coverage", ">=", 0.95), ("train_coverage", "train_coverage", ">=", 0.95), ("test_coverage", "test_coverage", ">=", 0.95), ("auc_gain", "auc_gain", ">=", 0.03),
        ("complex_auc_gain", "complex_auc_gain", ">=", 0.03), ("static_auc_gain", "static_auc_gain", ">=", -0.02), ("interval_above_zero", "gain_low", ">", 0),
    ],
    "fusion": [
        ("over_unaligned", "fused_over_unaligned", ">=", 0.01), ("over_global", "fused_over_global", ">=", 0.01), ("complex_over_unaligned", "fused_complex_over_unaligned", ">=", 0.01),
        ("interval_over_unaligned", "unaligned_low", ">", 0), ("interval_over_global", "global_low", ">", 0),
    ],
}

#: What a named gate is called when it passes, what else it may be called under which condition, and what if none holds.
VERDICTS = {
    "readiness": ("rl_ready", [("borderline", "coverage >= 0.99 AND reward_variance_rate > 0")], "not_ready"),
    "probe": ("passed", [("failed", "auc_gain <= 0 OR complex_auc_gain <= 0")], "inconclusive"),
}


def gate(metrics: DataFrame, checks: list[tuple[str, str, str, float]]) -> DataFrame:
    """One row per (name, metric, op, threshold) of a one-row metrics table: check, value, op, threshold, passed.

    A metric that is null or NaN leaves ``passed`` null: undecided, not failed."""
    made = []
    for name, metric, op, threshold in checks:
        v = F.nanvl(F.col(metric).cast("double"), F.lit(None).cast("double"))
        made.append(F.struct(F.lit(name).alias("check"), v.alias("value"), F.lit(op).alias("op"), F.lit(float(threshold)).alias("threshold"), OPS[op](v, F.lit(float(threshold))).alias("passed")))
    return metrics.select(F.explode(F.array(*made)).alias("c")).select("c.*")


def verdict(metrics: DataFrame, name: str) -> DataFrame:
    """``metrics`` (any number of rows) with ``failed``, the checks of the named gate that don't hold, and ``verdict``.

    A null or NaN metric fails its check here."""
    missed = []
    for check, metric, op, threshold in NAMED[name]:
        v = F.nanvl(F.col(metric).cast("double"), F.lit(None).cast("double"))
        missed.append(F.when(~F.coalesce(OPS[op](v, F.lit(float(threshold))), F.lit(False)), check))
    good, others, last = VERDICTS.get(name, ("passed", [], "failed"))
    out = F.when(F.size("failed") == 0, good)
    for called, condition in others:
        out = out.when(F.expr(condition), called)
    return metrics.withColumn("failed", F.array_compact(F.array(*missed))).withColumn("verdict", out.otherwise(last))


def status(checked: DataFrame) -> DataFrame:
    """passed if all are, failed if any is, else inconclusive."""
    agg = checked.agg(F.bool_and(F.coalesce("passed", F.lit(True))).alias("ok"), F.count_if(F.col("passed").isNull()).alias("open"), F.count("*").alias("checks"))
    return agg.select("checks", F.col("open").alias("undecided"), F.when(~F.col("ok"), "failed").when(F.col("open") > 0, "inconclusive").otherwise("passed").alias("status"))


def failed_rules(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, in order, as an array."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, or null: the row is kept."""
    out = None
    for n, c in rules:
        out = F.when(c, n) if out is None else out.when(c, n)
    return out


def expect(violations: dict[str, DataFrame]) -> DataFrame:
    """(expectation, violations): how many rows of each table of offenders there are."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(n).alias("expectation"), "violations") for n, df in violations.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require(checked: DataFrame) -> None:
    bad = checked.filter("violations > 0").collect()  # a row per expectation
    if bad:
        raise ValueError("; ".join(f"{r.expectation}: {r.violations}" for r in bad))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).count().filter("count > 1")


def manifest_faults(rows: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(key, fault): ``missing <field>`` once for a key with a null or blank required field, ``repeated`` for a key of several rows.

    Rows with a null key count as rows of one key."""
    blank = lambda f: F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == ""
    flags = [(f"missing {f}", F.max(blank(f))) for f in required] + [("repeated", F.count("*") > 1)]
    each = rows.groupBy(key).agg(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags])).alias("_f"))
    return each.select(key, F.explode("_f").alias("fault"))


def coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, filled, rows, share): rows whose field is neither null nor empty."""
    counts = rows.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) != "").alias(f"_{f}") for f in fields])
    made = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("filled")) for f in fields])
    return counts.select("rows", F.explode(made).alias("c")).select("c.field", "c.filled", "rows", F.coalesce(F.try_divide(F.col("c.filled").cast("double"), F.col("rows")), F.lit(0.0)).alias("share"))
