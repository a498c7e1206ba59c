"""Audit of releases: what their rows and files establish, and what they may be used for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import ratio

#: Share of rows that evidence must cover, and of decoded samples that must succeed.
COVERED, DECODED = 0.8, 0.95


def normalised_name(name: Column) -> Column:
    """The file's stem in lower case, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.element_at(F.split(name, "/"), -1)), r"\.[^.]*$", ""), "[^a-z0-9]", "")


def release_checks(rows: DataFrame, files: DataFrame, expected: dict[str, tuple[str, ...]]) -> DataFrame:
    """A row for each release of ``expected`` (release to the labels it must show): counts, failed checks and three statuses.

    ``rows`` has release, label, paired, masked, timed (true, false or null: no) and decoded (null: not tried); ``files`` has
    release and error.  Releases without rows or files fail their checks.  A field is present if any row has it."""
    spark = rows.sparkSession
    named = spark.createDataFrame([(r, label) for r, labels in expected.items() for label in labels], "release string, label string")
    yes = lambda c: F.count_if(F.col(c))
    counts = rows.groupBy("release").agg(F.count("*").alias("n"), yes("paired").alias("paired"), yes("masked").alias("masked"), yes("timed").alias("timed"), F.count("decoded").alias("tried"), yes("decoded").alias("decoded"))
    shown = rows.select("release", "label").distinct().join(F.broadcast(named), ["release", "label"]).groupBy("release").agg(F.count("*").alias("labels"))  # one row a label that is named here
    held = files.groupBy("release").agg(F.count("*").alias("files"), F.count("error").alias("errors"))
    wanted = named.groupBy("release").agg(F.count("*").alias("wanted"))
    x = reduce(lambda a, b: a.join(b, "release", "left"), [wanted, counts, shown, held]).na.fill(0)
    share = lambda c: ratio(F.col(c), F.col("n"))
    sections = {
        "binary": [("has_files", F.col("files") > 0), ("files_readable", F.col("errors") == 0), ("all_labels_shown", F.col("labels") == F.col("wanted")), ("decode_sample", F.col("tried") > 0), ("decode_rate", ratio(F.col("decoded"), F.col("tried")) >= DECODED)],
        "evidence": [("pair_field", F.col("paired") > 0), ("pair_coverage", share("paired") >= COVERED), ("mask_field", F.col("masked") > 0), ("mask_coverage", share("masked") >= COVERED)],
        "temporal": [("time_field", F.col("timed") > 0), ("time_coverage", share("timed") >= COVERED)],
    }
    poor = {"binary": "insufficient_or_partial", "evidence": "not_established", "temporal": "not_established"}
    for name, checks in sections.items():
        failed = F.filter(F.array(*[F.when(~ok, label) for label, ok in checks]), lambda v: v.isNotNull())
        x = x.withColumn(f"{name}_failed", failed).withColumn(name, F.when(F.size(failed) == 0, "usable").otherwise(poor[name]))
    return x


def release_decision(checks: DataFrame, train: str, test: str, overlap: int) -> DataFrame:
    """One row: decision and status from the checks of two releases and the number of file names they share."""
    of = lambda r, c: F.coalesce(F.max(F.when(F.col("release") == r, F.col(c) == "usable")), F.lit(False))
    x = checks.agg(of(train, "binary").alias("a"), of(test, "binary").alias("b"), of(train, "evidence").alias("training_evidence"), of(test, "evidence").alias("test_evidence"))
    binary = F.col("a") & F.col("b") & F.lit(overlap == 0)
    decision = F.when(binary & F.col("training_evidence"), "usable_for_binary_and_evidence_supervision").when(binary, "usable_for_binary_only").otherwise("not_yet_usable_or_only_partially_downloaded")
    return x.select(decision.alias("decision"), F.when(binary, "passed").otherwise("incomplete").alias("status"), "training_evidence", "test_evidence")
