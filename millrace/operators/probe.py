"""Manifests with count contracts: what must hold is counted in the pass that writes the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut
from .joins import longest_prefix_join
from .order import tasks


def probe_manifest(records: DataFrame, labels: DataFrame, tests: DataFrame, runs: DataFrame, expected: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(manifest, contracts) of ``records`` (case, path, model), with the ``labels`` (case, role, labels, caption) of both roles,
    the cases of ``tests`` and the runs (prefix, source, model) whose folder holds the record's path (the longest counts).

    A record without case, of a case met before (the least path stands), outside all runs or of another model than its
    run's is refused with that reason; it stays in the manifest as a row with its ``reason``.  Labels are the real side's, null
    unless both sides have some; ``consistent`` says whether they agree.  ``contracts`` (contract, expected, actual, holds)
    is counted while the manifest is written: refused rows, missing or inconsistent labels and absent test cases must be 0,
    and the counts named in ``expected`` (cases, test_cases, or the name of a source) must be met."""
    r = cut(records.select(F.trim("case").alias("case"), "path", F.lower(F.trim("model")).alias("model")), "records")
    parts = tasks(r)
    by = lambda x, key="case": x.repartition(parts, key)
    at = longest_prefix_join(by(r.select("path"), "path").distinct(), "path", runs.select("prefix", F.struct("source", F.col("model").alias("run_model")).alias("_run")), "_run", "path")
    r = cut(by(r, "path").join(by(at.select("path", "_run"), "path"), "path", "left"), "found")
    # Records without case may be many, and are no key: they have the one row of labels of an empty case at most, sent to them.
    empty = F.coalesce(F.col("case"), F.lit("")) == ""
    named = by(r.filter(~empty))
    least = by(r.filter(~empty)).groupBy("case").agg(F.min(F.struct("path", "model")).alias("_least"))
    side = lambda role: F.max(F.when(F.col("role") == role, F.struct(F.col("labels"), F.col("caption"))))
    both = lambda x: x.groupBy("case").agg(side("real").alias("_real"), side("fake").alias("_fake"))
    test = by(tests.select(F.col("case").alias("_test")).dropna(), "_test").distinct()
    labelled = named.join(least, "case", "left").join(both(by(labels)), "case", "left").join(test, F.col("case") == F.col("_test"), "left")
    one = F.broadcast(both(labels.filter("case = ''")))
    rest = r.filter(empty).join(one, "case", "left").join(F.broadcast(tests.filter("case = ''").select(F.col("case").alias("_test")).distinct()), F.col("case") == F.col("_test"), "left")
    r = labelled.unionByName(rest, allowMissingColumns=True)
    reason = (
        F.when(F.coalesce(F.col("case"), F.lit("")) == "", "missing_case")
        .when(~F.struct("path", "model").eqNullSafe(F.col("_least")), "duplicate_case")
        .when(F.col("_run").isNull(), "outside_runs")
        .when((F.coalesce(F.col("model"), F.lit("")) != "") & (F.col("model") != F.lower("_run.run_model")), "model_mismatch")
    )
    two = F.col("_real").isNotNull() & F.col("_fake").isNotNull()
    out = r.select(
        "case", "path", reason.alias("reason"), F.col("_run.source").alias("source"), F.lower("_run.run_model").alias("model"), F.when(F.col("_test").isNull(), "train").otherwise("test").alias("split"),
        F.when(two, F.col("_real.labels")).alias("labels"), F.when(two, F.col("_real.caption")).alias("caption"), F.when(two, F.col("_real.labels").eqNullSafe(F.col("_fake.labels"))).alias("consistent"))
    good = F.col("reason").isNull()
    counts = {"refused": ~good, "labels_missing": good & F.col("consistent").isNull(), "labels_inconsistent": good & ~F.col("consistent"), "cases": good, "test_cases": good & (F.col("split") == "test")}
    counts |= {n: good & (F.col("source") == n) for n in expected if n not in counts}
    seen = Observation()
    manifest = cut(out.observe(seen, *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(counts.values())]), "manifest")
    actual = {name: seen.get[f"c{i}"] for i, name in enumerate(counts)}
    absent = test.join(by(manifest.filter(good).select("case")), F.col("_test") == F.col("case"), "left_anti").count()
    wanted = {"refused": 0, "labels_missing": 0, "labels_inconsistent": 0, "tests_absent": 0} | expected
    rows = [(n, w, (actual | {"tests_absent": absent})[n]) for n, w in wanted.items()]
    contracts = records.sparkSession.createDataFrame([(n, w, a, w == a) for n, w, a in rows], "contract string, expected long, actual long, holds boolean")
    return manifest, contracts
