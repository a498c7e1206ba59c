import numpy as np
from pyspark.sql import functions as F

from millrace.operators import joins, metrics, planning


def test_decisions_in_order_with_ties_nulls_and_one_case_a_video(spark):
    rows = [(1, "a", 1, True, 1), (2, "a", 1, True, 2), (3, "b", 1, True, None), (4, "b", 2, True, 2), (5, "c", 1, None, 1), (6, None, 1, True, 1), (7, "d", 1, True, 1), (8, "e", 1, True, 1), (9, "e", 0, True, None)]
    cases = spark.createDataFrame(rows, "k int, v string, o int, sel boolean, s int")
    done = spark.createDataFrame([(7,), (7,), (None,)], "k int")
    videos = spark.createDataFrame([("e",), (None,)], "v string")
    named = [("first", F.col("s") == 1), ("any", F.col("s") > 0)]
    got = planning.continue_by_strategy(cases, "k", "v", "o", done, videos, F.col("sel"), named)
    want = {1: "first", 2: "reserve", 3: "rerun", 4: "any", 5: "no_selection", 6: "no_selection", 7: "completed_case", 8: "completed_video", 9: "completed_video"}
    assert {r.k: r.decision for r in got.collect()} == want and got.columns == [*cases.columns, "decision"]
    assert planning.continue_by_strategy(cases.limit(0), "k", "v", "o", done, videos, F.col("sel"), named).count() == 0


def test_a_shared_word_stands_between_the_tiers_and_the_rest(spark):
    rows = [(1, 0, "p", ["x", "y"]), (2, 0, "q", ["y", "y", ""]), (3, 0, "p", ["z"]), (4, 0, "r", ["x"]), (5, 0, None, None), (6, 1, "p", ["x"])]
    df = spark.createDataFrame(rows, "id int, b int, v string, w array<string>")
    got = {r.id: (r.other, r.score) for r in joins.best_by_tiers(df, ["b"], "id", [("v", 9)], 1, ("w", 5)).collect()}
    assert got == {1: (3, 9), 3: (1, 9), 2: (1, 5), 4: (1, 5), 5: (1, 1)}


def test_every_resample_draws_n_and_reruns_agree(spark):
    ids = spark.createDataFrame([(i,) for i in range(40)] + [(3,), (None,)], "k long")
    a, b = (sorted(map(tuple, metrics.bootstrap_draws(ids.repartition(n), "k", 7, "s").collect())) for n in (1, 5))
    assert a == b and {r for r, _, _ in a} == set(range(7)) and all(sum(t for r, _, t in a if r == i) == 40 for i in range(7))
    assert metrics.bootstrap_draws(ids.limit(0), "k", 3, "s").count() == 0


def test_grid_of_quantiles_equals_numpy(spark):
    rng = np.random.default_rng(3)
    scores = np.round(rng.random(500), 4)
    labels = (rng.random(500) < scores).astype(int)
    df = spark.createDataFrame([("g", float(s), int(y)) for s, y in zip(scores, labels, strict=True)] + [("small", 0.3, 1), ("small", 0.2, 0)], "g string, s double, y int")
    for goal in ("balanced_accuracy", "f1"):
        for grid in (11, 64):
            got = {r.g: (r.threshold, r[goal]) for r in metrics.threshold_sweep(df, ["g"], "s", "y", goal, grid).collect()}
            best = []
            for t in np.quantile(np.unique(np.concatenate([[0.0], scores, [1.0]])), np.linspace(0, 1, grid)):
                tp, fp = int(((scores >= t - 1e-12) & (labels == 1)).sum()), int(((scores >= t - 1e-12) & (labels == 0)).sum())
                pos, neg = int(labels.sum()), int((1 - labels).sum())
                v = (tp / pos + 1 - fp / neg) / 2 if goal == "balanced_accuracy" else 2 * tp / max(tp + fp + pos, 1)
                best.append((round(v, 12), -abs(t - 0.5), t))
            assert abs(got["g"][0] - max(best)[2]) < 1e-9 and abs(got["g"][1] - max(best)[0]) < 1e-9
            assert got["small"] == (0.3, 1.0)


def test_repair_by_class_pairs_no_targets(spark):
    targets = spark.createDataFrame([(i, i % 3, i % 2) for i in range(60)] + [(90, 1, None), (91, None, 1), (5, 0, 0)], "t long, a int, b int")
    donors = spark.createDataFrame([(i, i % 4, i % 2, float(i % 5)) for i in range(40)] + [(70, 1, None, 9.0)], "d long, x int, b int, s double")
    tiers = [("good", (F.col("a") == F.col("x")) & (F.col("s") > 3)), ("same", F.col("a") == F.col("x")), ("any", F.lit(True))]
    want = planning.repair(targets.join(donors, "b"), "t", tiers, "s", "d")
    got = planning.repair_by_class(targets, "t", ["a", "b"], donors, ["b"], tiers, "s", "d")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 61
    # 2 x 4 classes meet 40 donors: no row of targets times donors.
    joins = [n for n in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in n]
    assert len(joins) == 2 and "_class" in joins[0]


def test_plan_faults_without_windows_over_a_key(spark):
    rows = [("a", 1, 9, True), ("a", 2, None, True), ("b", 2, 9, False), ("c", 3, 9, False), ("d", 4, 4, True), (None, None, None, False), (None, None, None, None)]
    plan = spark.createDataFrame(rows, "case string, target int, donor int, needs boolean")
    errors = planning.validate_plan(plan, "case", "target", "donor", F.col("needs"), 2)
    got = sorted((r.case or "", r.error) for r in errors.collect())
    over = "donor_limit_exceeded"
    assert got == sorted([("", "case_repeated"), ("", "target_reused")] * 2 + [("a", "case_repeated")] * 2 + [("a", "donor_missing"), ("a", "target_reused"), ("b", "target_reused"), ("a", over), ("b", over), ("c", over), ("d", "donor_is_target")])
    # Rows without a donor were one window, which a task held whole.
    assert "Window" not in errors._jdf.queryExecution().optimizedPlan().toString()
