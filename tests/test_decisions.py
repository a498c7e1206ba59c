import pytest
from pyspark.sql import functions as F

from millrace.operators import decisions


def test_transfer_needs_all_four(spark):
    rows = []
    for branch, right, kept in (("control", 6, 9), ("pair", 9, 9), ("worse", 9, 7)):
        for i in range(10):
            for truth in (True, False):
                rows.append((branch, "own", "minor-motion" if i % 2 else "none", truth, truth if i < right else not truth if i % 3 else None))
                rows.append((branch, "external", None, truth, truth if i < kept else not truth))
    items = spark.createDataFrame(rows, "branch string, part string, bucket string, truth boolean, predicted boolean")
    good = decisions.transfer_gate(items, "control", "pair", "pair_gain").first()
    assert good.status == "passed" and good.own_gain == pytest.approx(0.3) and good.external_accuracy == 0 and good.moving_gain > 0
    bad = decisions.transfer_gate(items, "control", "worse", "pair_gain").first()
    assert bad.status == "failed" and bad.failed == ["external_accuracy", "external_f1"]
    none = decisions.transfer_gate(items.filter("bucket IS NULL OR bucket = 'none'"), "control", "absent", "pair_gain").first()
    assert none.failed == ["own_gain", "external_accuracy", "external_f1", "moving_gain"] and none.moving_gain == -1.0


def test_signal_has_three_statuses(spark):
    schema = "g string, valid boolean, true_mask boolean, labelled boolean, consistent boolean, inside double, outside double"
    good = ("ok", True, True, True, True, 0.3, 0.01)
    rows = [good] * 20 + [("ok", False, None, True, None, None, None)] + [("few", True, i % 2 == 0, True, True, 0.3, 0.01) for i in range(10)] + [("flat", True, True, True, i > 0, 0.02, 0.02) for i in range(10)]
    got = {r.g: r for r in decisions.signal_gate(spark.createDataFrame(rows, schema), ["g"]).collect()}
    assert (got["ok"].status, got["ok"].failed) == ("passed", []) and got["few"].status == "diagnostic_only"
    assert got["flat"].status == "failed" and got["flat"].failed == ["camera_consistency", "median_ratio", "inside_over_outside"]


def test_judge_leaves_small_controls_undecided(spark):
    rows = [(i, "original", 5.0) for i in range(40)] + [(i, "frames", 1.0 if i < 30 else 9.0) for i in range(40)] + [(i, "box", 1.0) for i in range(29)] + [(i, "time", 1.0) for i in range(30)]
    scores = spark.createDataFrame(rows, "record int, variant string, score double")
    judged = lambda s, local: {r.control: r for r in decisions.judge_gate(s, scores, "frames", local).collect()}
    got = judged(scores, ("box", "time"))
    assert (got["frames"].passed, got["box"].passed, got["time"].passed) == (True, None, True) and got["box"].status == "passed" and got["frames"].rate == 0.75
    assert judged(scores, ("box",))["box"].status == "failed"  # no local control decided
    assert judged(scores.filter("record != 3"), ("time",))["time"].passed is None  # 29 pairs
    unread = scores.withColumn("score", F.when(F.col("record") > 2, F.col("score")))
    assert judged(unread, ("box",))["frames"].valid_rate < 0.95 and judged(unread, ("box",))["frames"].status == "failed"


def test_questions_and_joint_training(spark):
    rows = []
    for condition, score in {"final": lambda t: 0.9 if t else 0.1, "base": lambda t: 0.5, "none": lambda t: 0.5, "opposite": lambda t: 0.1 if t else 0.9, "flipped": lambda t: 0.1 if t else 0.9}.items():
        rows += [(condition, q, label, t, score(t)) for label in range(22) for q in range(3) for t in (True, False)]
    items = spark.createDataFrame(rows, "condition string, question int, label int, truth boolean, score double")
    m = decisions.condition_metrics(items)
    got = {r.condition: r for r in m.collect()}
    assert (got["final"].balanced_accuracy, got["final"].macro_ap, got["final"].labels, got["final"].paired_accuracy, got["final"].coverage) == (1, 1, 22, 1, 1) and got["base"].balanced_accuracy == 0.5
    assert decisions.question_gate(m, 1.0, "base", "base", "final", "opposite", "none").first().status == "passed"
    absent = decisions.question_gate(m, 0.5, "base", "gone", "final", "opposite", "none").first()
    assert absent.failed == ["coverage", "trained_an_epoch"]
    joint = lambda **k: decisions.joint_gate(m, **({"ready": True, "correct": "final", "shuffled": "flipped", "opposite": "opposite", "nothing": "none"} | k)).first().status
    assert joint() == "passed_for_short_rl" and joint(shuffled="final") == "borderline_short_rl_only" and joint(ready=False) == joint(opposite="final", nothing="final") == "not_ready_for_rl"
    holes = items.withColumn("score", F.when((F.col("condition") != "final") | (F.col("question") > 0), F.col("score")))
    assert {r.condition: r.coverage for r in decisions.condition_metrics(holes).collect()}["final"] == pytest.approx(2 / 3)


def test_improvement(spark):
    of = lambda rows: decisions.improvement_gate(spark.createDataFrame(rows, "metric string, change double")).first()
    assert of([("a", 0.006), ("b", -0.0005)]).status == "passed"
    assert of([("a", 0.006), ("b", -0.002)]).failed == ["no_regression"] and of([("a", 0.001)]).failed == ["gain"] and of([]).status == "failed"


def test_wide_conditions_equal_exploded_ones(spark):
    rows = [(q, q % 5, None if q % 31 == 3 else (q * k) % 3 == 0, *[None if (q + k + i) % 17 == 0 else ((q * 7 + k * 3 + i) % 10) / 10 for i in range(3)]) for q in range(90) for k in (1, 2)]
    x = spark.createDataFrame(rows, "question int, label int, truth boolean, a double, b double, c double")
    items = x.selectExpr("question", "label", "truth", "stack(3, 'a', a, 'b', b, 'c', c) AS (condition, score)")
    names = ["condition", "balanced_accuracy", "macro_ap", "labels", "paired_accuracy", "coverage"]
    want = {r.condition: r for r in decisions.condition_metrics(items).select(names).collect()}
    got = decisions.metrics_of_conditions(x, {n: F.col(n) for n in "abc"})
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # written: the gates don't compute it again
    for r in got.select(names).collect():
        assert tuple(r)[1:] == pytest.approx(tuple(want.pop(r.condition))[1:])
    assert not want
    assert decisions.metrics_of_conditions(x.limit(0), {"a": F.col("a")}).collect() == []
