import pytest
from pyspark.sql import functions as F

from millrace.functions import labels as L
from millrace.operators import sampling


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_buckets_of_null_and_empty_labels(spark):
    none = F.lit(None).cast("array<string>")
    for labels in (none, F.array().cast("array<string>"), F.array(F.lit(None).cast("string"))):
        assert tuple(one(spark, *[L.motion_bucket(labels, s) for s in ("ignored", "none", "own", "text")])) == ("unknown",) * 4
    mixed = F.array(F.lit(" STATIC"), F.lit("fast-speed"))
    assert tuple(one(spark, *[L.motion_bucket(mixed, s) for s in ("ignored", "none", "own", "text")])) == ("unknown", "no-motion", "unknown", "static")
    assert one(spark, L.coarse_signature(L.clean_labels(F.array(F.lit("Fast_Speed")))))[0] == "motion-unknown|fast-speed|steadiness-unknown"


def test_strict_labels_name_the_reason(spark):
    text = lambda body: F.lit(f"<m>{body}</m>")
    rows = [(text("[]"), ""), (text('["a", "b"]'), ""), (text('["a", "a"]'), "duplicate_labels"), (text('["c"]'), "unknown_labels"), (text("[1]"), "not_string_list"), (text('{"a": "b"}'), "not_string_list"), (text('["a"'), "invalid_json"), (F.lit("x <m>[]</m>"), "tag_or_extra_text"), (F.lit(None).cast("string"), "tag_or_extra_text")]
    got = one(spark, *[L.strict_labels(t, "m", ["a", "b"]) for t, _ in rows])
    assert [g["reason"] for g in got] == [want for _, want in rows] and got[1]["labels"] == ["a", "b"]


def test_prompt_times_and_intervals(spark):
    got = one(spark, L.prompt_times(F.lit("[T=0.5s] x [T=2s]"), F.lit(2)), L.prompt_times(F.lit("[T=0.5s]"), F.lit(3)), L.prompt_times(F.lit(""), F.lit(0)), L.shifted_interval(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(3.0)))
    assert got[0] == [0.5, 2.0] and got[1] == [0.0, 1.0, 2.0] and got[2] == [] and tuple(got[3]) == (1.0, 2.0)
    assert tuple(one(spark, L.dense_frames(F.lit(0), F.lit(5.0), 2.0), L.dense_frames(F.lit(10), F.lit(10.0), 5.0), L.window_starts(F.lit(1), 4, 2), L.window_starts(F.lit(9), 4, 2))) == (None, [0, 2, 4, 6, 8, 9], [], [0, 2, 4, 5])


def test_orders_of_few_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(3)], "id long")
    assert sorted(r.repeat_index for r in sampling.cycle_pad(df, "s", "id", 8).collect()) == list(range(8))
    assert sampling.cycle_pad(df.limit(0), "s", "id", 8).collect() == []
    draws = sampling.epoch_draws(df, "s", "id", 2, 4).collect()
    assert sorted(r.draw * 4 + r["rank"] for r in draws) == list(range(6)) and all(sorted(r.id for r in draws if r.epoch == e) == [0, 1, 2] for e in (0, 1))
    tests = spark.createDataFrame([(1, "test")], "id long, split string")
    assert {r.id: r.split for r in sampling.resolved_split(df, tests, "s", "id", 0.5).collect()} == {0: "train", 1: "test", 2: "train"}
    with pytest.raises(Exception, match="in both splits"):
        sampling.resolved_split(df, tests.union(spark.createDataFrame([(1, "train")], tests.schema)), "s", "id", 0.5).collect()


def test_frames_of_equal_clips_are_made_once(spark):
    from millrace.plans import catalog

    plan = catalog.clip_frames(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    grouped = [i for i, line in enumerate(plan) if "Aggregate" in line]
    assert len(grouped) == 2 and "transform(" not in "".join(plan[grouped[1] + 1 :]) and "sequence(" not in "".join(plan[grouped[1] + 1 :])
