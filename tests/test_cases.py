"""Case operators and prompt functions on nulls, ties, empty tables and long groups."""

from pyspark.sql import functions as F

from millrace.functions import prompts as P
from millrace.operators import cases, metrics, order


def test_nearest_frames_against_brute_force(spark):
    tube = [("a", f) for f in range(0, 900, 7)] + [("b", 5)]
    wanted = [(i, "a", i * 1.25) for i in range(0, 800, 3)] + [(1000, "b", 4.5), (1001, "b", -50.0), (1002, "c", 1.0), (1003, "a", None), (1004, None, 2.0)]
    w = spark.createDataFrame(wanted, "id int, case string, at double")
    got = {r.id: r for r in cases.aligned_frames(w, spark.createDataFrame(tube, "case string, frame int"), "case", "at", "frame", zero_missing=False).collect()}
    assert len(got) == len(wanted)
    for i, c, at in wanted:
        frames = [f for k, f in tube if k == c]
        if at is None or not frames:
            assert got[i].status in ("missing", "nearest") and (at is None or got[i].mask_frame is None)
            continue
        near = round(at) if round(at) in frames else min(frames, key=lambda f: (abs(f - at), f))
        assert (got[i].mask_frame, got[i].status) == (near, "visible" if round(at) in frames else "nearest"), (i, c, at)


def test_running_max_over_many_ranges(spark):
    rows = spark.range(500).select((F.col("id") % 2).alias("g"), "id", F.when(F.col("id") % 7 == 0, -F.col("id")).alias("v"))
    got = {r.id: r.m for r in order.running_max(rows.repartition(5), ["g"], [F.asc("id")], F.col("v"), "m").collect()}
    for i in range(500):
        seen = [-j for j in range(i % 2, i + 1, 2) if j % 7 == 0]
        assert got[i] == (max(seen) if seen else None)


def test_donors_of_empty_tables_ties_and_nulls(spark):
    schema = "k int, video int, label string, donor int, score double"
    rows = spark.createDataFrame([(1, 1, "x", 1, 5.0), (2, 1, "x", 2, 5.0), (3, 2, "x", 3, 5.0), (4, 3, "y", 4, None), (5, None, "x", 5, 1.0)], schema)
    rules = spark.createDataFrame([("x", "x", "exact"), ("y", "x", "group")], "label string, donor_label string, level string")
    find = lambda r: {x.k: (x.donor, x.level) for x in cases.best_donor(r.select("k", "video", "label"), r.select("video", "label", "donor", "score"), rules, "k", "video", "label", "donor", "score").collect()}
    assert find(rows) == {1: (3, "exact"), 2: (3, "exact"), 3: (1, "exact"), 4: (1, "group"), 5: (None, None)}
    assert find(rows.limit(0)) == {}


def test_group_split_keeps_groups_whole(spark):
    rows = spark.createDataFrame([(i, g, l) for i, (g, l) in enumerate([("big", "R")] * 30 + [("s1", "A"), ("s1", "R"), ("s2", "U"), (None, "A")])], "i int, g string, l string")
    got = cases.group_split(rows, "g", "l", "x", 4, "U").collect()
    assert len(got) == 34 and all(len({r.split for r in got if r.g == g}) == 1 for g in ("big", "s1", "s2", None))
    assert cases.group_split(rows.limit(0), "g", "l", "x", 4).collect() == []


def test_subjects_and_reserve_of_null_scores(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 3.0), ("b", 3, None)], "g string, k int, s double")
    got = {r.g: (r.k, r.mode) for r in cases.subject_draw(rows, "g", "k", "s", F.lit(False), "x", 0.5).collect()}
    assert got["a"] == (2, "fallback") and got["b"][1] == "fallback"
    assert [r.k for r in cases.reserve(rows, rows.filter("g = 'b'"), "g", "s", "k").collect()] == [2]


def test_prompt_functions_on_edges(spark):
    row = spark.createDataFrame([("<i>\nx <i>\ny\n<i>", None)], "t string, n string").select(
        P.marked_lines(F.col("t"), "<i>", F.array(F.lit(1))).alias("one"), P.marked_lines(F.lit("<i><i>"), "<i>", F.array(F.lit(0))).alias("twice"),
        P.marked_lines(F.col("n"), "<i>", F.array(F.lit(0))).alias("null"), P.without_lines(F.col("t"), "<i>").alias("bare"), P.placeholders_match(F.col("n"), "<i>", F.lit(None).cast("array<int>")).alias("none"),
        P.padded_frames(F.lit(0)).alias("p0"), P.padded_frames(F.lit(81)).alias("p81"), P.padded_frames(F.lit(82)).alias("p82"), P.fraction(F.lit("80")).alias("f"), P.fraction(F.lit("?")).alias("nf"),
        P.swapped_choice(F.lit("A, B; AB a")).alias("sw"), P.swapped_choice(F.lit("")).alias("sw0"), P.path_state(F.lit(""), F.lit(True), F.lit(None).cast("boolean"), F.lit("m"), F.lit(True)).alias("ps"),
        P.skipped(F.lit("accepted"), F.col("n")).alias("sk"), P.skipped(F.col("n"), F.lit("r")).alias("skn"), P.label_votes(F.col("n"), [("a", ["x"], [])]).alias("v"),
        P.clip_plan(F.lit(5), F.lit(4), F.lit(10.0), 16.0).alias("cp"), P.annotation_faults(F.col("n"), F.lit("real"), F.lit(0.0), F.lit(1.0), ("k",)).alias("af"),
    ).first()
    assert (row.one, row.twice, row.null, row.bare, row.none) == ("x <i>\ny\n", None, None, "y\n", True)
    assert (row.p0, row.p81, row.p82, row.f, row.nf) == (None, 81, 85, 0.8, None)
    assert (row.sw, row.sw0, row.ps.state, row.sk, row.skn, row.v, row.cp, row.af) == ("B, A; AB a", "", "missing", False, False, [], None, ["missing_answer"])


def test_sweep_may_choose_an_end(spark):
    rows = spark.createDataFrame([(0.2, 1), (0.3, 1)], "s double, y int")
    got = metrics.threshold_sweep(rows, [], "s", "y", "f1").first()
    assert (got.threshold, got.f1) == (0.2, 1.0)
    flat = metrics.threshold_sweep(spark.createDataFrame([(0.2, 0)], "s double, y int"), [], "s", "y").first()
    assert flat.threshold == 1.0
