import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import votes
from millrace.operators import order, probe, proposals, trajectory

FAMILIES = {"object": ("whole", ("car", "boat")), "person": ("body", ("adult",))}
SCHEMA = "doc int, kind string, pos int, raw_id string, family string, cls string, scope string, concept string, phrase string, prompt string, hint string, parent string"


def normalised(spark, rows, most=3, most_deferred=2):
    df = spark.createDataFrame(rows, SCHEMA)
    got = proposals.normalise_proposals(df, FAMILIES, {"overlay": "needs_tracking"}, ("logo",), ("thing",), most, most_deferred).collect()
    return {(r.kind, r.pos): (r.status, r.reason, r.new_id, r.parent_id) for r in got}


def candidate(pos, prompt="p", raw="r", family="object", cls="car", scope="whole", concept="c", phrase="x", hint=None, doc=1):
    return doc, "candidate", pos, raw, family, cls, scope, concept, phrase, prompt, hint, None


def test_refusals_in_order_and_links_that_survive(spark):
    rows = [
        candidate(1, "thing", hint="possibly_multiple"),  # ambiguous: doesn't make the next one a duplicate
        candidate(2, " THING ", raw="a"),
        candidate(3, "thing", hint="possibly_multiple"),  # duplicate stands before ambiguous
        candidate(4, "q", raw="a", family=" Object "),
        candidate(5, "w", family="odd", cls="x", phrase=""),
        candidate(6, "w", cls="adult"),
        candidate(7, "w", scope="body"),
        candidate(8, "w", phrase=" "),
        candidate(9, "w", concept="LOGO"),
        candidate(10, "w", raw="b"),
        candidate(11, "z", raw="late"),
        (1, "deferred", 1, None, "overlay", None, None, None, "One  Two", None, None, "a"),
        (1, "deferred", 2, None, "Overlay", None, None, None, "one two", None, None, "a"),
        (1, "deferred", 3, None, "odd", None, None, None, "y", None, None, None),
        (1, "deferred", 4, None, "overlay", None, None, None, "y", None, None, "late"),
        (1, "deferred", 5, None, "overlay", None, None, None, "z", None, None, None),
        (None, "candidate", 66, None, None, None, None, None, None, None, None, None),
    ]
    got = normalised(spark, rows)
    assert len(got) == len(rows)
    want = {1: "ambiguous_prompt", 2: None, 3: "duplicate_prompt", 4: None, 5: "invalid_family_class_or_scope", 6: "family_class_mismatch", 66: "unplaced", 7: "family_scope_mismatch", 8: "missing_required_text", 9: "banned_concept", 10: None, 11: "beyond_limit"}
    got_reasons = {p: got["candidate", p][1] for p in want}
    assert got_reasons == want
    assert [got["candidate", p][2] for p in (2, 4, 10)] == ["candidate_01", "candidate_02", "candidate_03"]
    assert got["deferred", 1] == ("deferred", "needs_tracking", "deferred_01", "candidate_02")  # the last accepted with that raw id
    assert got["deferred", 2][:2] == ("refused", "duplicate_signature") and got["deferred", 3][1] == "invalid_family_or_text"
    assert got["deferred", 4] == ("deferred", "needs_tracking", "deferred_02", None) and got["deferred", 5][1] == "beyond_limit"


def test_many_candidates_of_one_document(spark):
    rows = [candidate(i, f"p{i % 700}") for i in range(1400)]
    got = normalised(spark, rows, most=500)
    assert sum(v[0] == "accepted" for v in got.values()) == 500 and got["candidate", 499][2] == "candidate_500" and got["candidate", 8][2] == "candidate_09"
    assert all(v[1] == ("duplicate_prompt" if p >= 700 else "beyond_limit" if p >= 500 else None) for (_, p), v in got.items())


def test_rules_stop_and_lack_in_order(spark):
    rules = [
        (1, "question", ["not just pan"], None, None, "pan", False, 2, True),
        (2, "question", ["pan"], None, None, "pan", True, 2, False),
        (3, "question", None, ["zoom", "in"], ["out"], "zoom", True, 3, False),
        (4, "text", ["slow"], None, None, "slow", None, 1, False),
    ]
    texts = [(1, "question", "Not just PAN?", True), (1, "question", "pan, zoom in", True), (2, "question", "not just pan or zoom in", False), (2, "question", "not just pan or zoom in", False), (3, "question", "zoom in and out, pan", False), (4, "text", "slowly", None), (5, None, None, None), (6, "text", None, True)]
    rows = spark.createDataFrame(texts, "k int, kind string, text string, answer boolean")
    table = spark.createDataFrame(rules, votes.RULES)
    got = {(r.k, r.label): r.n for r in votes.votes(rows, table, "k").collect()}
    assert got == {(1, "pan"): 2, (1, "zoom"): 3, (2, "pan"): 4, (4, "slow"): 1}
    swapped = spark.createDataFrame([(2, *rules[0][1:]), (1, *rules[1][1:]), *rules[2:]], votes.RULES)
    assert (1, "pan") in {(r.k, r.label) for r in votes.votes(rows, swapped, "k").collect() if r.n == 4}  # pan counts before the rule that stops
    one = spark.range(1).select(votes.answer_sign(F.lit(" YES, so")).alias("a"), votes.answer_sign(F.lit("maybe")).alias("b"), votes.plain_question(F.lit("<video> Is it?  Please only answer Yes or No.")).alias("q")).first()
    assert tuple(one) == (True, None, "Is it?")


def test_final_labels(spark):
    order = ["still", "fast", "slow", "regular", "static", "pan", "zoom"]
    groups = [({"still": 1}, "still"), ({"fast": 3, "slow": 2, "regular": 1}, "regular")]
    cases = [({}, []), ({"other": 3}, []), ({"pan": 1}, ["still", "regular", "pan"]), ({"fast": 2, "slow": 2}, ["still", "fast"]), ({"still": 1, "zoom": 5, "pan": 5}, ["still", "regular", "static", "pan"]), ({"pan": 0, "zoom": -1}, [])]
    df = spark.createDataFrame(list(enumerate(m for m, _ in cases)), "i int, m map<string,int>")
    got = df.select("i", votes.final_labels(F.col("m"), order, groups, ["regular"], {"still": "static"}, most=4).alias("l")).orderBy("i").collect()
    assert [r.l for r in got] == [want for _, want in cases]


def test_probe_manifest_counts_its_contracts(spark):
    r = spark.createDataFrame([("a", "/r/x/1", "M"), ("a", "/r/x/0", None), ("b", "/r/x/y/2", "m"), ("c", "/q/3", None), (None, "/r/x/4", None), ("d", "/r/x/5", "")], "case string, path string, model string")
    labels = spark.createDataFrame([(c, s, ["l"] if (c, s) != ("d", "fake") else ["m"], "cap") for c in "abd" for s in ("real", "fake")], "case string, role string, labels array<string>, caption string")
    tests = spark.createDataFrame([("a",), ("zz",), (None,)], "case string")
    runs = spark.createDataFrame([("/r/x", "X", "m"), ("/r/x/y", "Y", "n")], "prefix string, source string, model string")
    manifest, contracts = probe.probe_manifest(r, labels, tests, runs, {"cases": 2, "test_cases": 1, "X": 5})
    got = {x.path: (x.reason, x.source, x.split, x.consistent) for x in manifest.collect()}
    assert got == {"/r/x/0": (None, "X", "test", True), "/r/x/1": ("duplicate_case", "X", "test", True), "/r/x/y/2": ("model_mismatch", "Y", "train", True), "/q/3": ("outside_runs", None, "train", None), "/r/x/4": ("missing_case", "X", "train", None), "/r/x/5": (None, "X", "train", False)}
    assert {c.contract: (c.actual, c.holds) for c in contracts.collect()} == {"refused": (4, False), "labels_missing": (0, True), "labels_inconsistent": (1, False), "tests_absent": (1, False), "cases": (2, True), "test_cases": (1, True), "X": (2, False)}


def test_probe_tasks_follow_the_records_and_empty_cases_have_labels(spark, monkeypatch):
    monkeypatch.setattr(order, "ROWS_A_TASK", 100, raising=False)
    r = spark.createDataFrame([(str(i) if i % 3 else [" ", "", None][i % 9 // 3], f"/r/x/{i}", "m") for i in range(1500)], "case string, path string, model string")
    labels = spark.createDataFrame([(c, s, "l", "cap") for c in ("", "1", "2", None) for s in ("real", "fake")], "case string, role string, labels string, caption string")
    tests = spark.createDataFrame([("",), ("1",), (None,)], "case string")
    runs = spark.createDataFrame([("/r", "R", "m"), ("/r/x", "X", "m"), ("/q", "Q", "m")], "prefix string, source string, model string")
    manifest, contracts = probe.probe_manifest(r, labels, tests, runs, {"cases": 1000, "X": 1000})
    got = {x.path: (x.case, x.reason, x.source, x.split, x.labels) for x in manifest.collect()}
    want = {i: (str(i), None, "X", "test" if i == 1 else "train", "l" if i < 3 else None) for i in range(1500) if i % 3}
    want |= {i: (None, "missing_case", "X", "train", None) if i % 9 == 6 else ("", "missing_case", "X", "test", "l") for i in range(0, 1500, 3)}
    assert got == {f"/r/x/{i}": w for i, w in want.items()} and manifest.count() == 1500
    assert {c.contract: c.actual for c in contracts.collect()} == {"refused": 500, "labels_missing": 998, "labels_inconsistent": 0, "tests_absent": 1, "cases": 1000, "X": 1000}
    # Tasks that wrote the manifest: adaptive execution made one of them.
    assert len(manifest.inputFiles()) > 10


def test_trajectory_features_of_short_and_broken_tracks(spark):
    rows = [("sq", i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0]])] + [("one", 0, [1.0, 1.0]), ("two", 0, [2.0, 0.0]), ("two", 1, [5.0, 0.0]), ("odd", 0, [1.0, 0.0]), ("odd", 1, [1.0]), ("odd", 2, None), (None, 0, [1.0, 0.0])]
    got = {r.t: r for r in trajectory.trajectory_features(spark.createDataFrame(rows, "t string, i int, v array<float>"), "t", [F.col("i")], "v").collect()}
    assert got.keys() == {"sq", "two", "odd"}
    sq = got["sq"]
    assert [sq[f"d{i}"] for i in range(7)] == pytest.approx([1, 1, 1, 0, 0, 0, 0]) and [sq[f"a{i}"] for i in range(6)] == pytest.approx([1, 1, 0, 0, 0, 0])
    assert (sq.n, sq.distance_mean, sq.distance_var) == (4, pytest.approx(1), pytest.approx(0)) and math.isclose(sq.angle_max, 1)
    assert [got["two"][c] for c in trajectory.COLUMNS] == pytest.approx([0.0] * 21) and got["odd"].distance_max == 0.0


def test_small_documents_give_what_large_ones_give(spark, monkeypatch):
    rows = [(f"d{i % 7}" if i % 29 else None, "candidate" if i % 3 else "deferred", i, f"r{i % 5}", "object" if i % 3 else "overlay", "car", "whole", "c", f"p{i % 6}", f"q{i % 11}", None, f"r{i % 4}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc string, kind string, pos long, raw_id string, family string, cls string, scope string, concept string, phrase string, prompt string, hint string, parent string")
    run = lambda: {(r.doc, r.kind, r.pos): tuple(r)[3:] for r in proposals.normalise_proposals(df, {"object": ("whole", ("car",))}, {"overlay": "needs_tracking"}, (), (), 3, 1).collect()}
    small = run()
    monkeypatch.setattr(proposals, "small_groups", lambda rows, by: False)
    assert run() == small and len(small) == 150
