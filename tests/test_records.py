import json
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import leaves
from millrace.operators import assign, audit, evidence, order, scan
from millrace.plans import records
from millrace.sources import footers


def test_running_product_of_a_long_group_and_of_broken_matrices(spark):
    rng = np.random.default_rng(1)
    m = {("long", i): np.eye(3) + rng.normal(size=(3, 3)) * 0.02 for i in range(3000)}
    m |= {("b", i): np.eye(3) + rng.normal(size=(3, 3)) * 0.1 for i in range(5)} | {(None, 0): np.eye(3) * 2}
    rows = [(g, i, x.ravel().tolist()) for (g, i), x in m.items()] + [("bad", 0, np.eye(3).ravel().tolist()), ("bad", 1, None), ("bad", 2, [1.0] * 9), ("short", 0, [1.0])]
    df = spark.createDataFrame(rows, "g string, i int, m array<double>").repartition(7)
    got = {(r.g, r.i): r.c for r in scan.running_product(df, ["g"], [F.col("i")], "m", "c").collect()}
    assert len(got) == len(rows)
    for g, n in (("long", 3000), ("b", 5)):
        now = np.eye(3)
        for i in range(n):
            now = m[g, i] @ now
            now /= now[2, 2]
            assert np.allclose(np.array(got[g, i]).reshape(3, 3), now, rtol=1e-6)
    assert got[None, 0] == np.eye(3).ravel().tolist()
    assert got["bad", 0] is not None and got["bad", 1] is None and got["bad", 2] is None and got["short", 0] is None
    plain = scan.running_product(spark.createDataFrame([(1, [2.0]), (2, [3.0])], "i int, m array<double>"), [], [F.col("i")], "m", "c", size=1, projective=False)
    assert sorted(r.c[0] for r in plain.collect()) == [2.0, 6.0]


def plain_walk(x, path=()):
    items = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()
    for k, v in items:
        yield (*path, str(k)), v
        yield from plain_walk(v, (*path, str(k)))


def test_walk_of_any_depth(spark):
    deep = "q"
    for i in range(12):
        deep = [deep] if i % 2 else {"k": deep}
    docs = [{"a": {"b": ["x", {"c": "y"}, 3, None]}, "d": "z", "": " "}, deep, [], {}, "s", 5, [[[]], {"é/ü": True}]]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(90, "broken{"), (91, None), (92, "")]
    got = leaves.walk(spark.createDataFrame(rows, "id int, j string").selectExpr("*", "1 AS path"), "id", "j").collect()
    want = [(i, p, v) for i, d in enumerate(docs) for p, v in plain_walk(d)]
    assert sorted((r.id, tuple(r.path), r.text) for r in got if r.text is not None) == sorted((i, p, v) for i, p, v in want if isinstance(v, str))
    assert sorted((r.id, tuple(r.path)) for r in got) == sorted((i, p) for i, p, _ in want)
    assert all(json.loads(r.value) == dict(((i, p), v) for i, p, v in want)[r.id, tuple(r.path)] for r in got)


def test_best_string_and_its_ties(spark):
    docs = [
        {"target": {"video_path": "a"}, "donor": {"video_path": "/video/b.mp4"}},
        {"bb": {"video_path": "x"}, "aa": {"video_path": "y"}, "c": {"video_path": " "}},  # ties: the lesser path
        {"long": {"er": {"video_path": "x"}}, "z": {"video_path": "y"}},  # the shorter path
        {"generated_target": {"video_path": "C:\\video\\x"}, "other": 5},
        {"name": "video_path"},
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, j string")
    got = {r.id: (r.path, r.score) for r in leaves.best_string(leaves.walk(df, "id", "j"), "id", records.PATH_NAMES, records.PATH_RULES).collect()}
    assert got == {0: ("target/video_path", 20), 1: ("aa/video_path", 0), 2: ("z/video_path", 0), 3: ("generated_target/video_path", 0)}


def test_footers_of_broken_files(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "a" / "x.parquet"))
    spark.range(3).selectExpr("id", "'s' AS s").coalesce(1).write.parquet(str(tmp_path / "b" / "y.parquet"))
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 not a file")
    (tmp_path / "empty.parquet").write_bytes(b"")
    (tmp_path / "other.txt").write_text("x")
    got = footers.parquet_audit(spark, str(tmp_path), files_a_task=1)
    rows = {r.path.rsplit("/", 1)[-1][:4]: r for r in got.collect() if r.error}
    assert rows.keys() == {"bad.", "empt"} and all(r.n_rows is None for r in rows.values())
    groups = {r.columns: (r.files, r.n_rows, r.errors) for r in footers.schema_groups(got).collect()}
    assert groups == {"id": (1, 10, 0), "id,s": (1, 3, 0), None: (2, None, 2)}


def test_release_checks_and_decision(spark):
    schema = "release string, label string, paired boolean, masked boolean, timed boolean, decoded boolean"
    good = [("set", l, True, i > 0, None, i != 3) for i, l in enumerate(["r", "f", "p"] * 20)]
    poor = [("ood", "r", None, False, False, None)]
    files = spark.createDataFrame([("set", None), ("ood", "x"), ("ood", None)], "release string, error string")
    labels = ("r", "f", "p")
    x = audit.release_checks(spark.createDataFrame(good + poor, schema), files, {"set": labels, "ood": labels, "none": labels})
    got = {r.release: r for r in x.collect()}
    assert (got["set"].binary, got["set"].evidence, got["set"].temporal) == ("usable", "usable", "not_established")
    assert got["ood"].binary_failed == ["files_readable", "all_labels_shown", "decode_sample", "decode_rate"] and got["none"].n == 0
    assert got["ood"].evidence_failed == ["pair_field", "pair_coverage", "mask_field", "mask_coverage"]
    decide = lambda a, b, n: audit.release_decision(x, a, b, n).first().decision
    assert decide("set", "set", 0) == "usable_for_binary_and_evidence_supervision" and decide("set", "set", 1) == decide("set", "ood", 0) == decide("set", "absent", 0) == "not_yet_usable_or_only_partially_downloaded"
    names = spark.createDataFrame([("a/B-c_1.x.MP4",), ("bc1x",), (None,)], "n string").select(audit.normalised_name(F.col("n")).alias("s")).collect()
    assert [r.s for r in names] == ["bc1x", "bc1x", None]


SCHEMA = "target int, target_group int, operation string, donor int, donor_group int, score double"


def ledger_rows(spark, rows, quotas, **caps):
    q = spark.createDataFrame(quotas, "operation string, quota int")
    return assign.assign_with_ledgers(spark.createDataFrame(rows, SCHEMA), q, **caps).collect()


def test_ledgers_hold_and_no_open_target_has_a_free_donor(spark):
    rng = np.random.default_rng(5)
    ops = ["a", "b", "c", "none"]
    rows = [(t, t // 3, ops[int(rng.integers(0, 4))], int(d), int(d) % 7, float(rng.integers(0, 5))) for t in range(400) for d in rng.integers(0, 40, size=4)]
    quotas, caps = {"a": 60, "b": 9, "c": 200}, {"target_cap": 2, "donor_cap": 4, "group_cap": 20}
    got = ledger_rows(spark, rows, list(quotas.items()), **caps)
    assert sorted(r.target for r in got) == list(range(400))
    done = [r for r in got if r["round"] is not None]
    used = lambda f: {k: sum(f(r) == k for r in done) for k in {f(r) for r in done}}
    groups, donors, families, work = used(lambda r: r.target // 3), used(lambda r: r.donor), used(lambda r: r.donor_group), used(lambda r: r.operation)
    assert max(groups.values()) <= 2 and max(donors.values()) <= 4 and max(families.values()) <= 20 and all(work[o] <= quotas[o] for o in work)
    assert all((r.target, r.target // 3, r.operation, r.donor, r.donor_group, r.score) in rows for r in done)
    open_ = {r.target: r.reason for r in got if r["round"] is None}
    for t, g, o, d, f, _ in rows:
        if t in open_:
            assert groups.get(g, 0) >= 2 or donors.get(d, 0) >= 4 or families.get(f, 0) >= 20 or work.get(o, 0) >= quotas.get(o, 0)
    assert set(open_.values()) <= {"target group served", "operations full", "all donors full"} and len(set(open_.values())) > 1


def test_one_taste_takes_few_rounds_and_nulls_are_reported(spark):
    rows = [(t, t, "a", d, d, float(100 - d)) for t in range(150) for d in range(50)] + [(900, None, "a", 1, 1, 1.0), (901, 1, "a", 1, 1, None)]
    got = ledger_rows(spark, rows, [("a", 1000)], target_cap=1, donor_cap=3, group_cap=3)
    assert {r.reason for r in got if r.target >= 900} == {"no candidate"} and all(r.donor is not None for r in got if r.target < 900)
    assert max(r["round"] for r in got if r["round"] is not None) < 30  # not one round a donor


def test_tasks_of_the_ledgers_follow_the_rows(spark, monkeypatch):
    rows = [(t, t // 3, "ab"[t % 2], d, d % 5, float((t * 7 + d) % 9)) for t in range(300) for d in range(t % 4, 12, 3)] + [(None, 1, "a", 1, 1, 1.0), (900, None, "a", 1, 1, 1.0), (3, 1, "b", 3, 3, 0.5)]
    run = lambda: assign.assign_with_ledgers(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a", 70), ("b", 20)], "operation string, quota int"), 2, 3, 6)
    few = sorted(map(str, run().collect()))
    monkeypatch.setattr(order, "ROWS_A_TASK", 100, raising=False)
    got = run()
    # Adaptive execution made one task of these rows, as it makes one of millions that are narrow.
    assert got.rdd.getNumPartitions() >= len(rows) / 100 > 10
    assert sorted(map(str, got.collect())) == few and len(few) == 301


def test_rooms_of_the_ledgers_grow_with_the_tables(spark, tmp_path):
    for times in (1, 3):
        folder, n = tmp_path / str(times), 120 * times
        tables = {
            "orders": spark.range(n).selectExpr("id AS o_orderkey", "id % 4 AS o_custkey", "CAST(id % 3 AS string) AS o_orderpriority"),
            "supplier": spark.range(6 * times).selectExpr("id AS s_suppkey", "CAST(id % 2 AS int) AS s_nationkey"),
            # An order has a supplier of either nation, and three of four like that of the first better.
            "lineitem": spark.range(2 * n).selectExpr("id DIV 2 AS l_orderkey", f"id DIV 2 % {3 * times} * 2 + id % 2 AS l_suppkey", "IF((id DIV 2 % 4 = 0) = (id % 2 = 0), 1.0D, 2.0D) AS l_quantity"),
        }
        for name, rows in tables.items():
            rows.coalesce(1).write.parquet(str(folder / f"{name}.parquet"))
        got = records.ledger_assignment(spark, str(folder)).collect()
        assert sorted(r.target for r in got) == list(range(n)) and all(r["round"] is not None for r in got)
        # Equal parts are 20 orders a supplier and 60 * times a nation; 30 like one supplier best.
        assert max(Counter(r.donor for r in got).values()) == 24 and max(Counter(r.donor_group for r in got).values()) == 72 * times
        assert {r["round"] for r in got} == {0, 1}


def test_large_rooms_are_places_over_ranges(spark, monkeypatch):
    rows = [(t, t % 5, "ab"[t % 2], d, d % 3, float((t * 7 + d) % 9)) for t in range(200) for d in range(t % 4, 12, 3)]
    quotas, caps = [("a", 70), ("b", 90)], {"target_cap": 35, "donor_cap": 14, "group_cap": 50}
    few = sorted(map(str, ledger_rows(spark, rows, quotas, **caps)))
    monkeypatch.setattr(assign, "RANKED_IN_TASKS", 20)
    assert sorted(map(str, ledger_rows(spark, rows, quotas, **caps))) == few and len(few) == 200
    open_ = ledger_rows(spark, rows, [("a", 0)], **caps)
    assert [r.reason for r in open_] == ["operations full"] * 200 and all(r["round"] is None for r in open_)


def test_intervals_tubes_and_snapped_times(spark):
    frames = [("t", f, f / 10.0, 1.0, 0.0, 0.0, 1.0, 1.0) for f in (0, 1, 2, 5, 6, 20)] + [("t", 3, 0.3, 0.0, 9.0, 9.0, 9.0, 9.0), ("t", 7, 0.7, 5.0, -1.0, 2.0, 3.0, 4.0), (None, 1, 0.1, 1.0, 0.0, 0.0, 1.0, 1.0), ("e", 1, 0.1, 0.0, 0.0, 0.0, 1.0, 1.0), ("t", 2, 0.2, 1.0, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(frames, "k string, f int, s double, a double, x1 double, y1 double, x2 double, y2 double")
    got = evidence.intervals(df, "k", "f", "s", "a", 1, 0.35).orderBy("interval").collect()
    assert [(r.k, r.first_frame, r.last_frame, r.start, r.end, r.n_runs) for r in got] == [("t", 0, 7, 0.0, 0.7, 2), ("t", 20, 20, 2.0, 2.0, 1)]
    tubes = {r.k: r for r in evidence.tubes(df, "k", "f", "s", "a", ["x1", "y1", "x2", "y2"]).collect()}
    assert (tubes["t"].n_frames, tubes["t"].n_empty, tubes["t"].x1, tubes["t"].y2, tubes["t"].key_frame, tubes["t"].area_max) == (8, 1, -1.0, 4.0, 7, 5.0)
    assert (tubes["e"].n_frames, tubes["e"].key_frame, tubes["e"].x1) == (0, None, None)
    points = spark.createDataFrame([("t", x) for x in (0.0, 1.0, 1.5, 2.0, 9.0)] + [("u", 1.0), ("t", None)], "k string, s double")
    samples = spark.createDataFrame([("t", 1.0), ("t", 2.0), ("t", 2.0), ("t", None), ("v", 0.0)], "k string, s double")
    near = {(r.k, r.s): r.n for r in evidence.snapped(points, samples, ["k"], "s", "n").collect()}
    assert near == {("t", 0.0): 1.0, ("t", 1.0): 1.0, ("t", 1.5): 1.0, ("t", 2.0): 2.0, ("t", 9.0): 2.0, ("u", 1.0): None, ("t", None): None}


def test_mean_area_of_a_tie_is_the_same_in_any_order(spark):
    areas = [round(0.01 * (i % 97) + 40, 2) for i in range(79)]
    areas.append(round(80 * 40.50125 - sum(areas), 2))  # the mean is 40.50125
    for order in (areas, areas[::-1], sorted(areas)):
        df = spark.createDataFrame([("t", f, float(f), a, 0.0, 0.0, 1.0, 1.0) for f, a in enumerate(order)], "k string, f int, s double, a double, x1 double, y1 double, x2 double, y2 double")
        for parts in (1, 3, 5, 7):
            got = evidence.tubes(df.repartition(parts), "k", "f", "s", "a", ["x1", "y1", "x2", "y2"], digits=4).first()
            assert got.area_mean == 40.50125 and (got.area_min, got.n_frames) == (min(areas), 80)


def test_only_a_partitions_first_and_last_group_are_carried():
    rng = np.random.default_rng(3)
    for sizes in ([4], [1] * 9, [3, 1, 5, 2], [1, 7], [6, 1]):
        keys = [f"k{g}" for g, n in enumerate(sizes) for _ in range(n)]
        cells = [(np.eye(2) + rng.normal(size=(2, 2)) * 0.1).ravel().tolist() for _ in keys]
        table = pa.table({"_key": keys, "m": pa.array(cells, pa.list_(pa.float64()))})
        for batch in (1, 2, 3, 100):
            out = pa.Table.from_batches(scan._local_products(iter(table.to_batches(batch)), "_key", "m", 2, True)).to_pylist()
            assert [r["_key"] for r in out] == keys
            assert [i for i, r in enumerate(out) if r["_end"]] == sorted({sizes[0] - 1, len(keys) - 1})
            now, name = np.eye(2), None
            for r in out:
                now = np.array(r["m"]).reshape(2, 2) @ (now if r["_key"] == name else np.eye(2))
                now, name = now / now[1, 1], r["_key"]
                assert np.allclose(np.array(r["_local"]).reshape(2, 2), now)
