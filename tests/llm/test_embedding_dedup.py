import numpy as np

from millrace.llm.embedding_dedup import forest, near_duplicates


def brute(rows, threshold):
    good = [(k, l, np.array(v, float)) for k, v, l in rows if k is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 16]
    out = {k: [0, k] for k, _, _ in rows}
    links = [(a[0], b[0]) for i, a in enumerate(good) for b in good[:i] if a[1] == b[1] and a[2] @ b[2] / np.sqrt((a[2] @ a[2]) * (b[2] @ b[2])) >= threshold]
    for a, b in links:
        out[a][0] += 1
        out[b][0] += 1
    while True:
        before = [x[1] for x in out.values()]
        for a, b in links:
            out[a][1] = out[b][1] = min(out[a][1], out[b][1])
        if before == [x[1] for x in out.values()]:
            return {k: tuple(v) for k, v in out.items()}


def test_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(30):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), (centre + rng.normal(size=16) * 0.15).tolist(), c % 3))
    rows += [(len(rows) + i, rows[4][1], rows[4][2]) for i in range(5)]  # copies
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None, *[1.0] * 15], 1), (1004, rows[0][1], None), (1005, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS n", "'x' AS node")
    exact = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for k, v, l in rows]
    want = brute(exact, 0.93)
    for block in (512, 4):
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df, block=block).collect()}
        found, all_ = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
        assert all(got[k][0] <= want[k][0] for k in want) and found >= 0.9 * all_ > 0
        assert all(r.kept == (r.vec_id == r.component_id) for r in near_duplicates(df, block=block).collect())


def test_third_of_the_rows_in_one_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre, x = unit(rng.normal(size=64)), unit(rng.normal(size=(900, 64)))
    off = unit(x[:300] - np.outer(x[:300] @ centre, centre))
    x[:300] = np.sqrt(0.96) * centre + np.sqrt(0.04) * off
    for part in (x, x[:300]):  # among others, and alone: one pivot
        linked = part @ part.T >= 0.93
        df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(part)], "vec_id long, embedding array<double>, label int")
        got = {r.vec_id: r for r in near_duplicates(df).collect()}
        assert all(got[i].n_links <= n for i, n in enumerate(linked.sum(1) - 1))
        assert sum(r.n_links for r in got.values()) >= 0.9 * (linked.sum() - len(part)) > 0
        assert all(got[i].component_id == 0 for i in range(300))


def test_null_key_and_empty_table(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == {None: (0, None, False), 2: (1, 2, True), 3: (1, 2, False)}
    assert near_duplicates(df.limit(0)).collect() == []


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(0)
    for _ in range(50):
        linked = rng.random((8, 9)) < 0.15
        parts = lambda pairs: _parts(pairs, 8, 9)
        assert parts(forest(linked.copy())) == parts(list(zip(*np.nonzero(linked), strict=True)))


def _parts(pairs, rows, cols):
    parent = list(range(rows + cols))
    for _ in range(rows + cols):
        for a, b in pairs:
            p = min(parent[a], parent[rows + b])
            parent[a] = parent[rows + b] = p
    return parent


def test_widths_scales_and_signed_zeros(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0, 0.0, 0.0], "a"), (4, [0.9, 0.1, 0.0], "a"), (5, [0.0, 0.0, 1.0], "a"), (6, [1e200, 1e199], "b"), (7, [1e-200, 1e-201], "b"), (8, [1.0, 0.0], "c"), (9, [1.0, -0.0], "c")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (1, 8), 9: (1, 8)}
