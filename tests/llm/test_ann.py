import numpy as np
from pyspark.sql import functions as F

from millrace.llm.ann import encode, nearest, rotation

SCHEMA = "vec_id long, embedding array<float>"


def product(x, y):
    total = 0.0
    for a, b in zip(x.tolist(), y.tolist(), strict=True):  # not sum(), which compensates
        total += a * b
    return total


def brute(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            scored = sorted((-product(x, y), i) for i, y in good if i != q and len(y) == len(x))
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return {q: v for q, v in out.items() if v}


def test_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=24) * rng.uniform(0.1, 3) + (i % 3)).tolist()) for i in range(1500)]
    rows += [(1500 + i, rows[40][1]) for i in range(700)]  # a third are one vector
    rows += [(9000, None), (9020, []), (9040, [0.0] * 24), (9060, [float("nan")] * 24), (9080, [None, *[1.0] * 23]), (None, rows[0][1])]
    rows += [(9100, [1.0, 2.0]), (9101, [2.0, 1.0]), (9102, [-1.0, 0.5]), (9120, [3.0])]  # few of a length; none but itself
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS slice", "'x' AS key", "2 AS score")
    want = brute(rows, 20)
    for options in ({}, {"slice_values": 24 * 300, "sample_rows": 1}):
        got = {}
        for r in nearest(df, F.col("vec_id") % 20 == 0, **options).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        got = {q: sorted(v) for q, v in got.items()}
        assert got.keys() == want.keys()
        hits = sum(len(set(got[q]) & set(want[q])) for q in want)
        assert hits >= 0.999 * sum(map(len, want.values()))
        assert all([r for r, _, _ in v] == list(range(1, len(v) + 1)) for v in got.values())


def test_bound_holds():
    rng = np.random.default_rng(4)
    for width in (1, 2, 7, 64, 200):
        x, q = rng.normal(size=(2000, width)), rng.normal(size=(50, width))
        centre = x[:100].mean(0)
        assert np.allclose(rotation(width) @ rotation(width).T, np.eye(width))
        codes, scalars = encode(x, centre)
        assert codes.dtype == np.uint8 and codes.shape[1] == -(-width // 8)
        bits = np.unpackbits(codes, axis=1, count=width).astype(float)
        turned = q @ rotation(width)
        r, scale, error = scalars.T
        estimate = q @ centre[:, None] + (turned @ (2 * bits - 1).T) * (r * scale)
        off = np.abs(estimate - q @ x.T) / np.maximum(np.sqrt((q * q).sum(1))[:, None] * (r * error)[None], 1e-12)
        assert (off <= 1 + 1e-6).mean() > 0.9998


def test_large_numbers_and_repeats(spark):
    rows = [(i, [float(i % 5 + 1) * 1e37, 1e36, -float(i) * 1e36]) for i in range(60)] + [(20, [1e37, 0.0, 0.0])] * 2
    got = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 20, k=3).collect()
    assert len(got) == 6 and all(r.vec_id != 20 and np.isfinite(r.score) for r in got)
    assert nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
    doubles = spark.createDataFrame([(0, [1.0, 1e-9]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in nearest(doubles, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1.0 + 1e-9), (2, 1.0 + 1e-9)]
