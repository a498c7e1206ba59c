import random

import pytest
from pyspark.sql import functions as F

from millrace.llm.mixing import emit_copies, mix, ordinals, source_targets


def plain_targets(sizes, weights=(3, 1, 2), budget=1.5, cap=2):
    """Reshare by weight, step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, live = dict.fromkeys(names, 0.0), {s for s in names if sizes[s]}
    rest = budget * sum(sizes.values())
    while live:
        share = rest / sum(w[s] for s in live)
        over = {s for s in live if share * w[s] >= cap * sizes[s]}
        for s in over or live:
            target[s] = cap * sizes[s] if over else share * w[s]
        rest -= sum(target[s] for s in over)
        if not over:
            break
        live -= over
    return target


def test_targets_and_draws(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a", "b", "é", "Z", "a", "a", "a", None, "tiny"] if i % 50 == 0 else ["a", "a", "b", "Z", None])) for i in range(4000)]
    rows += [(None, "one two", "a"), (9001, None, "nul"), (9002, " \t\x0b", "nul")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(60, 0.06 * want[s]) for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(3)).collect()))
    copies = {(r.doc_id, r.source): r.copies for r in got}
    emitted = emit_copies(df.withColumn("size", F.lit("x"))).groupBy("doc_id", "source").count().collect()
    assert {(r.doc_id, r.source): r["count"] for r in emitted} == {k: c for k, c in copies.items() if c}


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).collect() == [] and emit_copies(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mix(blank).collect()] == [(0.0, 0)] * 2


def test_order_of_ordinals(spark):
    df = spark.createDataFrame([(s,) for s in ["b", None, "a", "é", "Z", ""]], "s string")
    assert [r.s for r in ordinals(df, "s", "n").orderBy("n").collect()] == ["", "Z", "a", "b", "é", None]
    assert source_targets(spark.createDataFrame([("a", 10)], "source string, size long")).first().target == 15.0
