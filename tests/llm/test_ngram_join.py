import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm.components import connected_components
from millrace.llm.ngram_join import Shingler, Threshold, combination_prefix, jaccard_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_components(rows, k, num, den):
    sets = {i: plain_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and den * (c := len(x & y)) >= num * (len(x) + len(y) - c):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base, long = fresh(60), fresh(90), fresh(1500)
    texts = [" ".join(fresh(rng.randrange(1, 60))) for _ in range(40)]
    texts += [" ".join(passage + fresh(rng.randrange(0, 9))) for _ in range(60)]  # all their shingles are frequent
    for _ in range(70):  # a group of near copies from slight to strong edits
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    for _ in range(6):
        w = list(long)
        for _ in range(rng.randrange(0, 50)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += texts[:20] + ["", " \t\n", "one", "one two", "ONE Two", "one  two", None, None, "x y z", "İ ß É"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "k", "num", "den"), [(1, 3, 9, 10), (2, 5, 4, 5)])
def test_against_all_pairs(spark, seed, k, num, den):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, words=k, num=num, den=den).collect()}
    assert got == plain_components(rows, k, num, den)


def test_nulls_repeats_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, "a", 1), (5, text, None, 2), (5, text, "b", 3), (7, text, "c", 4), (8, None, "d", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, sig int")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_components(df).collect())
    assert got == [(-1, 26, None), (5, 26, 5), (5, 26, 5), (7, 26, 5), (8, 0, 8)]


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shingles_of_slices_and_chunks_agree():
    texts = ["a b c d", None, "A  b\tc d", "é è", "x " * 500, ""]
    array = pa.array([None, *texts])[1:]
    got = [s.tolist() for s in Shingler(3).sets(array)]
    assert got[0] == got[2] and got[1] == got[5] == [] and len(got[0]) == 2 and len(got[3]) == len(got[4]) == 1
    shingler = Shingler(3)
    assert [next(shingler.sets(pa.array([t]))).tolist() for t in texts] == got


def test_combination_prefixes_share_a_signature():
    rng, bound = np.random.default_rng(3), Threshold(9, 10)
    for _ in range(200):
        n = int(rng.integers(9, 300))
        x = np.unique(rng.integers(-(2**62), 2**62, n))
        often = lambda s: s % 10 < rng_cut  # noqa: B023, E731
        rng_cut = int(rng.integers(0, 11))
        y = x.copy()
        while True:  # change y while the two still link
            z = y.copy()
            z[rng.integers(len(z))] = rng.integers(-(2**62), 2**62)
            z = np.unique(z)
            c = len(np.intersect1d(x, z))
            if 10 * c < 9 * (len(x) + len(z) - c):
                break
            y = z
        a, b = (combination_prefix(s, often(s), bound, len(s)) for s in (x, y))
        assert len(np.intersect1d(a, b))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(50, 80)] + [(7, 7), (None, 3), (1, 50)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 1 for i in (1, *range(50, 80))}


def test_large_buckets_are_extended_not_paired(spark):
    """A family around one text, more of it than a bucket may hold: near and far copies, and sub-families that share edits."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for family in range(4):
        own = list(base)
        for i in range(20 * family):
            own[7 * i % 150] = f"f{family}.{i}"
        for _ in range(110):
            w = list(own)
            for _ in range(rng.randrange(0, 12)):
                w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(w[: rng.choice((150, 150, 140, 120))]))
    rows = list(enumerate(rows))
    for k, num, den in ((5, 4, 5), (3, 9, 10)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=k, num=num, den=den).collect()}
        assert got == plain_components(rows, k, num, den)


def test_words_of_one_polynomial_hash_stay_apart(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba")))]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2}
