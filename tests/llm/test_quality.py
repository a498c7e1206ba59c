import math
import random

from millrace.llm import quality
from millrace.llm.quality import classify


def corpus():
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.3
        words = [rng.choice(["lorem", "ipsum", "dolor", "amet", "sit"]) + ("***" if bad else "") for _ in range(rng.randrange(20, 60))]
        docs.append((i, " ".join(words), rng.choice(["h1", "h1", "h2", None]), rng.choice(["p1", "p2", None])))
        if i % 2:
            labels.append((i, int(not bad)))
    return docs, labels


def test_held_out_accuracy_and_shrinkage(spark):
    docs, labels = corpus()
    odd = [(1000, None, "h9", None), (1001, "", None, None), (None, "lorem ipsum " * 20, "h1", "p1"), (3, docs[3][1], docs[3][2], docs[3][3])]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS score", "2 AS label")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None), labels[0]], "doc_id long, quality int")
    got = classify(df, lab).collect()
    assert len(got) == len(docs) + len(odd)
    held = [(r.kept, "***" not in docs[r.doc_id][1]) for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 2 == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= v <= 1 for r in got for v in (r.p_doc, r.host_rate, r.path_rate, r.score))
    rates = [r.host_rate for r in got if r.doc_id not in (1000, 1001)]
    lone = next(r for r in got if r.doc_id == 1000)
    assert abs(lone.host_rate - sum(rates) / len(rates)) < 0.35  # one document barely moves its site


def test_posteriors_against_plain_sums(spark, monkeypatch):
    """The rates of every document from plain loops over all others of its site."""
    docs, labels = corpus()
    strengths = []
    monkeypatch.setattr(quality, "_prior_strength", lambda sites, base: strengths.append(2.0 + 3 * len(strengths)) or strengths[-1])
    got = {r.doc_id: r for r in classify(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    truth = dict(labels)
    evidence = {i: truth.get(i, got[i].p_doc) for i, *_ in docs}
    total = sum(evidence.values()) / len(evidence)
    for i, _, h, p in docs[::17]:
        host = [evidence[j] for j, _, g, _ in docs if g == h and j != i]
        path = [evidence[j] for j, _, g, q in docs if (g, q) == (h, p) and j != i]
        host_rate = (sum(host) + strengths[0] * total) / (len(host) + strengths[0])
        path_rate = (sum(path) + strengths[1] * host_rate) / (len(path) + strengths[1])
        assert abs(got[i].host_rate - host_rate) < 1e-5 and abs(got[i].path_rate - path_rate) < 1e-5
        logit = lambda x: math.log(x / (1 - x))
        score = 1 / (1 + math.exp(-(logit(min(max(got[i].p_doc, 1e-9), 1 - 1e-9)) + logit(path_rate) - logit(total))))
        assert abs(got[i].score - score) < 1e-3


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "abc", None, "x")], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.score, r.kept) for r in classify(df, none).collect()] == [(0.5, True)]
    assert classify(df.limit(0), none).collect() == []
