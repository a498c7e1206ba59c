import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm.language_id import RIDGE, Model, ngrams, predict_language, train_model

SYLLABLES = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["über", "sch", "ein", "gen"], "cc": ["что", "это", "как", "дом"]}


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        out.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(12)), lang))
    return out


def test_held_out_accuracy_and_edges(spark):
    rows = texts(1, 240)
    df = spark.createDataFrame([(k, t, lang if k % 3 else None, "s", 0.5) for k, t, lang in rows], "doc_id long, text string, lang string, source string, score double")
    model = train_model(df)
    odd = [(1000, None), (1001, ""), (1002, "123 *** 😀"), (1003, "漢字"), (1004, "a"), (None, "kalomi"), (1005, "kalomi " * 20_000), (1005, "kalomi " * 20_000)]
    every = df.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = predict_language(every, model).collect()
    assert len(got) == len(rows) + len(odd)
    held = {k: lang for k, _, lang in rows if k % 3 == 0}
    right = [r.lang_pred == held[r.doc_id] for r in got if r.doc_id in held]
    assert sum(right) >= 0.98 * len(right)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1000, 1001, 1002))
    assert by[1003].lang_pred in SYLLABLES and by[1005].lang_pred == by[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)


def test_scores_against_a_plain_kernel_machine(spark):
    """Scores of the folded model equal those from kernel values, landmark by landmark."""
    sample = [(lang, k, ngrams(t)) for k, t, lang in texts(3, 45)]
    model = Model(sample)
    order = sorted(sample, key=lambda x: (x[0], x[1], x[2].tobytes()))
    kernel = lambda a, b: len(set(a.tolist()) & set(b.tolist())) / (len(a) * len(b)) ** 0.5
    grams = [x[2] for x in order]
    own = np.array([[kernel(a, b) for b in grams] for a in grams])  # all are landmarks here
    power, axes = np.linalg.eigh(own)
    good = power > 1e-8 * power[-1]
    to_space = axes[:, good] / np.sqrt(power[good])
    rows = own @ to_space
    truth = np.array([[float(x[0] == c) for c in model.classes] for x in order])
    x = rows - rows.mean(0)
    w = np.linalg.solve(x.T @ x + RIDGE * len(x) * np.eye(x.shape[1]), x.T @ (truth - truth.mean(0)))
    for _, t, _ in texts(4, 12):
        g = ngrams(t)
        want = (np.array([kernel(g, m) for m in grams]) @ to_space - rows.mean(0)) @ w + truth.mean(0)
        assert np.allclose(model.scores([g])[0], want, atol=1e-6)


def test_more_classes_than_a_fixed_few(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abcdefghij") for _ in range(6)) + f" {chr(0x4E00 + i % 230) * 4}", f"l{i % 230}") for i in range(460)]
    assert len(train_model(spark.createDataFrame(rows, "doc_id long, text string, lang string")).classes) == 230


def test_training_filter_is_kept(spark):
    df = spark.createDataFrame(texts(2, 60), "doc_id long, text string, lang string")
    assert train_model(df, train=F.col("lang") != "bb").classes == ["aa", "cc"]


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert train_model(df) is None
    assert {r.lang_pred for r in predict_language(df, None, carry=("lang",)).collect()} == {"und"}
    assert predict_language(df.limit(0), None).collect() == []


def test_ngrams_count_presence_of_letters_only():
    assert ngrams("ab!ab") is not None and (ngrams("AB") == ngrams("ab ** ab")[: len(ngrams("AB"))]).sum() > 0
    assert ngrams("12") is None and len(ngrams("a")) == 2 + 2 + 1
