"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model on plain text features gives each document's own evidence.  The
evidence (the label where there is one, else the model's probability) is summed
per path and per host.  Each host's rate is shrunk toward the global rate and
each path's toward its host's, by prior strengths estimated from how much the
rates of that level vary beyond what their sizes explain (method of moments):
sites with little data stay at their prior, large ones follow their own.  A
document's own evidence is left out of the rates that it is scored by.  The
final log odds are the document's plus the path's posterior's less the global's.

Null texts count as empty.  Null hosts and paths are sites of their own.  Labels
other than 0 and 1 and repeated labels with differing values are averaged.
Documents that repeat a key are classified each by its own text.  Without any
labels all documents get the score 0.5 and are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, unit_hash, word_count

#: Bound of the labelled sample that the model is fitted on.
SAMPLE = 20_000
RIDGE = 1.0
FEATURES = ("log_words", "word_length", "symbols", "digits", "capitals", "lines_once", "words_once", "short")
#: Documents are kept from this score on.
KEEP = 0.5
#: Least and largest weight, in documents, of a prior.
PRIOR = (2.0, 1e6)


def features(text: Column) -> dict[str, Column]:
    """Feature name to a double; empty text gives zeros."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = word_count(text)
    count = lambda x: F.greatest(x, F.lit(1)).cast("double")
    left = lambda p: F.length(F.regexp_replace(text, p, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    tokens = F.split(text, " ")
    return {
        "log_words": F.log1p(words.cast("double")),
        "word_length": (F.length(text) - F.regexp_count(text, F.lit(r"\s"))) / count(words),
        "symbols": left(r"[\p{L}\p{N}\s]+") / chars,
        "digits": left(r"[^0-9]+") / chars,
        "capitals": left(r"[^A-Z]+") / chars,
        "lines_once": F.size(F.array_distinct(lines)) / count(F.size(lines)),
        "words_once": F.size(F.array_distinct(tokens)) / count(F.size(tokens)),
        "short": (words < 20).cast("double"),
    }


class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.middle, self.spread = x.mean(0), x.std(0) + 1e-9
        z = np.hstack([(x - self.middle) / self.spread, np.ones((len(x), 1))])
        w, ridge = np.zeros(z.shape[1]), RIDGE * np.eye(z.shape[1])
        ridge[-1, -1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
            w += step
            if abs(step).max() < 1e-9:
                break
        self.weights, self.bias = w[:-1], w[-1]

    def log_odds(self) -> Column:
        terms = [(F.col(f) - float(m)) / float(s) * float(w) for f, m, s, w in zip(FEATURES, self.middle, self.spread, self.weights, strict=True)]
        return sum(terms, F.lit(float(self.bias)))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _prior_strength(sites: DataFrame, base: Column) -> float:
    """Documents that the prior is worth, from sites (n, s) and each one's prior rate: the excess of the rates' variance over sampling noise."""
    rate = F.col("s") / F.col("n")
    got = sites.filter("n >= 2").agg(
        F.sum("n"), F.sum(F.col("n") * (rate - base) * (rate - base)), F.sum(base * (1 - base)), F.sum(F.col("n") * base * (1 - base))
    ).first()
    n, spread, noise, scale = (float(x or 0) for x in got)
    if not n or not scale:
        return PRIOR[0]
    excess = (spread - noise) / n
    return float(min(PRIOR[1], max(PRIOR[0], (scale / n) / excess - 1))) if excess > 1e-12 else PRIOR[1]


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality") -> DataFrame:
    """``key``, p_doc, host_rate, path_rate, score, kept for each row."""
    truth = labels.filter(labels[key].isNotNull() & labels[label].isNotNull()).groupBy(labels[key].alias("_lk")).agg(F.avg(labels[label].cast("double")).alias("label"))
    base = docs.select(docs[key].alias("_key"), docs[host].alias("host"), docs[path].alias("path"), *(c.alias(n) for n, c in features(docs[text]).items()))
    base = cut(base.join(truth, F.col("_key") == F.col("_lk"), "left").drop("_lk"), "features")
    known = base.filter("label IS NOT NULL")
    n = known.count()
    drawn = known.filter(unit_hash("_key", seed="quality-1") < min(1.0, SAMPLE / max(n, 1))).select(*FEATURES, "label").limit(2 * SAMPLE).collect()
    if not drawn:
        return base.select(F.col("_key").alias(key), *[F.lit(0.5).alias(c) for c in ("p_doc", "host_rate", "path_rate", "score")], F.lit(True).alias("kept"))
    rows = np.array([[float(v) for v in r] for r in drawn])
    model = Logistic(rows[:, :-1], rows[:, -1])
    scored = base.select("_key", "host", "path", "label", model.log_odds().alias("odds")).withColumn("p", 1 / (1 + F.exp(-F.col("odds"))))
    evidence = F.coalesce("label", "p")
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(evidence).alias("s")), "paths", small=True)
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts", small=True)
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    k_host = _prior_strength(hosts, F.lit(float(total)))
    hosts = hosts.select(F.col("host").alias("_host"), F.col("n").alias("_hn"), F.col("s").alias("_hs"), ((F.col("s") + k_host * float(total)) / (F.col("n") + k_host)).alias("host_rate"))
    nested = cut(paths.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host"), "sites", small=True)
    k_path = _prior_strength(nested, F.col("host_rate"))
    sites = nested.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "_hn", "_hs", F.col("n").alias("_pn"), F.col("s").alias("_ps"))
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    joined = joined.withColumn("host_rate", (F.col("_hs") - evidence + k_host * float(total)) / (F.col("_hn") - 1 + k_host))
    joined = joined.withColumn("path_rate", (F.col("_ps") - evidence + k_path * F.col("host_rate")) / (F.col("_pn") - 1 + k_path))
    odds = F.col("odds") + _logit(F.col("path_rate")) - _logit(F.lit(float(total)))
    joined = joined.withColumn("score", F.round(1 / (1 + F.exp(-odds)), 6))
    return joined.select(F.col("_key").alias(key), F.round("p", 6).alias("p_doc"), F.round("host_rate", 6).alias("host_rate"), F.round("path_rate", 6).alias("path_rate"), "score", (F.col("score") >= KEEP).alias("kept"))
