"""Queries of the metric family over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, metrics, windows
from ..session import table


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with a score: share of 2000 characters."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").withColumn("score", F.least(F.col("n_chars") / 2000.0, F.lit(1.0)))


SCORED = "SELECT l.doc_id, quality, toxic, lang, source, n_chars, least(n_chars / 2000.0::DOUBLE, 1.0::DOUBLE) AS score FROM labels l JOIN documents d USING (doc_id)"


def r6(c: str):
    return F.round(c, 6).alias(c)


def confusion_by_lang(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.confusion(_scored(spark, d), ["lang"], F.col("quality") == 1, F.col("n_chars") >= 500)
    return out.select("lang", "tp", "fp", "tn", "fn", *map(r6, ("accuracy", "precision", "recall", "balanced_accuracy", "f1")))


CONFUSION_SQL = f"""
WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND n_chars >= 500) AS tp, count(*) FILTER (quality = 0 AND n_chars >= 500) AS fp,
  count(*) FILTER (quality = 0 AND n_chars < 500) AS tn, count(*) FILTER (quality = 1 AND n_chars < 500) AS fn FROM ({SCORED}) GROUP BY lang),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS rc, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS sp FROM c)
SELECT lang, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy, round(p, 6) AS precision, round(rc, 6) AS recall,
  round((rc + sp) / 2, 6) AS balanced_accuracy, round(coalesce(2 * p * rc / nullif(p + rc, 0), 0), 6) AS f1 FROM r
"""


def auc_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(_scored(spark, d), ["lang"], "score", "quality").select("lang", "pos", "neg", r6("auc"))


AUC_SQL = f"""
WITH x AS ({SCORED}), k AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS r FROM x),
a AS (SELECT lang, sum(quality)::BIGINT AS pos, sum(1 - quality)::BIGINT AS neg, sum(r) FILTER (quality = 1) AS s FROM k GROUP BY lang)
SELECT lang, pos, neg, round((s - pos * (pos + 1) / 2.0::DOUBLE) / nullif(pos * neg, 0), 6) AS auc FROM a
"""


def average_precision_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(_scored(spark, d), ["lang"], "score", "quality").select("lang", "pos", r6("ap"))


AP_SQL = f"""
WITH x AS ({SCORED}), g AS (SELECT lang, score, sum(quality) AS p, count(*) AS n FROM x GROUP BY lang, score),
c AS (SELECT lang, p, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
SELECT lang, sum(p)::BIGINT AS pos, round(coalesce(sum(p * tp / seen::DOUBLE) / nullif(sum(p), 0), 0), 6) AS ap FROM c GROUP BY lang
"""


def threshold_sweep_ba(spark: SparkSession, d: str) -> DataFrame:
    return metrics.threshold_sweep(_scored(spark, d), ["lang"], "score", "quality").select("lang", "threshold", r6("balanced_accuracy"))


def _sweep_sql(goal: str, value: str) -> str:
    return f"""
WITH x AS ({SCORED}), e AS (SELECT lang, score, quality AS p, 1 - quality AS n FROM x UNION ALL SELECT DISTINCT lang, unnest([0.0::DOUBLE, 1.0::DOUBLE]), 0, 0 FROM x),
g AS (SELECT lang, score, sum(p) AS p, sum(n) AS n FROM e GROUP BY lang, score),
c AS (SELECT lang, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY lang) AS ap, sum(n) OVER (PARTITION BY lang) AS an FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC)),
b AS (SELECT lang, score, round({value}, 12) AS v FROM c)
SELECT lang, score AS threshold, round(v, 6) AS {goal} FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY v DESC, abs(score - 0.5::DOUBLE), score DESC) = 1
"""


SWEEP_SQL = _sweep_sql("balanced_accuracy", "(coalesce(tp / nullif(ap, 0)::DOUBLE, 0) + 1 - coalesce(fp / nullif(an, 0)::DOUBLE, 0)) / 2")


def threshold_sweep_f1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.threshold_sweep(_scored(spark, d), ["lang"], "score", "quality", "f1").select("lang", "threshold", r6("f1"))


SWEEP_F1_SQL = _sweep_sql("f1", "coalesce(2 * tp / nullif(tp + fp + ap, 0)::DOUBLE, 0)")


def pairwise_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per source and the unweighted mean over sources: toxic as gold, low quality as prediction."""
    per = metrics.confusion(_scored(spark, d), ["source"], F.col("toxic") == 1, F.col("quality") == 0).select("source", "recall", "balanced_accuracy", "f1")
    macro = per.agg(*[F.avg(c).alias(c) for c in per.columns[1:]]).select(F.lit("(macro)").alias("source"), *per.columns[1:])
    return per.unionByName(macro).select("source", *map(r6, per.columns[1:]))


PAIRWISE_SQL = f"""
WITH c AS (SELECT source, count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp,
  count(*) FILTER (toxic = 0 AND quality = 1) AS tn, count(*) FILTER (toxic = 1 AND quality = 1) AS fn FROM ({SCORED}) GROUP BY source),
r AS (SELECT source, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS sp FROM c),
m AS (SELECT source, recall, (recall + sp) / 2 AS balanced_accuracy, coalesce(2 * p * recall / nullif(p + recall, 0), 0) AS f1 FROM r),
u AS (SELECT * FROM m UNION ALL SELECT '(macro)', avg(recall), avg(balanced_accuracy), avg(f1) FROM m)
SELECT source, round(recall, 6) AS recall, round(balanced_accuracy, 6) AS balanced_accuracy, round(f1, 6) AS f1 FROM u
"""


def multilabel_prf(spark: SparkSession, d: str) -> DataFrame:
    """Per return flag: does an order hold it (gold) against whether a large line is of it (prediction)."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("label")).agg(F.bool_or(F.col("l_quantity") > 25).alias("pred"))
    c = li.groupBy("label").agg(F.count_if("pred").alias("tp"), F.count_if(~F.col("pred")).alias("fn"), F.count("*").alias("support"))
    return c.withColumn("recall", metrics.ratio(F.col("tp"), F.col("support"))).select("label", "tp", "fn", "support", r6("recall"))


MULTI_SQL = """
WITH g AS (SELECT l_orderkey, l_returnflag AS label, bool_or(l_quantity > 25) AS pred FROM lineitem GROUP BY ALL)
SELECT label, count(*) FILTER (pred) AS tp, count(*) FILTER (NOT pred) AS fn, count(*) AS support, round(count(*) FILTER (pred) / count(*)::DOUBLE, 6) AS recall FROM g GROUP BY label
"""


def sample_set_f1(spark: SparkSession, d: str) -> DataFrame:
    """Mean set F1 and exact-match rate of each order's flags against its large lines' flags, by order status."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("gold"), F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_returnflag"))).alias("pred"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    x = li.join(o, "l_orderkey").withColumns({"f1": metrics.set_f1(F.col("gold"), F.col("pred")), "exact": (F.array_sort("gold") == F.array_sort("pred")).cast("double")})
    return x.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.avg("f1"), 6).alias("set_f1"), F.round(F.avg("exact"), 6).alias("exact_rate"))


SETF1_SQL = """
WITH g AS (SELECT l_orderkey, l_returnflag, bool_or(l_quantity > 25) AS pred FROM lineitem GROUP BY ALL),
s AS (SELECT l_orderkey, count(*) AS gold, count(*) FILTER (pred) AS hit FROM g GROUP BY l_orderkey)
SELECT o_orderstatus, count(*) AS orders, round(avg(2.0::DOUBLE * hit / (gold + hit)), 6) AS set_f1, round(avg((gold = hit)::INT::DOUBLE), 6) AS exact_rate
FROM s JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderstatus
"""


def bucket_confusion(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.substring("o_orderpriority", 1, 1).alias("gold"), F.least(F.floor(F.col("o_totalprice") / 100000) + 1, F.lit(5)).cast("int").cast("string").alias("pred"))
    c = o.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    total = c.groupBy("gold").agg(F.sum("n").alias("support"), F.coalesce(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n"))), F.lit(0)).alias("hit"), F.count("*").alias("predicted_buckets"))
    return total.select("gold", "support", "hit", "predicted_buckets", F.round(F.col("hit") / F.col("support"), 6).alias("recall"))


BUCKET_SQL = """
WITH o AS (SELECT o_orderpriority[1] AS gold, least(floor(o_totalprice / 100000) + 1, 5)::INT::VARCHAR AS pred FROM orders)
SELECT gold, count(*) AS support, count(*) FILTER (gold = pred) AS hit, count(DISTINCT pred) AS predicted_buckets, round(count(*) FILTER (gold = pred) / count(*)::DOUBLE, 6) AS recall FROM o GROUP BY gold
"""


def group_variance_rate(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return metrics.two_level_variance(o, ["o_orderstatus"], ["o_custkey"], "o_totalprice").select("o_orderstatus", "groups", r6("zero_variance_rate"), F.round("mean_std", 4).alias("mean_std"))


VARIANCE_SQL = """
WITH g AS (SELECT o_orderstatus, o_custkey, stddev_pop(o_totalprice) AS sd FROM orders GROUP BY ALL)
SELECT o_orderstatus, count(*) AS groups, round(avg((sd <= 1e-12)::INT::DOUBLE), 6) AS zero_variance_rate, round(avg(sd), 4) AS mean_std FROM g GROUP BY ALL
"""


def pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    g = c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.bool_or(F.col("role") == "assistant").alias("answered"), F.count_distinct("role").alias("roles"), F.count_distinct("text").alias("unique_texts"), F.var_pop(F.length("text").cast("double")).alias("v"))
    return g.groupBy("turns").agg(F.count("*").alias("conversations"), F.round(F.avg(F.col("answered").cast("double")), 6).alias("answered_rate"), F.round(F.avg((F.col("v") > 1e-8).cast("double")), 6).alias("varied_rate"), F.round(F.avg(F.col("unique_texts").cast("double")), 6).alias("mean_unique"), F.max("roles").alias("most_roles"))


PASS_SQL = """
WITH g AS (SELECT conv_id, count(*) AS turns, bool_or(role = 'assistant') AS answered, count(DISTINCT role) AS roles, count(DISTINCT text) AS u, var_pop(length(text)::DOUBLE) AS v FROM conversations GROUP BY conv_id)
SELECT turns, count(*) AS conversations, round(avg(coalesce(answered, false)::INT::DOUBLE), 6) AS answered_rate, round(avg((v > 1e-8)::INT::DOUBLE), 6) AS varied_rate, round(avg(u::DOUBLE), 6) AS mean_unique, max(roles) AS most_roles FROM g GROUP BY turns
"""


def quantiles_by_group(spark: SparkSession, d: str) -> DataFrame:
    li, by = table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]
    q = metrics.quantiles(li, by, "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    m = metrics.order_statistics(li, by, "l_quantity", {"upper_median_quantity": lambda n: F.floor(n / 2)})
    return q.select(*by, *[F.round(c, 4).alias(c) for c in ("p05", "p50", "p95")]).join(m, by)


QUANTILE_SQL = """
SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95,
  list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper_median_quantity FROM lineitem GROUP BY ALL
"""


def grouping_sets_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupingSets([["lang"], ["source"], ["lang", "source"], []], "lang", "source").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))


SETS_SQL = "SELECT lang, source, grouping_id(lang, source)::BIGINT AS level, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())"


def explode_counts_all(spark: SparkSession, d: str) -> DataFrame:
    """Every token of each language with its count, however rare."""
    docs = table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("token"))
    return docs.groupBy("lang", "token").agg(F.count("*").alias("n"))


EXPLODE_ALL_SQL = "SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents) GROUP BY ALL"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("day"), "value")
    return e.groupBy("event_type", "day").agg(F.avg("value").alias("mean"))


DAILY = "SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS day, avg(value) AS mean FROM events GROUP BY ALL"


def rolling_centered(spark: SparkSession, d: str) -> DataFrame:
    return windows.rolling_mean(_daily(spark, d), ["event_type"], "day", "mean", 5, "smooth").select("event_type", "day", r6("smooth"))


ROLLING_SQL = f"SELECT event_type, day, round(avg(mean) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM ({DAILY})"


def window_stats_slope_corr(spark: SparkSession, d: str) -> DataFrame:
    s = _daily(spark, d)
    out = windows.series_stats(s, ["event_type"], "day", "mean", 10)
    corr = s.groupBy("event_type").agg(F.corr("day", "mean").alias("corr"))
    return out.join(corr, "event_type").select("event_type", "n", "min_at", "max_at", *map(r6, ("first_value", "last_value", "head_mean", "tail_mean", "min_value", "max_value", "slope", "corr")))


STATS_SQL = f"""
WITH s AS ({DAILY}), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS u, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS v FROM s)
SELECT event_type, count(*) AS n, arg_min(day, (mean, day)) AS min_at, arg_max(day, (mean, -day)) AS max_at, round(arg_min(mean, day), 6) AS first_value, round(arg_max(mean, day), 6) AS last_value,
  round(avg(mean) FILTER (u <= 10), 6) AS head_mean, round(avg(mean) FILTER (v <= 10), 6) AS tail_mean, round(min(mean), 6) AS min_value, round(max(mean), 6) AS max_value,
  round(regr_slope(mean, day::DOUBLE), 6) AS slope, round(corr(day, mean), 6) AS corr FROM k GROUP BY event_type
"""


def longest_run_hours(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("hour"))
    return windows.longest_run(e, ["user_id"], "hour")


RUN_SQL = """
WITH h AS (SELECT DISTINCT user_id, floor(epoch(ts) / 3600)::BIGINT AS hour FROM events), i AS (SELECT *, hour - row_number() OVER (PARTITION BY user_id ORDER BY hour) AS g FROM h),
r AS (SELECT user_id, g, min(hour) AS first, max(hour) AS last, count(*) AS n FROM i GROUP BY ALL)
SELECT user_id, n, first, last FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1
"""


def runs_max_gap(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("hour"))
    return windows.runs(e, ["user_id"], "hour", 6).groupBy("user_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


GAP_SQL = """
WITH h AS (SELECT DISTINCT user_id, floor(epoch(ts) / 3600)::BIGINT AS hour FROM events),
s AS (SELECT user_id, hour, (coalesce(hour - lag(hour) OVER (PARTITION BY user_id ORDER BY hour), 7) > 6)::INT AS b FROM h),
r AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY hour) AS run FROM s), c AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY ALL)
SELECT user_id, count(*) AS runs, max(n) AS longest FROM c GROUP BY user_id
"""


def cosine_steps(spark: SparkSession, d: str) -> DataFrame:
    return windows.cosine_steps(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding").select("label", "vec_id", F.round("cosine_distance", 5).alias("cosine_distance"))


COSINE_SQL = """
WITH b AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
SELECT label, vec_id, round(1 - list_cosine_similarity(e, p), 5) AS cosine_distance FROM b WHERE p IS NOT NULL
"""


def gate_table(spark: SparkSession, d: str) -> DataFrame:
    x = _scored(spark, d)
    m = metrics.confusion(x, [], F.col("quality") == 1, F.col("n_chars") >= 500)
    checks = [("accuracy", "accuracy", ">=", 0.5), ("balanced", "balanced_accuracy", ">=", 0.6), ("recall", "recall", ">=", 0.4), ("f1", "f1", "<", 0.99)]
    return gates.gate(m, checks).select("check", F.round("value", 6).alias("value"), "op", "threshold", "passed")


GATE_SQL = f"""
WITH c AS (SELECT count(*) FILTER (quality = 1 AND n_chars >= 500) AS tp, count(*) FILTER (quality = 0 AND n_chars >= 500) AS fp, count(*) FILTER (quality = 0 AND n_chars < 500) AS tn, count(*) FILTER (quality = 1 AND n_chars < 500) AS fn FROM ({SCORED})),
r AS (SELECT (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS acc, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS rc, tn / (tn + fp)::DOUBLE AS sp FROM c),
v AS (SELECT 'accuracy' AS "check", acc AS value, '>=' AS op, 0.5::DOUBLE AS threshold, acc >= 0.5 AS passed FROM r UNION ALL SELECT 'balanced', (rc + sp) / 2, '>=', 0.6, (rc + sp) / 2 >= 0.6 FROM r
  UNION ALL SELECT 'recall', rc, '>=', 0.4, rc >= 0.4 FROM r UNION ALL SELECT 'f1', 2 * p * rc / (p + rc), '<', 0.99, 2 * p * rc / (p + rc) < 0.99 FROM r)
SELECT "check", round(value, 6) AS value, op, threshold, passed FROM v
"""


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("url", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", '(?i)lang="([a-z]+)"', 1).alias("lang"))
    return gates.coverage(pages, ["url", "title", "lang"]).withColumn("share", F.round("share", 6))


COVERAGE_SQL = """
WITH p AS (SELECT url, regexp_extract(html, '<title>(.*?)</title>', 1, 'is') AS title, regexp_extract(html, 'lang="([a-z]+)"', 1, 'i') AS lang FROM pages),
c AS (SELECT 'url' AS field, count(*) FILTER (coalesce(url, '') != '') AS filled, count(*) AS rows FROM p UNION ALL SELECT 'title', count(*) FILTER (coalesce(title, '') != ''), count(*) FROM p UNION ALL SELECT 'lang', count(*) FILTER (coalesce(lang, '') != ''), count(*) FROM p)
SELECT field, filled, rows, round(filled / rows::DOUBLE, 6) AS share FROM c
"""


def threshold_on_grid(spark: SparkSession, d: str) -> DataFrame:
    """The best threshold of a price for a returned line by status, among 2001 quantiles of the prices."""
    li = table(spark, d, "lineitem").select("l_linestatus", (F.col("l_extendedprice") / 100000).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    return metrics.threshold_sweep(li, ["l_linestatus"], "score", "returned", "f1", 2001).select("l_linestatus", r6("threshold"), r6("f1"))


GRID_SQL = """
WITH x AS (SELECT l_linestatus AS g, l_extendedprice / 100000 AS s, (l_returnflag = 'R')::INT AS y FROM lineitem),
e AS (SELECT g, s, y AS p, 1 - y AS n FROM x UNION ALL SELECT DISTINCT g, unnest([0.0::DOUBLE, 1.0::DOUBLE]), 0, 0 FROM x), c AS (SELECT g, s, sum(p) AS p, sum(n) AS n FROM e GROUP BY g, s),
m AS (SELECT g, s, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY g) AS ap FROM c WINDOW w AS (PARTITION BY g ORDER BY s DESC)),
q AS (SELECT g, unnest(CASE WHEN count(*) > 2001 THEN quantile_cont(s, [i / 2000::DOUBLE for i in range(2001)]) ELSE list(s) END) AS t FROM c GROUP BY g),
v AS (SELECT q.g, q.t, round(coalesce(2 * tp / nullif(tp + fp + ap, 0)::DOUBLE, 0), 12) AS v FROM q ASOF JOIN m ON q.g = m.g AND q.t <= m.s)
SELECT g AS l_linestatus, round(t, 6) AS threshold, round(v, 6) AS f1 FROM v QUALIFY row_number() OVER (PARTITION BY g ORDER BY v DESC, abs(t - 0.5::DOUBLE), t DESC) = 1
"""


def bootstrap_of_draws(spark: SparkSession, d: str) -> DataFrame:
    """The toxic rate of 20 resamples of as many draws as there are labelled documents."""
    lab = table(spark, d, "labels").select("doc_id", "toxic")
    drawn = metrics.bootstrap_draws(lab, "doc_id", 20, "draws").join(lab.filter("toxic IS NOT NULL"), "doc_id")
    return drawn.groupBy("repeat").agg(F.sum("times").alias("drawn"), F.count("*").alias("distinct_ids"), F.round(F.sum(F.col("times") * F.col("toxic")) / F.sum("times"), 6).alias("rate"))


DRAWS_SQL = """
WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL)),
w AS (SELECT r AS repeat, ('0x' || substr(sha256('draws:' || r || ':' || place), 1, 13))::BIGINT % n AS place FROM i, range(20) t(r)), x AS (SELECT repeat, doc_id, count(*) AS times FROM w JOIN i USING (place) GROUP BY ALL)
SELECT repeat, sum(times)::BIGINT AS drawn, count(*) AS distinct_ids, round(sum(times * toxic) / sum(times), 6) AS rate FROM x JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY repeat
"""


def bootstrap_rate(spark: SparkSession, d: str) -> DataFrame:
    """Spread of the toxic rate over 50 resamples (Poisson weights from a hash)."""
    lab = table(spark, d, "labels").select("doc_id", "toxic")
    drawn = metrics.bootstrap_counts(lab, "doc_id", 50, "boot").join(lab, "doc_id")
    rates = drawn.groupBy("repeat").agg((F.sum(F.col("times") * F.col("toxic")) / F.sum("times")).alias("rate"))
    return rates.select("repeat", r6("rate"))


_TIMES = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in metrics.poisson_steps())
BOOT_SQL = f"""
WITH w AS (SELECT doc_id, toxic, r AS repeat, ('0x' || substr(sha256('boot:' || r || ':' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM labels, range(50) t(r)),
k AS (SELECT *, {_TIMES} AS times FROM w)
SELECT repeat::INT AS repeat, round(sum(times * toxic) / sum(times)::DOUBLE, 6) AS rate FROM k WHERE times > 0 GROUP BY repeat
"""

QUERIES = {
    "confusion_by_lang": (confusion_by_lang, CONFUSION_SQL), "auc_by_lang": (auc_by_lang, AUC_SQL), "average_precision_by_lang": (average_precision_by_lang, AP_SQL),
    "threshold_sweep_ba": (threshold_sweep_ba, SWEEP_SQL), "threshold_sweep_f1": (threshold_sweep_f1, SWEEP_F1_SQL), "pairwise_metrics": (pairwise_metrics, PAIRWISE_SQL), "multilabel_prf": (multilabel_prf, MULTI_SQL),
    "sample_set_f1": (sample_set_f1, SETF1_SQL), "bucket_confusion": (bucket_confusion, BUCKET_SQL), "group_variance_rate": (group_variance_rate, VARIANCE_SQL),
    "pass_at_k": (pass_at_k, PASS_SQL), "quantiles_by_group": (quantiles_by_group, QUANTILE_SQL), "grouping_sets_counts": (grouping_sets_counts, SETS_SQL),
    "explode_counts_all": (explode_counts_all, EXPLODE_ALL_SQL), "rolling_centered": (rolling_centered, ROLLING_SQL), "window_stats_slope_corr": (window_stats_slope_corr, STATS_SQL),
    "longest_run": (longest_run_hours, RUN_SQL), "runs_max_gap": (runs_max_gap, GAP_SQL), "cosine_steps": (cosine_steps, COSINE_SQL), "gate_table": (gate_table, GATE_SQL),
    "coverage_report": (coverage_report, COVERAGE_SQL), "bootstrap_rate": (bootstrap_rate, BOOT_SQL), "bootstrap_of_draws": (bootstrap_of_draws, DRAWS_SQL), "threshold_on_grid": (threshold_on_grid, GRID_SQL),
}
