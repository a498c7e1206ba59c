"""Queries of the sampling, split and audit families over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, sampling
from ..session import table

#: Hash order of the samplers, in SQL.
KEY = "sha256('{seed}:' || {col})"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


def hash_order_sample(spark: SparkSession, d: str) -> DataFrame:
    """The 100 first documents in salted hash order."""
    return _docs(spark, d).withColumn("h", sampling.hash_key("s1", F.col("doc_id"))).orderBy("h", "doc_id").limit(100)


HASH_SQL = f"SELECT doc_id, lang, source, n_chars, {KEY.format(seed='s1', col='doc_id')} AS h FROM documents ORDER BY h, doc_id LIMIT 100"


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    """15 % of the documents by a hash fraction are validation."""
    x = _docs(spark, d).withColumn("split", F.when(sampling.hash_unit(sampling.hash_key("split", F.col("doc_id"))) < 0.15, "validation").otherwise("train"))
    return x.groupBy("lang", "split").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars"))


SPLIT_SQL = """
WITH x AS (SELECT *, CASE WHEN ('0x' || substr(sha256('split:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < 0.15 THEN 'validation' ELSE 'train' END AS split FROM documents)
SELECT lang, split, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM x GROUP BY ALL
"""


def hash_shard(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy(sampling.hash_shard(sampling.hash_key("shard", F.col("doc_id")), 16).alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


SHARD_SQL = "SELECT (('0x' || substr(sha256('shard:' || doc_id), 1, 8))::BIGINT % 16)::INT AS shard, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1"


def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    """120 documents in turn from languages and sources."""
    return sampling.round_robin(_docs(spark, d), ["lang", "source"], "rr", "doc_id", 120).select("doc_id", "lang", "source", "rn")


ROBIN_SQL = """
WITH k AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('rr:' || doc_id), doc_id)::INT AS rn FROM documents)
SELECT doc_id, lang, source, rn FROM k ORDER BY rn, lang, source LIMIT 120
"""


def first_per_stratum(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_n(_docs(spark, d), ["source"], "first", "doc_id", 5).select("source", "doc_id", "rn")


FIRSTN_SQL = "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('first:' || doc_id), doc_id)::INT AS rn FROM documents QUALIFY rn <= 5"


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of each (language, source) to test by largest remainder."""
    x = sampling.stratified_split(_docs(spark, d), ["lang", "source"], 0.25, "strat", "doc_id")
    return x.groupBy("lang", "source", "split").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


STRAT_SQL = """
WITH s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL),
b AS (SELECT *, CASE WHEN n <= 1 THEN 0 ELSE least(greatest(floor(n * 0.25::DOUBLE), 1), n - 1) END AS f, n * 0.25::DOUBLE - floor(n * 0.25::DOUBLE) AS r FROM s),
t AS (SELECT (round(sum(n * 0.25::DOUBLE)) - sum(f))::BIGINT AS short FROM b),
u AS (SELECT lang, source, 1 AS e, row_number() OVER (ORDER BY r DESC, lang, source) AS k FROM b WHERE n > 1 AND f < n - 1), v AS (SELECT lang, source, -1 AS e, row_number() OVER (ORDER BY r, lang, source) AS k FROM b WHERE f > 1),
e AS (SELECT lang, source, e FROM u, t WHERE short > 0 AND k <= short UNION ALL SELECT lang, source, e FROM v, t WHERE short <= 0 AND k <= -short),
q AS (SELECT b.lang, b.source, f + coalesce(e, 0) AS take FROM b LEFT JOIN e USING (lang, source)),
k AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('strat:' || doc_id), doc_id) AS rn FROM documents)
SELECT lang, source, CASE WHEN rn <= take THEN 'test' ELSE 'train' END AS split, count(*) AS n, min(doc_id) AS first_id FROM k JOIN q USING (lang, source) GROUP BY ALL
"""


def min_class_balance(spark: SparkSession, d: str) -> DataFrame:
    """As many labelled documents of each quality as the rarer one has, within each language."""
    x = table(spark, d, "labels").join(_docs(spark, d).select("doc_id", "lang"), "doc_id")
    return sampling.min_class_balance(x, ["lang"], "quality", "bal", "doc_id").select("lang", "quality", "doc_id", "rn")


BALANCE_SQL = """
WITH x AS (SELECT doc_id, lang, quality FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, min(n) AS least FROM (SELECT lang, quality, count(*) AS n FROM x GROUP BY ALL) GROUP BY lang),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY sha256('bal:' || doc_id), doc_id) AS rn FROM x)
SELECT lang, quality, doc_id, rn FROM k JOIN c USING (lang) WHERE rn <= least
"""


def balanced_yes_no_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The n-th toxic with the n-th clean labelled document of each language, in hash order."""
    x = table(spark, d, "labels").join(_docs(spark, d).select("doc_id", "lang"), "doc_id")
    yes = sampling.ranked(x.filter("toxic = 1"), ["lang"], "yn", "doc_id").select("lang", "rn", F.col("doc_id").alias("yes_id"))
    no = sampling.ranked(x.filter("toxic = 0"), ["lang"], "yn", "doc_id").select("lang", "rn", F.col("doc_id").alias("no_id"))
    return yes.join(no, ["lang", "rn"])


YESNO_SQL = """
WITH k AS (SELECT doc_id, lang, toxic, row_number() OVER (PARTITION BY lang, toxic ORDER BY sha256('yn:' || doc_id), doc_id) AS rn FROM labels JOIN documents USING (doc_id))
SELECT a.lang, a.rn, a.doc_id AS yes_id, b.doc_id AS no_id FROM k a JOIN k b ON a.lang = b.lang AND a.rn = b.rn AND a.toxic = 1 AND b.toxic = 0
"""


def rotation_derangement(spark: SparkSession, d: str) -> DataFrame:
    return sampling.rotation(_docs(spark, d), "lang", "doc_id")


ROTATION_SQL = """
WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), p AS (SELECT doc_id, lang, row_number() OVER (ORDER BY size DESC, lang, doc_id) - 1 AS at FROM documents JOIN s USING (lang)),
m AS (SELECT max(size) AS shift, sum(size)::BIGINT AS total FROM s)
SELECT a.doc_id, a.lang, b.doc_id AS other, b.lang AS other_group FROM p a, m JOIN p b ON b.at = (a.at + shift) % total
"""


def evenly_spaced_turns(spark: SparkSession, d: str) -> DataFrame:
    """Three evenly spaced turns of each conversation, rounding half to even."""
    c = table(spark, d, "conversations").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return c.select("conv_id", F.posexplode(sampling.evenly_spaced(F.col("turns"), 3)).alias("place", "turn"))


EVEN_SQL = """
WITH c AS (SELECT conv_id, list_sort(list(DISTINCT turn)) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, k::INT AS place, CASE WHEN len(t) <= 3 THEN t[k + 1] ELSE t[(round_even(k * (len(t) - 1) / 2.0::DOUBLE, 0) + 1)::INT] END AS turn FROM c, range(3) r(k) WHERE k < len(t)
"""


def leakage_audit(spark: SparkSession, d: str) -> DataFrame:
    """A split of documents: repeated ids, ids on both sides, texts on both sides."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest")).withColumn("test", sampling.hash_unit(sampling.hash_key("split", F.col("doc_id"))) < 0.15)
    test, train = docs.filter("test"), docs.filter("NOT test")
    return gates.expect({
        "repeated ids": gates.repeated(docs, ["doc_id"]),
        "ids on both sides": test.select("doc_id").intersect(train.select("doc_id")),
        "texts on both sides": test.select("digest").intersect(train.select("digest")),
    })


LEAK_SQL = """
WITH x AS (SELECT doc_id, text, ('0x' || substr(sha256('split:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < 0.15 AS test FROM documents)
SELECT 'repeated ids' AS expectation, (SELECT count(*) FROM (SELECT doc_id FROM x GROUP BY doc_id HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'ids on both sides', (SELECT count(*) FROM (SELECT doc_id FROM x WHERE test INTERSECT SELECT doc_id FROM x WHERE NOT test))
UNION ALL SELECT 'texts on both sides', (SELECT count(*) FROM (SELECT text FROM x WHERE test INTERSECT SELECT text FROM x WHERE NOT test))
"""


def flip_control(spark: SparkSession, d: str) -> DataFrame:
    """Labels with quality flipped: accuracy of the length rule on both sums to one in every language."""
    x = table(spark, d, "labels").join(_docs(spark, d), "doc_id").withColumn("pred", (F.col("n_chars") >= 500).cast("int"))
    return x.groupBy("lang").agg(F.round(F.avg((F.col("pred") == F.col("quality")).cast("double")), 6).alias("accuracy"), F.round(F.avg((F.col("pred") == 1 - F.col("quality")).cast("double")), 6).alias("flipped"))


FLIP_SQL = """
SELECT lang, round(avg(((n_chars >= 500)::INT = quality)::INT::DOUBLE), 6) AS accuracy, round(avg(((n_chars >= 500)::INT = 1 - quality)::INT::DOUBLE), 6) AS flipped FROM labels JOIN documents USING (doc_id) GROUP BY lang
"""

QUERIES = {
    "hash_order_sample": (hash_order_sample, HASH_SQL), "hash_split": (hash_split, SPLIT_SQL), "hash_shard": (hash_shard, SHARD_SQL), "round_robin_sample": (round_robin_sample, ROBIN_SQL),
    "first_per_stratum": (first_per_stratum, FIRSTN_SQL), "stratified_split_lr": (stratified_split, STRAT_SQL), "min_class_balance": (min_class_balance, BALANCE_SQL), "balanced_yes_no_pairs": (balanced_yes_no_pairs, YESNO_SQL),
    "rotation_derangement": (rotation_derangement, ROTATION_SQL), "evenly_spaced_turns": (evenly_spaced_turns, EVEN_SQL), "leakage_audit": (leakage_audit, LEAK_SQL), "flip_control": (flip_control, FLIP_SQL),
}
