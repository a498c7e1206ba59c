"""Queries of the planning operators; orders and their lines stand for cases, targets and donors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import planning
from ..session import table


def weighted_choice(spark: SparkSession, d: str) -> DataFrame:
    """One order per customer by price."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return planning.weighted_choice(o, ["o_custkey"], "o_orderkey", "o_totalprice", "w")


WEIGHTED_SQL = """
WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice, greatest(('0x' || substr(sha256('w:' || o_custkey || ':' || o_orderkey), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE, 1e-16) AS u FROM orders WHERE o_totalprice > 0)
SELECT o_custkey, o_orderkey, o_totalprice FROM x QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY -ln(u) / o_totalprice, o_orderkey) = 1
"""


def repair_cascade(spark: SparkSession, d: str) -> DataFrame:
    """A supplier for each customer: of the nation with a good balance, of the nation, else of the region."""
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "s_acctbal", "n_regionkey")
    same = F.col("c_nationkey") == F.col("s_nationkey")
    tiers = [("good", same & (F.col("s_acctbal") > 5000)), ("nation", same), ("region", F.lit(True))]
    best = planning.repair_by_class(c, "c_custkey", ["c_nationkey", "n_regionkey"], s, ["n_regionkey"], tiers, "s_acctbal", "s_suppkey")
    return best.groupBy("tier", "s_suppkey").agg(F.count("*").alias("n"))


REPAIR_SQL = """
WITH j AS (SELECT c_custkey, s_suppkey, s_acctbal, CASE WHEN c_nationkey = s_nationkey AND s_acctbal > 5000 THEN 0 WHEN c_nationkey = s_nationkey THEN 1 ELSE 2 END AS t
  FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN supplier ON s_nationkey = b.n_nationkey),
k AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY t, s_acctbal DESC, s_suppkey) = 1)
SELECT ['good', 'nation', 'region'][t + 1] AS tier, s_suppkey, count(*) AS n FROM k GROUP BY ALL
"""


def _plan(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("case_id"), F.col("l_partkey").alias("target"), F.when(F.col("l_discount") > 0.02, F.col("l_suppkey")).alias("donor"), (F.col("l_returnflag") == "R").alias("needs"))


PLAN = "SELECT l_orderkey || '-' || l_linenumber AS case_id, l_partkey AS target, CASE WHEN l_discount > 0.02 THEN l_suppkey END AS donor, l_returnflag = 'R' AS needs FROM lineitem"


def plan_validation(spark: SparkSession, d: str) -> DataFrame:
    e = planning.validate_plan(_plan(spark, d), "case_id", "target", "donor", F.col("needs"), 450)
    return e.groupBy("error").agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"))


VALID_SQL = f"""
WITH p AS ({PLAN}), w AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS a, count(*) OVER (PARTITION BY target) AS b, CASE WHEN donor IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY donor) END AS c FROM p),
e AS (SELECT case_id, 'case_repeated' AS error FROM w WHERE a > 1 UNION ALL SELECT case_id, 'target_reused' FROM w WHERE b > 1 UNION ALL SELECT case_id, 'donor_missing' FROM w WHERE needs AND donor IS NULL
  UNION ALL SELECT case_id, 'donor_is_target' FROM w WHERE donor = target UNION ALL SELECT case_id, 'donor_limit_exceeded' FROM w WHERE c > 450)
SELECT error, count(*) AS n, count(DISTINCT case_id) AS cases FROM e GROUP BY error
"""


def continuation(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases of customers: finished orders, customers of some nations done, first open order kept."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    done = table(spark, d, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    x = planning.continuation(o, "o_orderkey", "o_custkey", "o_orderdate", o.filter("o_orderstatus = 'F'"), done)
    return x.groupBy("decision").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


CONTINUE_SQL = """
WITH x AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus = 'F' AS dc, o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) AS dv FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, NOT dc AND NOT dv ORDER BY o_orderdate, o_orderkey) AS r FROM x)
SELECT CASE WHEN dc THEN 'completed_case' WHEN dv THEN 'completed_video' WHEN r = 1 THEN 'keep' ELSE 'reserve' END AS decision, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM k GROUP BY 1
"""


def continuation_by_strategy(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases of customers with their decision: some orders and customers done, customers in debt not selected, three strategies in order."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal", "c_mktsegment")
    x = o.join(c, "o_custkey", "left")
    grade = F.substring("o_orderpriority", 1, 1)
    strategies = [("person_preferred", (F.col("c_mktsegment") == "BUILDING") & (F.col("o_totalprice") > 100000)), ("keep_person_swap", grade == "1"), ("keep_good_base_pair", grade.isin("2", "3"))]
    out = planning.continue_by_strategy(x, "o_orderkey", "o_custkey", "o_orderdate", o.filter("o_orderstatus = 'P'"), c.filter("c_nationkey < 5"), F.col("c_acctbal") >= 0, strategies)
    return out.select("o_orderkey", "o_custkey", "decision")


STRATEGY_SQL = """
WITH x AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderstatus = 'P' THEN 'completed_case' WHEN c_nationkey < 5 THEN 'completed_video' WHEN NOT coalesce(c_acctbal >= 0, false) THEN 'no_selection' END AS early,
  CASE WHEN c_mktsegment = 'BUILDING' AND o_totalprice > 100000 THEN 'person_preferred' WHEN o_orderpriority[1] = '1' THEN 'keep_person_swap' WHEN o_orderpriority[1] IN ('2', '3') THEN 'keep_good_base_pair' END AS strategy FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
k AS (SELECT *, coalesce(early, CASE WHEN strategy IS NULL THEN 'rerun' END) AS e FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, e IS NULL ORDER BY o_orderdate, o_orderkey) AS n FROM k)
SELECT o_orderkey, o_custkey, coalesce(e, CASE WHEN n = 1 THEN strategy ELSE 'reserve' END) AS decision FROM r
"""


def pair_label_status(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring documents as pairs: what is known of their quality."""
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).alias("pair"), F.pmod("doc_id", F.lit(2)).alias("side"))
    x = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return planning.pair_label_status(x, "pair", "side", "quality").groupBy("status").agg(F.count("*").alias("n"))


STATUS_SQL = """
WITH g AS (SELECT doc_id // 2 AS pair, count(DISTINCT doc_id % 2) AS sides, count(quality) AS known, min(quality) AS lo, max(quality) AS hi FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT CASE WHEN known = 2 AND lo = hi THEN 'both_known_consistent' WHEN known = 2 THEN 'both_known_mismatch' WHEN known = 1 THEN 'one_sided' ELSE 'missing' END AS status, count(*) AS n FROM g WHERE sides = 2 GROUP BY 1
"""


def score_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Length and share of lines as scores of quality, fused on a grid of 41 weights."""
    docs = table(spark, d, "documents").select("doc_id", F.log1p(F.col("n_chars").cast("double")).alias("a"), F.regexp_count("text", F.lit("\n")).cast("double").alias("b"))
    x = table(spark, d, "labels").join(docs, "doc_id")
    return planning.fuse_scores(x, "a", "b", "quality", [round(i * 0.05, 2) for i in range(41)]).select("alpha", F.round("auc", 6).alias("auc"))


FUSION_SQL = """
WITH x AS (SELECT quality, ln(1 + n_chars::DOUBLE) AS a, len(regexp_extract_all(text, chr(10)))::DOUBLE AS b FROM labels JOIN documents USING (doc_id)), m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM x),
g AS (SELECT quality, round(i * 0.05::DOUBLE, 2) AS alpha, round((a - ma) / sa + round(i * 0.05::DOUBLE, 2) * ((b - mb) / sb), 9) AS s FROM x, m, range(41) t(i)),
k AS (SELECT alpha, quality, rank() OVER (PARTITION BY alpha ORDER BY s) + (count(*) OVER (PARTITION BY alpha, s) - 1) / 2.0::DOUBLE AS r FROM g),
c AS (SELECT alpha, round((sum(r) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0::DOUBLE) / (sum(quality) * sum(1 - quality))::DOUBLE, 9) AS auc FROM k GROUP BY alpha)
SELECT alpha, round(auc, 6) AS auc FROM c ORDER BY c.auc DESC, alpha LIMIT 1
"""

QUERIES = {
    "weighted_choice": (weighted_choice, WEIGHTED_SQL), "repair_cascade": (repair_cascade, REPAIR_SQL), "plan_validation": (plan_validation, VALID_SQL),
    "continuation_plan": (continuation, CONTINUE_SQL), "continuation_by_strategy": (continuation_by_strategy, STRATEGY_SQL), "pair_label_status": (pair_label_status, STATUS_SQL), "score_fusion": (score_fusion, FUSION_SQL),
}
