"""Queries of the join, set, filter and text families over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geom, text
from ..operators import assign, controls, gates, joins
from ..operators.order import dealt
from ..session import table


def dup_policy_last(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last event (by time, then id) joined to customers; users without one keep null."""
    e = joins.deduplicate(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], [F.col("ts"), F.col("event_id")], "last")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return c.join(e, "user_id", "left").select("user_id", "c_mktsegment", "event_id", "event_type")


LAST_SQL = """
WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT c_custkey AS user_id, c_mktsegment, event_id, event_type FROM customer LEFT JOIN l ON user_id = c_custkey
"""


def dup_policy_first(spark: SparkSession, d: str) -> DataFrame:
    o = joins.deduplicate(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "first")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return c.join(o, "o_custkey", "left").select("o_custkey", "c_name", "o_orderkey", "o_totalprice")


FIRST_SQL = """
WITH f AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)
SELECT c_custkey AS o_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN f ON o_custkey = c_custkey
"""


def unmatched_counts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    missing, unexpected = joins.unmatched(a, b, ["k"])
    return gates.expect({"customers without orders": missing, "orders without customer": unexpected})


UNMATCHED_SQL = """
SELECT 'customers without orders' AS expectation, count(*) AS violations FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'orders without customer', count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
"""


def coverage_join(spark: SparkSession, d: str) -> DataFrame:
    """Common ids over all ids of labels and documents."""
    a = table(spark, d, "documents").select("doc_id").distinct().withColumn("a", F.lit(1))
    b = table(spark, d, "labels").select("doc_id").distinct().withColumn("b", F.lit(1))
    x = a.join(b, "doc_id", "full_outer").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), F.count("*").alias("either"))
    return x.select("common", "either", F.round(F.try_divide("common", "either"), 6).alias("coverage"))


COVER_SQL = """
SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS common, count(*) AS either, round(count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) / count(*)::DOUBLE, 6) AS coverage
FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b USING (doc_id)
"""


def precedence_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders look up a name by customer key among large balances first, then by customer key anywhere."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    big = c.filter("c_acctbal > 5000").select("k", F.concat(F.lit("top "), "segment").alias("segment"))
    return joins.precedence_join(o, [(big, ["k"]), (c, ["k"])], ["segment"]).groupBy("segment", "matched_by").agg(F.count("*").alias("n"))


PRECEDENCE_SQL = """
WITH j AS (SELECT CASE WHEN b.c_custkey IS NOT NULL THEN 'top ' || b.c_mktsegment ELSE c.c_mktsegment END AS segment, CASE WHEN b.c_custkey IS NOT NULL THEN 0 WHEN c.c_custkey IS NOT NULL THEN 1 END AS matched_by
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) b ON b.c_custkey = o_custkey LEFT JOIN customer c ON c.c_custkey = o_custkey)
SELECT segment, matched_by, count(*) AS n FROM j GROUP BY ALL
"""


def unanimous_fallback_join(spark: SparkSession, d: str) -> DataFrame:
    """An order's priority by (customer, status); otherwise its customer's if all the customer's orders agree on a status."""
    o = table(spark, d, "orders")
    agreed = joins.unanimous_fallback(o, "o_custkey", "o_orderstatus")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return c.join(agreed, "o_custkey", "left").groupBy("c_nationkey", "o_orderstatus").agg(F.count("*").alias("n"))


UNANIMOUS_SQL = """
WITH a AS (SELECT o_custkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1)
SELECT c_nationkey, o_orderstatus, count(*) AS n FROM customer LEFT JOIN a ON o_custkey = c_custkey GROUP BY ALL
"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    u = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", u.alias("path"))


PATHS = "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages"


def ancestor_path_join(spark: SparkSession, d: str) -> DataFrame:
    p = _paths(spark, d)
    lookup = p.groupBy(text.path_parent(F.col("path")).alias("path")).agg(F.min("page_id").alias("owner"))
    return joins.ancestor_join(p, "path", lookup, "owner", "page_id")


ANCESTOR_SQL = f"""
WITH p AS ({PATHS}), l AS (SELECT regexp_replace(path, '/[^/]*$', '') AS prefix, min(page_id) AS owner FROM p GROUP BY ALL),
s AS (SELECT page_id, path, string_split(path, '/') AS parts FROM p), u AS (SELECT page_id, path, k AS depth, array_to_string(parts[1:len(parts) - k], '/') AS prefix FROM s, range(5) t(k) WHERE k < len(parts)),
m AS (SELECT page_id, min(depth) AS depth, arg_min(owner, depth) AS owner FROM u JOIN l USING (prefix) GROUP BY page_id)
SELECT p.page_id, p.path, m.depth::INT AS depth, m.owner FROM p LEFT JOIN m USING (page_id)
"""


def longest_prefix_join(spark: SparkSession, d: str) -> DataFrame:
    p = _paths(spark, d)
    rules = p.select(F.substring_index("path", "/", 2).alias("prefix")).union(p.select(F.substring_index("path", "/", 1))).distinct()
    rules = rules.withColumn("rule", F.substring(F.sha2("prefix", 256), 1, 8))
    return joins.longest_prefix_join(p, "path", rules, "rule", "page_id")


PREFIX_SQL = f"""
WITH p AS ({PATHS}), s AS (SELECT page_id, path, string_split(path, '/') AS parts FROM p),
m AS (SELECT page_id, path, array_to_string(parts[1:2], '/') AS longest FROM s)
SELECT page_id, path, substr(sha256(longest), 1, 8) AS rule, length(longest)::INT AS prefix_length FROM m
"""


def nearest_join_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """For each view the same user's nearest purchase within an hour."""
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type")
    a, b = e.filter("event_type = 'view'").drop("event_type"), e.filter("event_type = 'purchase'").select("user_id", "us", F.col("event_id").alias("purchase"))
    return joins.nearest_join(a, b, ["user_id"], "us", 3_600_000_000, "purchase", "event_id").select("event_id", "user_id", "distance", "nearest_purchase")


NEAREST_SQL = """
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type FROM events), v AS (SELECT * FROM e WHERE event_type = 'view'), p AS (SELECT * FROM e WHERE event_type = 'purchase'),
m AS (SELECT v.event_id, abs(v.us - p.us) AS distance, p.event_id AS purchase FROM v JOIN p ON v.user_id = p.user_id AND abs(v.us - p.us) <= 3600000000
  QUALIFY row_number() OVER (PARTITION BY v.event_id ORDER BY abs(v.us - p.us), p.us, p.event_id) = 1)
SELECT v.event_id, v.user_id, m.distance::BIGINT AS distance, m.purchase AS nearest_purchase FROM v LEFT JOIN m USING (event_id)
"""


def interval_contains(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user inside that user's first day of activity: an equi join on the user with a range filter."""
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    span = e.groupBy("user_id").agg(F.min("us").alias("start")).withColumn("end", F.col("start") + 86_400_000_000)
    return e.join(span, "user_id").filter("us BETWEEN start AND end").groupBy("user_id").agg(F.count("*").alias("events"), F.max(F.col("us") - F.col("start")).alias("last_offset"))


INTERVAL_SQL = """
WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), s AS (SELECT user_id, min(us) AS s FROM e GROUP BY user_id)
SELECT user_id, count(*) AS events, max(us - s) AS last_offset FROM e JOIN s USING (user_id) WHERE us BETWEEN s AND s + 86400000000 GROUP BY user_id
"""


def blocked_pair_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three parts nearest in price to each part among those of its type and size."""
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    return joins.nearest_in_block(p, ["p_type", "p_size"], "p_partkey", "p_retailprice", 3)


BLOCKED_SQL = """
SELECT a.p_type, a.p_size, a.p_partkey, b.p_partkey AS other, round(0 - abs(a.p_retailprice - b.p_retailprice), 4) AS score,
  row_number() OVER (PARTITION BY a.p_partkey ORDER BY round(0 - abs(a.p_retailprice - b.p_retailprice), 4) DESC, b.p_partkey)::INT AS rank
FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey != b.p_partkey QUALIFY rank <= 3
"""


def cascade_match_all(spark: SparkSession, d: str) -> DataFrame:
    """The best partner of every part in its brand, same type (100) before same first word (60) before same size (30) before any."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", F.substring_index("p_type", " ", 1).alias("word"), "p_size")
    return joins.best_by_tiers(p, ["p_brand"], "p_partkey", [("p_type", 100), ("word", 60), ("p_size", 30)], 1).select("p_brand", "p_partkey", "other", "score")


CASCADE_ALL_SQL = """
SELECT a.p_brand, a.p_partkey, b.p_partkey AS other, CASE WHEN a.p_type = b.p_type THEN 100 WHEN split_part(a.p_type, ' ', 1) = split_part(b.p_type, ' ', 1) THEN 60 WHEN a.p_size = b.p_size THEN 30 ELSE 1 END AS score
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey != b.p_partkey QUALIFY row_number() OVER (PARTITION BY a.p_partkey ORDER BY score DESC, b.p_partkey) = 1
"""


def cascade_match_words(spark: SparkSession, d: str) -> DataFrame:
    """The best partner of every part of its size: same name (100), type and brand (80), brand (60), type (40), price band (30), a shared word (15), any (1)."""
    p = table(spark, d, "part")
    both = F.concat_ws("|", "p_type", "p_brand").alias("both")
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " +").alias("words")
    p = p.select("p_partkey", "p_size", "p_name", both, "p_brand", "p_type", F.floor(F.col("p_retailprice") / 50).alias("band"), words)
    tiers = [("p_name", 100), ("both", 80), ("p_brand", 60), ("p_type", 40), ("band", 30)]
    return joins.best_by_tiers(p, ["p_size"], "p_partkey", tiers, 1, ("words", 15)).select("p_size", "p_partkey", "other", "score")


CASCADE_WORDS_SQL = """
WITH p AS (SELECT *, string_split(lower(p_name || ' ' || p_type), ' ') AS w, floor(p_retailprice / 50) AS band FROM part)
SELECT a.p_size, a.p_partkey, b.p_partkey AS other, CASE WHEN a.p_name = b.p_name THEN 100 WHEN a.p_type = b.p_type AND a.p_brand = b.p_brand THEN 80 WHEN a.p_brand = b.p_brand THEN 60 WHEN a.p_type = b.p_type THEN 40 WHEN a.band = b.band THEN 30 WHEN list_has_any(a.w, b.w) THEN 15 ELSE 1 END AS score
FROM p a JOIN p b ON a.p_size = b.p_size AND a.p_partkey != b.p_partkey QUALIFY row_number() OVER (PARTITION BY a.p_partkey ORDER BY score DESC, b.p_partkey) = 1
"""


def compat_rules_join(spark: SparkSession, d: str) -> DataFrame:
    """Nation pairs in one region that no rule blocks; an empty rule side stands for any nation."""
    n = table(spark, d, "nation")
    a = n.select("n_regionkey", F.col("n_name").alias("a"))
    b = n.select("n_regionkey", F.col("n_name").alias("b"))
    rules = n.filter("n_nationkey % 7 = 0").select(F.col("n_name").alias("x"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.col("n_name")).alias("y"))
    pairs = a.join(b, "n_regionkey").filter("a < b")
    return pairs.join(F.broadcast(rules), F.startswith("a", "x") & ((F.col("y") == "") | F.startswith("b", "y")), "left_anti")


COMPAT_SQL = """
WITH r AS (SELECT n_name AS x, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE n_name END AS y FROM nation WHERE n_nationkey % 7 = 0)
SELECT p.n_regionkey, p.n_name AS a, q.n_name AS b FROM nation p JOIN nation q ON p.n_regionkey = q.n_regionkey AND p.n_name < q.n_name
WHERE NOT EXISTS (SELECT 1 FROM r WHERE starts_with(p.n_name, x) AND (y = '' OR starts_with(q.n_name, y)))
"""


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source: old version all sources but two, new version with changed sizes for some."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    old, new = docs.filter("source NOT IN ('src1', 'src2')"), docs.filter("source IN ('src1', 'src3', 'src4')").withColumn("n_chars", F.col("n_chars") + 1)
    asked = docs.filter("source IN ('src1', 'src3', 'src5')").select("source").distinct()
    return joins.upsert(old, new, "source", asked).groupBy("source", "merge_status").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars"))


UPSERT_SQL = """
WITH o AS (SELECT * FROM documents WHERE source NOT IN ('src1', 'src2')), n AS (SELECT source, n_chars + 1 AS n_chars FROM documents WHERE source IN ('src1', 'src3')),
m AS (SELECT source, CASE WHEN source = 'src5' THEN 'missing' ELSE 'kept' END AS merge_status, n_chars FROM o WHERE source != 'src3' UNION ALL SELECT source, CASE WHEN source = 'src3' THEN 'replaced' ELSE 'added' END, n_chars FROM n)
SELECT source, merge_status, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM m GROUP BY ALL
"""


def overlap_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that are benchmark items, exactly or once only letters and digits are kept."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).filter("line != ''")
    bench = table(spark, d, "benchmark").select("text")
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    exact = lines.distinct().join(bench.select(F.col("text").alias("line")).distinct(), "line", "left_semi").agg(F.count("*").alias("exact"))
    near = lines.select(norm("line").alias("k")).filter("k != ''").distinct().join(bench.select(norm("text").alias("k")).distinct(), "k", "left_semi").agg(F.count("*").alias("normalised"))
    return exact.select(F.lit("exact").alias("kind"), F.col("exact").alias("n")).unionByName(near.select(F.lit("normalised").alias("kind"), F.col("normalised").alias("n")))


OVERLAP_SQL = """
WITH l AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT DISTINCT regexp_replace(lower(line), '[^a-z0-9]', '', 'g') AS k FROM l WHERE line != '')
SELECT 'exact' AS kind, count(*) AS n FROM l WHERE line != '' AND line IN (SELECT text FROM benchmark)
UNION ALL SELECT 'normalised', count(*) FROM k WHERE k != '' AND k IN (SELECT regexp_replace(lower(text), '[^a-z0-9]', '', 'g') FROM benchmark)
"""


def dedup_signature(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each (language, text without case and blanks)."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2(F.regexp_replace(F.lower("text"), "[ \t\n\r]+", " "), 256).alias("sig"))
    return docs.groupBy("lang", "sig").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "lang", "copies")


DEDUP_SQL = "SELECT min(doc_id) AS doc_id, lang, count(*) AS copies FROM (SELECT doc_id, lang, regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g') AS s FROM documents) GROUP BY lang, s"


def reasoned_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    reason = gates.first_reason([("too short", F.col("n_chars") < 200), ("too long", F.col("n_chars") > 10000), ("markup", F.contains("text", F.lit("|"))), ("symbols", F.regexp_count("text", F.lit("[*$%&#]")) > 20)])
    return docs.withColumn("reason", F.coalesce(reason, F.lit("kept"))).groupBy("reason").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


REASON_SQL = """
WITH r AS (SELECT doc_id, CASE WHEN n_chars < 200 THEN 'too short' WHEN n_chars > 10000 THEN 'too long' WHEN contains(text, '|') THEN 'markup' WHEN len(regexp_extract_all(text, '[*$%&#]')) > 20 THEN 'symbols' ELSE 'kept' END AS reason FROM documents)
SELECT reason, count(*) AS n, min(doc_id) AS first_id FROM r GROUP BY reason
"""


def failed_rule_tags(spark: SparkSession, d: str) -> DataFrame:
    rules = [("short", F.col("n_chars") < 500), ("digits", F.col("text").rlike("[0-9]{4}")), ("mail", F.contains("text", F.lit("@"))), ("pipes", F.contains("text", F.lit("|")))]
    docs = table(spark, d, "documents").withColumn("tags", gates.failed_rules(rules))
    return docs.groupBy(F.array_join("tags", "+").alias("tags")).agg(F.count("*").alias("n"))


TAGS_SQL = """
SELECT concat_ws('+', CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'digits' END, CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN contains(text, '|') THEN 'pipes' END) AS tags, count(*) AS n
FROM documents GROUP BY 1
"""


def keyword_bucket(spark: SparkSession, d: str) -> DataFrame:
    bucket = text.keyword_bucket(F.lower("p_type"), [("plated", ["plated"]), ("metal", ["steel", "copper", "brass"]), ("economy", ["economy"])], "other")
    return table(spark, d, "part").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"))


KEYWORD_SQL = """
SELECT CASE WHEN contains(lower(p_type), 'plated') THEN 'plated' WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'copper') OR contains(lower(p_type), 'brass') THEN 'metal' WHEN contains(lower(p_type), 'economy') THEN 'economy' ELSE 'other' END AS bucket,
  count(*) AS n, round(avg(p_retailprice), 4) AS mean_price FROM part GROUP BY 1
"""


def tag_extract(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    value, source = text.cascade(h, [("heading", "(?is)<h1>(.*?)</h1>"), ("title", "(?is)<title>(.*?)</title>")])
    one = text.only_tag(h, "title")
    return table(spark, d, "pages").select("page_id", text.collapse(value, 80).alias("headline"), source.alias("source"), one.isNotNull().alias("one_title"), F.regexp_count("html", F.lit("(?i)<p>")).alias("paragraphs"))


TAG_SQL = """
WITH p AS (SELECT page_id, html, regexp_extract(html, '<h1>(.*?)</h1>', 1, 'is') AS h1, regexp_extract(html, '<title>(.*?)</title>', 1, 'is') AS t FROM pages)
SELECT page_id, substr(trim(regexp_replace(coalesce(nullif(h1, ''), nullif(t, '')), '\\s+', ' ', 'g')), 1, 80) AS headline, CASE WHEN h1 != '' THEN 'heading' WHEN t != '' THEN 'title' END AS source,
  len(regexp_extract_all(html, '<title>.*?</title>', 0, 'is')) = 1 AND t != '' AS one_title, len(regexp_extract_all(html, '<p>', 0, 'i'))::INT AS paragraphs FROM p
"""


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    x = table(spark, d, "pages").select(F.regexp_extract(u, "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(u, "^[a-z]+://([^/?#]+)", 1).alias("host"), F.contains(u, F.lit("?")).alias("has_query"))
    return x.groupBy("scheme", "host").agg(F.count("*").alias("n"), F.count_if("has_query").alias("with_query"))


URL_SQL = "SELECT regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS n, count(*) FILTER (contains(url, '?')) AS with_query FROM pages GROUP BY 1, 2"


def last_message_by_role(spark: SparkSession, d: str) -> DataFrame:
    """Length of each conversation's last message of a role: one running maximum a role, no list of messages."""
    last = lambda role: F.max(F.when((F.col("role") == role) & F.col("text").isNotNull(), F.struct("turn", "text")))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(last("assistant").alias("a"), last("user").alias("u"))
    return c.select("conv_id", F.length("a.text").alias("last_assistant_chars"), F.length("u.text").alias("last_user_chars"))


MESSAGE_SQL = """
SELECT conv_id, length(arg_max(text, (turn, text)) FILTER (role = 'assistant'))::INT AS last_assistant_chars, length(arg_max(text, (turn, text)) FILTER (role = 'user'))::INT AS last_user_chars FROM conversations GROUP BY conv_id
"""


def box_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Boxes from line numbers: IoU with their order's first box, containment, and the far corner."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.pmod("l_partkey", F.lit(700)).cast("double").alias("x"), F.pmod("l_suppkey", F.lit(700)).cast("double").alias("y"), (F.col("l_quantity") * 6).alias("w"))
    b = li.withColumn("b", geom.box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w")))
    first = b.filter("l_linenumber = 1").select("l_orderkey", F.col("b").alias("f"))
    j = b.filter("l_linenumber > 1").join(first, "l_orderkey")
    i = geom.iou(F.col("b"), F.col("f"))
    return j.withColumns({"iou": i, "inside": geom.containment(F.col("b"), F.col("f")), "corner": geom.far_corner(F.col("b"))}).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.count_if(F.col("iou") >= 0.3).alias("hits"), F.round(F.avg("inside"), 6).alias("mean_inside"), F.count_if(F.col("corner.x1") > 0).alias("right"))


BOX_SQL = """
WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 700)::DOUBLE AS x1, (l_suppkey % 700)::DOUBLE AS y1, least((l_partkey % 700)::DOUBLE + l_quantity * 6, 1000) AS x2, least((l_suppkey % 700)::DOUBLE + l_quantity * 6, 1000) AS y2 FROM lineitem),
j AS (SELECT b.*, greatest(least(b.x2, f.x2) - greatest(b.x1, f.x1), 0) * greatest(least(b.y2, f.y2) - greatest(b.y1, f.y1), 0) AS c, (b.x2 - b.x1) * (b.y2 - b.y1) AS a1, (f.x2 - f.x1) * (f.y2 - f.y1) AS a2 FROM b JOIN b f ON f.l_orderkey = b.l_orderkey AND f.l_linenumber = 1 WHERE b.l_linenumber > 1),
k AS (SELECT *, c / (a1 + a2 - c) AS iou, c / least(a1, a2) AS inside, x2 - x1 AS w, y2 - y1 AS h FROM j),
q AS (SELECT *, list_transform([[0, 0], [1, 0], [0, 1], [1, 1]], lambda o: greatest(least(x2, o[1] * (1000 - w) + w) - greatest(x1, o[1] * (1000 - w)), 0) * greatest(least(y2, o[2] * (1000 - h) + h) - greatest(y1, o[2] * (1000 - h)), 0)) AS over FROM k)
SELECT l_linenumber, count(*) AS n, round(avg(iou), 6) AS mean_iou, count(*) FILTER (iou >= 0.3) AS hits, round(avg(inside), 6) AS mean_inside, count(*) FILTER (list_position(over, list_min(over)) IN (2, 4) AND w < 1000) AS "right" FROM q GROUP BY l_linenumber
"""


def variant_expand(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    v = controls.variants(c, {"original": F.col("text"), "twice": F.repeat("text", F.lit(2)), "empty": F.lit("")})
    return v.groupBy("variant").agg(F.count("*").alias("n"), F.sum(F.length("value")).cast("long").alias("chars"))


VARIANT_SQL = """
WITH c AS (SELECT text FROM conversations WHERE role = 'user')
SELECT 'original' AS variant, count(*) AS n, sum(length(text))::BIGINT AS chars FROM c UNION ALL SELECT 'twice', count(*), sum(2 * length(text))::BIGINT FROM c UNION ALL SELECT 'empty', count(*), 0 FROM c
"""


def pair_swap_control(spark: SparkSession, d: str) -> DataFrame:
    """First user and assistant turn of each conversation with the other's text."""
    c = table(spark, d, "conversations").filter("role IN ('user', 'assistant')")
    first = joins.deduplicate(c.select("conv_id", "role", "turn", "text"), ["conv_id", "role"], [F.col("turn"), F.col("text")], "first")
    s = controls.swap_in_pairs(first, "conv_id", "role", "text")
    return s.select("conv_id", "role", F.length("text").alias("chars"), F.length("other_text").alias("other_chars"))


SWAP_SQL = """
WITH f AS (SELECT conv_id, role, text FROM conversations WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) = 1)
SELECT a.conv_id, a.role, length(a.text)::INT AS chars, length(b.text)::INT AS other_chars FROM f a JOIN f b ON a.conv_id = b.conv_id AND a.role != b.role
"""


def label_cycle(spark: SparkSession, d: str) -> DataFrame:
    return controls.cycle_in_group(table(spark, d, "labels").withColumn("cls", F.concat_ws("", "quality", "toxic")), "cls", "doc_id")


CYCLE_SQL = """
WITH l AS (SELECT doc_id, quality::VARCHAR || toxic::VARCHAR AS cls FROM labels)
SELECT doc_id, cls, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS other FROM l WINDOW w AS (PARTITION BY cls ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


def assignment_until_full(spark: SparkSession, d: str) -> DataFrame:
    """Orders to suppliers of their lines: best quantity first, at most three orders a supplier, and the orders that stay open."""
    c = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity"), "l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("score"))
    return assign.assign_all(c, "l_orderkey", "l_suppkey", "score", 3)


ASSIGN_ALL_SQL = """
WITH RECURSIVE s AS (
  SELECT l_orderkey, l_suppkey, sum(l_quantity) AS score, 3::BIGINT AS room, NULL::INT AS round, 0 AS turn, true AS going FROM lineitem GROUP BY l_orderkey, l_suppkey
  UNION ALL
  SELECT l_orderkey, l_suppkey, score, room - (sum(taken) OVER (PARTITION BY l_suppkey))::BIGINT, CASE WHEN taken = 1 THEN turn ELSE round END, turn + 1, max(taken) OVER () = 1
  FROM (SELECT *, CASE WHEN asked AND row_number() OVER (PARTITION BY l_suppkey, asked ORDER BY score DESC, l_orderkey) <= room THEN 1 ELSE 0 END AS taken
    FROM (SELECT *, open AND row_number() OVER (PARTITION BY l_orderkey, open ORDER BY score DESC, l_suppkey) = 1 AS asked
      FROM (SELECT *, room > 0 AND max(round) OVER (PARTITION BY l_orderkey) IS NULL AS open FROM s WHERE going)))
), e AS (SELECT * FROM s WHERE turn = (SELECT max(turn) FROM s))
SELECT l_orderkey, l_suppkey, score, round, NULL AS reason FROM e WHERE round IS NOT NULL
UNION ALL SELECT l_orderkey, NULL, NULL, NULL, 'all donors full' FROM e GROUP BY l_orderkey HAVING max(round) IS NULL
"""


def content_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest of each region's nations: rows in order, hashed together."""
    n = table(spark, d, "nation").select("n_regionkey", F.concat_ws("|", "n_nationkey", "n_name").alias("row"))
    return n.groupBy("n_regionkey").agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("row")), "\n"), 256).alias("digest"))


DIGEST_SQL = "SELECT n_regionkey, count(*) AS rows, sha256(string_agg(n_nationkey || '|' || n_name, chr(10) ORDER BY n_nationkey || '|' || n_name)) AS digest FROM nation GROUP BY n_regionkey"


def status_fold(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.folds import fold_status

    return fold_status(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").groupBy("event_type").agg(F.count("*").alias("users"), F.sum("events").cast("long").alias("events"))


FOLD_SQL = """
WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS events FROM events GROUP BY user_id)
SELECT event_type, count(*) AS users, sum(events)::BIGINT AS events FROM l GROUP BY event_type
"""


def tumbling_2h(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.folds import tumbling

    return tumbling(table(spark, d, "events"), "ts", "2 hours", [F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")])


TUMBLING_SQL = "SELECT time_bucket(INTERVAL '2 hours', ts) AS window_start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1"


def sliding_6h(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.folds import tumbling

    return tumbling(table(spark, d, "events"), "ts", "6 hours", [F.count("*").alias("n")], slide="2 hours")


SLIDING_SQL = "WITH e AS (SELECT time_bucket(INTERVAL '2 hours', ts) - INTERVAL '2 hours' * k AS window_start FROM events, range(3) t(k)) SELECT window_start, count(*) AS n FROM e GROUP BY 1"


def lineage_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Plans keyed by the hash of what they consist of: first seen, last seen, times."""
    e = table(spark, d, "events").withColumn("plan", F.substring(F.sha2(F.concat_ws("|", "user_id", "event_type"), 256), 1, 16))
    return e.groupBy("plan").agg(F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"), F.count("*").alias("times"))


LINEAGE_SQL = "SELECT substr(sha256(user_id || '|' || event_type), 1, 16) AS plan, min(event_id) AS first_seen, max(event_id) AS last_seen, count(*) AS times FROM events GROUP BY 1"


def modal_caption(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent first line of each source; longer, then greater, on ties."""
    first = table(spark, d, "documents").groupBy("source", F.substring_index("text", "\n", 1).alias("line")).agg(F.count("*").alias("votes"))
    best = first.groupBy("source").agg(F.max(F.struct("votes", F.length("line").alias("len"), "line")).alias("b"))
    return best.select("source", F.col("b.votes").alias("votes"), F.col("b.line").alias("line"))


MODAL_SQL = """
WITH f AS (SELECT source, split_part(text, chr(10), 1) AS line, count(*) AS votes FROM documents GROUP BY ALL)
SELECT source, votes, line FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY votes DESC, length(line) DESC, line DESC) = 1
"""


def zip_join(spark: SparkSession, d: str) -> DataFrame:
    """n-th supplier with n-th customer of each nation."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    return joins.positional_join(s, c, ["nation"], [F.col("s_suppkey")], [F.col("c_custkey")]).select("nation", "rn", "s_suppkey", "c_custkey")


ZIP_SQL = """
SELECT a.nation, a.rn, s_suppkey, c_custkey FROM (SELECT s_nationkey AS nation, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) a
JOIN (SELECT c_nationkey AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) b USING (nation, rn)
"""


def topk_per_key(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "rank")


TOPK_SQL = "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 3"


def top1_tuple(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderpriority", "o_totalprice", "o_orderkey")).alias("best_order"))


TOP1_SQL = "SELECT o_custkey, o_orderkey AS best_order FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey DESC) = 1"

QUERIES = {
    "dup_policy_last": (dup_policy_last, LAST_SQL), "dup_policy_first": (dup_policy_first, FIRST_SQL), "unmatched_counts": (unmatched_counts, UNMATCHED_SQL), "coverage_join": (coverage_join, COVER_SQL),
    "precedence_join": (precedence_join, PRECEDENCE_SQL), "unanimous_fallback_join": (unanimous_fallback_join, UNANIMOUS_SQL), "ancestor_path_join": (ancestor_path_join, ANCESTOR_SQL),
    "longest_prefix_join": (longest_prefix_join, PREFIX_SQL), "nearest_join_tolerance": (nearest_join_tolerance, NEAREST_SQL), "interval_contains": (interval_contains, INTERVAL_SQL),
    "blocked_pair_topk": (blocked_pair_topk, BLOCKED_SQL), "cascade_match_all": (cascade_match_all, CASCADE_ALL_SQL), "cascade_match_words": (cascade_match_words, CASCADE_WORDS_SQL), "compat_rules_join": (compat_rules_join, COMPAT_SQL), "upsert_merge": (upsert_merge, UPSERT_SQL),
    "overlap_exact_normalised": (overlap_normalised, OVERLAP_SQL), "dedup_signature": (dedup_signature, DEDUP_SQL), "reasoned_filter": (reasoned_filter, REASON_SQL), "failed_rule_tags": (failed_rule_tags, TAGS_SQL),
    "keyword_bucket": (keyword_bucket, KEYWORD_SQL), "tag_extract": (tag_extract, TAG_SQL), "url_parts": (url_parts, URL_SQL), "last_message_by_role": (last_message_by_role, MESSAGE_SQL), "box_overlap": (box_overlap, BOX_SQL),
    "variant_expand": (variant_expand, VARIANT_SQL), "pair_swap_control": (pair_swap_control, SWAP_SQL), "label_cycle": (label_cycle, CYCLE_SQL), "assignment_until_full": (assignment_until_full, ASSIGN_ALL_SQL),
    "content_digest": (content_digest, DIGEST_SQL), "status_fold": (status_fold, FOLD_SQL), "tumbling_2h": (tumbling_2h, TUMBLING_SQL), "sliding_6h": (sliding_6h, SLIDING_SQL), "lineage_upsert": (lineage_upsert, LINEAGE_SQL),
    "modal_caption": (modal_caption, MODAL_SQL), "zip_join": (zip_join, ZIP_SQL), "topk_per_key": (topk_per_key, TOPK_SQL), "top1_tuple": (top1_tuple, TOP1_SQL),
}
