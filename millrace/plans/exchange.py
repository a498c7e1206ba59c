"""Queries that write tables with the sinks, read them back with the sources and set their fields right, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom, text
from ..operators import controls, gates, joins
from ..session import scratch, table
from ..sources import arrays, records


def json_line_policies(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines, some broken, blank or no objects: what each reading policy keeps, and lines of text under a byte-order mark."""
    m = F.col("event_id") % 10
    line = F.when(m == 3, F.concat(F.lit('{"event_id": '), "event_id")).when(m == 5, "").when(m == 7, "[1, 2]").otherwise(F.to_json(F.struct("event_id", "user_id", "value")))
    lines = table(spark, d, "events").select(line.alias("value"))
    path = scratch(spark, "lines")
    lines.write.text(f"{path}/json")
    lines.select(F.concat(F.lit("﻿"), "value").alias("value")).write.text(f"{path}/marked")
    schema = "event_id long, user_id long, value double"
    dropped = records.json_lines(spark, f"{path}/json", schema, "drop").agg(F.count("user_id").alias("n"), F.lit(0).cast("long").alias("bad"), F.sum("event_id").alias("ids"))
    kept = records.json_lines(spark, f"{path}/json", schema, "keep")
    bad = F.col(records.CORRUPT).isNotNull()
    kept = kept.agg(F.count(F.struct("event_id", records.CORRUPT)).alias("n"), F.count_if(bad).alias("bad"), F.sum(F.when(~bad, F.col("event_id"))).alias("ids"))
    plain = records.text_lines(spark, f"{path}/marked")
    plain = plain.agg(F.count("*").alias("n"), F.count_if(~F.startswith("value", F.lit("{"))).alias("bad"), F.sum(F.get_json_object("value", "$.event_id").cast("long")).alias("ids"))
    tagged = [x.select(F.lit(name).alias("policy"), "*") for name, x in (("drop", dropped), ("keep", kept), ("text", plain))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


LINES_SQL = """
WITH e AS (SELECT event_id, event_id % 10 AS m FROM events), g AS (SELECT sum(event_id) FILTER (m NOT IN (3, 5, 7))::BIGINT AS ids, count(*) FILTER (m NOT IN (3, 5, 7)) AS whole, count(*) FILTER (m != 5) AS lines, count(*) FILTER (m IN (3, 7)) AS broken, count(*) FILTER (m = 7) AS lists FROM e)
SELECT 'drop' AS policy, whole AS n, 0::BIGINT AS bad, ids FROM g UNION ALL SELECT 'keep', lines, broken, ids FROM g UNION ALL SELECT 'text', lines, lists, ids FROM g
"""


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Parts through CSV: stated columns first, lists as JSON, nulls empty, quotes and commas kept, all strings when read."""
    note = F.when(F.col("p_size") % 3 != 0, F.concat("p_type", F.lit(', "'), "p_brand", F.lit('"')))
    p = table(spark, d, "part").select(note.alias("note"), F.split("p_name", " ").alias("words"), "p_partkey", F.col("p_size").alias("size"))
    path = scratch(spark, "csv")
    records.write_csv(p, path, ["p_partkey"])
    return records.csv_strings(spark, path)


CSV_SQL = """
SELECT p_partkey::VARCHAR AS p_partkey, CASE WHEN p_size % 3 != 0 THEN p_type || ', "' || p_brand || '"' ELSE '' END AS note, p_size::VARCHAR AS size, to_json(string_split(p_name, ' '))::VARCHAR AS words FROM part
"""


def ranked_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Lines written as shards of four ranks, read by the first glob that names a file."""
    path = scratch(spark, "ranks")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", (F.col("l_suppkey") % 4).alias("rank"))
    li.write.partitionBy("rank").json(path)
    got = records.ranked_shards(spark, path, "l_orderkey long, l_quantity double", ["rank_*.jsonl", "rank=*/*.json"])
    rank = F.regexp_extract("source_file", r"/rank=(\d+)/", 1).cast("int").alias("rank")
    return got.groupBy(rank).agg(F.count("l_orderkey").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.max("l_orderkey").alias("last"))


RANKS_SQL = "SELECT (l_suppkey % 4)::INT AS rank, count(*) AS n, round(sum(l_quantity), 2) AS quantity, max(l_orderkey) AS last FROM lineitem GROUP BY 1"


def inventory_of_two_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as inventories with their lines as entities, nested below a video or flat: passed entities, with what they inherit."""
    flat = F.col("l_orderkey") % 2 == 1
    own = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("d"), F.col("l_suppkey") % 5))
    status = F.when(F.col("l_returnflag") == "R", "fail").otherwise("pass").alias("quality_status")
    entity = F.struct(F.when(flat, F.col("l_orderkey")).alias("video_id"), own.alias("domain"), F.col("l_partkey").alias("entity_id"), F.col("l_quantity").alias("size"), status)
    each = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(entity).alias("entities"))
    nested = F.to_json(F.struct(F.array(F.struct(F.col("l_orderkey").alias("video_id"), F.concat(F.lit("v"), F.col("l_orderkey") % 3).alias("domain"), "entities")).alias("videos")))
    payload = each.select(F.when(flat, F.to_json(F.struct("entities"))).otherwise(nested).alias("value"))
    child = "video_id:long,domain:string,entity_id:long,size:double,quality_status:string"
    got = records.inventory(payload, "videos", "entities", "video_id:long,domain:string", child, ["video_id", "domain"])
    return got.filter("quality_status = 'pass'").select("video_id", "domain", "entity_id", "size")


INVENTORY_SQL = """
SELECT l_orderkey AS video_id, CASE WHEN l_linenumber % 2 = 0 THEN 'd' || l_suppkey % 5 WHEN l_orderkey % 2 = 0 THEN 'v' || l_orderkey % 3 END AS domain, l_partkey AS entity_id, l_quantity AS size FROM lineitem WHERE l_returnflag IS DISTINCT FROM 'R'
"""


def domain_index(spark: SparkSession, d: str) -> DataFrame:
    """An index entry for each document in a bare list, under an alias or by key: domain held to three names, confidence to 0..1."""
    score = F.when(F.col("n_chars") % 7 == 0, "high").otherwise(((F.col("n_chars") % 150) / 100).cast("string"))
    entry = F.to_json(F.struct("doc_id", F.concat(F.lit("  "), F.upper("lang")).alias("domain"), score.alias("confidence")))
    m = F.col("doc_id") % 3
    wrapped = F.when(m == 0, F.concat(F.lit("["), entry, F.lit("]"))).when(m == 1, F.concat(F.lit('{"entries": ['), entry, F.lit("]}"))).otherwise(F.concat(F.lit('{"k'), "doc_id", F.lit('": '), entry, F.lit("}")))
    payload = table(spark, d, "documents").select(wrapped.alias("value"))
    return records.index_rows(payload, ["videos", "entries"], "struct<doc_id:bigint,domain:string,confidence:string>", {"domain": (["en", "de", "es"], "other")}, {"confidence": (0.0, 1.0, 0.5)})


INDEX_SQL = """
SELECT doc_id, CASE WHEN lower(lang) IN ('en', 'de', 'es') THEN lower(lang) ELSE 'other' END AS domain, CASE WHEN n_chars IS NULL OR n_chars % 7 = 0 THEN 0.5::DOUBLE ELSE least((n_chars % 150) / 100::DOUBLE, 1.0::DOUBLE) END AS confidence FROM documents
"""


def manifests_below(spark: SparkSession, d: str) -> DataFrame:
    """A manifest file for each source, in folders by letter: read at any depth, listed by path, joined by file."""
    docs = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"))
    path = scratch(spark, "manifests")
    body = F.to_json(F.struct("source", "n_docs", "chars"), {"pretty": "true"}).alias("value")
    docs.select(F.substring("source", -1, 1).alias("letter"), body).write.partitionBy("letter").option("maxRecordsPerFile", 1).text(path)
    read = records.documents_below(spark, [path], "source string, n_docs long, chars long", "*.txt")
    files = records.file_manifest(spark, path, "*.txt")
    at = F.substring_index("source_file", f"{path}/", -1)
    got = read.withColumn("path", at).join(files, "path")
    return got.select("source", "n_docs", "chars", "suffix", (F.col("size") > 0).alias("filled"), (F.col("video_id") == F.concat(F.lit("vid_"), F.substring(F.sha1("path"), 1, 16))).alias("named"))


MANIFESTS_SQL = "SELECT source, count(*) AS n_docs, sum(n_chars)::BIGINT AS chars, '.txt' AS suffix, true AS filled, true AS named FROM documents GROUP BY source"


def wide_series(spark: SparkSession, d: str) -> DataFrame:
    """Sums of event values by hour as series, joined outer on the hour."""
    hour = (F.unix_timestamp("ts") / 3600).cast("long").alias("step")
    series = table(spark, d, "events").groupBy(hour, "event_type").agg(F.round(F.sum("value"), 4).alias("value"))
    return records.wide_by_step(series, "step", "event_type", "value", ["error", "purchase", "signup"])


WIDE_SQL = """
WITH s AS (SELECT epoch(ts)::BIGINT // 3600 AS step, event_type, value FROM (SELECT date_trunc('second', ts) AS ts, event_type, value FROM events))
SELECT step, round(sum(value) FILTER (event_type = 'error'), 4) AS error, round(sum(value) FILTER (event_type = 'purchase'), 4) AS purchase, round(sum(value) FILTER (event_type = 'signup'), 4) AS signup FROM s GROUP BY step
"""


def device_use(spark: SparkSession, d: str) -> DataFrame:
    """Lines of device samples written as text and parsed: share of memory in use and mean load by device; broken fields are null."""
    used = F.when(F.col("l_linenumber") == 5, "N/A").otherwise(F.col("l_quantity").cast("int").cast("string"))
    li = table(spark, d, "lineitem").select(F.concat_ws(", ", F.col("l_suppkey") % 8, used, F.lit("80"), (F.col("l_discount") * 100).cast("int"), F.lit("40")).alias("value"))
    path = scratch(spark, "samples")
    li.write.text(path)
    got = records.device_samples(records.text_lines(spark, path))
    share = F.sum("used") / F.sum(F.when(F.col("used").isNotNull(), F.col("total")))
    return got.groupBy("index").agg(F.count("*").alias("samples"), F.count("used").alias("valid"), F.round(share, 6).alias("memory"), F.round(F.avg("utilisation"), 6).alias("load"))


DEVICE_SQL = """
SELECT (l_suppkey % 8)::DOUBLE AS index, count(*) AS samples, count(*) FILTER (l_linenumber != 5) AS valid, round(sum(trunc(l_quantity)) FILTER (l_linenumber != 5) / (80 * count(*) FILTER (l_linenumber != 5)), 6) AS memory, round(avg(trunc(l_discount * 100)), 6) AS load FROM lineitem GROUP BY 1
"""


def split_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Orders split by predicate into three outputs in one pass, and the ledger of what was written."""
    path = scratch(spark, "split")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    records.write_split(o, path, [("rejected", F.col("o_orderstatus") == "P"), ("urgent", F.startswith("o_orderpriority", F.lit("1-")))], "other")
    got = spark.read.parquet(path)
    fields = ["o_orderkey", "o_custkey", "o_orderpriority"]
    parts = {n: got.filter(F.col("output") == n) for n in ("rejected", "urgent", "other")}
    return records.ledger(parts, dict.fromkeys(parts, fields))


_DIGEST = " || ".join(f"lpad(lower(hex((sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) % 4294967296)::BIGINT)), 8, '0')" for i in range(4))
LEDGER_SQL = f"""
WITH o AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'rejected' WHEN starts_with(o_orderpriority, '1-') THEN 'urgent' ELSE 'other' END AS output, sha256(to_json({{'o_orderkey': o_orderkey, 'o_custkey': o_custkey, 'o_orderpriority': o_orderpriority}})::VARCHAR) AS h FROM orders)
SELECT output, count(*) AS records, {_DIGEST} AS digest FROM o GROUP BY output
"""


def registry_of_sources(spark: SparkSession, d: str) -> DataFrame:
    """A registry of sources with their documents of the first half, its entries replaced or joined by those of the second half."""
    docs = table(spark, d, "documents")
    entry = lambda rows, tag: rows.groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).withColumn("version", F.lit(tag))
    old = entry(docs.filter("doc_id % 2 = 0"), "old")
    new = entry(docs.filter("doc_id % 2 = 1 AND substring(source, -1, 1) IN ('1', '3', '5')"), "new")
    return records.registry_upsert(old, new, "source")


UPSERT_SQL = """
WITH o AS (SELECT source, count(*) AS n, max(doc_id) AS last, 'old' AS version FROM documents WHERE doc_id % 2 = 0 GROUP BY source), n AS (SELECT source, count(*) AS n, max(doc_id) AS last, 'new' AS version FROM documents WHERE doc_id % 2 = 1 AND right(source, 1) IN ('1', '3', '5') GROUP BY source)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.source = o.source)
"""


def fields_by_alias(spark: SparkSession, d: str) -> DataFrame:
    """Orders with fields under several names: first filled, first number, held to an enum, tags once, paths under a new root."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus"))
    number = F.when(F.col("o_orderkey") % 4 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
    words = F.array(F.col("o_orderpriority"), F.lower("o_orderpriority"), F.concat(F.lit(" "), "o_orderstatus"), F.lit(""), F.lit("x" * 90))
    level = F.regexp_replace("o_orderpriority", "^[0-9]-", "  ")
    path = F.concat_ws("/", F.lit("/data"), F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("ab"), F.col("o_orderkey"))
    return o.select(
        "o_orderkey", text.first_value(status, F.col("o_orderpriority")).alias("status"),
        text.first_number(number, F.col("o_orderkey").cast("string"), low=10.0, high=100.0, otherwise=F.lit(0.0)).alias("number"),
        text.enum_or_default(level, ["high", "not specified", "low"], "unknown").alias("level"), text.normalise(F.concat(level, F.lit("__Level "))).alias("plain"),
        F.array_join(text.distinct_strings(words, 3, 80), "|").alias("tags"), text.remap_prefix(path, [("/data/a", "/new"), ("/data", "/rest")]).alias("path"),
    )


ALIAS_SQL = f"""
WITH o AS (SELECT *, regexp_replace(o_orderpriority, '^[0-9]-', '') AS l FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS status, least(greatest(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE o_custkey END, 10), 100)::DOUBLE AS number,
  CASE WHEN lower(l) IN ('high', 'not specified', 'low') THEN lower(l) ELSE 'unknown' END AS level, lower(l) || ' level' AS plain, o_orderpriority || '|' || o_orderstatus || '|{"x" * 80}' AS tags,
  CASE WHEN o_custkey % 2 = 0 THEN '/new/' || o_orderkey ELSE '/rest/ab/' || o_orderkey END AS path FROM o
"""


def sides_by_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Which side of a pair an event is: stated, by key, by folder or by answer; counted with those that stay open."""
    m, side = F.col("event_id") % 5, F.when(F.col("user_id") % 2 == 0, "real").otherwise("fake")
    paths = F.when(m == 2, F.array(F.concat(F.lit("a\\"), side, F.lit("\\1.png")))).when(m == 3, F.array(F.lit("x/real/1"), F.lit("x/fake/2")))
    answer = F.when(m == 3, F.concat(F.lit("so <ANSWER>"), side, F.lit("</answer>")))
    value, source = text.pair_side(F.when(m == 0, F.concat(F.lit(" "), F.upper(side))).otherwise("?"), F.when(m == 1, F.concat(F.lit("k:"), side)), paths, answer, ("real", "fake"))
    e = table(spark, d, "events").select("event_id", value.alias("side"), source.alias("source"))
    return e.groupBy("side", "source").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


SIDES_SQL = """
SELECT CASE WHEN event_id % 5 != 4 THEN CASE WHEN user_id % 2 = 0 THEN 'real' ELSE 'fake' END END AS side, CASE event_id % 5 WHEN 0 THEN 'stated' WHEN 1 THEN 'key' WHEN 2 THEN 'path' WHEN 3 THEN 'answer' END AS source, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1, 2
"""


def manifest_faults(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a manifest: rows whose required fields are blank or whose name repeats, and the sales of the rest by a unique lookup."""
    c = table(spark, d, "customer")
    rows = c.select(F.when(F.col("c_custkey") % 10 == 0, "Customer#000000001").otherwise(F.col("c_name")).alias("id"), F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_mktsegment")).alias("segment"), "c_custkey")
    faults = gates.manifest_faults(rows, "id", ["segment"])
    sales = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("sales"))
    sound = rows.join(faults.select("id").distinct(), "id", "left_anti").join(joins.deduplicate(sales, ["o_custkey"], [], "error"), F.col("c_custkey") == F.col("o_custkey"), "left")
    good = sound.select("id", F.lit("none").alias("fault"), "sales")
    return faults.select("id", "fault", F.lit(None).cast("double").alias("sales")).unionByName(good)


FAULTS_SQL = """
WITH r AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'Customer#000000001' ELSE c_name END AS id, CASE WHEN c_acctbal < 0 THEN ' ' ELSE c_mktsegment END AS segment, c_custkey FROM customer),
f AS (SELECT id, 'missing segment' AS fault FROM r WHERE trim(segment) = '' GROUP BY id UNION ALL SELECT id, 'repeated' FROM r GROUP BY id HAVING count(*) > 1),
s AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS sales FROM orders GROUP BY o_custkey)
SELECT id, fault, NULL::DOUBLE AS sales FROM f UNION ALL SELECT id, 'none', sales FROM r LEFT JOIN s ON o_custkey = c_custkey WHERE id NOT IN (SELECT id FROM f)
"""


def patch_scores(spark: SparkSession, d: str) -> DataFrame:
    """Lines as patches of a supplier: mean of the best tenth, hit of the best patch and overlap with the returned ones."""
    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("patch"), (F.col("l_returnflag") == "R").alias("truth"))
    best = arrays.top_fraction_mean(li, ["l_suppkey"], "score", 0.1).select("l_suppkey", F.round("top_mean", 4).alias("top_mean"))
    point = arrays.pointing_and_iou(li, ["l_suppkey"], "score", F.col("truth"), 60000.0)
    return best.join(point.select("l_suppkey", "hit", F.round("iou", 9).alias("iou")), "l_suppkey")


PATCH_SQL = """
WITH p AS (SELECT l_suppkey, l_extendedprice AS s, l_orderkey * 10 + l_linenumber AS patch, l_returnflag = 'R' AS t FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY s DESC, patch) AS n, count(*) OVER (PARTITION BY l_suppkey) AS c FROM p)
SELECT l_suppkey, round(avg(s) FILTER (n <= greatest(ceil(c * 0.1::DOUBLE), 1)), 4) AS top_mean, bool_or(t) FILTER (n = 1) AS hit, round(coalesce(count(*) FILTER (s >= 60000 AND t) / nullif(count(*) FILTER (s >= 60000 OR t), 0)::DOUBLE, 0), 9) AS iou FROM r GROUP BY l_suppkey
"""


def alternating_labels(spark: SparkSession, d: str) -> DataFrame:
    """Good and bad documents in turn: the n-th of both stand together."""
    lab = table(spark, d, "labels").select("doc_id", "quality")
    return controls.interleave(lab.filter("quality = 1"), lab.filter("quality = 0"), "doc_id").select("doc_id", "side", "place")


TURNS_SQL = "SELECT doc_id, (1 - quality)::INT AS side, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS place FROM labels WHERE quality IN (0, 1)"


def whole_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes made from lines, in pixels of a 640 x 360 picture, as whole thousandths; empty ones are null."""
    x, y = F.col("l_quantity") * 17.3 - 60, F.col("l_linenumber") * 61.7 - 90
    b = F.struct(x.alias("x1"), y.alias("y1"), (x + F.col("l_suppkey") % 50).alias("x2"), (y + F.col("l_partkey") % 40).alias("y2"))
    boxed = geom.whole_box(b, F.lit(640), F.lit(360))
    li = table(spark, d, "lineitem").select(boxed.alias("b"))
    return li.groupBy("b.x1", "b.y1", "b.x2", "b.y2").agg(F.count("*").alias("n"))


BOXES_SQL = """
WITH b AS (SELECT l_quantity * 17.3::DOUBLE - 60 AS x, l_linenumber * 61.7::DOUBLE - 90 AS y, l_suppkey % 50 AS w, l_partkey % 40 AS h FROM lineitem),
p AS (SELECT greatest(0, least(640, round_even(x, 0))) AS x1, greatest(0, least(360, round_even(y, 0))) AS y1, greatest(0, least(640, round_even(x + w, 0))) AS x2, greatest(0, least(360, round_even(y + h, 0))) AS y2 FROM b),
n AS (SELECT x2 > x1 AND y2 > y1 AS ok, round_even(x1 / 640 * 1000, 0)::INT AS x1, round_even(y1 / 360 * 1000, 0)::INT AS y1, round_even(x2 / 640 * 1000, 0)::INT AS x2, round_even(y2 / 360 * 1000, 0)::INT AS y2 FROM p)
SELECT CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1, CASE WHEN ok THEN x2 END AS x2, CASE WHEN ok THEN y2 END AS y2, count(*) AS n FROM n GROUP BY 1, 2, 3, 4
"""

QUERIES = {
    "json_line_policies": (json_line_policies, LINES_SQL), "csv_round_trip": (csv_round_trip, CSV_SQL), "ranked_predictions": (ranked_predictions, RANKS_SQL),
    "inventory_of_two_shapes": (inventory_of_two_shapes, INVENTORY_SQL), "domain_index": (domain_index, INDEX_SQL), "manifests_below": (manifests_below, MANIFESTS_SQL),
    "wide_series": (wide_series, WIDE_SQL), "device_use": (device_use, DEVICE_SQL), "split_ledger": (split_ledger, LEDGER_SQL),
    "registry_of_sources": (registry_of_sources, UPSERT_SQL), "fields_by_alias": (fields_by_alias, ALIAS_SQL), "sides_by_evidence": (sides_by_evidence, SIDES_SQL),
    "manifest_faults": (manifest_faults, FAULTS_SQL), "patch_scores": (patch_scores, PATCH_SQL), "alternating_labels": (alternating_labels, TURNS_SQL),
    "whole_boxes": (whole_boxes, BOXES_SQL),
}
