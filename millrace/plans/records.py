"""Queries of matrix scans, JSON walks, file and release audits, ledgers and evidence over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import leaves
from ..operators import assign, audit, evidence, scan
from ..operators.order import sent, tasks
from ..session import table
from ..sources import footers


def cumulative_transforms(spark: SparkSession, d: str) -> DataFrame:
    """A small projective transform for each line of an order, composed from the order's first line on."""
    p, s, q = (F.col(c).cast("double") for c in ("l_partkey", "l_suppkey", "l_quantity"))
    m = F.array(1 + p % 7 / 97, s % 5 / 53, q, -(s % 5) / 53, F.lit(1.0), F.col("l_linenumber").cast("double"), p % 3 / 997, F.lit(0.0), 1 + p % 4 / 11)
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]  # line numbers repeat
    li = table(spark, d, "lineitem").select("l_orderkey", *order, m.alias("m"))
    out = scan.running_product(li, ["l_orderkey"], [F.col(c) for c in order], "m", "c")
    return out.select("l_orderkey", "l_linenumber", *[F.round(F.col("c")[i], 6).alias(f"c{i}") for i in range(9)])


_CELL = lambda i, j: " + ".join(f"m{i * 3 + k} * c{k * 3 + j}" for k in range(3))
TRANSFORM_SQL = f"""
WITH RECURSIVE m AS (
  SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, 1 + l_partkey::DOUBLE % 7 / 97 AS m0, l_suppkey::DOUBLE % 5 / 53 AS m1, l_quantity::DOUBLE AS m2,
    0 - (l_suppkey::DOUBLE % 5) / 53 AS m3, 1.0::DOUBLE AS m4, l_linenumber::DOUBLE AS m5, l_partkey::DOUBLE % 3 / 997 AS m6, 0.0::DOUBLE AS m7, 1 + l_partkey::DOUBLE % 4 / 11 AS m8 FROM lineitem
), r AS (
  SELECT l_orderkey, l_linenumber, n, {", ".join(f"m{i} / m8 AS c{i}" for i in range(9))} FROM m WHERE n = 1
  UNION ALL
  SELECT m.l_orderkey, m.l_linenumber, m.n, {", ".join(f"({_CELL(i, j)}) / ({_CELL(2, 2)})" for i in range(3) for j in range(3))} FROM r JOIN m ON m.l_orderkey = r.l_orderkey AND m.n = r.n + 1
)
SELECT l_orderkey, l_linenumber, {", ".join(f"round(c{i}, 6) AS c{i}" for i in range(9))} FROM r
"""


def json_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of the events' properties, wrapped to differing depths, by their path."""
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a": [1, {"b": '), "props", F.lit('}, "x"]}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), "props", F.lit(', "y", null]'))).otherwise(F.col("props"))
    e = table(spark, d, "events").select("event_id", wrapped.alias("j"))
    return leaves.walk(e, "event_id", "j").groupBy(F.array_join("path", "/").alias("path")).agg(F.count("*").alias("n"), F.count("text").alias("texts"), F.sum(F.expr("try_cast(value AS long)")).alias("total"))


MEMBERS_SQL = """
WITH e AS (SELECT event_id % 3 AS k, json_extract_string(props, '$.k')::BIGINT AS v FROM events),
m AS (
  SELECT 'a' AS path, NULL AS t, NULL::BIGINT AS v FROM e WHERE k = 0 UNION ALL SELECT 'a/0', NULL, 1 FROM e WHERE k = 0 UNION ALL SELECT 'a/1', NULL, NULL FROM e WHERE k = 0
  UNION ALL SELECT 'a/1/b', NULL, NULL FROM e WHERE k = 0 UNION ALL SELECT 'a/1/b/k', NULL, v FROM e WHERE k = 0 UNION ALL SELECT 'a/2', 'x', NULL FROM e WHERE k = 0
  UNION ALL SELECT '0', NULL, NULL FROM e WHERE k = 1 UNION ALL SELECT '0/k', NULL, v FROM e WHERE k = 1 UNION ALL SELECT '1', 'y', NULL FROM e WHERE k = 1 UNION ALL SELECT '2', NULL, NULL FROM e WHERE k = 1
  UNION ALL SELECT 'k', NULL, v FROM e WHERE k = 2)
SELECT path, count(*) AS n, count(t) AS texts, sum(v)::BIGINT AS total FROM m GROUP BY path
"""

#: Names of the strings that may be a target's path, and what speaks for and against one.
PATH_NAMES = ("video_path", "target_video_path", "original_video_path", "canonical_video_path")
PATH_RULES: list[leaves.Rule] = [
    (20, "path", ("target",), ()),
    (-50, "path", ("donor", "reference"), ()),
    (5, "value", ("/video/",), (".mp4",)),
    (-25, "path", ("source_clip", "full_fake", "full_real", "generated"), ()),
]


def scored_paths(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest target path in a nested report of each order."""
    k = F.col("o_orderkey")
    text = k.cast("string")
    report = F.to_json(F.struct(
        F.when(k % 3 != 0, F.struct(F.concat(F.lit("C:\\video\\"), text).alias("video_path"))).alias("Target"),
        F.struct(F.concat(F.lit("/d/"), text, F.lit(".mp4")).alias("video_path"), F.lit(" ").alias("target_video_path")).alias("donor"),
        F.array(F.struct(F.concat(F.lit("/c/"), text, F.lit(".mp4")).alias("canonical_video_path"))).alias("source_clip"),
        F.when(k % 2 == 0, F.struct(F.struct(F.concat(text, F.lit(".avi")).alias("original_video_path")).alias("inner"))).alias("meta")))
    found = leaves.walk(table(spark, d, "orders").select("o_orderkey", report.alias("j")), "o_orderkey", "j")
    return leaves.best_string(found, "o_orderkey", PATH_NAMES, PATH_RULES)


SCORED_PATHS_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 != 0 THEN 'Target/video_path' WHEN o_orderkey % 2 = 0 THEN 'meta/inner/original_video_path' ELSE 'source_clip/0/canonical_video_path' END AS path,
  CASE WHEN o_orderkey % 3 != 0 THEN 'C:\\video\\' || o_orderkey WHEN o_orderkey % 2 = 0 THEN o_orderkey || '.avi' ELSE '/c/' || o_orderkey || '.mp4' END AS value,
  CASE WHEN o_orderkey % 3 != 0 THEN 25 WHEN o_orderkey % 2 = 0 THEN 0 ELSE -20 END AS score FROM orders
"""


def parquet_files(spark: SparkSession, d: str) -> DataFrame:
    """Files, rows and columns of each table, from the footers of its files."""
    a = footers.parquet_audit(spark, d).withColumn("name", F.regexp_extract("path", r"/([a-z]+)\.parquet(/[^/]*)?$", 1))
    return a.groupBy("name").agg(F.sum("n_rows").alias("n_rows"), F.max("n_columns").alias("n_columns"), F.count("error").alias("errors"), F.count_distinct("schema_sha256").alias("schemas"))


#: Columns of each table.
_TABLES = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


def release_audit(spark: SparkSession, d: str) -> DataFrame:
    """Two releases of documents, by their source: what each may be used for, and whether they share names."""
    docs = table(spark, d, "documents")
    release = F.when(F.coalesce(F.ascii(F.substring("source", -1, 1)), F.lit(0)) % 2 == 0, "set").otherwise("ood")
    marked = table(spark, d, "labels").select(F.col("doc_id").alias("_id"), "quality", "toxic")
    x = docs.join(marked, docs["doc_id"] == marked["_id"], "left").select(
        "doc_id", release.alias("release"), F.col("lang").alias("label"), F.col("quality").isNotNull().alias("paired"), (F.col("n_chars") >= 100).alias("masked"),
        (F.col("n_chars") >= 1000).alias("timed"), F.when(F.col("doc_id") % 10 == 0, F.col("text").isNotNull()).alias("decoded"))
    files = footers.parquet_audit(spark, f"{d}/documents.parquet")
    both = files.select(F.explode(F.array(F.lit("set"), F.lit("ood"))).alias("release"), "error")
    langs = ("de", "en", "es", "fr")
    return audit.release_checks(x, both, {"set": langs, "ood": langs}).select("release", "n", "labels", "paired", "masked", "timed", "tried", "decoded", "binary", "evidence", "temporal", F.array_join(F.concat("binary_failed", "evidence_failed", "temporal_failed"), ",").alias("failed"))


RELEASE_SQL = """
WITH x AS (
  SELECT CASE WHEN coalesce(ascii(right(source, 1)), 0) % 2 = 0 THEN 'set' ELSE 'ood' END AS release, lang, doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL) AS p, coalesce(n_chars >= 100, false) AS m, coalesce(n_chars >= 1000, false) AS t,
    CASE WHEN doc_id % 10 = 0 THEN text IS NOT NULL END AS d FROM documents
), c AS (
  SELECT release, count(*) AS n, count(DISTINCT lang) FILTER (lang IN ('de', 'en', 'es', 'fr')) AS labels, count(*) FILTER (p) AS paired, count(*) FILTER (m) AS masked, count(*) FILTER (t) AS timed, count(d) AS tried, count(*) FILTER (d) AS decoded FROM x GROUP BY release
), b AS (
  SELECT *, concat_ws(',', CASE WHEN labels != 4 THEN 'all_labels_shown' END, CASE WHEN tried = 0 THEN 'decode_sample' END, CASE WHEN coalesce(decoded / nullif(tried, 0)::DOUBLE, 0) < 0.95 THEN 'decode_rate' END) AS fb,
    concat_ws(',', CASE WHEN paired = 0 THEN 'pair_field' END, CASE WHEN paired / n::DOUBLE < 0.8 THEN 'pair_coverage' END, CASE WHEN masked = 0 THEN 'mask_field' END, CASE WHEN masked / n::DOUBLE < 0.8 THEN 'mask_coverage' END) AS fe,
    concat_ws(',', CASE WHEN timed = 0 THEN 'time_field' END, CASE WHEN timed / n::DOUBLE < 0.8 THEN 'time_coverage' END) AS ft FROM c
)
SELECT release, n, labels, paired, masked, timed, tried, decoded, CASE WHEN fb = '' THEN 'usable' ELSE 'insufficient_or_partial' END AS "binary", CASE WHEN fe = '' THEN 'usable' ELSE 'not_established' END AS evidence,
  CASE WHEN ft = '' THEN 'usable' ELSE 'not_established' END AS temporal, concat_ws(',', nullif(fb, ''), nullif(fe, ''), nullif(ft, '')) AS failed FROM b
"""

#: Room of a supplier and of a nation, as a fraction of an equal part of the orders.
LEDGER_SHARE = (6, 5)


def ledger_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Orders to suppliers of their lines under ledgers of customer, supplier, nation and priority, and the orders that stay open.

    The rooms follow the tables, and no ledger has less in all than there are orders.  A customer and a priority have room for
    all of theirs, as an order has no other; a supplier has it for LEDGER_SHARE of an equal part of the orders, a nation for as
    many such parts as the largest has suppliers."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    n = tasks(li)
    c = li.repartition(n, "l_orderkey").join(o.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(sent(s), F.col("l_suppkey") == F.col("s_suppkey"))
    c = c.select(F.col("l_orderkey").alias("target"), F.col("o_custkey").alias("target_group"), F.col("o_orderpriority").alias("operation"), F.col("l_suppkey").alias("donor"), F.col("s_nationkey").alias("donor_group"), F.col("l_quantity").alias("score"))
    quotas = o.groupBy(F.col("o_orderpriority").alias("operation")).agg(F.count("*").alias("quota"))
    most = lambda rows, key: rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    orders, suppliers, (over, under) = o.count(), max(1, s.count()), LEDGER_SHARE
    part = lambda k: -(-orders * k * over // (suppliers * under))
    caps = {"target_cap": most(o, "o_custkey"), "donor_cap": part(1), "group_cap": part(most(s, "s_nationkey"))}
    return assign.assign_with_ledgers(c, quotas, **caps)


_STEP = lambda inner, key, room, flag, was: f"SELECT *, {was} AND row_number() OVER (PARTITION BY {key}, {was} ORDER BY score DESC, target) <= {room} AS {flag} FROM ({inner})"
_OPEN = "SELECT *, rt > 0 AND rd > 0 AND rg > 0 AND ro > 0 AND max(round) OVER (PARTITION BY target) IS NULL AS open FROM s WHERE going"
_ASKED = f"""SELECT *, open AND row_number() OVER (PARTITION BY target, open ORDER BY many, operation, CASE WHEN turn < {assign.BEST_ROUNDS} THEN -score ELSE 0 END,
  CASE WHEN turn < {assign.BEST_ROUNDS} THEN '' ELSE sha256(target || ':' || donor) END, donor) = 1 AS asked FROM ({_OPEN})"""
_KEPT = _STEP(_STEP(_STEP(_STEP(_ASKED, "target_group", "rt", "k1", "asked"), "donor", "rd", "k2", "k1"), "donor_group", "rg", "k3", "k2"), "operation", "ro", "k4", "k3")
_PART = lambda k: f"((orders * {k} * {LEDGER_SHARE[0]} + suppliers * {LEDGER_SHARE[1]} - 1) // (suppliers * {LEDGER_SHARE[1]}))::BIGINT"
LEDGER_SQL = f"""
WITH RECURSIVE c AS (
  SELECT l_orderkey AS target, o_custkey AS target_group, o_orderpriority AS operation, l_suppkey AS donor, s_nationkey AS donor_group, max(l_quantity) AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL
), q AS (SELECT o_orderpriority AS operation, count(*) AS quota FROM orders GROUP BY 1
), n AS (SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM supplier) AS suppliers, (SELECT max(k) FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey)) AS of_customer, (SELECT max(k) FROM (SELECT count(*) AS k FROM supplier GROUP BY s_nationkey)) AS of_nation
), s AS (
  SELECT c.*, count(*) OVER (PARTITION BY c.operation) AS many, of_customer::BIGINT AS rt, {_PART("1")} AS rd, {_PART("of_nation")} AS rg, quota::BIGINT AS ro, NULL::INT AS round, 0 AS turn, true AS going
  FROM c JOIN q ON q.operation = c.operation CROSS JOIN n
  UNION ALL
  SELECT target, target_group, operation, donor, donor_group, score, many, rt - (sum(k4::INT) OVER (PARTITION BY target_group))::BIGINT, rd - (sum(k4::INT) OVER (PARTITION BY donor))::BIGINT,
    rg - (sum(k4::INT) OVER (PARTITION BY donor_group))::BIGINT, ro - (sum(k4::INT) OVER (PARTITION BY operation))::BIGINT, CASE WHEN k4 THEN turn ELSE round END, turn + 1, max(k4::INT) OVER () = 1 FROM ({_KEPT})
), e AS (SELECT * FROM s WHERE turn = (SELECT max(turn) FROM s))
SELECT target, operation, donor, donor_group, score, round, NULL AS reason FROM e WHERE round IS NOT NULL
UNION ALL SELECT target, NULL, NULL, NULL, NULL, NULL, CASE WHEN max(rt) <= 0 THEN 'target group served' WHEN max(ro) <= 0 THEN 'operations full' ELSE 'all donors full' END FROM e GROUP BY target HAVING max(round) IS NULL
"""


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames of ten minutes of their user's track."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, d, "events").select("user_id", F.floor(seconds / 600).cast("long").alias("frame"), "value", "event_type")
    area = F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value"))
    x = F.pmod(F.col("frame"), F.lit(300)).cast("double")
    return e.groupBy("user_id", "frame").agg(F.round(F.sum(area), 4).alias("area")).select("user_id", "frame", (F.col("frame") * 600.0).alias("time"), "area", x.alias("x1"), (x / 2).alias("y1"), (x + F.col("area")).alias("x2"), (x / 2 + F.col("area")).alias("y2"))


def evidence_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of each user's frames, a day's gap apart at most, and their ends at the nearest error of the user."""
    frames = _frames(spark, d)
    found = evidence.intervals(frames, "user_id", "frame", "time", "area", 72, 86400.0)
    samples = frames.filter("area = 0").select("user_id", "time")
    for end in ("start", "end"):
        found = evidence.snapped(found, samples.withColumnRenamed("time", end), ["user_id"], end, f"{end}_snapped")
    return found.select("user_id", "interval", "first_frame", "last_frame", "start", "end", "n_runs", "start_snapped", "end_snapped")


FRAMES_SQL = """
f AS (SELECT user_id, floor(epoch_us(ts) / 1e6::DOUBLE / 600)::BIGINT AS frame, round(sum(CASE WHEN event_type = 'error' THEN 0 ELSE value END), 4) AS area FROM events GROUP BY ALL),
g AS (SELECT *, frame * 600.0::DOUBLE AS time, (frame % 300)::DOUBLE AS x FROM f)"""
INTERVAL_SQL = f"""
WITH {FRAMES_SQL},
a AS (SELECT *, CASE WHEN frame - lag(frame) OVER w <= 72 THEN 0 ELSE 1 END AS s FROM g WHERE area > 0 WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM a),
r AS (SELECT user_id, run, min(frame) AS first_frame, max(frame) AS last_frame, min(time) AS st, max(time) AS en FROM b GROUP BY ALL),
m AS (SELECT *, CASE WHEN st - lag(en) OVER (PARTITION BY user_id ORDER BY run) <= 86400 THEN 0 ELSE 1 END AS s FROM r),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY run) AS interval_no FROM m),
v AS (SELECT user_id, interval_no::BIGINT AS interval_no, min(first_frame) AS first_frame, max(last_frame) AS last_frame, min(st) AS st, max(en) AS en, count(*) AS n_runs FROM i GROUP BY ALL),
z AS (SELECT user_id, time FROM g WHERE area = 0),
p AS (SELECT v.user_id, v.interval_no, arg_min(z.time, (abs(z.time - v.st), z.time)) AS ss, arg_min(z.time, (abs(z.time - v.en), z.time)) AS es FROM v JOIN z ON z.user_id = v.user_id GROUP BY ALL)
SELECT v.user_id, v.interval_no AS "interval", first_frame, last_frame, st AS start, en AS "end", n_runs, ss AS start_snapped, es AS end_snapped FROM v LEFT JOIN p ON p.user_id = v.user_id AND p.interval_no = v.interval_no
"""


def evidence_tubes(spark: SparkSession, d: str) -> DataFrame:
    """Union box, key frame and areas of each user's frames."""
    t = evidence.tubes(_frames(spark, d), "user_id", "frame", "time", "area", ["x1", "y1", "x2", "y2"], digits=4)
    return t.withColumns({c: F.round(c, 4) for c in ("x2", "y2", "area_mean")})


TUBE_SQL = f"""
WITH {FRAMES_SQL}
SELECT user_id, count(*) FILTER (area > 0) AS n_frames, count(*) FILTER (area <= 0) AS n_empty, min(x) FILTER (area > 0) AS x1, min(x / 2) FILTER (area > 0) AS y1, round(max(x + area) FILTER (area > 0), 4) AS x2, round(max(x / 2 + area) FILTER (area > 0), 4) AS y2,
  arg_max(frame, (area, -frame)) FILTER (area > 0) AS key_frame, arg_max(time, (area, -frame)) FILTER (area > 0) AS key_time, min(area) FILTER (area > 0) AS area_min, max(area) FILTER (area > 0) AS area_max, round(avg(area) FILTER (area > 0), 4) AS area_mean FROM g GROUP BY user_id
"""

PARQUET_SQL = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, {n}::BIGINT AS n_columns, 0::BIGINT AS errors, 1::BIGINT AS schemas FROM {t}" for t, n in _TABLES.items())

QUERIES = {
    "cumulative_transforms": (cumulative_transforms, TRANSFORM_SQL), "json_members": (json_members, MEMBERS_SQL), "scored_paths": (scored_paths, SCORED_PATHS_SQL), "parquet_files": (parquet_files, PARQUET_SQL),
    "release_audit": (release_audit, RELEASE_SQL), "ledger_assignment": (ledger_assignment, LEDGER_SQL), "evidence_intervals": (evidence_intervals, INTERVAL_SQL), "evidence_tubes": (evidence_tubes, TUBE_SQL),
}
