"""Queries of the track, vote and status operators; order lines stand for frames of tracked objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..operators import tracks
from ..session import table


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Lines as boxes: an order is a video, a supplier group a track, the line number a frame."""
    li = table(spark, d, "lineitem")
    x, y = F.pmod("l_partkey", F.lit(600)).cast("double"), F.pmod("l_suppkey", F.lit(600)).cast("double")
    side = F.col("l_quantity") * 8
    return li.select("l_orderkey", F.pmod("l_suppkey", F.lit(2)).alias("track"), F.col("l_linenumber").alias("frame"), geom.box(x, y, x + side, y + side).alias("box"), (side * side).alias("area"), F.col("l_discount").alias("score"), (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 100 + F.col("l_quantity")).alias("seq"))


FRAMES = """SELECT l_orderkey, l_suppkey % 2 AS track, l_linenumber AS frame, (l_partkey % 600)::DOUBLE AS x1, (l_suppkey % 600)::DOUBLE AS y1, least((l_partkey % 600)::DOUBLE + l_quantity * 8, 1000) AS x2,
  least((l_suppkey % 600)::DOUBLE + l_quantity * 8, 1000) AS y2, (l_quantity * 8) * (l_quantity * 8) AS area, l_discount AS score, l_partkey * 1000000 + l_suppkey * 100 + l_quantity AS seq FROM lineitem"""


def track_statistics(spark: SparkSession, d: str) -> DataFrame:
    f = tracks.fold_packets(_frames(spark, d), ["l_orderkey", "track"], "frame", "seq")
    return tracks.track_stats(f, ["l_orderkey", "track"], "frame", "area", "score").select("l_orderkey", "track", "frames", F.round("area_median", 4).alias("area_median"), F.round("area_mean", 1).alias("area_mean"), F.round(F.col("area_std") / 7, 4).alias("area_std_by_7"), F.round("visible_ratio", 6).alias("visible_ratio"), "key_frame")


TRACK_SQL = f"""
WITH f AS ({FRAMES}), p AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey, track, frame ORDER BY seq DESC) = 1)
SELECT l_orderkey, track, count(*) AS frames, round(median(area), 4) AS area_median, round(avg(area), 1) AS area_mean, round(stddev_pop(area) / 7, 4) AS area_std_by_7, round(count(*) / (max(frame) - min(frame) + 1)::DOUBLE, 6) AS visible_ratio,
  arg_min(frame, (-area, frame)) AS key_frame FROM p GROUP BY l_orderkey, track
"""


def reference_frames(spark: SparkSession, d: str) -> DataFrame:
    return tracks.reference_frame(tracks.fold_packets(_frames(spark, d), ["l_orderkey"], "frame", "seq"), ["l_orderkey"], "frame", "box").select("l_orderkey", "frame", F.round(F.col("score") / 7, 6).alias("score_by_7"))


REFERENCE_SQL = f"""
WITH g AS ({FRAMES}), f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY l_orderkey, frame ORDER BY seq DESC) = 1), n AS (SELECT *, lag(x1) OVER w AS ax1, lag(y1) OVER w AS ay1, lag(x2) OVER w AS ax2, lag(y2) OVER w AS ay2, lead(x1) OVER w AS bx1, lead(y1) OVER w AS by1, lead(x2) OVER w AS bx2, lead(y2) OVER w AS by2 FROM f WINDOW w AS (PARTITION BY l_orderkey ORDER BY frame)),
i AS (SELECT *, greatest(least(x2, ax2) - greatest(x1, ax1), 0) * greatest(least(y2, ay2) - greatest(y1, ay1), 0) AS ca, greatest(least(x2, bx2) - greatest(x1, bx1), 0) * greatest(least(y2, by2) - greatest(y1, by1), 0) AS cb, (x2 - x1) * (y2 - y1) AS a FROM n),
s AS (SELECT l_orderkey, frame, round(4 * a / 1000000 + least(x1, y1, 1000 - x2, 1000 - y2) / 1000 + (CASE WHEN ax1 IS NULL THEN 0.5 ELSE ca / (a + (ax2 - ax1) * (ay2 - ay1) - ca) END + CASE WHEN bx1 IS NULL THEN 0.5 ELSE cb / (a + (bx2 - bx1) * (by2 - by1) - cb) END) / 2, 9) AS score FROM i)
SELECT l_orderkey, frame, round(score / 7, 6) AS score_by_7 FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, frame) = 1
"""


def overlap_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one size as tracks over sizes of their containers: does a track repeat its group's largest one."""
    li = table(spark, d, "lineitem").select(F.pmod("l_orderkey", F.lit(500)).alias("video"), F.pmod("l_partkey", F.lit(5)).alias("track"), F.pmod("l_suppkey", F.lit(40)).alias("frame"), (F.col("l_quantity") * 10).alias("w"))
    one = li.groupBy("video", "track", "frame").agg(F.max("w").alias("w"))
    f = one.withColumn("box", geom.box(F.lit(0), F.lit(0), F.col("w"), F.col("w")))
    best = one.groupBy("video", "track").agg(F.sum("w").alias("s")).groupBy("video").agg(F.max(F.struct("s", "track"))["track"].alias("track"))
    out = tracks.overlap_with_primary(f, "video", "track", "frame", "box", best)
    return out.select("video", "track", F.round("median_iou", 6).alias("median_iou"), F.round("median_inside", 6).alias("median_inside"), "duplicate")


OVERLAP_SQL = """
WITH o AS (SELECT l_orderkey % 500 AS video, l_partkey % 5 AS track, l_suppkey % 40 AS frame, max(l_quantity * 10) AS w FROM lineitem GROUP BY ALL),
b AS (SELECT video, track FROM (SELECT video, track, sum(w) AS s FROM o GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY video ORDER BY s DESC, track DESC) = 1),
j AS (SELECT a.video, a.track, least(a.w, p.w) * least(a.w, p.w) AS c, a.w * a.w AS x, p.w * p.w AS y FROM o a JOIN b ON a.video = b.video AND a.track != b.track JOIN o p ON p.video = b.video AND p.track = b.track AND p.frame = a.frame),
m AS (SELECT video, track, median(c / (x + y - c)) AS i, median(c / least(x, y)) AS k FROM j GROUP BY ALL)
SELECT video, track, round(i, 6) AS median_iou, round(k, 6) AS median_inside, i >= 0.7 OR k >= 0.8 AS duplicate FROM m
"""

#: label, group, priority
VOCABULARY = [("view", "look", 1), ("click", "look", 2), ("purchase", "money", 2), ("refund", "money", 1), ("signup", "account", 1), ("login", "account", 2), ("logout", "account", 3)]


def label_votes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("label"), F.lit(1).alias("n"))
    groups = spark.createDataFrame(VOCABULARY, "label string, `group` string, priority int")
    return tracks.label_votes(e, "user_id", "label", "n", groups)


VOTES_SQL = f"""
WITH v(label, "group", priority) AS (VALUES {", ".join(map(str, VOCABULARY))}), t AS (SELECT user_id, event_type AS label, count(*) AS votes FROM events GROUP BY ALL),
w AS (SELECT user_id, "group", label, votes, priority FROM t JOIN v USING (label) QUALIFY row_number() OVER (PARTITION BY user_id, "group" ORDER BY votes DESC, priority DESC, label DESC) = 1)
SELECT user_id, "group", label, votes FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, priority DESC, "group") <= 8
"""


def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "no_track").otherwise("failed").alias("s"))
    return tracks.rollup_status(o, "o_custkey", "s")


ROLLUP_SQL = "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'success' WHEN bool_or(o_orderstatus = 'P') THEN 'no_track' ELSE 'failure' END AS status, count(*) AS n FROM orders GROUP BY o_custkey"


def subject_selection(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("ok", F.col("o_totalprice") > 150000)
    return tracks.select_subjects(o, "o_custkey", "o_orderkey", "o_totalprice", "ok").groupBy("state").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


SUBJECT_SQL = """
WITH k AS (SELECT *, o_totalprice > 150000 AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice > 150000 DESC, o_totalprice DESC, o_orderkey) AS r FROM orders)
SELECT CASE WHEN r = 1 AND ok THEN 'primary' WHEN r = 1 THEN 'fallback_primary' WHEN ok THEN 'secondary' ELSE 'ineligible' END AS state, count(*) AS n, min(o_orderkey) AS first FROM k GROUP BY 1
"""

QUERIES = {
    "track_statistics": (track_statistics, TRACK_SQL), "reference_frames": (reference_frames, REFERENCE_SQL), "overlap_duplicates": (overlap_duplicates, OVERLAP_SQL),
    "label_votes": (label_votes, VOTES_SQL), "status_rollup": (status_rollup, ROLLUP_SQL), "subject_selection": (subject_selection, SUBJECT_SQL),
}
