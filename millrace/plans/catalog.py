"""Queries of label buckets, reasons, windows, intervals and orders over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import sampling
from ..session import table

WRITTEN = ("complex-motion", "minor-motion", "no-motion", "static", "fast-speed", "slow-speed", "unsteady", "no-shaking", "pan-left", "pan-right", "zoom-in", "zoom-out")


def _name(c: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (c % len(names) + 1).cast("int"))


def motion_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Orders by bucket of their labels in all four readings and by coarse signature."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(_name(F.col("l_partkey"), WRITTEN)).alias("ls"))
    x = x.select(L.motion_bucket(F.col("ls")).alias("plain"), L.motion_bucket(F.col("ls"), "none").alias("as_none"), L.motion_bucket(F.col("ls"), "own").alias("own"), L.motion_bucket(F.col("ls"), "text").alias("by_text"), L.coarse_signature(F.col("ls")).alias("signature"))
    return x.groupBy(*x.columns).agg(F.count("*").alias("n"))


BUCKET_SQL = """
WITH x AS (SELECT l_orderkey, list(l_partkey % 12) AS k FROM lineitem GROUP BY 1),
y AS (SELECT CASE WHEN list_contains(k, 0) THEN 'complex-motion' WHEN list_contains(k, 1) THEN 'minor-motion' END AS m, list_contains(k, 2) AS none, list_contains(k, 3) AS st, list_contains(k, 1) AS minor, k FROM x)
SELECT coalesce(m, CASE WHEN none THEN 'no-motion' END, 'unknown') AS plain, coalesce(m, CASE WHEN none OR st THEN 'no-motion' END, 'unknown') AS as_none, coalesce(m, CASE WHEN none OR st THEN 'static' END, 'unknown') AS own,
  CASE WHEN st THEN 'static' WHEN minor THEN 'minor-motion' ELSE 'complex-motion' END AS by_text,
  coalesce(m, CASE WHEN none THEN 'no-motion' END, 'motion-unknown') || '|' || CASE WHEN list_contains(k, 4) THEN 'fast-speed' WHEN list_contains(k, 5) THEN 'slow-speed' ELSE 'speed-unknown' END || '|'
    || CASE WHEN list_contains(k, 6) THEN 'unsteady' WHEN list_contains(k, 7) THEN 'no-shaking' ELSE 'steadiness-unknown' END AS signature, count(*) AS n FROM y GROUP BY ALL
"""

#: Groups of part types by prefix; the first that fits counts.
GROUPS = [("metal", "^STANDARD|^PROMO"), ("cheap", "^ECON|^SMALL"), ("large", "^LARGE")]


def part_groups(spark: SparkSession, d: str) -> DataFrame:
    """Parts by group of their type and by whether their name is on a list of words."""
    p = table(spark, d, "part").select("p_size", L.first_rule(F.col("p_type"), GROUPS, None).alias("grp"), L.banned(F.col("p_name"), ["small ring", " large ring"], ["bolt", "gear"]).alias("banned"))
    return p.groupBy("grp", "banned").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))


GROUP_SQL = """
SELECT CASE WHEN starts_with(p_type, 'STANDARD') OR starts_with(p_type, 'PROMO') THEN 'metal' WHEN starts_with(p_type, 'ECON') OR starts_with(p_type, 'SMALL') THEN 'cheap' WHEN starts_with(p_type, 'LARGE') THEN 'large' END AS grp,
  trim(lower(p_name)) IN ('small ring', ' large ring') OR contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'gear') AS banned, count(*) AS n, sum(p_size)::BIGINT AS sizes FROM part GROUP BY ALL
"""


def path_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label of an order by the folder of its path, else by its answer."""
    path = F.concat(F.lit("/data/"), _name(F.col("o_orderkey"), ("Fake", "real", "other")), F.lit("/"), F.col("o_orderkey").cast("string"))
    said = F.concat(F.lit("so <answer> "), _name(F.col("o_custkey"), ("FAKE", "Real", "both")), F.lit(" </answer>"))
    return table(spark, d, "orders").groupBy(L.path_or_answer(path, said).alias("label")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


PATH_SQL = """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Fake' WHEN o_orderkey % 3 = 1 THEN 'Real' WHEN o_custkey % 3 = 0 THEN 'Fake' WHEN o_custkey % 3 = 1 THEN 'Real' ELSE 'UNKNOWN' END AS label, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY ALL
"""

REASONS = ("target:missing_mask", "donor: mapped_but_unverified", "target: invalid_npz; path=/a/b", "schema=3 -> 4: bad", "mask npz does not exist: /x", "no id")


def blocked_orders(spark: SparkSession, d: str) -> DataFrame:
    """Status of each order by the reasons of its returned lines, and how often each kind of reason stands behind it."""
    reason = F.when(F.col("l_returnflag") == "R", _name(F.col("l_partkey"), REASONS))
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(reason).alias("rs"))
    x = x.withColumn("status", L.blocked_status(F.col("rs"))).withColumn("category", F.explode_outer(F.transform("rs", L.reason_category)))
    return x.groupBy("status", "category").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"))


BLOCKED_SQL = """
WITH l AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN l_partkey % 6 END AS k FROM lineitem),
o AS (SELECT l_orderkey, CASE WHEN bool_or(k = 0) THEN 'blocked_missing_mask' WHEN bool_or(k = 1) THEN 'blocked_mapped_but_unverified' WHEN bool_or(k = 2) THEN 'blocked_invalid_mask_npz' WHEN count(k) > 0 THEN 'blocked_schema_error' ELSE 'preflight_passed' END AS status, count(k) AS ks FROM l GROUP BY 1)
SELECT status, CASE k WHEN 0 THEN 'target:missing_mask' WHEN 1 THEN 'donor: mapped_but_unverified' WHEN 2 THEN 'target: invalid_npz' WHEN 3 THEN 'schema -> 4' WHEN 4 THEN 'mask_npz_does_not_exist' WHEN 5 THEN 'no id' END AS category,
  CASE WHEN k IS NULL THEN count(DISTINCT l_orderkey) ELSE count(*) END AS n, count(DISTINCT l_orderkey) AS orders FROM o JOIN l USING (l_orderkey) WHERE k IS NOT NULL OR ks = 0 GROUP BY status, k
"""


def strict_label_lists(spark: SparkSession, d: str) -> DataFrame:
    """Label lists of orders in a tag, some of them broken, by the reason they are refused for."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(_name(F.col("l_partkey"), WRITTEN)).alias("ls"))
    k = F.col("l_orderkey") % 7
    body = F.concat(F.lit("["), F.array_join(F.transform("ls", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.when(k == 1, "").when(k == 2, ", 5]").otherwise("]"))
    text = F.concat(F.when(k == 3, "so ").otherwise(" "), F.lit("<camera_motion>"), body, F.lit("</camera_motion>\n"))
    got = x.select(L.strict_labels(text, "camera_motion", list(WRITTEN[:8])).alias("r"))
    return got.groupBy("r.reason").agg(F.count("*").alias("n"), F.sum(F.size("r.labels")).alias("labels"))


STRICT_SQL = """
WITH x AS (SELECT l_orderkey % 7 AS k, list(l_partkey % 12) AS ls FROM lineitem GROUP BY l_orderkey),
y AS (SELECT ls, CASE WHEN k = 3 THEN 'tag_or_extra_text' WHEN k = 1 THEN 'invalid_json' WHEN k = 2 THEN 'not_string_list' WHEN len(ls) > len(list_distinct(ls)) THEN 'duplicate_labels' WHEN len(list_filter(ls, lambda v: v >= 8)) > 0 THEN 'unknown_labels' ELSE '' END AS reason FROM x)
SELECT reason, count(*) AS n, sum(CASE WHEN reason = '' THEN len(ls) ELSE 0 END)::BIGINT AS labels FROM y GROUP BY ALL
"""


def shifted_intervals(spark: SparkSession, d: str) -> DataFrame:
    """An interval of each line moved within 10 seconds, and its type turned by half the vocabulary."""
    start, long = F.col("l_quantity") % 10, F.col("l_linenumber") * 1.5
    moved = L.shifted_interval(start, F.least(start + long, F.lit(10.0)), F.lit(0.0), F.lit(10.0))
    text = F.concat(F.lit("a <type> "), _name(F.col("l_partkey"), WRITTEN), F.lit("</type> b <type>other</type>"))
    turned = L.replace_in_tag(text, "type", lambda b: L.rotated(b, list(WRITTEN)))
    x = table(spark, d, "lineitem").select("l_returnflag", moved.alias("m"), turned.alias("t"), ((F.col("l_partkey") + 6) % 12).alias("k"))
    right = F.concat(F.lit("a <type>"), _name(F.col("k"), WRITTEN), F.lit("</type> b <type>other</type>"))
    return x.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("m.start"), 3).alias("starts"), F.round(F.sum("m.end"), 3).alias("ends"), F.count_if(F.col("t") == right).alias("turned"))


SHIFT_SQL = """
WITH x AS (SELECT l_returnflag, l_quantity % 10 AS s, least(l_quantity % 10 + l_linenumber * 1.5::DOUBLE, 10) AS e FROM lineitem),
y AS (SELECT *, (s + e) / 2 AS m, e - s AS w, e - s >= 8 AS f FROM x),
z AS (SELECT *, CASE WHEN f THEN 10.0::DOUBLE / 3 ELSE w END AS n FROM y),
v AS (SELECT *, CASE WHEN f THEN m > 5 ELSE abs(n / 2 - m) >= abs(10 - n / 2 - m) END AS low FROM z)
SELECT l_returnflag, count(*) AS n, round(sum(CASE WHEN low THEN 0 ELSE 10 - n END), 3) AS starts, round(sum(CASE WHEN low THEN n ELSE 10 END), 3) AS ends, count(*) AS turned FROM v GROUP BY ALL
"""


def clip_frames(spark: SparkSession, d: str) -> DataFrame:
    """Windows and sampled frames of clips as long as the lines' quantities; those of equal clips are made once."""
    n, fps = F.col("n"), F.col("l_linenumber") * 4.0
    clips = table(spark, d, "lineitem").groupBy("l_linenumber", F.col("l_quantity").cast("int").alias("n")).agg(F.count("*").alias("k"))
    x = clips.select("l_linenumber", "k", L.window_starts(n, 8, 3).alias("w"), L.window_starts(n, 8, 3, 4).alias("few"), L.dense_frames(n, fps, 10.0).alias("f"))
    total = lambda c: F.sum(F.col("k") * F.aggregate(c, F.lit(0), lambda s, v: s + v))
    size = lambda c: F.sum(F.col("k") * F.size(c))
    return x.groupBy("l_linenumber").agg(size("w").alias("windows"), total("w").alias("starts"), total("few").alias("few_starts"), size("f").alias("frames"), total("f").alias("indices"))


CLIP_SQL = """
WITH x AS (SELECT l_linenumber, l_quantity::INT AS n, l_linenumber * 4.0::DOUBLE AS fps FROM lineitem),
y AS (SELECT *, greatest(n - 8, 0) AS last, least(fps, 10) AS rate FROM x),
z AS (SELECT *, CASE WHEN n < 2 THEN [] ELSE list_sort(list_distinct(list_append(range(0, last + 1, 3), last::BIGINT))) END AS w,
  list_distinct(list_append(list_transform(range(0, greatest(ceil(((n - 1) / fps + 1e-9) * rate)::BIGINT, 1)), lambda k: least(n - 1, round_even(k * (1.0::DOUBLE / rate) * fps, 0)::BIGINT)), (n - 1)::BIGINT)) AS f FROM y),
v AS (SELECT *, CASE WHEN len(w) > 4 THEN list_transform(range(0, 4), lambda i: w[round_even(i * (len(w) - 1) / 3.0::DOUBLE, 0)::INT + 1]) ELSE w END AS few FROM z)
SELECT l_linenumber, sum(len(w))::BIGINT AS windows, sum(coalesce(list_sum(w), 0))::BIGINT AS starts, sum(coalesce(list_sum(few), 0))::BIGINT AS few_starts, sum(len(f))::BIGINT AS frames, sum(list_sum(f))::BIGINT AS indices FROM v GROUP BY ALL
"""


def list_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of lines per order, with the ratio of summed discounts to summed prices and a weighted score."""
    price, part = F.col("l_extendedprice"), F.col("l_extendedprice") * F.col("l_discount")
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum(part).alias("off"), F.sum(price).alias("price"), F.avg(0.7 * F.col("l_discount") + 0.3 * F.col("l_tax")).alias("score"))
    return x.groupBy("lines").agg(F.count("*").alias("orders"), F.round(F.sum("off") / F.sum("price"), 6).alias("ratio"), F.round(F.avg("score"), 6).alias("mean_score"))


SIZES_SQL = """
WITH x AS (SELECT l_orderkey, count(*) AS lines, sum(l_extendedprice * l_discount) AS off, sum(l_extendedprice) AS price, avg(0.7::DOUBLE * l_discount + 0.3::DOUBLE * l_tax) AS score FROM lineitem GROUP BY 1)
SELECT lines, count(*) AS orders, round(sum(off) / sum(price), 6) AS ratio, round(avg(score), 6) AS mean_score FROM x GROUP BY 1
"""


def repeated_control(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents in hash order, over and over, until there is one for each event."""
    return sampling.cycle_pad(table(spark, d, "labels").select("doc_id"), "pad", "doc_id", table(spark, d, "events").count())


REPEAT_SQL = """
WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('pad:' || doc_id), doc_id) - 1 AS spot, count(*) OVER () AS n FROM labels)
SELECT doc_id, i AS repeat_index FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) e JOIN k ON i % n = spot
"""


def epoch_draws(spark: SparkSession, d: str) -> DataFrame:
    """Documents of three epochs dealt to four ranks."""
    return sampling.epoch_draws(table(spark, d, "documents").select("doc_id"), "ep", "doc_id", 3, 4)


EPOCH_SQL = """
WITH k AS (SELECT doc_id, epoch::INT AS epoch, (SELECT count(*) FROM documents) * epoch + row_number() OVER (PARTITION BY epoch ORDER BY sha256('ep:' || epoch || ':' || doc_id), doc_id) - 1 AS g FROM documents, range(3) r(epoch))
SELECT doc_id, epoch, g // 4 AS draw, g % 4 AS rank FROM k
"""


def manifest_order(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the order of their labels' list (quality, then descending id), unlabelled ones after them."""
    listed = table(spark, d, "labels").select("doc_id", (F.col("quality") * 1_000_000_000 - F.col("doc_id")).alias("ordinal"))
    return sampling.manifest_order(table(spark, d, "documents").select("doc_id"), listed, "doc_id", "ordinal")


ORDER_SQL = """
SELECT doc_id, row_number() OVER (ORDER BY quality NULLS LAST, CASE WHEN quality IS NULL THEN doc_id ELSE -doc_id END) AS place FROM documents LEFT JOIN labels USING (doc_id)
"""


def resolved_split(spark: SparkSession, d: str) -> DataFrame:
    """Split by label where there is one (toxic to test, clean to train), else by hash."""
    given = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "test").otherwise("train").alias("split"))
    return sampling.resolved_split(table(spark, d, "documents").select("doc_id"), given, "split", "doc_id", 0.7)


SPLIT_SQL = """
SELECT doc_id, CASE WHEN toxic = 1 THEN 'test' WHEN toxic IS NOT NULL THEN 'train' WHEN ('0x' || substr(sha256('split:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.7 THEN 'train' ELSE 'test' END AS split FROM documents LEFT JOIN labels USING (doc_id)
"""

QUERIES = {
    "motion_buckets": (motion_buckets, BUCKET_SQL), "part_groups": (part_groups, GROUP_SQL), "path_labels": (path_labels, PATH_SQL), "blocked_orders": (blocked_orders, BLOCKED_SQL),
    "strict_label_lists": (strict_label_lists, STRICT_SQL), "shifted_intervals": (shifted_intervals, SHIFT_SQL), "clip_frames": (clip_frames, CLIP_SQL), "list_sizes": (list_sizes, SIZES_SQL),
    "repeated_control": (repeated_control, REPEAT_SQL), "epoch_draws": (epoch_draws, EPOCH_SQL), "manifest_order": (manifest_order, ORDER_SQL), "resolved_split": (resolved_split, SPLIT_SQL),
}
