"""Queries of proposals, votes, manifests, flushes and trajectories over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import votes as V
from ..operators import probe, proposals, trajectory
from ..operators.order import dealt
from ..session import table
from ..streaming import flush


def _pick(c: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (c % len(names) + 1).cast("int"))


def proposal_status(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as proposed candidates: what is accepted, deferred or refused, and why."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    candidate = n % 4 != 0
    person = p % 4 == 1
    x = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.when(candidate, "candidate").otherwise("deferred").alias("kind"), (n * 1_000_000_000_000 + p * 1_000_000 + s * 100 + F.col("l_quantity").cast("long")).alias("pos"),
        F.concat(F.lit(" r"), (p % 3).cast("string")).alias("raw_id"), F.when(candidate, _pick(p, ("object", "person", "odd", " Object "))).otherwise(_pick(p, ("overlay", "texture", "bad"))).alias("family"), _pick(s, ("car", "adult", "boat")).alias("cls"),
        F.when((F.col("l_quantity").cast("long") % 5 == 0) | person, "body").otherwise("whole").alias("scope"), F.when(p % 11 == 0, "Logo").otherwise(F.concat(F.lit("c"), (p % 7).cast("string"))).alias("concept"),
        F.when(s % 13 == 0, " ").otherwise(F.concat(F.lit("Phrase  "), (p % 5).cast("string"))).alias("phrase"), F.when(p % 6 == 0, "Thing").otherwise(F.concat(F.lit("p"), (s % 4).cast("string"))).alias("prompt"),
        F.when(n % 2 == 0, "possibly_multiple").alias("hint"), F.concat(F.lit("r"), (s % 3).cast("string")).alias("parent")).distinct()
    return proposals.normalise_proposals(x, {"object": ("whole", ("car", "boat")), "person": ("body", ("adult",))}, {"overlay": "needs_tracking", "texture": "not_bounded"}, ("logo",), ("thing",), 3, 1)


PROPOSAL_SQL = """
WITH x AS (
  SELECT DISTINCT l_orderkey AS doc, CASE WHEN l_linenumber % 4 != 0 THEN 'candidate' ELSE 'deferred' END AS kind, l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + l_quantity::BIGINT AS pos,
    l_partkey AS p, l_suppkey AS s, l_linenumber AS n, l_quantity::BIGINT AS q FROM lineitem
), y AS (
  SELECT *, 'r' || (p % 3) AS raw, 'r' || (s % 3) AS par, CASE WHEN p % 4 = 1 THEN 'person' WHEN p % 4 = 2 THEN 'odd' ELSE 'object' END AS fam, CASE WHEN q % 5 = 0 OR p % 4 = 1 THEN 'body' ELSE 'whole' END AS scope,
    CASE WHEN p % 6 = 0 THEN 'thing' ELSE 'p' || (s % 4) END AS prompt, p % 6 = 0 AND n % 2 = 0 AS vague FROM x
), l AS (
  SELECT *, CASE WHEN kind = 'candidate' THEN CASE WHEN fam = 'odd' THEN 'invalid_family_class_or_scope' WHEN (fam = 'person') != (s % 3 = 1) THEN 'family_class_mismatch' WHEN fam = 'object' AND scope = 'body' THEN 'family_scope_mismatch'
      WHEN s % 13 = 0 THEN 'missing_required_text' WHEN p % 11 = 0 THEN 'banned_concept' END ELSE CASE WHEN p % 3 = 2 OR s % 13 = 0 THEN 'invalid_family_or_text' END END AS why,
    CASE WHEN kind = 'candidate' THEN prompt ELSE (p % 3) || ':' || (p % 5) END AS sig FROM y
), f AS (
  SELECT *, min(CASE WHEN why IS NULL AND NOT (vague AND kind = 'candidate') THEN pos END) OVER (PARTITION BY doc, kind, sig) AS fst FROM l
), r AS (
  SELECT *, coalesce(why, CASE WHEN fst < pos THEN CASE WHEN kind = 'candidate' THEN 'duplicate_prompt' ELSE 'duplicate_signature' END END, CASE WHEN vague AND kind = 'candidate' THEN 'ambiguous_prompt' END) AS no FROM f
), k AS (
  SELECT *, row_number() OVER (PARTITION BY doc, kind, no IS NULL ORDER BY pos) AS nth FROM r
), z AS (
  SELECT *, coalesce(no, CASE WHEN nth > CASE WHEN kind = 'candidate' THEN 3 ELSE 1 END THEN 'beyond_limit' END) AS refused FROM k
), i AS (
  SELECT *, CASE WHEN refused IS NULL THEN kind || '_' || lpad(nth::VARCHAR, 2, '0') END AS new_id FROM z
), a AS (SELECT doc, raw, arg_max(new_id, pos) AS parent_id FROM i WHERE kind = 'candidate' AND new_id IS NOT NULL GROUP BY ALL)
SELECT i.doc, i.kind, i.pos, CASE WHEN refused IS NOT NULL THEN 'refused' WHEN i.kind = 'candidate' THEN 'accepted' ELSE 'deferred' END AS status,
  coalesce(refused, CASE WHEN i.kind = 'deferred' THEN CASE WHEN p % 3 = 0 THEN 'needs_tracking' ELSE 'not_bounded' END END) AS reason, new_id, CASE WHEN i.kind = 'deferred' AND refused IS NULL THEN a.parent_id END AS parent_id
FROM i LEFT JOIN a ON a.doc = i.doc AND a.raw = i.par
"""

VOTE_RULES = [
    (1, "text", ["the", "ing"], None, None, "fast", None, 1, False), (2, "text", ["eau"], None, ["oi"], "slow", None, 1, False), (3, "text", None, ["ie", "en"], None, "pan", None, 1, False),
    (4, "question", ["th"], None, None, "static", True, 2, False), (5, "question", ["ou"], None, None, "pan", False, 2, True), (6, "question", ["en", "on"], None, None, "zoom", True, 2, False), (7, "question", ["re"], None, None, "tilt", True, 2, False),
]
VOTE_ORDER = ["fast", "slow", "static", "pan", "zoom", "tilt"]


def caption_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of conversations: user turns are captions, assistant turns are questions with an answer by their turn."""
    c = table(spark, d, "conversations").filter("role IN ('user', 'assistant')")
    said = V.answer_sign(F.when(F.col("turn") % 4 == 1, " Yes, it is").otherwise("no"))
    x = c.select("conv_id", F.when(F.col("role") == "user", "text").otherwise("question").alias("kind"), "text", F.when(F.col("role") == "assistant", said).alias("answer"))
    n = V.votes(x, spark.createDataFrame(VOTE_RULES, V.RULES), "conv_id")
    counts = n.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m"))  # a row a label that the rules know
    labels = V.final_labels(F.col("m"), VOTE_ORDER, [({"fast": 1, "slow": 2}, "slow")], [], {"fast": "static"}, most=3)
    return counts.select("conv_id", F.array_join(labels, ",").alias("labels"), F.coalesce(F.try_element_at("m", F.lit("pan")), F.lit(0)).cast("long").alias("pan_votes"))


VOTE_SQL = """
WITH c AS (SELECT conv_id, role, turn % 4 = 1 AS yes, lower(text) AS t FROM conversations WHERE role IN ('user', 'assistant')),
v AS (
  SELECT conv_id, 'fast' AS label, 1 AS n FROM c WHERE role = 'user' AND (contains(t, 'the') OR contains(t, 'ing')) UNION ALL SELECT conv_id, 'slow', 1 FROM c WHERE role = 'user' AND contains(t, 'eau') AND NOT contains(t, 'oi')
  UNION ALL SELECT conv_id, 'pan', 1 FROM c WHERE role = 'user' AND contains(t, 'ie') AND contains(t, 'en') UNION ALL SELECT conv_id, 'static', 2 FROM c WHERE role = 'assistant' AND yes AND contains(t, 'th')
  UNION ALL SELECT conv_id, 'pan', 2 FROM c WHERE role = 'assistant' AND NOT yes AND contains(t, 'ou') UNION ALL SELECT conv_id, 'zoom', 2 FROM c WHERE role = 'assistant' AND yes AND NOT contains(t, 'ou') AND (contains(t, 'en') OR contains(t, 'on'))
  UNION ALL SELECT conv_id, 'tilt', 2 FROM c WHERE role = 'assistant' AND yes AND NOT contains(t, 'ou') AND contains(t, 're')
), s AS (SELECT conv_id, coalesce(sum(n) FILTER (label = 'fast'), 0) AS f, coalesce(sum(n) FILTER (label = 'slow'), 0) AS w, coalesce(sum(n) FILTER (label = 'static'), 0) AS st, coalesce(sum(n) FILTER (label = 'pan'), 0) AS pan,
  coalesce(sum(n) FILTER (label = 'zoom'), 0) AS z, coalesce(sum(n) FILTER (label = 'tilt'), 0) AS ti FROM v GROUP BY conv_id),
o AS (
  SELECT conv_id, CASE WHEN f > w THEN 'fast' ELSE 'slow' END AS label, CASE WHEN f > w THEN 0 ELSE 1 END AS place, -3 AS a, 0 AS b FROM s
  UNION ALL SELECT conv_id, 'static', 2, CASE WHEN f > w THEN -2 ELSE 0 END, 0 - st - CASE WHEN f > 0 THEN 1 ELSE 0 END FROM s WHERE st > 0 OR f > 0
  UNION ALL SELECT conv_id, 'pan', 3, 0, 0 - pan FROM s WHERE pan > 0 UNION ALL SELECT conv_id, 'zoom', 4, 0, 0 - z FROM s WHERE z > 0 UNION ALL SELECT conv_id, 'tilt', 5, 0, 0 - ti FROM s WHERE ti > 0
), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY a, b, place) AS nth FROM o)
SELECT k.conv_id, string_agg(label, ',' ORDER BY place) AS labels, any_value(s.pan)::BIGINT AS pan_votes FROM k JOIN s ON s.conv_id = k.conv_id WHERE nth <= 3 GROUP BY k.conv_id
"""


def probe_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records of runs with labels of both sides: the manifest, and the contracts it was counted against."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, d, "orders")
    case = F.when(k % 50 == 0, " ").otherwise(k.cast("string"))
    r = o.select(case.alias("case"), F.concat(F.lit("/runs/"), _pick(c, ("a", "a/b", "c", "a")), F.lit("/"), k.cast("string")).alias("path"), F.when(c % 7 == 0, "m1").otherwise("").alias("model"))
    r = r.unionByName(o.filter(k % 20 == 1).select(case.alias("case"), F.concat(F.lit("/runs/a/z"), k.cast("string")).alias("path"), F.lit(None).cast("string").alias("model")))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("case"), F.when(F.col("l_linenumber") % 2 == 1, "real").otherwise("fake").alias("role"), "l_returnflag")
    labels = dealt(li, "case").groupBy("case", "role").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("labels")).withColumn("caption", F.concat_ws(":", "role", "labels"))
    tests = o.filter(k % 5 == 0).select(k.cast("string").alias("case"))
    runs = spark.createDataFrame([("/runs/a", "A", "M1"), ("/runs/a/b", "B", "m2")], "prefix string, source string, model string")
    manifest, contracts = probe.probe_manifest(r, labels, tests, runs, {"cases": o.count(), "A": 100})
    return manifest.unionByName(contracts, allowMissingColumns=True)


PROBE_SQL = """
WITH r AS (
  SELECT CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE o_orderkey::VARCHAR END AS c, '/runs/' || CASE o_custkey % 4 WHEN 1 THEN 'a/b' WHEN 2 THEN 'c' ELSE 'a' END || '/' || o_orderkey AS path, CASE WHEN o_custkey % 7 = 0 THEN 'm1' ELSE '' END AS m FROM orders
  UNION ALL SELECT CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE o_orderkey::VARCHAR END, '/runs/a/z' || o_orderkey, NULL FROM orders WHERE o_orderkey % 20 = 1
), x AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY path) AS nth, CASE WHEN path LIKE '/runs/a/b/%' THEN 'B' WHEN path LIKE '/runs/a/%' THEN 'A' END AS src FROM r
), l AS (
  SELECT l_orderkey::VARCHAR AS c, array_to_string(list_sort(list_distinct(list(l_returnflag) FILTER (l_linenumber % 2 = 1))), ',') AS rl, array_to_string(list_sort(list_distinct(list(l_returnflag) FILTER (l_linenumber % 2 = 0))), ',') AS fl FROM lineitem GROUP BY 1
), y AS (
  SELECT x.c, x.path, CASE WHEN x.c = '' THEN 'missing_case' WHEN nth > 1 THEN 'duplicate_case' WHEN src IS NULL THEN 'outside_runs' WHEN m = 'm1' AND src = 'B' THEN 'model_mismatch' END AS reason, src,
    CASE WHEN x.c != '' AND x.c::BIGINT % 5 = 0 THEN 'test' ELSE 'train' END AS split, rl, fl FROM (SELECT *, nullif(c, '') AS cc FROM x) x LEFT JOIN l ON l.c = x.cc
), m AS (
  SELECT c AS "case", path, reason, src AS source, CASE src WHEN 'A' THEN 'm1' WHEN 'B' THEN 'm2' END AS model, split, CASE WHEN rl IS NOT NULL AND fl IS NOT NULL THEN rl END AS labels,
    CASE WHEN rl IS NOT NULL AND fl IS NOT NULL THEN 'real:' || rl END AS caption, CASE WHEN rl IS NOT NULL AND fl IS NOT NULL THEN rl = fl END AS consistent FROM y
), t AS (
  SELECT 'refused' AS contract, 0 AS expected, count(*) FILTER (reason IS NOT NULL) AS actual FROM m UNION ALL SELECT 'labels_missing', 0, count(*) FILTER (reason IS NULL AND consistent IS NULL) FROM m
  UNION ALL SELECT 'labels_inconsistent', 0, count(*) FILTER (reason IS NULL AND NOT consistent) FROM m UNION ALL SELECT 'cases', (SELECT count(*) FROM orders), count(*) FILTER (reason IS NULL) FROM m
  UNION ALL SELECT 'A', 100, count(*) FILTER (reason IS NULL AND source = 'A') FROM m
  UNION ALL SELECT 'tests_absent', 0, (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey::VARCHAR NOT IN (SELECT "case" FROM m WHERE reason IS NULL))
)
SELECT "case", path, reason, source, model, split, labels, caption, consistent, NULL AS contract, NULL::BIGINT AS expected, NULL::BIGINT AS actual, NULL::BOOLEAN AS holds FROM m
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, contract, expected, actual, expected = actual FROM t
"""


def flush_batches(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user, flushed by fives or after a day."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    return flush.replay(e, "user_id", "ts", "event_id", 5, 86_400)


FLUSH_SQL = """
WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch_us(ts) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS n FROM events
), s AS (
  SELECT user_id, n, moment AS opened, 1 AS held, 1::BIGINT AS batch FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, CASE WHEN held = 5 OR e.moment >= opened + 86400000000 THEN e.moment ELSE opened END, CASE WHEN held = 5 OR e.moment >= opened + 86400000000 THEN 1 ELSE held + 1 END, batch + CASE WHEN held = 5 OR e.moment >= opened + 86400000000 THEN 1 ELSE 0 END
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1
), b AS (
  SELECT s.user_id, batch, min(opened) AS opened, max(e.moment) AS last, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY s.n) AS items, max(batch) OVER (PARTITION BY s.user_id) AS newest FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n GROUP BY s.user_id, batch
)
SELECT user_id::VARCHAR AS key, opened, CASE WHEN n = 5 THEN last ELSE opened + 86400000000 END AS closed, n, CASE WHEN n = 5 THEN 'count' WHEN batch = newest THEN 'open' ELSE 'time' END AS reason, items FROM b
"""


def label_trajectories(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of a label, by id, as a trajectory: its 21 features."""
    t = trajectory.trajectory_features(table(spark, d, "embeddings"), "label", [F.col("vec_id")], "embedding")
    return t.select("label", "n", *[F.round(c, 6).alias(c) for c in trajectory.COLUMNS])


_AT = lambda c, p: f"round(coalesce(max({c}) FILTER (n = {p}), 0), 6)"
_ALL = lambda c, f: f"round(coalesce({f}({c}), 0), 6)"
TRAJECTORY_SQL = f"""
WITH e AS (
  SELECT label, vec_id, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-8::DOUBLE)) AS u FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), p AS (
  SELECT label, row_number() OVER w AS n, u, lag(u) OVER w AS v, lag(u, 2) OVER w AS x FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)
), q AS (
  SELECT label, n, list_inner_product(u, v) AS uv, list_inner_product(u, x) AS ux, list_inner_product(v, x) AS vx, list_inner_product(u, u) AS uu, list_inner_product(v, v) AS vv, list_inner_product(x, x) AS xx FROM p WHERE v IS NOT NULL
), t AS (
  SELECT label, n, 1 - uv AS d, CASE WHEN n > 2 THEN 1 - (uv - ux - vv + vx) / (greatest(sqrt(uu + vv - 2 * uv), 1e-8::DOUBLE) * greatest(sqrt(vv + xx - 2 * vx), 1e-8::DOUBLE)) END AS a FROM q
)
SELECT label, count(*) + 1 AS n, {", ".join(f"{_AT('d', i + 2)} AS d{i}" for i in range(7))}, {", ".join(f"{_AT('a', i + 3)} AS a{i}" for i in range(6))},
  {", ".join(f"{_ALL('d', f)} AS distance_{c}" for c, f in (("mean", "avg"), ("min", "min"), ("max", "max"), ("var", "var_pop")))}, {", ".join(f"{_ALL('a', f)} AS angle_{c}" for c, f in (("mean", "avg"), ("min", "min"), ("max", "max"), ("var", "var_pop")))}
FROM t GROUP BY label
"""

QUERIES = {
    "proposal_status": (proposal_status, PROPOSAL_SQL), "caption_labels": (caption_labels, VOTE_SQL), "probe_contracts": (probe_contracts, PROBE_SQL),
    "flush_batches": (flush_batches, FLUSH_SQL), "label_trajectories": (label_trajectories, TRAJECTORY_SQL),
}
