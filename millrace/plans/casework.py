"""Queries of the case operators and prompt functions over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions.responses import ARTIFACTS
from ..operators import cases, gates
from ..operators.sampling import hash_key
from ..session import table


def prompt_lines(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with as many frame lines as a line's quantity: every other one kept, all removed, and their count against a payload."""
    n = F.col("l_quantity").cast("int")
    text = F.concat(F.lit("look\n"), F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("Frame "), k.cast("string"), F.lit(": <image>\n"))), ""), F.lit("which?"))
    x = table(spark, d, "lineitem").select("l_linenumber", text.alias("t"), F.filter(F.sequence(F.lit(0), n), lambda i: i % 2 == 0).alias("even"), F.sequence(F.lit(1), F.col("l_linenumber") * 7).alias("payload"))
    kept, bare = P.marked_lines(F.col("t"), "<image>", F.col("even")), P.without_lines(F.col("t"), "<image>")
    return x.groupBy("l_linenumber").agg(F.sum(F.length(kept)).alias("kept_chars"), F.count_if(bare == "look\nwhich?").alias("bare"), F.count_if(P.placeholders_match(F.col("t"), "<image>", F.col("payload"))).alias("matching"))


LINES_SQL = """
SELECT l_linenumber, sum(11 + list_sum(list_transform(list_filter(range(1, l_quantity::BIGINT + 1), lambda k: k % 2 = 1), lambda k: 16 + length(k::VARCHAR))))::BIGINT AS kept_chars,
  count(*) AS bare, count(*) FILTER (l_quantity = l_linenumber * 7) AS matching FROM lineitem GROUP BY 1
"""


def clip_plans(spark: SparkSession, d: str) -> DataFrame:
    """Frames and times of clips that are two frames long for each unit of a line's quantity."""
    first, last = F.col("l_linenumber") * 3, F.col("l_linenumber") * 3 + F.col("l_quantity").cast("int") * 2
    x = table(spark, d, "lineitem").select("l_linenumber", first.alias("a"), last.alias("b"), P.clip_plan(first, last, F.lit(12.0), 16.0).alias("p"))
    x = x.withColumn("f", P.clip_frames(F.col("a"), F.col("b"), F.col("p")))
    end = P.frame_time(F.col("p.frames") - 1, F.when(F.col("l_linenumber") > 2, F.element_at("f", -1)), F.lit(12.0), F.col("a") / 12.0, F.col("p.fps"))
    total = F.aggregate("f", F.lit(0.0), lambda s, v: s + v)
    return x.groupBy("l_linenumber").agg(F.sum("p.frames").alias("frames"), F.sum("p.valid").alias("valid"), F.round(F.sum("p.fps"), 3).alias("rates"), F.round(F.sum(total), 3).alias("sources"), F.round(F.sum(end), 3).alias("ends"))


CLIP_SQL = """
WITH x AS (SELECT l_linenumber, l_linenumber * 3 AS a, l_linenumber * 3 + l_quantity::INT * 2 AS b FROM lineitem), y AS (SELECT *, (b - a + 1) / 12.0::DOUBLE AS s FROM x),
z AS (SELECT *, CASE WHEN s <= 5 THEN greatest(1, round_even(s * 16.0::DOUBLE, 0)::INT) ELSE 81 END AS valid, CASE WHEN s <= 5 THEN 16.0::DOUBLE ELSE 81.0::DOUBLE / s END AS fps FROM y),
v AS (SELECT *, CASE WHEN s <= 5 THEN ceil((valid - 1) / 4.0::DOUBLE)::INT * 4 + 1 ELSE 81 END AS frames FROM z)
SELECT l_linenumber, sum(frames)::BIGINT AS frames, sum(valid)::BIGINT AS valid, round(sum(fps), 3) AS rates, round(sum(CASE WHEN valid > 1 THEN valid * (a + b) / 2.0::DOUBLE ELSE a END + (frames - valid) * b), 3) AS sources,
  round(sum(CASE WHEN l_linenumber > 2 THEN (CASE WHEN frames = 1 THEN a ELSE b END) / 12.0::DOUBLE ELSE a / 12.0::DOUBLE + (frames - 1) / fps END), 3) AS ends FROM v GROUP BY 1
"""


def _minutes(c: str):
    return F.hour(c) * 60 + F.minute(c)


def _frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    return e.filter("event_type <> 'purchase'").select("event_id", "user_id", (_minutes("ts") * 0.75).alias("at")), e.filter("event_type = 'purchase'").select("user_id", _minutes("ts").alias("frame")).distinct()


def frames_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    """Purchases of a user in the minute that another event points to."""
    x = cases.aligned_frames(*_frames(spark, d), "user_id", "at", "frame")
    return x.groupBy("status").agg(F.count("*").alias("n"), F.sum("mask_frame").alias("frames"), F.sum("source_frame").alias("sources"))


FRAMES = """
WITH w AS (SELECT event_id, user_id, (hour(ts) * 60 + minute(ts)) * 0.75::DOUBLE AS spot, round_even((hour(ts) * 60 + minute(ts)) * 0.75::DOUBLE, 0)::BIGINT AS s FROM events WHERE event_type <> 'purchase'),
t AS (SELECT DISTINCT user_id, hour(ts) * 60 + minute(ts) AS f FROM events WHERE event_type = 'purchase')"""

ZERO_SQL = f"""{FRAMES}
SELECT CASE WHEN f IS NULL THEN 'zero_filled' ELSE 'visible' END AS status, count(*) AS n, sum(f)::BIGINT AS frames, sum(s)::BIGINT AS sources FROM w LEFT JOIN t ON w.user_id = t.user_id AND s = f GROUP BY 1
"""


def frames_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The same, with the nearest minute that has a purchase where the one pointed to has none."""
    x = cases.aligned_frames(*_frames(spark, d), "user_id", "at", "frame", zero_missing=False)
    return x.groupBy("status").agg(F.count("*").alias("n"), F.sum("mask_frame").alias("frames"), F.sum("source_frame").alias("sources"))


NEAREST_SQL = f"""{FRAMES},
b AS (SELECT event_id, any_value(s) AS s, arg_min(f, (abs(f - spot), f)) FILTER (f IS NOT NULL) AS near, bool_or(f = s) AS hit FROM w LEFT JOIN t USING (user_id) GROUP BY 1)
SELECT CASE WHEN hit THEN 'visible' WHEN near IS NULL THEN 'missing' ELSE 'nearest' END AS status, count(*) AS n, sum(CASE WHEN hit THEN s ELSE near END)::BIGINT AS frames, sum(s)::BIGINT AS sources FROM b GROUP BY 1
"""


def donor_search(spark: SparkSession, d: str) -> DataFrame:
    """The best-off customer of another nation for each customer, of its own segment or one later in the alphabet."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.col("c_custkey").alias("donor"), "c_acctbal")
    s = c.select("c_mktsegment").distinct()
    level = F.when(F.col("c_mktsegment") == F.col("donor_label"), "exact").when(F.col("c_mktsegment") < F.col("donor_label"), "group")
    rules = s.join(s.withColumnRenamed("c_mktsegment", "donor_label"), F.col("c_mktsegment") <= F.col("donor_label")).withColumn("level", level)
    return cases.best_donor(c.drop("donor"), c.drop("c_custkey"), rules, "c_custkey", "c_nationkey", "c_mktsegment", "donor", "c_acctbal")


DONOR_SQL = """
SELECT a.c_custkey, b.c_custkey AS donor, CASE WHEN a.c_mktsegment = b.c_mktsegment THEN 'exact' WHEN b.c_custkey IS NOT NULL THEN 'group' END AS level
FROM customer a LEFT JOIN customer b ON a.c_nationkey <> b.c_nationkey AND a.c_mktsegment <= b.c_mktsegment QUALIFY row_number() OVER (PARTITION BY a.c_custkey ORDER BY b.c_acctbal DESC, b.c_custkey) = 1
"""


def pending_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose customer isn't done with, and whether they can run."""
    c = table(spark, d, "customer")
    status = F.when(F.col("c_mktsegment") == "BUILDING", "uploaded_verified").when(F.col("c_mktsegment") == "MACHINERY", "needs_manual_review").when(F.col("c_mktsegment") == "FURNITURE", "accepted").otherwise("running")
    states = c.select(F.col("c_custkey").alias("o_custkey"), status.alias("status"), F.when(F.col("c_acctbal") > 3000, "r").alias("receipt"))
    x = cases.pending(table(spark, d, "orders"), states, "o_custkey", F.col("o_orderstatus") != "P")
    return x.groupBy("work").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


PENDING_SQL = """
SELECT CASE WHEN o_orderstatus <> 'P' THEN 'run' ELSE 'fail' END AS work, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment IN ('MACHINERY', 'FURNITURE') AND c_acctbal > 3000) GROUP BY 1
"""


def group_split(spark: SparkSession, d: str) -> DataFrame:
    """About 500 lines to eval, whole orders only; flag N is the unknown label."""
    x = cases.group_split(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", "l_returnflag", "gs", 500, "N")
    return x.groupBy("split", "l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"), F.sum("l_orderkey").alias("keys"))


GROUP_SPLIT_SQL = """
WITH g AS (SELECT l_orderkey, count(*) AS size, count(DISTINCT nullif(l_returnflag, 'N')) AS k, min(nullif(l_returnflag, 'N')) AS lo FROM lineitem GROUP BY 1),
h AS (SELECT l_orderkey, size, CASE WHEN k > 1 THEN 'mixed' ELSE coalesce(lo, 'N') END AS label FROM g),
s AS (SELECT label, sum(size) * 500 / sum(sum(size)) OVER ()::DOUBLE AS exact, count(*) OVER () AS labels FROM h GROUP BY 1),
f AS (SELECT *, floor(exact) AS base, 500 - sum(floor(exact)) OVER () AS short, row_number() OVER (ORDER BY exact - floor(exact) DESC, label) AS place FROM s),
q AS (SELECT label, CASE WHEN labels <= 500 THEN greatest(base + (place <= short)::INT, 1) ELSE base + (place <= short)::INT END AS take FROM f),
c AS (SELECT l_orderkey, sum(size) OVER (PARTITION BY label ORDER BY sha256('gs:' || l_orderkey), l_orderkey) - size < take AS e FROM h JOIN q USING (label))
SELECT CASE WHEN e THEN 'eval' ELSE 'train' END AS split, l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS orders, sum(l_orderkey)::BIGINT AS keys FROM lineitem JOIN c USING (l_orderkey) GROUP BY ALL
"""


def matched_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Finished with open orders of one priority, 300 pairs taken in turn from the priorities."""
    return cases.matched_pairs(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ("F", "O"), "mp", "o_orderkey", 300)


MATCHED_SQL = """
WITH r AS (SELECT o_orderpriority, o_orderstatus AS s, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY sha256('mp:' || o_orderkey), o_orderkey) AS place FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT a.o_orderpriority, a.place, a.o_orderkey AS first, b.o_orderkey AS second FROM r a JOIN r b ON a.o_orderpriority = b.o_orderpriority AND a.place = b.place AND a.s = 'F' AND b.s = 'O'
ORDER BY a.place, sha256('mp:' || a.o_orderpriority), a.o_orderpriority LIMIT 300
"""


def subject_draw(spark: SparkSession, d: str) -> DataFrame:
    """A customer's dearest order, or with a probability of 15% another one that isn't pending."""
    return cases.subject_draw(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderstatus") != "P", "sd", 0.85)


SUBJECT_SQL = """
WITH b AS (SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY 1),
p AS (SELECT o_custkey, o_orderkey AS second FROM orders JOIN b USING (o_custkey) WHERE o_orderstatus <> 'P' AND o_orderkey <> best AND o_totalprice > 0
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY -ln(greatest(('0x' || substr(sha256('sd:' || o_custkey || ':' || o_orderkey), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE, 1e-16)) / o_totalprice, o_orderkey) = 1),
m AS (SELECT *, CASE WHEN second IS NULL THEN 'fallback' WHEN ('0x' || substr(sha256('sd:' || o_custkey), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.85 THEN 'primary' ELSE 'secondary' END AS mode FROM b LEFT JOIN p USING (o_custkey))
SELECT o_custkey, CASE WHEN mode = 'secondary' THEN second ELSE best END AS o_orderkey, mode FROM m
"""

#: Shapes of masks with the share of cases below which each is taken, for persons and for others.
PERSON, OTHER = ([("shape", 0.60), ("dilated", 0.85), ("closing", 0.95)], "erode_then_dilate"), ([("shape", 0.70), ("dilated", 0.90)], "expanded_box")


def mask_policies(spark: SparkSession, d: str) -> DataFrame:
    """Mask shape and prompt template of each part by hash; economy parts stand for persons."""
    unit = P.closed_unit(hash_key("mask", F.col("p_partkey")))
    shape = F.when(F.col("p_type") == "ECONOMY", P.variant(unit, *PERSON)).otherwise(P.variant(unit, *OTHER))
    x = table(spark, d, "part").select(shape.alias("shape"), P.chosen_template(F.col("p_partkey"), ["one", "two", "three"], "tm").alias("template"), "p_partkey")
    return x.groupBy("shape", "template").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


MASK_SQL = """
WITH x AS (SELECT *, ('0x' || substr(sha256('mask:' || p_partkey), 1, 12))::BIGINT / 281474976710655.0::DOUBLE AS u, ('0x' || substr(sha256('tm:' || p_partkey), 1, 8))::BIGINT % 3 AS t FROM part)
SELECT CASE WHEN p_type = 'ECONOMY' THEN CASE WHEN u < 0.6 THEN 'shape' WHEN u < 0.85 THEN 'dilated' WHEN u < 0.95 THEN 'closing' ELSE 'erode_then_dilate' END
  WHEN u < 0.7 THEN 'shape' WHEN u < 0.9 THEN 'dilated' ELSE 'expanded_box' END AS shape, ['one', 'two', 'three'][t + 1] AS template, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM x GROUP BY ALL
"""


def reserve_plan(spark: SparkSession, d: str) -> DataFrame:
    """The dearest order of each customer without a pending one, with a prompt for it."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    x = cases.reserve(o, o.filter("o_orderstatus = 'P'"), "o_custkey", "o_totalprice", "o_orderkey")
    template = F.when(F.col("o_orderstatus") == "F", "edit {what} of {who}").otherwise("replace {what}, keep {who}")
    return x.select("o_custkey", "o_orderkey", P.rendered(template, {"what": F.col("o_orderpriority"), "who": F.col("o_custkey")}).alias("prompt"))


RESERVE_SQL = """
SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'edit ' || o_orderpriority || ' of ' || o_custkey ELSE 'replace ' || o_orderpriority || ', keep ' || o_custkey END AS prompt FROM orders
WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1
"""


def path_states(spark: SparkSession, d: str) -> DataFrame:
    """States of page addresses, some of them readable, volatile or mapped to another host."""
    k = F.col("page_id")
    mapped = F.when(F.contains("url", F.lit(".example.")), F.replace("url", F.lit(".example."), F.lit(".kept.")))
    x = table(spark, d, "pages").select(P.path_state(F.col("url"), k % 3 == 0, F.contains("url", F.lit("?")), mapped, k % 5 == 0).alias("s"))
    return x.groupBy("s.state").agg(F.count("*").alias("n"), F.sum(F.length("s.path")).alias("chars"), F.count_if(F.contains("s.path", F.lit(".kept."))).alias("moved"))


STATES_SQL = """
WITH x AS (SELECT url, coalesce(page_id % 3 = 0, false) AS r, coalesce(contains(url, '?'), false) AS v, CASE WHEN contains(url, '.example.') THEN replace(url, '.example.', '.kept.') END AS m, coalesce(page_id % 5 = 0, false) AS mr FROM pages),
y AS (SELECT CASE WHEN coalesce(url, '') = '' THEN ['missing', NULL] WHEN r AND NOT v THEN ['readable_persistent', url] WHEN m IS NOT NULL AND mr THEN ['readable_persistent', m] WHEN r THEN ['readable_volatile', url] WHEN m IS NOT NULL THEN ['mapped_but_unverified', m] ELSE ['missing', NULL] END AS s FROM x)
SELECT s[1] AS state, count(*) AS n, sum(length(s[2]))::BIGINT AS chars, count(*) FILTER (contains(s[2], '.kept.')) AS moved FROM y GROUP BY 1
"""


def fixed_subset(spark: SparkSession, d: str) -> DataFrame:
    """Faults of the lines of finished orders, whose flags R and A are the two sides."""
    wanted = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return gates.expect(cases.subset_faults(table(spark, d, "lineitem"), wanted, "l_orderkey", "l_returnflag", ("R", "A"), F.col("l_discount") > 0.09))


SUBSET_SQL = """
WITH w AS (SELECT DISTINCT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F'), k AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM w)),
s AS (SELECT l_orderkey, count(DISTINCT CASE WHEN l_returnflag IN ('R', 'A') THEN l_returnflag END) AS sides FROM k GROUP BY 1)
SELECT 'repeated' AS expectation, (SELECT count(*) FROM (SELECT 1 FROM k GROUP BY l_orderkey, l_returnflag HAVING count(*) > 1)) AS violations UNION ALL SELECT 'missing', (SELECT count(*) FROM w ANTI JOIN s USING (l_orderkey))
UNION ALL SELECT 'incomplete', (SELECT count(*) FROM s WHERE sides < 2) UNION ALL SELECT 'leaking', (SELECT count(*) FROM k WHERE l_discount > 0.09)
"""


def editable_parts(spark: SparkSession, d: str) -> DataFrame:
    """Operations of each part: the brands of its type with more than a few parts, weighted; promotional parts have none."""
    p = table(spark, d, "part")
    rules = p.filter("p_type <> 'PROMO'").groupBy("p_type", F.col("p_brand").alias("operation")).agg(((F.count("*") % 10 + 1) / 10).alias("weight"))
    x = cases.editable(p.withColumn("quality", F.col("p_size") / 100), rules, "p_partkey", "p_type", "quality", F.col("p_size") < 5)
    return x.select("p_partkey", F.size("operations").alias("operations"), F.size(F.filter("operations", lambda o: o["status"] == "review")).alias("for_review"), F.round("total", 3).alias("total"))


EDITABLE_SQL = """
WITH r AS (SELECT p_type, p_brand AS operation, (count(*) % 10 + 1) / 10 AS weight FROM part WHERE p_type <> 'PROMO' GROUP BY ALL)
SELECT p_partkey, count(operation)::INT AS operations, (CASE WHEN any_value(p_size) < 5 THEN count(operation) ELSE 0 END)::INT AS for_review, round(coalesce(sum(round(p_size / 100 * weight, 6)), 0), 3) AS total FROM part LEFT JOIN r USING (p_type) GROUP BY 1
"""


def offender_examples(spark: SparkSession, d: str) -> DataFrame:
    """Documents that fail a check, counted by reason with the ids of the first five."""
    reason = gates.first_reason([("no_text", F.coalesce(F.length("text"), F.lit(0)) == 0), ("short", F.col("n_chars") < 200), ("long", F.col("n_chars") > 20000), ("no_source", F.col("source").isNull())])
    x = cases.offenders(table(spark, d, "documents").select("doc_id", reason.alias("reason")), "reason", "doc_id", 5)
    return x.select("reason", "n", F.array_join(F.transform("examples", lambda i: i.cast("string")), ",").alias("examples"))


OFFENDER_SQL = """
WITH x AS (SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 'no_text' WHEN n_chars < 200 THEN 'short' WHEN n_chars > 20000 THEN 'long' WHEN source IS NULL THEN 'no_source' END AS reason FROM documents)
SELECT reason, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id)[1:5], ',') AS examples FROM x WHERE reason IS NOT NULL GROUP BY 1
"""


def annotation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Annotated responses made of lines, by the faults found in them."""
    k, q = F.col("l_partkey") % 6, F.col("l_quantity").cast("int")
    kind = F.when(k == 1, "No Such Kind").otherwise(F.lit(ARTIFACTS[0]))
    box = F.concat(F.lit("<bbox>["), F.concat_ws(", ", (q * 10).cast("string"), F.lit("10"), F.lit("300"), F.lit("900")), F.lit("]</bbox>"))
    span = F.concat(F.lit("<t>[1.5, "), (F.col("l_linenumber") + 0.5).cast("string"), F.lit("]</t>"))
    answer = F.when(k == 2, "").otherwise(F.concat(F.lit("<answer> "), F.when(k == 3, "Real").otherwise("FAKE"), F.lit(" </answer>")))
    text = F.concat(F.lit("<type> "), kind, F.lit(" </type> in "), span, F.lit(" at "), box, answer)
    faults = P.annotation_faults(text, F.lit("fake"), F.lit(0.0), F.when(k != 4, 5.0), ARTIFACTS)
    return table(spark, d, "lineitem").select(F.array_join(faults, ",").alias("faults")).groupBy("faults").agg(F.count("*").alias("n"))


AUDIT_SQL = """
WITH x AS (SELECT l_partkey % 6 AS k, l_quantity AS q, l_linenumber AS l FROM lineitem)
SELECT concat_ws(',', CASE WHEN k = 2 THEN 'missing_answer' WHEN k = 3 THEN 'answer_gt_mismatch' END, CASE WHEN q * 10 >= 300 THEN 'invalid_bbox' END, CASE WHEN k = 1 THEN 'invalid_artifact_type' END,
  CASE WHEN k = 4 OR l + 0.5::DOUBLE < 1.5 OR l + 0.5::DOUBLE > 5.000001::DOUBLE THEN 'invalid_time_interval' END) AS faults, count(*) AS n FROM x GROUP BY 1
"""

#: Words of part names as rules: label, any of these, none of those.
VOTES = [("tool", ["bolt", "rod", "anvil"], ["old"]), ("cool", ["cold", "blue"], []), ("tool", ["gear"], ["small", "large"]), ("fresh", ["new"], ["ring"])]


def part_votes(spark: SparkSession, d: str) -> DataFrame:
    """Labels that the names of parts vote for."""
    return table(spark, d, "part").groupBy(F.array_join(P.label_votes(F.col("p_name"), VOTES), ",").alias("votes")).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


VOTES_SQL = """
WITH x AS (SELECT p_partkey, lower(p_name) AS s FROM part),
y AS (SELECT *, (contains(s, 'bolt') OR contains(s, 'rod') OR contains(s, 'anvil')) AND NOT contains(s, 'old') AS a, contains(s, 'cold') OR contains(s, 'blue') AS c, contains(s, 'gear') AND NOT contains(s, 'small') AND NOT contains(s, 'large') AS b, contains(s, 'new') AND NOT contains(s, 'ring') AS f FROM x)
SELECT concat_ws(',', CASE WHEN a THEN 'tool' END, CASE WHEN c THEN 'cool' END, CASE WHEN b AND NOT a THEN 'tool' END, CASE WHEN f THEN 'fresh' END) AS votes, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM y GROUP BY 1
"""


def record_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of events from their JSON, their own columns and a default, and the mean of two shares."""
    k = P.first_path(F.col("props"), ["$.a.b", "$.k"])
    own = P.kept_entries(F.create_map(F.lit("type"), F.col("event_type"), F.lit("blank"), F.lit(" "), F.lit("other"), F.lit("x")), ["type", "blank"])
    ref = P.merged(["k", "name"], {"k": F.when(k.cast("int") > 50, k)}, {"name": F.when(F.col("user_id") % 2 == 0, "base")}, {"k": F.lit("0"), "name": F.col("event_type")})
    x = table(spark, d, "events").select("event_type", P.fraction(k).alias("f"), F.size(own).alias("entries"), ref.alias("r"), P.pair_score(F.col("user_id") % 10, F.lit(4)).alias("score"))
    return x.groupBy("event_type", "r.name").agg(F.round(F.sum("f"), 4).alias("shares"), F.sum("entries").alias("entries"), F.sum(F.col("r.k").cast("long")).alias("ks"), F.round(F.sum("score"), 3).alias("scores"))


FIELDS_SQL = """
WITH x AS (SELECT event_type, user_id, nullif(json_extract_string(props, '$.k'), '') AS k FROM events)
SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'base' ELSE event_type END AS name, round(sum(CASE WHEN k::DOUBLE > 1 THEN k::DOUBLE / 100 ELSE k::DOUBLE END), 4) AS shares, count(*) AS entries,
  sum(CASE WHEN k::INT > 50 THEN k::INT ELSE 0 END)::BIGINT AS ks, round(sum(round(sqrt(user_id % 10 * 4), 6)), 3) AS scores FROM x GROUP BY ALL
"""


def swapped_records(spark: SparkSession, d: str) -> DataFrame:
    """Choices with their sides exchanged, and labels under a fixed exchange of the vocabulary."""
    side = F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("B")
    text = F.concat(F.lit("Clip A and clip B in ABBA: "), side, F.lit(". A"))
    names = ["left", "right", "up", "down"]
    turned = P.permuted(F.array(F.element_at(F.array(*map(F.lit, names)), (F.col("o_custkey") % 4 + 1).cast("int")), F.lit("up"), F.lit("other")), {"left": "right", "right": "left", "up": "down", "down": "up"}, names)
    return table(spark, d, "orders").groupBy(P.swapped_choice(text).alias("text"), F.array_join(turned, ",").alias("labels")).agg(F.count("*").alias("n"))


SWAPPED_SQL = """
SELECT 'Clip B and clip A in ABBA: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'B' ELSE 'A' END || '. B' AS text, CASE o_custkey % 4 WHEN 0 THEN 'right,down' WHEN 1 THEN 'left,down' WHEN 2 THEN 'down' ELSE 'up,down' END AS labels, count(*) AS n FROM orders GROUP BY ALL
"""


def readiness_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The readiness gate for each priority: orders are questions, their lines sampled answers, flag R the right one, A another, N no valid one.

    A question is complete if it has as many answers as its last one's number; rewards are 1 for the right answer, 0 for others."""
    flag = lambda f: F.count_if(F.col("l_returnflag").isin(*f))
    each = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        flag("RA").alias("valid"), flag("R").alias("right"), flag("A").alias("wrong"), F.count("*").alias("all"), F.max("l_linenumber").alias("last"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(each, "o_orderkey", "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    m = o.groupBy("o_orderpriority").agg(
        share(F.col("valid").isNotNull()).alias("coverage"), share(F.col("all") == F.col("last")).alias("complete_rate"), share(F.col("valid") > 0).alias("format_pass_at_k"), share(F.col("right") > 0).alias("correct_pass_at_k"),
        share((F.col("right") > 0) & (F.col("wrong") > 0)).alias("both_answers_rate"), share((F.col("right") > 0) & (F.col("right") < F.col("all"))).alias("reward_variance_rate"))
    return gates.verdict(m, "readiness").select("o_orderpriority", F.array_join("failed", ",").alias("failed"), "verdict")


READY_SQL = """
WITH e AS (SELECT l_orderkey AS o_orderkey, count(*) FILTER (l_returnflag IN ('R', 'A')) AS v, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS w, count(*) AS n, max(l_linenumber) AS z FROM lineitem GROUP BY 1),
m AS (SELECT o_orderpriority, avg((v IS NOT NULL)::INT) AS c, avg(coalesce(v > 0, false)::INT) AS f, avg(coalesce(r > 0, false)::INT) AS p, avg(coalesce(r > 0 AND w > 0, false)::INT) AS b, avg(coalesce(n = z, false)::INT) AS k, avg(coalesce(r > 0 AND r < n, false)::INT) AS u FROM orders LEFT JOIN e USING (o_orderkey) GROUP BY 1),
x AS (SELECT *, concat_ws(',', CASE WHEN c < 0.99 THEN 'coverage' END, CASE WHEN k < 1 THEN 'expected_samples' END, CASE WHEN f < 0.9 THEN 'format_exploration' END, CASE WHEN p < 0.5 THEN 'correct_exploration' END, CASE WHEN b < 0.1 THEN 'both_answers' END, CASE WHEN u < 0.2 THEN 'reward_varies' END) AS failed FROM m)
SELECT o_orderpriority, failed, CASE WHEN failed = '' THEN 'rl_ready' WHEN c >= 0.99 AND b > 0 THEN 'borderline' ELSE 'not_ready' END AS verdict FROM x
"""

QUERIES = {
    "prompt_lines": (prompt_lines, LINES_SQL), "clip_plans": (clip_plans, CLIP_SQL), "frames_zero_filled": (frames_zero_filled, ZERO_SQL), "frames_nearest": (frames_nearest, NEAREST_SQL),
    "donor_search": (donor_search, DONOR_SQL), "pending_orders": (pending_orders, PENDING_SQL), "group_split": (group_split, GROUP_SPLIT_SQL), "matched_pairs": (matched_pairs, MATCHED_SQL),
    "subject_draw": (subject_draw, SUBJECT_SQL), "mask_policies": (mask_policies, MASK_SQL), "reserve_plan": (reserve_plan, RESERVE_SQL), "path_states": (path_states, STATES_SQL),
    "fixed_subset": (fixed_subset, SUBSET_SQL), "editable_parts": (editable_parts, EDITABLE_SQL), "offender_examples": (offender_examples, OFFENDER_SQL), "annotation_audit": (annotation_audit, AUDIT_SQL),
    "part_votes": (part_votes, VOTES_SQL), "record_fields": (record_fields, FIELDS_SQL), "swapped_records": (swapped_records, SWAPPED_SQL), "readiness_verdicts": (readiness_verdicts, READY_SQL),
}
