"""Queries of responses, rewards, pair metrics and named gates over the driver tables, each with its SQL.

Responses are put together from order lines, so that the SQL can tell from the lines what the parsers must find in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import responses
from ..operators import gates, metrics, pairs, sampling
from ..session import table


def r6(c: str) -> Column:
    return F.round(c, 6).alias(c)


KINDS = ("Texture Flicker", "malformed text", "Face Identity Drift", "Unheard Kind")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, response, truth): a block for each line; finished orders answer Fake, open ones Real, others neither."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % 4 + 1).cast("int"))
    t0 = F.col("l_linenumber") % 2
    t1 = t0 + F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    x2, y2 = F.when(F.col("l_quantity") > 25, 500).otherwise(50), F.when(F.col("l_discount") > 0.08, 1001).otherwise(900)
    plain = F.format_string("<t>[%d, %d]</t> at <bbox>[100,10,%d,%d]</bbox>", t0, t1, x2, y2)
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", plain.alias("plain"), F.concat(F.lit("<type>"), kind, F.lit("</type> in "), plain).alias("typed"))
    x = lines.join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    x = x.groupBy("o_orderkey", "o_orderstatus", "o_orderpriority").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(F.col("o_orderstatus") == "F", F.col("typed")).otherwise(F.col("plain")).alias("b")))).alias("bs"))
    said = F.when(F.col("o_orderstatus") == "F", "Fake").when(F.col("o_orderstatus") == "O", " real ").otherwise("unsure")
    tail = F.when(F.col("o_orderkey") % 5 == 0, " done").otherwise("")
    text = F.concat(F.lit("<think>looked "), F.array_join(F.transform("bs", lambda b: b["b"]), " and "), F.lit("</think>\n<answer>"), said, F.lit("</answer>"), tail)
    first = F.substring("o_orderpriority", 1, 1)
    truth = F.when(first.isin("1", "2"), "generated").when(first == "3", " Genuine").when(first == "4", "<answer>Real</answer>").otherwise("who knows")
    return x.select("o_orderkey", text.alias("response"), truth.alias("truth"))


def reward_variants(spark: SparkSession, d: str) -> DataFrame:
    """All reward variants and the evidence counts of a response for each order, 1.5 seconds long."""
    x = _tagged(spark, d).select("o_orderkey", "response", responses.truth(F.col("truth")).alias("true"), responses.answer(F.col("response")).alias("predicted"))
    x = x.withColumn("e", responses.evidence(F.col("response"), F.col("predicted"), F.lit(1.5)))
    scores = responses.rewards(F.col("response"), F.col("true"), F.lit(1.5), F.col("predicted"), F.col("e"))
    return x.select("o_orderkey", "true", "predicted", *[F.col(f"e.{c}").cast("long").alias(c) for c in ("raw", "strict", "duplicate", "invalid", "bad_box", "bad_time", "bad_type")], *[F.round(s, 6).alias(n) for n, s in scores.items()])


REWARD_SQL = """
WITH l AS (
  SELECT o_orderkey, o_orderstatus AS st, o_orderpriority[1] AS pr, CASE WHEN o_orderstatus = 'F' THEN l_partkey % 4 ELSE -1 END AS kind, l_linenumber % 2 AS t0,
    l_linenumber % 2 + CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS t1, NOT (l_quantity > 25 AND NOT l_discount > 0.08) AS bb FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), f AS (SELECT *, NOT (t1 >= t0 AND t1 <= 1.55) AS bt, kind = 3 AS bk FROM l
), s AS (
  SELECT o_orderkey, st, pr, count(*) AS lines, CASE WHEN st IN ('F', 'O') THEN count(*) ELSE 0 END AS raw, CASE WHEN st IN ('F', 'O') THEN count(*) FILTER (NOT bb AND NOT bt AND NOT bk) ELSE 0 END AS valid,
    CASE WHEN st IN ('F', 'O') THEN count(DISTINCT CASE WHEN NOT bb AND NOT bt AND NOT bk THEN kind || ':' || t0 || ':' || t1 END) ELSE 0 END AS strict,
    CASE WHEN st IN ('F', 'O') THEN count(*) FILTER (bb) ELSE 0 END AS bad_box, CASE WHEN st IN ('F', 'O') THEN count(*) FILTER (bt) ELSE 0 END AS bad_time, CASE WHEN st IN ('F', 'O') THEN count(*) FILTER (bk) ELSE 0 END AS bad_type
  FROM f GROUP BY o_orderkey, st, pr
), p AS (
  SELECT *, CASE WHEN pr IN ('1', '2') THEN 'Fake' WHEN pr IN ('3', '4') THEN 'Real' END AS "true", CASE st WHEN 'F' THEN 'Fake' WHEN 'O' THEN 'Real' END AS predicted, st IN ('F', 'O') AND o_orderkey % 5 != 0 AS good,
    least(ln(1.0::DOUBLE + raw), ln(4.0::DOUBLE)) AS ri, least(ln(1.0::DOUBLE + strict), ln(4.0::DOUBLE)) AS si, least(ln(1.0::DOUBLE + lines), ln(4.0::DOUBLE)) AS li FROM s
), q AS (
  SELECT *, coalesce("true" = predicted, false) AS ok, coalesce("true" = 'Real' AND predicted = 'Fake', false) AS wf FROM p
), a AS (SELECT *, CASE WHEN ok THEN 1.0::DOUBLE WHEN wf THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END AS asym, CASE WHEN good THEN ri ELSE 0.0::DOUBLE END AS looked FROM q)
SELECT o_orderkey, "true", predicted, raw, strict, valid - strict AS duplicate, raw - valid AS invalid, bad_box, bad_time, bad_type,
  round(0.8 * asym + 0.2 * looked, 6) AS paper_asymmetric_inspection, round(0.8 * ok::INT + 0.2 * looked, 6) AS symmetric_zero_inspection, round(0.8 * asym + 0.2 * good::INT, 6) AS asymmetric_outer_format,
  asym AS asymmetric_answer_only, round(0.8 * asym + 0.2 * CASE WHEN good AND ok THEN si ELSE 0 END, 6) AS strict_unique_inspection, round(looked, 6) AS inspection_only_hackable,
  round(CASE WHEN wf THEN -0.2 WHEN ok AND "true" = 'Fake' THEN 0.8 * li ELSE 0 END, 6) AS official_repository_bug FROM a
"""

WRITTEN = ("pan-left", "TILT_UP", "static", "warp", "zoom-in", " Roll-cw ")


def label_set_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Label lists in a tag (every seventh order without it) against labels of the lines that weren't returned."""
    name = lambda c: F.element_at(F.array(*map(F.lit, WRITTEN)), (F.col(c) % 6 + 1).cast("int"))
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", name("l_partkey").alias("p")))).alias("ps"),
        F.collect_list(F.when(F.col("l_returnflag") != "R", name("l_suppkey"))).alias("ts"),
    )
    body = F.concat(F.lit("["), F.array_join(F.transform("ps", lambda p: F.concat(F.lit('"'), p["p"], F.lit('"'))), ", "), F.lit("]"))
    text = F.when(F.col("l_orderkey") % 7 == 0, body).otherwise(F.concat(F.lit("so <camera_motion> "), body, F.lit("</camera_motion>")))
    x = x.select("l_orderkey", responses.label_response(text).alias("r"), responses.known_labels(F.col("ts")).alias("true"))
    return x.select("l_orderkey", F.array_join("r.labels", " ").alias("labels"), F.array_join("r.unknown", " ").alias("unknown"), "r.duplicate", *[F.round(c, 6).alias(n) for n, c in responses.label_rewards(F.col("r"), F.col("true")).items()])


LABEL_SQL = """
WITH w AS (SELECT l_orderkey, list(l_partkey % 6) AS p, list_distinct(list(l_suppkey % 6) FILTER (l_returnflag != 'R')) AS t FROM lineitem GROUP BY l_orderkey),
v AS (SELECT l_orderkey, l_orderkey % 7 != 0 AS valid, CASE WHEN l_orderkey % 7 != 0 THEN p ELSE [] END AS p, coalesce(t, []) AS t FROM w),
k AS (SELECT *, list_filter([0, 1, 4, 5], lambda x: list_contains(p, x)) AS pk, list_filter([0, 1, 4, 5], lambda x: list_contains(t, x)) AS tk, list_contains(p, 3) AS u, len(list_distinct(p)) < len(p) AS duplicate FROM v),
m AS (SELECT *, 2 * len(list_filter(pk, lambda x: list_contains(tk, x))) AS hit, len(pk) + u::INT + len(tk) AS total, valid AND NOT u AND NOT duplicate AS clean FROM k)
SELECT l_orderkey, concat_ws(' ', CASE WHEN list_contains(pk, 0) THEN 'pan-left' END, CASE WHEN list_contains(pk, 1) THEN 'tilt-up' END, CASE WHEN list_contains(pk, 5) THEN 'roll-CW' END, CASE WHEN list_contains(pk, 4) THEN 'zoom-in' END) AS labels,
  CASE WHEN u THEN 'warp' ELSE '' END AS unknown, duplicate, round(CASE WHEN NOT valid THEN 0 WHEN total = 0 THEN 1 ELSE hit / total::DOUBLE END, 6) AS set_f1, (clean AND pk = tk)::INT::DOUBLE AS exact, clean::INT::DOUBLE AS format FROM m
"""


def balanced_braces(spark: SparkSession, d: str) -> DataFrame:
    """The JSON object within each event's text, found by its braces."""
    e = table(spark, d, "events").select("event_type", "props", F.concat(F.lit("so } it is: "), "props", F.lit(" or {not}")).alias("t"))
    x = e.withColumn("found", responses.first_balanced(F.col("t")))
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("found") == F.col("props")).alias("whole"), F.sum(F.length("found")).alias("chars"))


BRACES_SQL = "SELECT event_type, count(*) AS n, count(props) AS whole, sum(length(props))::BIGINT AS chars FROM events GROUP BY event_type"


def choice_metrics(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("?"), F.lit(None)), (F.col("n_chars") % 4 + 1).cast("int")).alias("chosen"))
    x = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "A").otherwise("B").alias("gold")).join(docs, "doc_id")
    return pairs.choice_metrics(x, ["lang"], "gold", "chosen").select("lang", "n", "a_as_a", "a_as_b", "b_as_a", "b_as_b", "unknown", *map(r6, ("valid_rate", "accuracy", "chose_a", "accuracy_a", "accuracy_b")))


CHOICE_SQL = """
WITH x AS (SELECT lang, quality = 1 AS a, n_chars % 4 AS c FROM labels JOIN documents USING (doc_id)),
c AS (SELECT lang, count(*) AS n, count(*) FILTER (a AND c = 0) AS a_as_a, count(*) FILTER (a AND c = 1) AS a_as_b, count(*) FILTER (NOT a AND c = 0) AS b_as_a, count(*) FILTER (NOT a AND c = 1) AS b_as_b, count(*) FILTER (c > 1) AS unknown, count(*) FILTER (a) AS ga FROM x GROUP BY lang)
SELECT lang, n, a_as_a, a_as_b, b_as_a, b_as_b, unknown, round((n - unknown) / n::DOUBLE, 6) AS valid_rate, round((a_as_a + b_as_b) / n::DOUBLE, 6) AS accuracy,
  round(coalesce((a_as_a + b_as_a) / nullif(n - unknown, 0)::DOUBLE, 0), 6) AS chose_a, round(coalesce(a_as_a / nullif(ga, 0)::DOUBLE, 0), 6) AS accuracy_a, round(coalesce(b_as_b / nullif(n - ga, 0)::DOUBLE, 0), 6) AS accuracy_b FROM c
"""


def swap_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring documents as the two orders of a case; a letter by length, which stands for real or fake by order."""
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 2).alias("case"), F.when(F.col("doc_id") % 2 == 0, "real_first").otherwise("fake_first").alias("order"), (F.floor(F.col("doc_id") / 2) % 3).alias("third"), F.when(F.col("n_chars") % 3 == 0, "A").when(F.col("n_chars") % 3 == 1, "B").alias("chosen"))
    meant = F.when(F.col("chosen").isNotNull(), F.when((F.col("chosen") == "A") == (F.col("order") == "real_first"), "real").otherwise("fake"))
    x = docs.withColumn("meant", meant).withColumn("right", F.col("meant") == "fake")
    return pairs.swap_metrics(x, ["third"], "case", "order", ("real_first", "fake_first"), "chosen", "meant", "right").select("third", "cases", *map(r6, ("consistent", "both_right", "flipped")))


SWAP_SQL = """
WITH x AS (SELECT doc_id // 2 AS c, doc_id % 2 AS o, n_chars % 3 AS l FROM documents), y AS (SELECT c, o, l, CASE WHEN l = 2 THEN NULL WHEN (l = 0) = (o = 0) THEN 'real' ELSE 'fake' END AS m FROM x),
j AS (SELECT a.c % 3 AS third, a.m AS am, b.m AS bm, a.l AS al, b.l AS bl FROM y a JOIN y b ON a.c = b.c AND a.o = 0 AND b.o = 1)
SELECT third, count(*) AS cases, round(avg(coalesce(am = bm, false)::INT::DOUBLE), 6) AS consistent, round(avg(coalesce(am = 'fake' AND bm = 'fake', false)::INT::DOUBLE), 6) AS both_right,
  round(avg((al < 2 AND bl < 2 AND al != bl)::INT::DOUBLE), 6) AS flipped FROM j GROUP BY third
"""


def paired_questions(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring labelled documents of one language as a pair of questions."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    x = table(spark, d, "labels").join(docs, "doc_id").withColumn("pair", F.floor(F.col("doc_id") / 4))
    return pairs.paired_accuracy(x, ["lang"], "pair", (F.col("n_chars") >= 500) == (F.col("quality") == 1)).select("lang", "pairs", r6("paired_accuracy"))


PAIRED_SQL = """
WITH x AS (SELECT lang, doc_id // 4 AS pair, count(*) AS n, bool_and((n_chars >= 500) = (quality = 1)) AS ok FROM labels JOIN documents USING (doc_id) GROUP BY ALL)
SELECT lang, count(*) AS pairs, round(avg(ok::INT::DOUBLE), 6) AS paired_accuracy FROM x WHERE n = 2 GROUP BY lang
"""


def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", (F.col("n_chars") % 5 + 1).cast("int").alias("score"))
    return pairs.score_stats(docs, ["source"], "score").select("source", "n", "n1", "n2", "n3", "n4", "n5", r6("mean"), "median", r6("good"), r6("bad"))


JUDGE_SQL = """
WITH x AS (SELECT source, n_chars % 5 + 1 AS s FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (s = 1) AS n1, count(*) FILTER (s = 2) AS n2, count(*) FILTER (s = 3) AS n3, count(*) FILTER (s = 4) AS n4, count(*) FILTER (s = 5) AS n5,
  round(avg(s), 6) AS mean, median(s)::DOUBLE AS median, round(avg((s >= 4)::INT::DOUBLE), 6) AS good, round(avg((s <= 2)::INT::DOUBLE), 6) AS bad FROM x GROUP BY source
"""


def control_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Longest turn of the user against the assistant's and the system's, conversation by conversation."""
    c = table(spark, d, "conversations").select("conv_id", "role", F.length("text").alias("score"))
    return pairs.control_deltas(c, "conv_id", "role", "score", "user", ["assistant", "system"]).select("control", "pairs", *[F.round(x, 4).alias(x) for x in ("original_mean", "control_mean", "mean_delta", "above", "equal", "below")])


DELTA_SQL = """
WITH m AS (SELECT conv_id, role, max(length(text)) AS s FROM conversations GROUP BY ALL), j AS (SELECT c.role AS control, o.s AS o, c.s AS c FROM m o JOIN m c USING (conv_id) WHERE o.role = 'user' AND c.role IN ('assistant', 'system') AND o.s IS NOT NULL AND c.s IS NOT NULL)
SELECT control, count(*) AS pairs, round(avg(o), 4) AS original_mean, round(avg(c), 4) AS control_mean, round(avg(o - c), 4) AS mean_delta, round(avg((o > c)::INT::DOUBLE), 4) AS above, round(avg((o = c)::INT::DOUBLE), 4) AS equal, round(avg((o < c)::INT::DOUBLE), 4) AS below FROM j GROUP BY control
"""


def _rule(spark: SparkSession, d: str, least: int) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return metrics.confusion(table(spark, d, "labels").join(docs, "doc_id"), ["lang"], F.col("quality") == 1, F.col("n_chars") >= least)


def metric_deltas(spark: SparkSession, d: str) -> DataFrame:
    """What a threshold of 500 characters gains over one of 1000, language by language."""
    x = pairs.metric_deltas(_rule(spark, d, 500), _rule(spark, d, 1000), ["lang"], ["accuracy", "recall"])
    return x.select("lang", *map(r6, ("accuracy_method", "recall_method", "accuracy_delta", "recall_delta")))


MDELTA_SQL = """
WITH x AS (SELECT lang, quality = 1 AS g, n_chars >= 500 AS a, n_chars >= 1000 AS b FROM labels JOIN documents USING (doc_id)),
m AS (SELECT lang, avg((g = a)::INT::DOUBLE) AS aa, avg((g = b)::INT::DOUBLE) AS ab, coalesce(count(*) FILTER (g AND a) / nullif(count(*) FILTER (g), 0)::DOUBLE, 0) AS ra, coalesce(count(*) FILTER (g AND b) / nullif(count(*) FILTER (g), 0)::DOUBLE, 0) AS rb FROM x GROUP BY lang)
SELECT lang, round(aa, 6) AS accuracy_method, round(ra, 6) AS recall_method, round(aa - ab, 6) AS accuracy_delta, round(ra - rb, 6) AS recall_delta FROM m
"""


def ids_in_all(spark: SparkSession, d: str) -> DataFrame:
    names = {"documents": "doc_id", "labels": "doc_id", "pages": "page_id", "embeddings": "vec_id"}
    return pairs.in_all([table(spark, d, t).select(F.col(c).alias("id")) for t, c in names.items()], "id")


ALL_SQL = "SELECT doc_id AS id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT page_id FROM pages INTERSECT SELECT vec_id FROM embeddings"


def _label_rows(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") % 6).cast("string").alias("label")).agg(F.bool_or(F.col("l_returnflag") != "R").alias("gold"), F.bool_or(F.col("l_quantity") > 20).alias("pred"))
    return x.filter("gold OR pred")


def label_f1(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of each known label, and micro and macro ones of all."""
    each, overall, mean = pairs.label_metrics(_label_rows(spark, d), "label", "gold", "pred", F.col("label") != "3")
    long = each.select("label", F.col("support").cast("double").alias("support"), "precision", "recall", "f1")
    total = overall.select(F.lit("(all)").alias("label"), F.col("unknown_rate").alias("support"), F.col("micro_precision"), F.col("micro_recall"), F.col("micro_f1"))
    macro = mean.select(F.lit("(macro)").alias("label"), F.lit(0.0).alias("support"), F.lit(0.0), F.lit(0.0), "macro_f1")
    return long.union(total).union(macro).select("label", r6("support"), r6("precision"), r6("recall"), r6("f1"))


F1_SQL = """
WITH r AS (SELECT l_orderkey, (l_partkey % 6)::VARCHAR AS label, bool_or(l_returnflag != 'R') AS g, bool_or(l_quantity > 20) AS p FROM lineitem GROUP BY ALL), x AS (SELECT * FROM r WHERE g OR p),
e AS (SELECT label, count(*) FILTER (g) AS s, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p) AS pp FROM x WHERE label != '3' GROUP BY label),
f AS (SELECT label, s, coalesce(tp / nullif(pp, 0)::DOUBLE, 0) AS pr, coalesce(tp / nullif(s, 0)::DOUBLE, 0) AS rc FROM e), h AS (SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) AS f1 FROM f),
o AS (SELECT count(*) FILTER (g AND p) / nullif(count(*) FILTER (p), 0)::DOUBLE AS pr, count(*) FILTER (g AND p) / nullif(count(*) FILTER (g), 0)::DOUBLE AS rc, count(*) FILTER (p AND label = '3') / nullif(count(*) FILTER (p), 0)::DOUBLE AS u FROM x)
SELECT label, s::DOUBLE AS support, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1 FROM h
UNION ALL SELECT '(all)', round(u, 6), round(pr, 6), round(rc, 6), round(2 * pr * rc / (pr + rc), 6) FROM o UNION ALL SELECT '(macro)', 0, 0, 0, round(avg(f1), 6) FROM h WHERE s > 0
"""


def pair_choice_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate of choices and their consistency under swapping, with its own thresholds."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") % 10 < 5, "A").when(F.col("n_chars") % 10 < 9, "B").alias("chosen"), F.floor(F.col("doc_id") / 2).alias("case"), (F.col("doc_id") % 2).cast("string").alias("order"))
    x = docs.withColumns({"gold": F.lit("A"), "right": F.coalesce(F.col("chosen") == "A", F.lit(False))})
    c = pairs.choice_metrics(x, [], "gold", "chosen").select("accuracy", "chose_a", "valid_rate")
    s = pairs.swap_metrics(x, [], "case", "order", ("0", "1"), "chosen", "chosen", "right").select("consistent")
    checks = gates.NAMED["pair_choice"]
    made = [gates.gate(m, [x for x in checks if x[1] in m.columns]) for m in (c, s)]
    return made[0].unionByName(made[1]).select("check", F.round("value", 6).alias("value"), "op", "threshold", "passed")


PAIRGATE_SQL = """
WITH x AS (SELECT doc_id // 2 AS c, doc_id % 2 AS o, CASE WHEN n_chars % 10 < 5 THEN 'A' WHEN n_chars % 10 < 9 THEN 'B' END AS l FROM documents),
m AS (SELECT avg(coalesce(l = 'A', false)::INT::DOUBLE) AS acc, count(*) FILTER (l = 'A') / count(l)::DOUBLE AS a, count(l) / count(*)::DOUBLE AS v FROM x),
s AS (SELECT avg(coalesce(p.l = q.l, false)::INT::DOUBLE) AS k FROM x p JOIN x q ON p.c = q.c AND p.o = 0 AND q.o = 1)
SELECT 'pair_choice_accuracy' AS "check", round(acc, 6) AS value, '>=' AS op, 0.7::DOUBLE AS threshold, acc >= 0.7 AS passed FROM m UNION ALL SELECT 'swap_consistency', round(k, 6), '>=', 0.85, k >= 0.85 FROM s
UNION ALL SELECT 'chose_a_lower', round(a, 6), '>=', 0.45, a >= 0.45 FROM m UNION ALL SELECT 'chose_a_upper', round(a, 6), '<=', 0.55, a <= 0.55 FROM m UNION ALL SELECT 'choice_format_valid', round(v, 6), '>=', 0.95, v >= 0.95 FROM m
"""


def label_balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    """61 labelled documents: as many good as bad ones (the odd one is bad), from the sources in turn."""
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return sampling.label_balanced(x, "quality", ["source"], "lb", "doc_id", 61).select("quality", "source", "doc_id")


LABELBAL_SQL = """
WITH k AS (SELECT quality, source, doc_id, row_number() OVER (PARTITION BY quality, source ORDER BY sha256('lb:' || doc_id), doc_id) AS rn FROM labels JOIN documents USING (doc_id)),
l AS (SELECT quality, row_number() OVER (ORDER BY quality) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT quality FROM labels JOIN documents USING (doc_id))),
o AS (SELECT k.*, row_number() OVER (PARTITION BY k.quality ORDER BY rn, source) AS place, 61 // n + (i < 61 % n)::INT AS take FROM k JOIN l USING (quality))
SELECT quality, source, doc_id FROM o WHERE place <= take
"""


def quota_with_fill(spark: SparkSession, d: str) -> DataFrame:
    """150 documents, evenly from the sources; what small sources lack is filled from all others."""
    return sampling.quota_with_fill(table(spark, d, "documents").select("doc_id", "source"), ["source"], "qf", "doc_id", 150)


QUOTA_SQL = """
WITH g AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
k AS (SELECT doc_id, source, sha256('qf:' || doc_id) AS h, row_number() OVER (PARTITION BY source ORDER BY sha256('qf:' || doc_id), doc_id) AS rn FROM documents),
q AS (SELECT k.*, rn <= 150 // n + (i < 150 % n)::INT AS own FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
f AS (SELECT doc_id, source, row_number() OVER (ORDER BY h, doc_id) AS place FROM q WHERE NOT own)
SELECT doc_id, source FROM q WHERE own UNION ALL SELECT doc_id, source FROM f WHERE place <= 150 - (SELECT count(*) FROM q WHERE own)
"""


def earliest_passing(spark: SparkSession, d: str) -> DataFrame:
    """The first day on which an event type's mean reaches 50, and its days."""
    e = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"))
    return e.groupBy("event_type").agg(F.count("*").alias("days"), F.date_format(F.min(F.when(F.col("mean") >= 50, F.col("day"))), "yyyy-MM-dd").alias("first_day"))


EARLIEST_SQL = """
WITH e AS (SELECT event_type, ts::DATE AS day, avg(value) AS mean FROM events GROUP BY ALL)
SELECT event_type, count(*) AS days, (min(day) FILTER (mean >= 50))::VARCHAR AS first_day FROM e GROUP BY event_type
"""

QUERIES = {
    "reward_variants": (reward_variants, REWARD_SQL), "label_set_rewards": (label_set_rewards, LABEL_SQL), "balanced_braces": (balanced_braces, BRACES_SQL), "choice_metrics": (choice_metrics, CHOICE_SQL),
    "swap_metrics": (swap_metrics, SWAP_SQL), "paired_questions": (paired_questions, PAIRED_SQL), "judge_scores": (judge_scores, JUDGE_SQL), "control_deltas": (control_deltas, DELTA_SQL),
    "metric_deltas": (metric_deltas, MDELTA_SQL), "ids_in_all": (ids_in_all, ALL_SQL), "label_f1": (label_f1, F1_SQL), "pair_choice_gate": (pair_choice_gate, PAIRGATE_SQL),
    "label_balanced_sample": (label_balanced_sample, LABELBAL_SQL), "quota_with_fill": (quota_with_fill, QUOTA_SQL), "earliest_passing": (earliest_passing, EARLIEST_SQL),
}
