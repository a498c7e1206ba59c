import math

from pyspark.sql import functions as F

from millrace.functions import geom, text
from millrace.functions import responses as R


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_text(spark):
    c = F.col
    assert one(spark, text.first_value(c("a"), c("b")), a="", b="x") == "x"
    assert one(spark, text.first_number(c("a"), c("b"), low=0, high=1, otherwise=F.lit(0.5)), a="q", b="7") == 1.0
    assert one(spark, text.first_number(c("a"), low=0, high=1, otherwise=F.lit(0.5)), a="q") == 0.5
    assert one(spark, text.collapse(c("a"), 5), a="  a \n b  cdef") == "a b c"
    assert one(spark, text.enum_or_default(c("a"), ["real", "fake"], "none"), a=" REAL ") == "real"
    assert one(spark, text.tag(c("a"), "answer"), a="<ANSWER>x\ny</answer> <answer>z</answer>") == "x\ny"
    assert one(spark, text.only_tag(c("a"), "answer"), a="<answer>x</answer><answer>z</answer>") is None
    assert one(spark, text.number_list(c("a"), 4), a="1, 2,3.5 ,4") == [1, 2, 3.5, 4]
    assert one(spark, text.number_list(c("a"), 4), a="1,2,x,4") is None
    assert one(spark, text.label_list(c("a")), a='["a", "b"]') == ["a", "b"]
    assert one(spark, text.label_list(c("a")), a='["a", 3]') is None
    assert one(spark, text.distinct_strings(F.array(F.lit(" A"), F.lit("a"), F.lit(""), F.lit("b")), 5, 80)) == ["A", "b"]
    assert one(spark, text.remap_prefix(c("a"), [("/x", "/y")]), a="/x/b") == "/y/b"
    assert one(spark, text.remap_prefix(c("a"), [("/x", "/y")]), a="/xb") == "/xb"


def test_boxes(spark):
    box = lambda *v: geom.box(*map(F.lit, v))
    assert one(spark, geom.iou(box(0, 0, 10, 10), box(5, 0, 15, 10))) == 1 / 3
    assert one(spark, geom.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert one(spark, geom.containment(box(0, 0, 10, 10), box(0, 0, 100, 100))) == 1
    assert one(spark, geom.box(F.lit(9), F.lit(2000), F.lit(1), F.lit(-4))).asDict() == {"x1": 1, "y1": 0, "x2": 9, "y2": 1000}
    assert one(spark, geom.far_corner(box(0, 0, 100, 100))).asDict() == {"x1": 900, "y1": 0, "x2": 1000, "y2": 100}
    assert one(spark, geom.to_thousand(F.lit(12.0), F.lit(640.0))) == 18.75


def test_reward_of_tagged_responses(spark):
    from millrace.functions import responses

    block = "<type>texture flicker</type> in <t>[0.5, 1]</t> at <bbox>[1, 2, 30, 40]</bbox>"
    late = "<type>Malformed Text</type> in <t>[0.5, 2.04]</t> at <bbox>[0, 0, 1000, 1000]</bbox>"
    wrong = "<type>blur</type> in <t>[1, 0.5]</t> at <bbox>[0, 0, 0, 0]</bbox>"
    cases = [(block, "Fake", "fake"), (wrong + wrong, "Fake", "fake"), (block + block + late, "Fake", "1"), ("x", "Real", "real"), (block, "Real", "fake"), (block, "Fake", "Real"), (block, "no", "real")]
    df = spark.createDataFrame([(i, f"<think>{b}</think><answer>{a}</answer>", t) for i, (b, a, t) in enumerate(cases)], "i int, r string, t string")
    df = df.select("i", "r", responses.truth(F.col("t")).alias("true"), responses.answer(F.col("r")).alias("p"))
    df = df.withColumn("e", responses.evidence(F.col("r"), F.col("p"), F.lit(2.0)))
    names = ("paper_asymmetric_inspection", "strict_unique_inspection", "asymmetric_answer_only")
    scores = responses.rewards(F.col("r"), F.col("true"), F.lit(2.0), F.col("p"), F.col("e"))
    rows = df.select("i", "e.*", *[scores[n].alias(n) for n in names]).orderBy("i").collect()
    assert [(r.raw, r.strict, r.duplicate, r.bad_type) for r in rows] == [(1, 1, 0, 0), (2, 0, 0, 2), (3, 2, 1, 0), (0, 0, 0, 0), (0, 0, 0, 0), (1, 1, 0, 0), (0, 0, 0, 0)]
    one_seen = 0.2 * math.log(2)
    assert [round(r.paper_asymmetric_inspection, 9) for r in rows] == [round(x, 9) for x in (0.8 + one_seen, 0.8 + 0.2 * math.log(3), 0.8 + 0.2 * math.log(4), 0.8, 0.0, -0.16 + one_seen, 0.0)]
    assert [round(r.strict_unique_inspection, 9) for r in rows] == [round(x, 9) for x in (0.8 + one_seen, 0.8, 0.8 + 0.2 * math.log(3), 0.8, 0.0, -0.16, 0.0)]
    assert [r.asymmetric_answer_only for r in rows] == [1.0, 1.0, 1.0, 1.0, 0.0, -0.2, 0.0]


def test_first_balanced_braces(spark):
    from millrace.functions import responses

    cases = {'a } {"x": "}{", "y": {"z": 1}} {2}': '{"x": "}{", "y": {"z": 1}}', r'{"q": "\"}"} tail': r'{"q": "\"}"}', "{ open": None, "none": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", responses.first_balanced(F.col("t")).alias("b"))
    assert {r.t: r.b for r in df.collect()} == cases


def test_label_responses_are_read_once(spark):
    rows = [('x <camera_motion>["Pan_Left", "warp", "static", "roll-cw"]</camera_motion>',), ('<camera_motion>["tilt-up", "TILT_UP"]</camera_motion>',), ('<camera_motion>["a", " "]</camera_motion>',), ("none",), (None,)]
    x = spark.createDataFrame(rows, "t string").select(R.label_response(F.col("t")).alias("r"), R.known_labels(F.array(F.lit("arc_CW"), F.lit(None), F.lit("pan-left"))).alias("true"))
    x = x.select("r.*", *[c.alias(n) for n, c in R.label_rewards(F.col("r"), F.col("true")).items()])
    got = [(r.valid, r.duplicate, r.labels, r.unknown, r.set_f1) for r in x.collect()]
    assert got == [(True, False, ["pan-left", "roll-CW"], ["warp"], 0.4), (True, True, ["tilt-up"], [], 0.0), (False, False, [], [], 0.0), (False, False, [], [], 0.0), (False, False, [], [], 0.0)]
    # The tag is searched and the list parsed a few times at most, not once for each known label and use.
    plan = spark.createDataFrame(rows, "t string").select(R.label_response(F.col("t")).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("from_json") + plan.count("from_json".upper()) <= 2


def test_evidence_is_read_once(spark):
    t = "<think>a <type>Texture Flicker</type> in <t>[0, 1]</t> at <bbox>[1,1,5,5]</bbox> b <type> texture flicker </type> in <t>[0,1]</t> at <bbox>[1, 1, 5, 5]</bbox> <t>[0,9]</t> at <bbox>[1,1]</bbox></think><answer>Fake</answer>"
    x = spark.createDataFrame([(t, "Fake"), (t, "Real"), (t, None), (None, "Fake")], "t string, p string")
    got = x.select(R.evidence(F.col("t"), F.col("p"), F.lit(1.5)).alias("e"))
    assert [tuple(r.e) for r in got.collect()] == [(2, 1, 1, 0, 0, 0, 0), (1, 0, 0, 1, 1, 1, 0), (0,) * 7, (0,) * 7]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 3  # thoughts, typed blocks and others
