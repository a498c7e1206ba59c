"""Tagged responses of a detector: answers, evidence blocks, label sets and the rewards made of them.

Everything is a Column of text in, a Column or struct out; a response that is null counts as empty.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of responses.
THINK = r"(?is)<think>(.*?)</think>"
ANSWER = r"(?is)<answer>\s*(Fake|Real)\s*</answer>"
WHOLE = r"(?is)\A\s*<think>.+?</think>\s*<answer>\s*(?:Fake|Real)\s*</answer>\s*\z"
FAKE_BLOCK = r"(?is)<type>\s*(.*?)\s*</type>\s*in\s*<t>\s*(.*?)\s*</t>\s*at\s*<bbox>\s*(.*?)\s*</bbox>"
REAL_BLOCK = r"(?is)<t>\s*(.*?)\s*</t>\s*at\s*<bbox>\s*(.*?)\s*</bbox>"
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"
LABELS_TAG = r"(?is)<camera_motion>\s*(.*?)\s*</camera_motion>"

# What truths are called.
FAKE_NAMES = ("1", "fake", "generated", "synthetic")
REAL_NAMES = ("0", "authentic", "genuine", "real")

# Kinds of artifact that a block may name.
ARTIFACTS = (
    "Hand Anatomy Error", "Limb Structure Error", "Body Proportion Error", "Face Identity Drift", "Facial Landmark Distortion",
    "Face Boundary Fusion", "Malformed Text", "Inconsistent Text Across Frames", "Logo / Symbol Distortion", "Object Deformation",
    "Object Identity Drift", "Object Part Inconsistency", "Boundary Fusion", "Contact Region Artifact", "Occlusion Error",
    "Texture Flicker", "Material Inconsistency", "Lighting / Shadow Inconsistency", "Entity Reappearance Change",
    "Cross-frame Identity Drift", "Object Category Shift", "Implausible Contact", "Motion Discontinuity", "Physical Interaction Error",
    "Known-person Factual Implausibility", "Non-realistic Event Premise", "Role / Context Contradiction", "Synthetic Rendering Cue",
    "Over-smoothed Generated Texture", "Stylized / CGI Rendering Inconsistency",
)

# Motion labels in their order.
MOTIONS = (
    "very-unsteady", "unsteady", "minimal-shaking", "no-shaking", "complex-motion", "minor-motion", "no-motion", "fast-speed",
    "regular-speed", "slow-speed", "dolly-in", "dolly-out", "truck-left", "truck-right", "pedestal-up", "pedestal-down", "pan-left",
    "pan-right", "tilt-up", "tilt-down", "roll-CW", "roll-CCW", "zoom-in", "zoom-out", "arc-CW", "arc-CCW", "side-tracking",
    "lead-tracking", "tail-tracking", "aerial-tracking", "arc-tracking", "pan-tracking", "tilt-tracking",
)
#: Labels that are neither known nor unknown.
LEFT_OUT = ("static",)

#: Seconds by which a span may pass the end, and what calling a real one fake costs.
SLACK, WRONGLY_FAKE = 0.05, -0.2
#: Names of the reward variants.
VARIANTS = ("paper_asymmetric_inspection", "symmetric_zero_inspection", "asymmetric_outer_format", "asymmetric_answer_only", "strict_unique_inspection", "inspection_only_hackable", "official_repository_bug")


def _every(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def _sole(found: Column) -> Column:
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once a row: a lambda binds it, where a column that is named twice may be computed twice."""
    return F.element_at(F.transform(F.array(value), f), 1)


def answer(text: Column) -> Column:
    """Fake or Real where exactly one answer tag says so, else null."""
    return F.initcap(F.lower(bound(_every(text, ANSWER, 1), _sole)))


def truth(value: Column) -> Column:
    """Fake or Real from a tagged answer or any of their names, else null."""
    plain = F.lower(F.trim(value))
    return F.coalesce(answer(value), F.when(plain.isin(*FAKE_NAMES), "Fake").when(plain.isin(*REAL_NAMES), "Real"))


def format_valid(text: Column) -> Column:
    """Is the whole response one thought and one answer."""
    return F.coalesce(text.rlike(WHOLE), F.lit(False))


def number_list(text: Column, n: int) -> Column:
    """[a, b, ...] of exactly ``n`` plain decimal numbers as an array, else null."""
    def read(text: Column) -> Column:
        parts = F.transform(F.split(F.substring(text, F.lit(2), F.length(text) - 2), ","), lambda x: F.trim(x))
        good = lambda p: text.rlike(r"(?s)^\[.*\]$") & (F.size(p) == n) & F.forall(p, lambda x: x.rlike(NUMBER))
        return bound(parts, lambda p: F.when(good(p), F.transform(p, lambda x: x.try_cast("double"))))

    return bound(F.trim(text), read)


def evidence(text: Column, predicted: Column, seconds: Column) -> Column:
    """Struct of raw, strict (valid and different), duplicate, invalid, bad_box, bad_time and bad_type blocks of the only thought.

    A fake answer needs typed blocks; for a real one the untyped blocks outside typed ones count."""
    block = lambda kind, t, b: F.struct(kind.alias("kind"), t.alias("t"), b.alias("b"))

    def typed(thought: Column) -> Column:
        # A whole block is found once; its parts are read from it.
        part = lambda x, i: F.regexp_extract(x, FAKE_BLOCK, i)
        return F.transform(_every(thought, FAKE_BLOCK, 0), lambda x: block(part(x, 1), part(x, 2), part(x, 3)))

    def plain(thought: Column) -> Column:
        rest = F.regexp_replace(F.coalesce(thought, F.lit("")), FAKE_BLOCK, "")
        part = lambda x, i: F.regexp_extract(x, REAL_BLOCK, i)
        return F.transform(_every(rest, REAL_BLOCK, 0), lambda x: block(F.lit(None).cast("string"), part(x, 1), part(x, 2)))

    def blocks(thought: Column) -> Column:
        return F.when(predicted == "Fake", typed(thought)).when(predicted == "Real", plain(thought)).otherwise(F.array().cast("array<struct<kind:string,t:string,b:string>>"))

    def parsed(x: Column) -> Column:
        return F.struct(F.lower(F.trim(x["kind"])).alias("kind"), number_list(x["t"], 2).alias("t"), number_list(x["b"], 4).alias("b"))

    def judged(x: Column) -> Column:
        at = lambda a, i: F.try_element_at(a, F.lit(i))
        t, b = x["t"], x["b"]
        time_ok = (at(t, 1) >= 0) & (at(t, 2) >= at(t, 1)) & (seconds.isNull() | (at(t, 2) <= seconds + SLACK))
        box_ok = F.forall(b, lambda v: (v >= 0) & (v <= 1000)) & (at(b, 3) > at(b, 1)) & (at(b, 4) > at(b, 2))
        kind_ok = (predicted == "Real") | x["kind"].isin(*[a.lower() for a in ARTIFACTS])
        sure = lambda c: F.coalesce(c, F.lit(False))
        return F.struct(x.alias("block"), sure(time_ok).alias("time_ok"), sure(box_ok).alias("box_ok"), sure(kind_ok).alias("kind_ok"))

    def counted(rows: Column) -> Column:
        good = lambda f: F.size(F.filter(rows, f))
        whole = F.transform(F.filter(rows, lambda r: r["time_ok"] & r["box_ok"] & r["kind_ok"]), lambda r: r["block"])
        sizes = lambda v: F.struct(F.size(v).alias("valid"), F.size(F.array_distinct(v)).alias("strict"))
        bad = lambda f: good(lambda r: ~r[f])
        return bound(bound(whole, sizes), lambda n: F.struct(F.size(rows).alias("raw"), n["strict"].alias("strict"), (n["valid"] - n["strict"]).alias("duplicate"), (F.size(rows) - n["valid"]).alias("invalid"), bad("box_ok").alias("bad_box"), bad("time_ok").alias("bad_time"), bad("kind_ok").alias("bad_type")))

    found = bound(bound(_every(text, THINK, 1), _sole), lambda thought: F.transform(F.transform(blocks(thought), parsed), judged))
    return bound(found, counted)


def inspection(n: Column) -> Column:
    """What n pieces of evidence earn: ln(1 + n), at most that of three."""
    return F.least(F.log1p(F.greatest(n, F.lit(0)).cast("double")), F.lit(math.log(4.0)))


def rewards(text: Column, true: Column, seconds: Column, predicted: Column, found: Column) -> dict[str, Column]:
    """Score by variant of VARIANTS; ``true`` and ``predicted`` as truth() and answer() give them, ``found`` from evidence()."""
    thought = F.coalesce(bound(_every(text, THINK, 1), _sole), F.lit(""))
    blocks = lambda t: F.when(true == "Fake", F.regexp_count(t, F.lit(REAL_BLOCK))).otherwise(F.regexp_count(F.regexp_replace(t, REAL_BLOCK, ""), F.lit(REAL_BLOCK)))

    def scored(x: Column) -> Column:
        return F.struct(*[s.alias(v) for v, s in zip(VARIANTS, _scores(true, predicted, x["good"], x["untyped"], found), strict=True)])

    every = bound(F.struct(format_valid(text).alias("good"), bound(thought, blocks).alias("untyped")), scored)
    return {v: every[v] for v in VARIANTS}


def _scores(true: Column, predicted: Column, good: Column, untyped: Column, found: Column) -> tuple[Column, ...]:
    right = F.coalesce(predicted == true, F.lit(False))
    wrongly_fake = F.coalesce((true == "Real") & (predicted == "Fake"), F.lit(False))
    lopsided = F.when(right, 1.0).when(wrongly_fake, WRONGLY_FAKE).otherwise(0.0)
    even = right.cast("double")
    looked = F.when(good, inspection(found["raw"])).otherwise(0.0)
    strictly = F.when(good & right, inspection(found["strict"])).otherwise(0.0)
    as_published = F.when(wrongly_fake, WRONGLY_FAKE).when(right, 0.8 * inspection(untyped)).otherwise(0.0)
    return (0.8 * lopsided + 0.2 * looked, 0.8 * even + 0.2 * looked, 0.8 * lopsided + 0.2 * good.cast("double"), lopsided, 0.8 * lopsided + 0.2 * strictly, looked, as_published)


def _folded(label: Column) -> Column:
    return F.replace(F.lower(F.trim(label)), F.lit("_"), F.lit("-"))


def known_labels(labels: Column) -> Column:
    """The motion labels among ``labels``, each once and in the vocabulary's order, however they are written."""
    names = F.create_map(*[F.lit(x) for m in MOTIONS for x in (m.lower(), m)])
    found = F.array_intersect(F.array(*[F.lit(m.lower()) for m in MOTIONS]), F.transform(labels, _folded))
    return F.coalesce(F.transform(found, lambda m: F.element_at(names, m)), F.array().cast("array<string>"))


def unknown_labels(labels: Column) -> Column:
    """Labels that are no motion label and not left out, sorted."""
    names = [m.lower() for m in MOTIONS] + list(LEFT_OUT)
    return F.array_sort(F.array_distinct(F.filter(F.transform(labels, _folded), lambda x: (x != "") & ~x.isin(*names))))


def label_response(text: Column) -> Column:
    """Struct of valid, duplicate, labels and unknown of a response with one tag that holds a JSON list of non-blank strings."""
    def listed(body: Column) -> Column:
        shape = body.rlike(r'^\s*\[\s*"([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*\]\s*$')
        return F.from_json(F.when(shape, body), "array<string>")

    def read(items: Column) -> Column:
        valid = items.isNotNull() & ~F.coalesce(F.exists(items, lambda x: F.trim(x) == ""), F.lit(False))
        kept = F.when(valid, items).otherwise(F.array().cast("array<string>"))
        return bound(F.transform(kept, _folded), lambda folded: F.struct(valid.alias("valid"), (F.size(F.array_distinct(folded)) < F.size(folded)).alias("duplicate"), known_labels(folded).alias("labels"), unknown_labels(folded).alias("unknown")))

    return bound(bound(bound(_every(text, LABELS_TAG, 1), _sole), listed), read)


def label_rewards(parsed: Column, true: Column) -> dict[str, Column]:
    """Set F1 (unknown labels count as wrong ones), exactness and format of label_response() against known_labels() of the truth."""
    hit = F.size(F.array_intersect(parsed["labels"], true))
    total = F.size(parsed["labels"]) + F.size(parsed["unknown"]) + F.size(true)
    clean = parsed["valid"] & (F.size(parsed["unknown"]) == 0) & ~parsed["duplicate"]
    f1 = F.when(~parsed["valid"], 0.0).when(total == 0, 1.0).otherwise(F.try_divide(2.0 * hit, total))
    return {"set_f1": f1, "exact": (clean & (parsed["labels"] == true)).cast("double"), "format": clean.cast("double")}


def motion_bucket(labels: Column, static_is_none: bool = False) -> Column:
    """complex-motion before minor-motion before no-motion, else unknown; ``static`` may stand for no motion."""
    none = F.array_contains(labels, "no-motion") | (F.array_contains(labels, "static") if static_is_none else F.lit(False))
    return F.when(F.array_contains(labels, "complex-motion"), "complex-motion").when(F.array_contains(labels, "minor-motion"), "minor-motion").when(none, "no-motion").otherwise("unknown")


def first_balanced(text: Column) -> Column:
    """The first balanced {...} of a text; braces inside double-quoted strings don't count.  Null if none closes.

    A fold over the characters from the first brace on: the state is (depth, in a string, after a backslash, place of the end)."""
    start = F.instr(text, "{")
    chars = F.filter(F.split(F.substring(text, start, F.length(text)), ""), lambda c: c != "")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        quote = (c == '"') & ~s["escaped"]
        depth = s["depth"] + F.when(s["quoted"], 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        at = s["at"] + 1
        end = F.when(s["end"] > 0, s["end"]).when((depth == 0) & ~s["quoted"] & (c == "}"), at).otherwise(0)
        return F.struct(at.alias("at"), depth.alias("depth"), F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"), end.alias("end"))

    end = F.aggregate(chars, zero, step)["end"]
    return F.when((start > 0) & (end > 0), F.substring(text, start, end))
