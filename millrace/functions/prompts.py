"""Prompts, payloads and frames of a case; all Column to Column.  Nulls give null unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.sampling import hash_key, hash_shard

#: Seconds up to which a clip keeps its speed, and the frames of a longer one.
SHORT_CLIP, LONG_CLIP_FRAMES = 5.0, 81
# Statuses after which a case is not worked on again, and the one that needs no receipt.
TERMINAL = (
    "accepted", "rejected_generation_failure", "rejected_global_drift", "rejected_wrong_edit", "rejected_low_visibility",
    "needs_manual_review", "uploaded_verified",
)
UPLOADED = "uploaded_verified"


def first_path(doc: Column, paths: list[str]) -> Column:
    """Text at the first JSON path that is there and not empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(doc, p), F.lit("")) for p in paths])


def kept_entries(values: Column, keys: list[str]) -> Column:
    """Entries of a string map under one of the keys whose value isn't blank."""
    return F.map_filter(values, lambda k, v: k.isin(*keys) & (F.coalesce(F.trim(v), F.lit("")) != ""))


def merged(fields: list[str], nested: dict[str, Column], base: dict[str, Column], prefixed: dict[str, Column]) -> Column:
    """struct of ``fields``: each from the nested record, else from the base record, else from the case's own prefixed column."""
    return F.struct(*[F.coalesce(*[part[f] for part in (nested, base, prefixed) if f in part], F.lit(None)).alias(f) for f in fields])


def pair_score(a: Column, b: Column) -> Column:
    """Geometric mean of two qualities, to six places, half to even; negative products give null."""
    return F.bround(F.when(a * b >= 0, F.sqrt(a * b)), 6)


def fraction(value: Column) -> Column:
    """A share written as a fraction or in per cent; what isn't a number gives null."""
    v = value.try_cast("double")
    return F.when(v > 1, v / 100).otherwise(v)


def marked_lines(text: Column, mark: str, chosen: Column) -> Column:
    """``text`` without the lines that hold ``mark`` and whose number among these, from 0, is not ``chosen``.

    Null where a line holds the mark twice."""
    line = f"[^\n]*\\Q{mark}\\E[^\n]*\n?"
    found = F.regexp_extract_all(text, F.lit(f"({line})"), F.lit(1))
    kept = F.transform(found, lambda x, i: F.when(F.array_contains(chosen, i), x).otherwise(""))
    twice = F.exists(found, lambda x: F.regexp_count(x, F.lit(f"\\Q{mark}\\E")) > 1)
    return F.when(~twice, F.array_join(F.zip_with(F.split(text, line, -1), F.concat(kept, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), ""))


def without_lines(text: Column, mark: str) -> Column:
    """``text`` without the lines that hold ``mark``."""
    return F.regexp_replace(text, f"[^\n]*\\Q{mark}\\E[^\n]*\n?", "")


def placeholders_match(text: Column, mark: str, payload: Column) -> Column:
    """The mark stands in the text as often as the payload has elements; nulls count as none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"\\Q{mark}\\E")) == F.coalesce(F.size(payload), F.lit(0))


def permuted(labels: Column, mapping: dict[str, str], order: list[str]) -> Column:
    """The labels each mapped to another, in the vocabulary's order; labels outside the mapping go."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    made = F.transform(labels, lambda x: F.try_element_at(table, x))
    return F.filter(F.array(*map(F.lit, order)), lambda x: F.coalesce(F.array_contains(F.array_compact(made), x), F.lit(False)))


def swapped_choice(text: Column) -> Column:
    """Each A and B that stands as a word of its own taken for the other, so that a record's two sides can change places."""
    pieces = F.split(text, r"\b[AB]\b", -1)
    turned = F.transform(F.regexp_extract_all(text, F.lit(r"\b([AB])\b"), F.lit(1)), lambda x: F.translate(x, "AB", "BA"))
    return F.array_join(F.zip_with(pieces, F.concat(turned, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def chosen_template(key: Column, templates: list[str], seed: str) -> Column:
    """One of the templates by the hash of the key."""
    return F.element_at(F.array(*map(F.lit, templates)), hash_shard(hash_key(seed, key), len(templates)) + 1)


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """``template`` with each {name} replaced by its value; null values are left empty."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def closed_unit(key: Column) -> Column:
    """[0, 1] from the first 48 bits of a hex hash."""
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / float((1 << 48) - 1)


def variant(unit: Column, steps: list[tuple[str, float]], last: str) -> Column:
    """The name of the first step the unit lies below, else ``last``."""
    out = F.lit(last)
    for name, below in reversed(steps):
        out = F.when(unit < below, name).otherwise(out)
    return F.when(unit.isNotNull(), out)


def padded_frames(frames: Column) -> Column:
    """The next count of the form 4n + 1; null without frames."""
    return F.when(frames > 0, frames + F.pmod(1 - frames, F.lit(4)))


def clip_plan(first: Column, last: Column, fps: Column, target_fps: float) -> Column:
    """struct(frames, valid, fps) of a clip from frame ``first`` to ``last``: a short one is resampled to ``target_fps`` and
    padded to 4n + 1, a longer one is spread over 81 frames; null without a span or rate."""
    seconds = (last - first + 1) / fps
    valid = F.greatest(F.lit(1), F.bround(seconds * target_fps, 0).cast("int"))
    short = F.struct(padded_frames(valid).alias("frames"), valid.alias("valid"), F.lit(float(target_fps)).alias("fps"))
    n = F.lit(LONG_CLIP_FRAMES)
    long = F.struct(n.alias("frames"), n.alias("valid"), (float(LONG_CLIP_FRAMES) / seconds).alias("fps"))
    return F.when((last >= first) & (fps > 0), F.when(seconds <= SHORT_CLIP, short).otherwise(long))


def clip_frames(first: Column, last: Column, plan: Column) -> Column:
    """Source frame (fractional) of each frame of a plan: even steps from first to last, then the last repeated."""
    valid = plan["valid"]
    step = (last - first) / F.greatest(valid - 1, F.lit(1)).cast("double")
    return F.transform(F.sequence(F.lit(0), plan["frames"] - 1), lambda i: F.when(i < valid, first + i * step).otherwise(last.cast("double")))


def frame_time(frame: Column, mapped: Column, source_fps: Column, start: Column, fps: Column) -> Column:
    """Seconds of a clip's frame: by the source frame it maps to, else from the start at the clip's rate, else null."""
    return F.coalesce(F.when(source_fps > 0, mapped / source_fps), F.when(fps > 0, start + frame / fps))


def path_state(raw: Column, readable: Column, volatile: Column, mapped: Column, mapped_readable: Column) -> Column:
    """struct(path, state) of a path: readable_persistent (itself, or where it is mapped to), readable_volatile, mapped_but_unverified or missing."""
    def made(path: Column | None, state: str) -> Column:
        return F.struct((F.lit(None).cast("string") if path is None else path).alias("path"), F.lit(state).alias("state"))

    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", made(None, "missing")).when(yes(readable) & ~yes(volatile), made(raw, "readable_persistent"))
        .when(mapped.isNotNull() & yes(mapped_readable), made(mapped, "readable_persistent")).when(yes(readable), made(raw, "readable_volatile"))
        .when(mapped.isNotNull(), made(mapped, "mapped_but_unverified")).otherwise(made(None, "missing"))
    )


def skipped(status: Column, receipt: Column) -> Column:
    """A case that is done with: uploaded, or in a final status with a receipt; nulls are not."""
    return F.coalesce(status.isin(*TERMINAL) & ((status == UPLOADED) | (F.coalesce(receipt, F.lit("")) != "")), F.lit(False))


def annotation_faults(text: Column, truth: Column, low: Column, high: Column, types: tuple[str, ...]) -> Column:
    """Why an annotated response can't be used, in order; an empty array where it can.

    ``truth`` is real or fake; spans must lie within [low, high], and none may be given where these are null."""
    text = F.coalesce(text, F.lit(""))
    every = lambda p, g=1: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    number = r"(-?\d+(?:\.\d+)?)"
    numbers = lambda body: F.transform(F.regexp_extract_all(body, F.lit(number), F.lit(1)), lambda x: x.cast("double"))
    said = F.lower(F.try_element_at(every(r"(?i)<answer>\s*(real|fake)\s*</answer>"), F.lit(1)))
    comma = r"\s*,\s*"
    boxes = F.transform(every(rf"(?i)<bbox>\s*(\[\s*{comma.join([number] * 4)}\s*\])\s*</bbox>"), numbers)
    spans = F.transform(every(rf"(?i)<t>\s*(\[\s*{comma.join([number] * 2)}\s*\])\s*</t>"), numbers)
    names = F.transform(every(r"(?i)<type>\s*([^<]+?)\s*</type>"), lambda x: x)
    bad_box = F.exists(boxes, lambda b: ~((b[0] >= 0) & (b[0] < b[2]) & (b[2] <= 1000) & (b[1] >= 0) & (b[1] < b[3]) & (b[3] <= 1000)))
    bad_span = F.exists(spans, lambda s: ~F.coalesce((s[0] >= low) & (s[0] <= s[1]) & (s[1] <= high + 1e-6), F.lit(False)))
    return F.array_compact(F.array(
        F.when(said.isNull(), "missing_answer").when(~said.eqNullSafe(truth), "answer_gt_mismatch"), F.when(bad_box, "invalid_bbox"),
        F.when(F.exists(names, lambda x: ~x.isin(*types)), "invalid_artifact_type"), F.when(bad_span, "invalid_time_interval"),
    ))


def label_votes(text: Column, rules: list[tuple[str, list[str], list[str]]]) -> Column:
    """Labels of the rules (label, any of these parts, none of those) that the lower-case text meets, in order, each once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    def anywhere(parts: list[str]) -> Column:
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(low, F.lit(p))
        return hit

    return F.array_distinct(F.array_compact(F.array(*[F.when(anywhere(has) & ~anywhere(lacks), label) for label, has, lacks in rules])))
