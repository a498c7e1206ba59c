"""Buckets, groups and reasons of labels, and the arithmetic of frames and intervals; all Column to Column.

Null arrays and texts give the default of each function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names by the order in which they are looked for.
MOTION = ("complex-motion", "minor-motion", "no-motion")
SPEED = ("fast-speed", "regular-speed", "slow-speed")
STEADINESS = ("very-unsteady", "unsteady", "minimal-shaking", "no-shaking")
# What a blocker contains, and the status it gives; earlier rules win.
BLOCKED = (
    ("blocked_missing_mask", "missing_mask(_path)?$"), ("blocked_mapped_but_unverified", "mapped_but_unverified"),
    ("blocked_invalid_mask_npz", "invalid_npz"),
)


def clean_labels(labels: Column) -> Column:
    return F.transform(labels, lambda x: F.replace(F.lower(F.trim(x)), F.lit("_"), F.lit("-")))


def first_of(labels: Column, order: tuple[str, ...], default: str) -> Column:
    """The first of ``order`` among the labels."""
    return F.coalesce(F.try_element_at(F.filter(F.array(*map(F.lit, order)), lambda x: F.coalesce(F.array_contains(labels, x), F.lit(False))), F.lit(1)), F.lit(default))


def motion_bucket(labels: Column, static: str = "ignored") -> Column:
    """complex-motion, minor-motion, no-motion or unknown, in this order.

    ``static``: ignored; none (the label static counts as no-motion, labels in any case); own (both are the bucket
    static); text (static anywhere in the labels first, then minor, all other labels are complex)."""
    if static == "text":
        text = F.lower(F.coalesce(F.array_join(labels, " "), F.lit("")))
        return F.when(text == "", "unknown").when(F.contains(text, F.lit("static")), "static").when(F.contains(text, F.lit("minor")), "minor-motion").otherwise("complex-motion")
    if static == "none":
        labels = F.transform(labels, lambda x: F.lower(F.trim(x)))
    plain = first_of(labels, MOTION if static == "ignored" else (*MOTION, "static"), "unknown")
    return F.when(plain.isin("no-motion", "static"), "static" if static == "own" else "no-motion").otherwise(plain)


def coarse_signature(labels: Column) -> Column:
    """(motion, speed, steadiness) joined by a bar, each the first that occurs or unknown."""
    parts = ((MOTION, "motion"), (SPEED, "speed"), (STEADINESS, "steadiness"))
    return F.concat_ws("|", *[first_of(labels, order, f"{name}-unknown") for order, name in parts])


def first_rule(text: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    """The name of the first rule (name, regular expression) found in the text."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def path_or_answer(path: Column, answer: Column) -> Column:
    """Fake or Real by a folder of the path, else by an answer tag, else UNKNOWN."""
    said = F.initcap(F.regexp_extract(answer, r"(?i)<answer>\s*(fake|real)\s*</answer>", 1))
    return F.coalesce(first_rule(F.lower(path), [("Fake", "/fake/"), ("Real", "/real/")], None), F.nullif(said, F.lit("")), F.lit("UNKNOWN"))


def blocked_status(blockers: Column) -> Column:
    """The status of a list of blockers: the first rule any of them meets, a schema error for others, passed for none."""
    out = F.when(F.coalesce(F.size(blockers), F.lit(0)) > 0, "blocked_schema_error").otherwise("preflight_passed")
    for status, pattern in reversed(BLOCKED):
        out = F.when(F.exists(blockers, lambda b: b.rlike(pattern)), status).otherwise(out)  # noqa: B023
    return out


def reason_category(reason: Column) -> Column:
    """A reason without the paths and numbers of its case."""
    arrow = F.concat(F.substring_index(reason, "=", 1), F.lit(" -> "), F.regexp_extract(reason, " -> (?s)([^:]*)", 1))
    return (
        F.when(F.contains(reason, F.lit("mask npz does not exist:")), "mask_npz_does_not_exist").when(F.contains(reason, F.lit("; path=")), F.substring_index(reason, "; path=", 1))
        .when(F.contains(reason, F.lit(" -> ")), arrow).otherwise(reason)
    )


def banned(text: Column, exact: list[str], parts: list[str]) -> Column:
    """The text, trimmed and in lower case, is one of ``exact`` or contains one of ``parts``."""
    value = F.trim(F.lower(text))
    hit = value.isin(*exact)
    for p in parts:
        hit = hit | F.contains(value, F.lit(p))
    return F.coalesce(hit, F.lit(False))


def strict_labels(text: Column, tag: str, allowed: list[str]) -> Column:
    """struct(labels, reason): the tag alone must hold a JSON list of different allowed strings; else why it doesn't."""
    whole = f"(?s)^\\s*<{tag}>(.*?)</{tag}>\\s*$"
    body = F.regexp_extract(text, whole, 1)
    string = r'"(?:[^"\\]|\\.)*"'
    labels = F.from_json(body, "array<string>")
    strings = body.rlike(rf"^\s*\[\s*(?:{string}(?:\s*,\s*{string})*)?\s*\]\s*$")
    reason = (
        F.when(~F.coalesce(text.rlike(whole), F.lit(False)), "tag_or_extra_text").when(F.try_parse_json(body).isNull(), "invalid_json").when(~strings, "not_string_list")
        .when(F.size(labels) != F.size(F.array_distinct(labels)), "duplicate_labels").when(F.exists(labels, lambda x: ~x.isin(*allowed)), "unknown_labels").otherwise("")
    )
    return F.struct(F.when(reason == "", labels).otherwise(F.array().cast("array<string>")).alias("labels"), reason.alias("reason"))


def prompt_times(text: Column, images: Column) -> Column:
    """The times [T=...s] of a prompt; 0, 1, ... where they are not as many as the images."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[T=([0-9]+(?:\.[0-9]+)?)s\]"), F.lit(1)), lambda x: x.cast("double"))
    count = F.transform(F.filter(F.sequence(F.lit(0), images), lambda i: i < images), lambda i: i.cast("double"))
    return F.when(F.size(found) == images, found).otherwise(count)


def shifted_interval(start: Column, end: Column, low: Column, high: Column) -> Column:
    """struct(start, end) of an interval moved to the far end of [low, high]; a nearly full one shrinks to a third.

    Without a span nothing moves."""
    span, long = high - low, F.greatest(end - start, F.lit(0.0))
    full = long >= span * 0.8
    size = F.when(full, F.greatest(span / 3.0, F.lit(0.01))).otherwise(long)
    middle = (start + end) / 2.0
    to_low, to_high = F.abs(low + size / 2.0 - middle), F.abs(high - size / 2.0 - middle)
    early = F.when(full, middle > (low + high) / 2.0).otherwise(to_low >= to_high)
    moved = F.when(early, F.struct(low.alias("start"), (low + size).alias("end"))).otherwise(F.struct((high - size).alias("start"), high.alias("end")))
    return F.when(span > 0, moved).otherwise(F.struct(start.alias("start"), end.alias("end")))


def rotated(value: Column, vocabulary: list[str]) -> Column:
    """The entry half the vocabulary further on; null for other values."""
    by = len(vocabulary) // 2
    return F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(vocabulary) for x in (v, vocabulary[(i + by) % len(vocabulary)])]), value)


def replace_in_tag(text: Column, tag: str, new) -> Column:
    """Each body of the tag replaced by ``new(body)`` where that is not null."""
    pattern = f"<{tag}>([^<]*)</{tag}>"
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    made = F.transform(bodies, lambda b: F.concat(F.lit(f"<{tag}>"), F.coalesce(new(F.trim(b)), b), F.lit(f"</{tag}>")))
    pieces = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(pieces, F.concat(made, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def dense_frames(frames: Column, fps: Column, target: float) -> Column:
    """Frame indices at no more than ``target`` frames a second from the first on, and the last frame; null without frames."""
    rate = F.least(fps, F.lit(target))
    steps = F.ceil(((frames - 1) / fps + 1e-9) * rate).cast("int")
    at = F.transform(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), lambda k: F.least(frames - 1, F.bround(k * (F.lit(1.0) / rate) * fps, 0).cast("int")))
    return F.when((frames > 0) & (fps > 0), F.array_sort(F.array_distinct(F.concat(at, F.array(frames - 1)))))


def window_starts(frames: Column, window: int, stride: int, most: int | None = None) -> Column:
    """First frames of windows every ``stride`` frames with one that ends with the last frame; ``most`` evenly chosen."""
    final = F.greatest(frames - F.least(F.lit(max(2, window)), frames), F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), final, F.lit(max(1, stride))), F.array(final)))
    if most and most > 1:
        n = F.size(starts)
        chosen = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(starts, (F.bround(i * (n - 1) / F.lit(float(most - 1)), 0) + 1).cast("int")))
        starts = F.when(n > most, chosen).otherwise(starts)
    return F.when(frames >= 2, starts).otherwise(F.array().cast("array<int>"))
