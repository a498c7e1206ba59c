"""Text and tag functions as Column to Column; Java's \\s matches ASCII blanks only, which is what they assume."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_value(*cols: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def first_number(*cols: Column, low: float, high: float, otherwise: Column) -> Column:
    """The first column that reads as a number, clamped; else ``otherwise``."""
    value = F.coalesce(*[c.try_cast("double") for c in cols])
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high))).otherwise(otherwise)


def collapse(text: Column, most: int | None = None) -> Column:
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.substring(out, 1, most) if most else out


def normalise(text: Column) -> Column:
    return collapse(F.replace(F.lower(text), F.lit("_"), F.lit(" ")))


def enum_or_default(text: Column, allowed: list[str], default: str, most: int = 96) -> Column:
    value = F.lower(collapse(text, most))
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def tag(text: Column, name: str) -> Column:
    """Body of the first <name>…</name>, any case, over lines; null if there is none."""
    return F.nullif(F.regexp_extract(text, f"(?is)<{name}>(.*?)</{name}>", 1), F.lit(""))


def only_tag(text: Column, name: str) -> Column:
    """The body if the tag occurs exactly once."""
    return F.when(F.regexp_count(text, F.lit(f"(?is)<{name}>.*?</{name}>")) == 1, tag(text, name))


def cascade(text: Column, patterns: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(value, source) of the first named pattern whose group 1 matches."""
    hits = [(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), name) for name, p in patterns]
    return F.coalesce(*[h for h, _ in hits]), F.coalesce(*[F.when(h.isNotNull(), F.lit(n)) for h, n in hits])


def pair_side(explicit: Column, key: Column, paths: Column, answer: Column, sides: tuple[str, str]) -> tuple[Column, Column]:
    """(side, source): stated, else the key's ending ``:side``, else the one side that is a folder of the paths, else an answer tag.

    Blank and unknown values pass to the next source; paths that name both sides or none decide nothing; null where no source decides."""
    stated, ending = F.lower(F.trim(explicit)), F.lower(F.trim(key))
    folders = F.replace(F.array_join(paths, "/"), F.lit("\\"), F.lit("/"))
    inside = [F.contains(folders, F.lit(f"/{s}/")) for s in sides]
    found = [
        (F.when(stated.isin(*sides), stated), "stated"),
        (F.coalesce(*[F.when(F.endswith(ending, F.lit(f":{s}")), s) for s in sides]), "key"),
        (F.when(inside[0] & ~inside[1], sides[0]).when(inside[1] & ~inside[0], sides[1]), "path"),
        (F.coalesce(*[F.when(F.contains(F.lower(answer), F.lit(f"<answer>{s}</answer>")), s) for s in sides]), "answer"),
    ]
    return F.coalesce(*[v for v, _ in found]), F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for v, n in found])


def keyword_bucket(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The bucket of the first rule one of whose keywords the text contains."""
    out = None
    for bucket, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, bucket) if out is None else out.when(hit, bucket)
    return out.otherwise(default)


def number_list(text: Column, n: int) -> Column:
    """Exactly n comma-separated numbers as an array, else null."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when((F.size(parts) == n) & ~F.exists(parts, lambda x: x.isNull()), parts)


def label_list(text: Column) -> Column:
    """A JSON list of non-blank strings as an array, else null (numbers are no labels)."""
    parsed = F.from_json(text, "array<string>")
    plain = text.rlike(r'^\s*\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)\]\s*$')
    return F.when(plain & ~F.exists(parsed, lambda x: F.trim(x) == ""), parsed)


def distinct_strings(values: Column, most: int, width: int) -> Column:
    """Trimmed, cut, non-empty strings; the first spelling of each (in any case) stays, at most ``most``."""
    cut = F.filter(F.transform(values, lambda x: F.substring(F.trim(x), 1, width)), lambda x: x != "")
    kept = F.aggregate(cut, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.slice(kept, 1, most)


def last_message(messages: Column, role: str) -> Column:
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"]


def path_parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def remap_prefix(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule (old, new) that the path equals or continues at a slash."""
    out = None
    for old, new in rules:
        hit = (path == old) | F.startswith(path, F.lit(old + "/"))
        moved = F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))
        out = F.when(hit, moved) if out is None else out.when(hit, moved)
    return out.otherwise(path) if out is not None else path
