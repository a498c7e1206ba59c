"""Walk through JSON of any depth, and the choice of one of its strings by a score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Scores of a candidate: (points, what is looked at, parts one of which it holds, endings one of which it has).
Rule = tuple[int, str, tuple[str, ...], tuple[str, ...]]


def walk(rows: DataFrame, key: str, json: str) -> DataFrame:
    """``key``, path (an array of names and places, from 0), value (its JSON), text (of strings only), for each member of objects and arrays at any depth.

    Documents are parsed once and opened level by level; a level is one pass over what of the level above holds
    members, so there are as many passes as the deepest document has levels, and flat documents take part in one.
    Null, broken and scalar documents have no members.  Keys may repeat: rows are walked one by one."""
    spark = rows.sparkSession
    kind = lambda v: F.schema_of_variant(v)
    opens = lambda v: kind(v).startswith("OBJECT") | kind(v).startswith("ARRAY")
    level = rows.select(F.col(key).alias("_id"), F.array().cast("array<string>").alias("path"), F.try_parse_json(F.col(json)).alias("_v"))
    level = level.filter(F.col("_v").isNotNull() & opens(F.col("_v")))
    out = None
    while True:
        members = level.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        found = members.select("_id", F.array_append("path", F.coalesce(F.col("key"), F.col("pos").cast("string"))).alias("path"), F.col("value").alias("_v"))
        found = found.withColumn("_open", opens(F.col("_v")))
        text = F.when(kind(F.col("_v")) == "STRING", F.col("_v").cast("string"))
        flat = cut(found.select("_id", "path", F.to_json("_v").alias("value"), text.alias("text"), "_open"), "members")
        seen = flat.select(F.col("_id").alias(key), "path", "value", "text")
        out = seen if out is None else out.unionByName(seen)
        below = flat.filter("_open")
        if below.isEmpty():
            return out
        level = below.select("_id", "path", F.parse_json("value").alias("_v"))


def best_string(found: DataFrame, key: str, names: tuple[str, ...], rules: list[Rule]) -> DataFrame:
    """``key``, path (joined by slashes), value, score: of the strings in ``found`` (from ``walk``) whose own name is one of ``names``, that of the highest score.

    A rule's points count once if the lower-case path ("path") or the string with forward slashes ("value") holds one of its parts or
    has one of its endings.  Ties go to the shorter path, then to the lesser path and value.  Blank strings don't take part."""
    path = F.array_join("path", "/")
    looked = {"path": F.lower(path), "value": F.replace("text", F.lit("\\"), F.lit("/"))}

    def points(rule: Rule) -> Column:
        score, where, parts, endings = rule
        fits = [F.contains(looked[where], F.lit(p)) for p in parts] + [F.endswith(looked[where], F.lit(e)) for e in endings]
        return F.when(reduce(lambda a, b: a | b, fits), score).otherwise(0)

    score = reduce(lambda a, b: a + b, [points(r) for r in rules], F.lit(0))
    named = found.filter(F.col("text").isNotNull() & (F.trim("text") != "") & F.element_at("path", -1).isin(*names))
    order = F.struct((-score).alias("s"), F.length(path).alias("n"), path.alias("p"), F.col("text").alias("v"))
    best = named.groupBy(key).agg(F.min(order).alias("_b"))
    return best.select(key, F.col("_b.p").alias("path"), F.col("_b.v").alias("value"), (-F.col("_b.s")).alias("score"))
