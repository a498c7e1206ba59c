"""Label votes of captions and answered questions by a table of rules, and the final set of labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import sent

#: A rule: place, kind of text, parts any of which / all of which / none of which it holds, label, answer that votes for it
#: (null: any), weight, whether later rules are passed over once its parts are met.
RULES = "rule int, kind string, any array<string>, all array<string>, lacks array<string>, label string, answer boolean, weight int, stop boolean"


def answer_sign(answer: Column) -> Column:
    """Whether an answer starts with yes or no, in any case, after blanks; else null."""
    low = F.lower(F.trim(F.regexp_replace(answer, r"\s+", " ")))
    return F.when(low.startswith("yes"), True).when(low.startswith("no"), False)


def plain_question(text: Column) -> Column:
    """The question without the media mark and the request for yes or no."""
    flat = F.trim(F.replace(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("<video>"), F.lit("")))
    return F.trim(F.regexp_replace(flat, r"(?i)\s*please only answer yes or no\.?\s*$", ""))


def votes(texts: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """``key``, label, n: the summed weights of the rules that each text meets.

    ``texts`` has ``key``, kind, text and answer (null: none given).  A text meets a rule of its kind if the lower-case text
    holds what the rule asks for; it votes if the answer is the rule's.  The first met rule with ``stop`` is the last that
    counts, whether it votes or not.  Each different text is met with the rules once, as a join; null texts meet none."""
    low = texts.withColumn("_low", F.lower("text")).filter("_low IS NOT NULL")
    different = low.select("kind", "_low", "answer").distinct()
    r = rules.select(*[F.col(c.split()[0]).alias(f"_{c.split()[0]}") for c in RULES.split(", ")])
    holds = lambda p: F.contains(F.col("_low"), p)
    met = (F.col("kind") == F.col("_kind")) & (F.coalesce(F.size("_any") <= 0, F.lit(True)) | F.exists("_any", holds)) & F.coalesce(F.forall("_all", holds), F.lit(True)) & ~F.coalesce(F.exists("_lacks", holds), F.lit(False))
    hits = different.join(sent(r), met)
    last = hits.groupBy("kind", "_low", "answer").agg(F.min(F.when(F.col("_stop"), F.col("_rule"))).alias("_last"), F.collect_list(F.struct("_rule", "_label", "_answer", "_weight")).alias("_hits"))  # as many as there are rules
    counted = F.filter("_hits", lambda h: (F.col("_last").isNull() | (h["_rule"] <= F.col("_last"))) & (h["_answer"].isNull() | h["_answer"].eqNullSafe(F.col("answer"))))
    found = last.select(F.col("kind").alias("_k"), F.col("_low").alias("_t"), F.col("answer").alias("_a"), counted.alias("_votes"))
    same = (F.col("kind") == F.col("_k")) & (F.col("_low") == F.col("_t")) & F.col("answer").eqNullSafe(F.col("_a"))
    each = low.join(found, same).select(key, F.explode("_votes").alias("v"))
    return each.groupBy(key, F.col("v._label").alias("label")).agg(F.sum("v._weight").alias("n"))


def final_labels(counts: Column, order: list[str], groups: list[tuple[dict[str, int], str]], defaults: list[str], implied: dict[str, str], most: int = 8) -> Column:
    """Labels, in ``order``, from a map of label to votes; empty where no known label has a vote.

    ``groups`` are (labels with priorities, fallback): each gives its label of most votes, then priority, then place, or its fallback.
    ``defaults`` are labels of groups that get a vote where their group has none; ``implied`` gives a label a vote where another
    has one.  Labels of no group come by votes, then place, up to ``most`` labels in all; implied ones come first."""
    at = {label: i for i, label in enumerate(order)}
    own = {label: F.greatest(F.coalesce(F.try_element_at(counts, F.lit(label)), F.lit(0)), F.lit(0)) for label in order}
    some = reduce(lambda a, b: a | b, [v > 0 for v in own.values()])
    now = dict(own)
    for label, other in implied.items():
        now[other] = now[other] + F.when(own[label] > 0, 1).otherwise(0)
    for label in defaults:
        group = next(g for g, _ in groups if label in g)
        now[label] = now[label] + F.when(reduce(lambda a, b: a & b, [own[m] == 0 for m in group]), 1).otherwise(0)
    core = []
    for group, fallback in groups:
        ranked = F.array(*[F.when(now[m] > 0, F.struct(now[m].cast("long").alias("n"), F.lit(p).alias("p"), F.lit(-at[m]).alias("a"), F.lit(m).alias("m"))) for m, p in group.items()])
        core.append(F.coalesce(F.array_max(ranked)["m"], F.lit(fallback)))
    grouped = {m for g, _ in groups for m in g}
    first = F.array_compact(F.array(*[F.when(F.array_contains(F.array(*core), label) & (now[other] > 0), other) for label, other in implied.items()])) if implied else F.array().cast("array<string>")
    others = [label for label in order if label not in grouped]
    ranked = F.array_sort(F.array_compact(F.array(*[F.when(now[m] > 0, F.struct((-now[m]).cast("long").alias("n"), F.lit(at[m]).alias("a"), F.lit(m).alias("m"))) for m in others]))) if others else None
    extras = F.transform(ranked, lambda s: s["m"]) if others else F.array().cast("array<string>")
    kept = F.slice(F.array_distinct(F.concat(F.array(*core), first, extras)), 1, most)
    return F.when(some, F.filter(F.array(*map(F.lit, order)), lambda label: F.array_contains(kept, label))).otherwise(F.array().cast("array<string>"))
