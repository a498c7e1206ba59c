"""Mixing sources to target weights by repetition rates.

Tokens are summed per source; every source gets a share of the total budget by
its weight, stopped at ``cap`` times its own size, and what is over goes to the
others by weight until none is above.  A source's rate is its target over its
size; a document is taken floor(rate) times plus once more with probability
equal to the fraction, decided by a keyed hash of the document.

Null text has size 0; sources without words have target 0; a null source is a
source of its own, last in order.  Equal keys are decided alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unit_hash, word_count

#: Weights given to the sources in order, over and over.
WEIGHTS = (3, 1, 2)
#: Words of the mix over words of the input, and the most a source may be repeated.
BUDGET, CAP = 1.5, 2
SEED = "mix-1"
#: Sources up to which their targets are broadcast.
BROADCAST_SOURCES = 100_000


def ordinals(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with the row's place (from 0) in the order of ``by``, nulls last, without one task holding all rows."""
    dealt = cut(df.repartitionByRange(F.col(by).asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "ordinals")
    sizes = sorted(dealt.groupBy("_part").count().collect())  # one row a partition
    before, at = [], 0
    for part, n in sizes:
        before.append((part, at))
        at += n
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before for x in pair]), F.col("_part")) if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(by).asc_nulls_last())) - 1 + offset
    return dealt.withColumn(name, place.cast("long")).drop("_part")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """source, source_size, target from one row (source, size) per document."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = ordinals(per, "source", "_place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("_weight", weight), "weights", small=True)
    live = ranked.filter("source_size > 0")
    total, w = live.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0))).first()
    capped, level = 0, 0.0
    while w:  # the sources at their cap only become more; each pass is one small aggregate over a row a source
        level = (budget * total - capped) / w
        over = F.col("source_size") * cap <= F.lit(level) * F.col("_weight")
        more, left = live.agg(F.coalesce(F.sum(F.when(over, F.col("source_size") * cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0))).first()
        if left == w or not left:
            break
        capped, w = more, left
    target = F.least(F.col("source_size") * float(cap), F.lit(float(level)) * F.col("_weight"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def copies_of(key: Column, cap: int = CAP, seed: str = SEED) -> Column:
    """floor(rate) copies and one more by a keyed draw, from the columns target and source_size."""
    rate = F.least(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)), F.lit(float(cap)))
    return F.floor(rate) + F.when(unit_hash(key, seed=seed) < rate - F.floor(rate), 1).otherwise(0)


def _sent(targets: DataFrame) -> DataFrame:
    return F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets


def emit_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it; its columns may have any names."""
    columns = docs.columns
    own = {c: f"own_{i}" for i, c in enumerate(columns)}
    docs = docs.select([F.col(f"`{c}`").alias(own[c]) for c in columns])
    key, text, source = own[key], own[text], own[source]
    sized = docs.select(docs[source].alias("source"), word_count(docs[text]).alias("size"))
    targets = source_targets(sized, weights, budget, cap).withColumnRenamed("source", "_source")
    joined = docs.join(_sent(targets), docs[source].eqNullSafe(F.col("_source")), "left").withColumn("_copies", copies_of(docs[key], cap, seed))
    repeated = joined.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies").cast("long"))))
    return repeated.select([F.col(own[c]).alias(c) for c in columns])


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``key``, source, size, source_size, target, copies, taken for each row."""
    sized = cut(docs.select(docs[key].alias("_key"), docs[source].alias("source"), word_count(docs[text]).alias("size")), "sizes")
    targets = source_targets(sized, weights, budget, cap).withColumnRenamed("source", "_source")
    # The target table has one row a source; a source's many documents are the split side of the join.
    joined = sized.join(_sent(targets), sized["source"].eqNullSafe(F.col("_source")), "left")
    copies = copies_of(F.col("_key"), cap, seed)
    return joined.select(F.col("_key").alias(key), "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
