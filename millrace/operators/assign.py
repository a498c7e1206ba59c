"""Capped assignment in rounds: each round is a few joins and windows, not a walk over all rows on one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .order import BROADCAST_ROWS, dealt, placed, sent, tasks
from .sampling import RANKED_IN_TASKS


def assign_all(candidates: DataFrame, target: str, donor: str, score: str, cap: int) -> DataFrame:
    """(target, donor, score, round, reason): every target of ``candidates`` once, each donor at most ``cap`` times.

    In a round every open target proposes its best donor that has room (by score, then donor), and each donor accepts
    its best proposals (by score, then target) up to its room; there are rounds until one accepts nothing.  As long as an open target has a donor with room, it
    proposes, and a donor that is asked accepts at least one; so a target stays open only if all its donors are full.
    It then has no donor, score and round, and the reason "all donors full"; a target whose donors or scores are all
    null has "no donor"."""
    rows = cut(candidates.select(target, donor, score), "candidates")
    parts = tasks(rows)
    known = F.col(donor).isNotNull() & F.col(score).isNotNull()
    open_ = cut(rows.filter(known).repartition(parts, target).groupBy(target, donor).agg(F.max(score).alias(score)).withColumn("_room", F.lit(cap).cast("long")))
    done = None
    turn = 0
    while True:
        best = dealt(open_, target).groupBy(target).agg(F.min(F.struct((-F.col(score)).alias("_s"), F.col(donor).alias("_d"), "_room")).alias("_b"))
        asked = best.select(target, F.col("_b._d").alias(donor), (-F.col("_b._s")).alias(score), F.col("_b._room").alias("_room"))
        rank = F.row_number().over(Window.partitionBy(donor).orderBy(F.desc(score), target))
        taken = cut(asked.withColumn("_r", rank).filter((F.col("_r") <= cap) & (F.col("_r") <= F.col("_room"))).select(target, donor, score, F.lit(turn).alias("round")))
        if taken.isEmpty():
            break
        done = taken if done is None else cut(done.unionByName(taken))
        used = taken.groupBy(donor).agg(F.count("*").alias("_new"))
        left = open_.join(sent(taken.select(target)), target, "left_anti").join(sent(used), donor, "left")
        open_ = cut(left.withColumn("_room", F.col("_room") - F.coalesce("_new", F.lit(0))).filter("_room > 0").select(target, donor, score, "_room"))
        turn += 1
    done = taken if done is None else done
    every = rows.select(target, known.alias("_any")).repartition(parts, target).groupBy(target).agg(F.max("_any").alias("_any"))
    reason = F.when(F.col("round").isNull(), F.when(F.col("_any"), "all donors full").otherwise("no donor"))
    return every.join(sent(done.repartition(parts, target)), target, "left").select(target, donor, score, "round", reason.alias("reason"))


#: Rounds in which targets ask for their best candidates; in later ones they spread by hash, so that targets with one taste don't fill one donor a round.
BEST_ROUNDS = 8


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` whose target isn't among those of ``gone``; where these are many, both sides are dealt by target."""
    gone = gone.select("target")
    if gone.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(gone), "target", "left_anti")
    parts = tasks(rows)
    return rows.repartition(parts, "target").join(gone.repartition(parts, "target"), "target", "left_anti")


def assign_with_ledgers(candidates: DataFrame, quotas: DataFrame, target_cap: int, donor_cap: int, group_cap: int) -> DataFrame:
    """target, operation, donor, donor_group, score, round, reason: each target of ``candidates`` once, within four ledgers.

    ``candidates`` has target, target_group, operation, donor, donor_group, score; ``quotas`` has operation and quota, a row
    each.  A target group is served at most ``target_cap`` times, a donor ``donor_cap`` times, a donor group ``group_cap``
    times and an operation as often as its quota says (operations without one: never).

    In a round each open target asks for one candidate whose four ledgers have room: the operation with the fewest
    candidates first, then by score, then donor (after BEST_ROUNDS by a hash instead of the score).  The ledgers then keep, one after the
    other, the best of those that ask (by score, then target) up to their room.  Each keeps at least one, so rounds end
    only when no open target has a candidate with room; their reason is the first that holds of "no candidate" (none with
    all keys and a score), "target group served", "operations full" and "all donors full"."""
    ledgers = {"target_group": target_cap, "donor": donor_cap, "donor_group": group_cap}
    keys = ["target", "target_group", "operation", "donor", "donor_group"]
    rows = cut(candidates.select(*keys, "score"), "rows")
    parts = tasks(rows)
    valid = cut(rows.dropna().repartition(parts, "target").groupBy(*keys).agg(F.max("score").alias("score")), "candidates")
    scarce = valid.groupBy("operation").agg(F.count("*").alias("_many"))
    known = scarce.join(quotas.select("operation", F.col("quota").cast("long").alias("_operation")), "operation", "left")
    valid = valid.join(sent(cut(known, "operations")), "operation")
    rooms = {f"_{k}": F.lit(cap).cast("long") for k, cap in ledgers.items()} | {"_operation": F.coalesce("_operation", F.lit(0))}
    open_ = valid.withColumns(rooms).filter("_operation > 0")
    done, turn = None, 0
    while not open_.isEmpty():
        best = turn < BEST_ROUNDS
        taste = (-F.col("score")) if best else F.sha2(F.concat_ws(":", "target", "donor"), 256)
        whole = F.struct("_many", "operation", taste.alias("taste"), "donor", *[c for c in open_.columns if c not in ("_many", "operation", "donor")])
        asked = cut(dealt(open_, "target").groupBy("target").agg(F.min(whole).alias("_b")).select("_b.*").drop("taste"), "asked")
        by_score = [F.desc("score"), F.col("target")]
        for key, cap in ledgers.items():
            # A large room may be asked for by many: places over range partitions.
            large = cap >= RANKED_IN_TASKS
            ranked = placed(asked, [key], by_score, "_r") if large else asked.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*by_score))).filter(F.col("_r") <= cap)
            asked = ranked.filter(F.col("_r") <= F.col(f"_{key}")).drop("_r")
        # Operations are few and large, too.
        taken = cut(placed(asked, ["operation"], by_score, "_r").filter("_r <= _operation").select(*keys, "score", F.lit(turn).alias("round")), "taken")
        if taken.isEmpty():
            break
        done = taken if done is None else cut(done.unionByName(taken), "done")
        left = _without(open_, taken)
        for key in (*ledgers, "operation"):
            used = taken.groupBy(key).agg(F.count("*").alias("_new"))
            left = left.join(sent(used), key, "left").withColumn(f"_{key}", F.col(f"_{key}") - F.coalesce("_new", F.lit(0))).drop("_new").filter(f"_{key} > 0")
        open_ = cut(left.select(*open_.columns), "open")
        turn += 1
    done = valid.limit(0).select(*keys, "score", F.lit(0).alias("round")) if done is None else done
    used = {key: done.groupBy(key).agg(F.count("*").alias(f"_used_{key}")) for key in ("target_group", "operation")}
    rest = _without(valid, done)
    for key, counts in used.items():
        rest = rest.join(sent(counts), key, "left")
    served = F.coalesce("_used_target_group", F.lit(0)) >= target_cap
    full = F.coalesce("_used_operation", F.lit(0)) >= F.coalesce("_operation", F.lit(0))
    # Every target has a row without marks, those that stay open have some with them.
    unmarked = rows.filter("target IS NOT NULL").select("target", *[F.lit(None).cast("boolean").alias(c) for c in ("served", "full")])
    marked = rest.select("target", served.alias("served"), (full | served).alias("full")).unionByName(unmarked)
    why = marked.repartition(2 * parts, "target").groupBy("target").agg(F.min("served").alias("served"), F.min("full").alias("full"))
    reason = F.when(F.col("served"), "target group served").when(F.col("full"), "operations full").when(F.col("full").isNotNull(), "all donors full").otherwise("no candidate")
    out = why.join(sent(done.drop("target_group").repartition(2 * parts, "target")), "target", "left")
    return out.select("target", "operation", "donor", "donor_group", "score", "round", F.when(F.col("round").isNull(), reason).alias("reason"))
