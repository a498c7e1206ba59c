"""Operators over cases: frame lookup, donor search, group splits, matched pairs, subject draws, plans and their faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prompts import skipped
from .order import placed, running, running_max, sent, with_totals
from .planning import weighted_choice
from .sampling import hash_key, hash_unit, largest_shares, ranked


def aligned_frames(wanted: DataFrame, tube: DataFrame, case: str, at: str, frame: str, zero_missing: bool = True) -> DataFrame:
    """``wanted`` with ``source_frame`` (``at`` rounded half to even), ``mask_frame`` and ``status``: visible where the tube
    (one row a case and frame) has that frame; else zero_filled, or with ``zero_missing=False`` nearest (ties: the earlier).

    The nearest frames are running maxima over ranges of (case, frame) in both directions, so a long tube is no task of
    its own.  A case without a tube is ``missing``."""
    rows = wanted.withColumn("source_frame", F.bround(F.col(at), 0).cast("long"))
    have = tube.select(F.col(case).alias("_c"), F.col(frame).cast("long").alias("_f"))
    out = rows.join(have, (F.col(case) == F.col("_c")) & (F.col("source_frame") == F.col("_f")), "left")
    if zero_missing:
        return out.withColumn("mask_frame", F.col("_f")).withColumn("status", F.when(F.col("_f").isNotNull(), "visible").otherwise("zero_filled")).drop("_c", "_f")
    spots = rows.select(case, F.col(at).cast("double").alias("_at")).distinct().withColumn("_f", F.lit(None).cast("long"))
    both = spots.unionByName(have.select(F.col("_c").alias(case), F.col("_f").cast("double").alias("_at"), "_f"))
    # At equal places frames come first, so that each direction sees them.
    both = running_max(both, [case], [F.asc("_at"), F.col("_f").asc_nulls_last()], F.col("_f"), "_low")
    both = running_max(both, [case], [F.desc("_at"), F.col("_f").desc_nulls_last()], -F.col("_f"), "_high").withColumn("_high", -F.col("_high"))
    near = both.filter("_f IS NULL").groupBy(F.col(case).alias("_n"), F.col("_at").alias("_nat")).agg(
        F.first(F.when(F.col("_high").isNull() | (F.col("_at") - F.col("_low") <= F.col("_high") - F.col("_at")), F.col("_low")).otherwise(F.col("_high"))).alias("_near"))
    out = out.join(near, F.col(case).eqNullSafe(F.col("_n")) & F.col(at).cast("double").eqNullSafe(F.col("_nat")), "left")
    status = F.when(F.col("_f").isNotNull(), "visible").when(F.col("_near").isNotNull(), "nearest").otherwise("missing")
    return out.withColumn("mask_frame", F.coalesce("_f", "_near")).withColumn("status", status).drop("_c", "_f", "_n", "_nat", "_near")


def best_donor(targets: DataFrame, donors: DataFrame, compatible: DataFrame, key: str, video: str, label: str, donor: str, score: str) -> DataFrame:
    """(key, donor, level) of each target: the best-scored donor of another video whose label is compatible, or nulls.

    ``compatible`` has (label, donor_label, level).  Of each donor label only the best donor and the best of another video
    are joined: one of the two is free for any target, so no pair of rows is formed.  Ties: the least donor id."""
    order = F.struct(F.col(score), -F.col(donor))
    one = donors.filter(F.col(score).isNotNull()).groupBy(F.col(label).alias("donor_label"), F.col(video).alias("_video")).agg(F.max_by(F.struct(F.col(donor).alias("d"), F.col(score).alias("s")), order).alias("_d"))
    rank = F.row_number().over(Window.partitionBy("donor_label").orderBy(F.desc("_d.s"), F.asc("_d.d")))
    two = one.withColumn("_rank", rank).filter("_rank <= 2")
    by_label = compatible.join(two, "donor_label").select(F.col(label), "level", "_video", "_d")
    found = targets.select(key, video, label).join(sent(by_label), label).filter(F.col(video) != F.col("_video"))
    best = found.groupBy(key).agg(F.max_by(F.struct("_d.d", "level"), F.struct("_d.s", -F.col("_d.d"))).alias("_b"))
    return targets.select(key).join(best, key, "left").select(key, F.col("_b.d").alias(donor), "_b.level")


def pending(tasks: DataFrame, states: DataFrame, key: str, present: Column) -> DataFrame:
    """Tasks that are not done with, with ``work``: run, or fail where the input is not ``present``; ``states`` has key, status and receipt."""
    done = states.filter(skipped(F.col("status"), F.col("receipt"))).select(key).distinct()
    return tasks.join(done, key, "left_anti").withColumn("work", F.when(F.coalesce(present, F.lit(False)), "run").otherwise("fail"))


def group_split(rows: DataFrame, group: str, label: str, seed: str, count: int, unknown: str = "unknown") -> DataFrame:
    """``rows`` with ``split``: about ``count`` rows go to eval, whole groups only, lightly by label.

    A group's label is its one known label, mixed, or unknown.  Each label's share of ``count`` is rounded by largest
    remainder, at least 1 if there is room for all labels; groups in hash order go to eval until the share is reached."""
    known = F.nullif(F.col(label), F.lit(unknown))
    groups = rows.groupBy(group).agg(F.count("*").alias("_size"), F.min(known).alias("_lo"), F.max(known).alias("_hi"))
    groups = groups.withColumn("_label", F.when(F.col("_lo") < F.col("_hi"), "mixed").otherwise(F.coalesce("_lo", F.lit(unknown)))).drop("_lo", "_hi")
    shares = largest_shares(groups.groupBy("_label").agg(F.sum("_size").alias("n")), "_label", count)
    order = [F.asc("_h"), F.col(group).asc_nulls_last()]
    stood = running(groups.withColumn("_h", hash_key(seed, F.col(group))), ["_label"], order, {"_upto": F.col("_size")})
    split = F.when(F.col("_upto") - F.col("_size") < F.col("take"), "eval").otherwise("train")
    return with_totals(rows, [group], with_totals(stood, ["_label"], shares).select(group, split.alias("split")))


def matched_pairs(rows: DataFrame, signature: str, side: str, sides: tuple[str, str], seed: str, key: str, pairs: int) -> DataFrame:
    """(signature, place, first, second): the n-th row of one side with the n-th of the other within each signature, in hash
    order; ``pairs`` of them taken in turn from the signatures.  Rows without a signature or of another side are left out."""
    known = rows.filter(F.col(signature).isNotNull() & F.col(side).isin(*sides)).select(signature, side, key)
    stood = ranked(known, [signature, side], seed, key, "place").filter(F.col("place") <= pairs)
    one = lambda s, name: stood.filter(F.col(side) == s).select(signature, "place", F.col(key).alias(name))
    met = one(sides[0], "first").join(one(sides[1], "second"), [signature, "place"]).withColumn("_h", hash_key(seed, F.col(signature)))
    return placed(met, [], [F.asc("place"), F.asc("_h"), F.asc(signature)], "_at").filter(F.col("_at") <= pairs).drop("_at", "_h")


def subject_draw(tracks: DataFrame, group: str, key: str, score: str, secondary: Column, seed: str, primary_share: float) -> DataFrame:
    """(group, key, mode) a group: its best track (ties: the larger id), or with probability 1 - ``primary_share`` one of the
    other tracks that are ``secondary``, in proportion to their scores; the best where there is no other (mode fallback).

    Draws are hashes of group and key, so they repeat."""
    best = tracks.groupBy(group).agg(F.max_by(key, F.struct(score, key)).alias("_best"))
    pool = tracks.join(best, group).filter(F.coalesce(secondary, F.lit(False)) & (F.col(key) != F.col("_best"))).select(group, key, score)
    drawn = weighted_choice(pool, [group], key, score, seed).select(group, F.col(key).alias("_second"))
    unit = hash_unit(hash_key(seed, F.col(group)))
    mode = F.when(F.col("_second").isNull(), "fallback").when(unit < primary_share, "primary").otherwise("secondary")
    out = best.join(drawn, group, "left").withColumn("mode", mode)
    return out.select(group, F.when(F.col("mode") == "secondary", F.col("_second")).otherwise(F.col("_best")).alias(key), "mode")


def reserve(tracks: DataFrame, used: DataFrame, video: str, score: str, key: str) -> DataFrame:
    """The best track (ties: the least id) of each video that is not used yet."""
    free = tracks.join(used.select(video).distinct(), video, "left_anti")
    return free.groupBy(video).agg(F.max_by(F.struct(*[c for c in free.columns if c != video]), F.struct(score, -F.col(key))).alias("_r")).select(video, "_r.*")


def subset_faults(rows: DataFrame, wanted: DataFrame, key: str, side: str, sides: tuple[str, str], leaked: Column) -> dict[str, DataFrame]:
    """Offenders of a fixed subset, for ``expect``: rows of a key and side that repeat, keys that are missing, keys without both sides, rows that leak."""
    kept = rows.join(wanted.select(key).distinct(), key, "left_semi")
    # A key without rows stays in the outer join with no side.
    seen = wanted.select(key).distinct().join(kept.groupBy(key).agg(F.count_distinct(F.when(F.col(side).isin(*sides), F.col(side))).alias("_sides"), F.count("*").alias("_rows")), key, "left")
    return {
        "repeated": kept.groupBy(key, side).count().filter("count > 1"), "missing": seen.filter("_rows IS NULL"),
        "incomplete": seen.filter("_rows IS NOT NULL AND _sides < 2"), "leaking": kept.filter(F.coalesce(leaked, F.lit(False))),
    }


def editable(tracks: DataFrame, rules: DataFrame, key: str, kind: str, quality: str, weak: Column) -> DataFrame:
    """(key, operations, total): the operations a track's kind allows with quality x weight to six places and whether they are
    eligible or, where ``weak`` holds, for review only; tracks of another kind have none.  ``rules`` has kind, operation and weight, few a kind."""
    joined = tracks.join(sent(rules), kind, "left").withColumn("_w", F.round(F.col(quality) * F.col("weight"), 6))
    one = F.struct("operation", F.col("_w").alias("weight"), F.when(F.coalesce(weak, F.lit(False)), "review").otherwise("eligible").alias("status"))
    grouped = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("operation").isNotNull(), one))).alias("operations"), F.coalesce(F.round(F.sum("_w"), 6), F.lit(0.0)).alias("total"))
    return grouped.select(key, "operations", "total")


def offenders(rows: DataFrame, reason: str, key: str, most: int) -> DataFrame:
    """(reason, n, examples): how many rows each reason has, and its ``most`` least keys in order; null reasons are left out."""
    bad = rows.filter(F.col(reason).isNotNull())
    first = bad.withColumn("_rn", F.row_number().over(Window.partitionBy(reason).orderBy(key))).filter(F.col("_rn") <= most)
    shown = first.groupBy(reason).agg(F.array_sort(F.collect_list(key)).alias("examples"))
    return bad.groupBy(reason).agg(F.count("*").alias("n")).join(shown, reason).select(reason, "n", "examples")
