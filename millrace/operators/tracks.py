"""Operators on frame-level records of tracked objects: folding, statistics, overlap, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom


def fold_packets(packets: DataFrame, track: list[str], frame: str, order: str) -> DataFrame:
    """One row per track and frame: the packet that came last."""
    whole = F.struct(*packets.columns)
    return packets.groupBy(*track, frame).agg(F.max_by(whole, order).alias("_p")).select("_p.*")


def track_stats(frames: DataFrame, track: list[str], frame: str, area: str, score: str, span: Column | None = None) -> DataFrame:
    """Per track: frames, area median, mean and population deviation, visible share of its frame span, mean score, key frame.

    The key frame is the first of largest area.  ``span`` may state how many frames the track was looked for in."""
    looked = span if span is not None else F.max(frame) - F.min(frame) + 1
    return frames.groupBy(*track).agg(
        F.count("*").alias("frames"), F.median(area).alias("area_median"), F.avg(area).alias("area_mean"), F.stddev_pop(area).alias("area_std"),
        F.percentile(area, F.lit(0.2)).alias("area_p20"), (F.count("*") / looked).alias("visible_ratio"), F.avg(score).alias("score_mean"),
        F.min(F.struct((-F.col(area)).alias("_a"), F.col(frame)))[frame].alias("key_frame"),
    )


def union_box(frames: DataFrame, track: list[str], box: str) -> DataFrame:
    b = F.col(box)
    return frames.groupBy(*track).agg(F.struct(F.min(b["x1"]).alias("x1"), F.min(b["y1"]).alias("y1"), F.max(b["x2"]).alias("x2"), F.max(b["y2"]).alias("y2")).alias("union_box"))


def overlap_with_primary(frames: DataFrame, group: str, track: str, frame: str, box: str, primary: DataFrame, iou: float = 0.7, inside: float = 0.8) -> DataFrame:
    """(group, track, median_iou, median_inside, duplicate) of the tracks that share frames with their group's primary track.

    A track without a common frame is no duplicate and has no row."""
    main = primary.select(group, F.col(track).alias("_primary"))
    at = frames.join(main, group)
    left = at.filter(F.col(track) != F.col("_primary")).select(group, track, frame, F.col(box).alias("_b"))
    right = at.filter(F.col(track) == F.col("_primary")).select(group, frame, F.col(box).alias("_p"))
    common = left.join(right, [group, frame]).withColumns({"_i": geom.iou(F.col("_b"), F.col("_p")), "_c": geom.containment(F.col("_b"), F.col("_p"))})
    out = common.groupBy(group, track).agg(F.median("_i").alias("median_iou"), F.median("_c").alias("median_inside"))
    return out.withColumn("duplicate", (F.col("median_iou") >= iou) | (F.col("median_inside") >= inside))


def reference_frame(frames: DataFrame, track: list[str], frame: str, box: str, side: float = 1000.0) -> DataFrame:
    """The best frame of each track: 4 x area share + margin to the border + stability against both neighbours (0.5 where there is none); the first of equal ones."""
    w = Window.partitionBy(*track).orderBy(frame)
    b = F.col(box)
    margin = F.least(b["x1"], b["y1"], F.lit(side) - b["x2"], F.lit(side) - b["y2"]) / side
    near = [F.when(n.isNull(), 0.5).otherwise(geom.iou(b, n)) for n in (F.lag(box).over(w), F.lead(box).over(w))]
    steady = (near[0] + near[1]) / 2
    scored = frames.withColumn("_s", F.round(4 * geom.area(b) / (side * side) + margin + steady, 9)).filter(geom.area(b) > 0)
    best = scored.groupBy(*track).agg(F.max(F.struct("_s", (-F.col(frame)).alias("_n"))).alias("_b"))
    return best.select(*track, (-F.col("_b._n")).alias(frame), F.col("_b._s").alias("score"))


def label_votes(votes: DataFrame, key: str, label: str, count: str, groups: DataFrame, most: int = 8) -> DataFrame:
    """(key, group, label, votes): the winner of each label group by votes, then priority; at most ``most`` groups a key, by votes.

    ``groups`` has (label, group, priority) and is a small fixed vocabulary."""
    tally = votes.groupBy(key, label).agg(F.sum(count).cast("long").alias("votes")).join(F.broadcast(groups), label)
    win = tally.groupBy(key, "group").agg(F.max(F.struct("votes", "priority", label)).alias("_w")).select(key, "group", f"_w.{label}", "_w.votes", "_w.priority")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("votes"), F.desc("priority"), "group"))
    return win.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r", "priority")


def rollup_status(rows: DataFrame, key: str, status: str) -> DataFrame:
    """success if any row is, else no_track if any row is, else failure."""
    s = F.col(status)
    return rows.groupBy(key).agg(F.when(F.bool_or(s == "success"), "success").when(F.bool_or(s == "no_track"), "no_track").otherwise("failure").alias("status"), F.count("*").alias("n"))


def select_subjects(tracks: DataFrame, group: str, track: str, score: str, eligible: str) -> DataFrame:
    """(group, track, state): primary is the best eligible track, else the best at all (fallback_primary); other eligible ones are secondary."""
    best = Window.partitionBy(group).orderBy(F.desc(eligible), F.desc(score), track)
    first = F.row_number().over(best) == 1
    return tracks.select(group, track, F.when(first & F.col(eligible), "primary").when(first, "fallback_primary").when(F.col(eligible), "secondary").otherwise("ineligible").alias("state"))
