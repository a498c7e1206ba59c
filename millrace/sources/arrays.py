"""NumPy archives as tables: mask tubes (a raster per frame) and feature tensors, validated as they are read."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASKS = "path string, frame int, height int, width int, area long, x1 int, y1 int, x2 int, y2 int, error string"


def mask_rows(path: str, content: bytes) -> list[dict]:
    """One row a frame with the mask's area and bounding box (x2, y2 exclusive), or one row that says what is wrong.

    A tube holds frame_indices (strictly increasing integers) and masks (frames x height x width); a tube with an empty mask is not valid."""
    try:
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            frames, masks = z["frame_indices"], z["masks"]
        if frames.ndim != 1 or not np.issubdtype(frames.dtype, np.integer) or (np.diff(frames) <= 0).any():
            raise ValueError("frame_indices must be strictly increasing integers")
        if masks.ndim != 3 or len(masks) != len(frames) or not len(frames):
            raise ValueError("masks must be frames x height x width")
        if not masks.any(axis=(1, 2)).all():
            raise ValueError("a mask is empty")
    except (ValueError, KeyError, OSError) as e:
        return [dict.fromkeys(("frame", "height", "width", "area", "x1", "y1", "x2", "y2")) | {"path": path, "error": str(e).strip("'")[:200]}]
    rows = []
    for f, m in zip(frames.tolist(), masks > 0, strict=True):
        ys, xs = np.flatnonzero(m.any(1)), np.flatnonzero(m.any(0))
        rows.append({"path": path, "frame": f, "height": m.shape[0], "width": m.shape[1], "area": int(m.sum()), "x1": int(xs[0]), "y1": int(ys[0]), "x2": int(xs[-1]) + 1, "y2": int(ys[-1]) + 1, "error": None})
    return rows


def mask_tubes(spark: SparkSession, path: str) -> DataFrame:
    """A row per frame of every .npz below ``path``; rasters are reduced where they are read and never shuffled."""
    fields = pa.schema([("path", pa.string()), *((n, pa.int64() if n == "area" else pa.int32()) for n in ("frame", "height", "width", "area", "x1", "y1", "x2", "y2")), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column(0), b.column(1), strict=True):
                yield pa.RecordBatch.from_pylist(mask_rows(p.as_py(), c.as_py()), schema=fields)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(path)
    return files.select("path", "content").mapInArrow(run, MASKS)


def nearest_mask(times: DataFrame, masks: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """For each requested ``time`` the mask of its key nearest in ``mask_time``, if within 0.51 / fps; ties go to the earlier."""
    reach = 0.51 / fps
    cell = lambda c: F.floor(c / reach)
    m = masks.withColumn("_cell", F.explode(F.array(*[cell(F.col("mask_time")) + d for d in (-1, 0, 1)])))
    far = F.abs(F.col("time") - F.col("mask_time"))
    near = times.withColumn("_cell", cell(F.col("time"))).join(m, [*keys, "_cell"]).filter(far <= reach)
    best = near.groupBy(*keys, "time").agg(F.min(F.struct(far.alias("d"), "mask_time", "area")).alias("_b"))
    return times.join(best, [*keys, "time"], "left").select(*keys, "time", "_b.mask_time", "_b.area")


def top_fraction_mean(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """Mean of the largest ceil(n x share) values of each group (one at least), through counts per value."""
    from pyspark.sql import Window

    steps = rows.groupBy(*by, value).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*by).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"_n": F.sum("_c").over(Window.partitionBy(*by)), "_seen": F.sum("_c").over(upto)})
    take = F.greatest(F.ceil(F.col("_n") * share), F.lit(1))
    used = F.greatest(F.least(F.col("_c"), take - (F.col("_seen") - F.col("_c"))), F.lit(0))
    return steps.groupBy(*by).agg((F.sum(used * F.col(value)) / F.sum(used)).alias("top_mean"))


def pointing_and_iou(rows: DataFrame, by: list[str], score: str, truth: Column, threshold: float) -> DataFrame:
    """Per group of patches: does the best-scored patch (first on ties, by ``patch``) lie in the truth, and IoU of score >= threshold with it."""
    hot = F.col(score) >= threshold
    return rows.groupBy(*by).agg(
        F.max_by(truth, F.struct(F.col(score), (-F.col("patch")).alias("n"))).alias("hit"),
        F.coalesce(F.try_divide(F.count_if(hot & truth).cast("double"), F.count_if(hot | truth)), F.lit(0.0)).alias("iou"),
    )
