"""How far two versions of a picture differ inside a region and outside it, frame by frame and by pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A difference of up to so many of 255 steps counts as identical.
IDENTICAL = 2.0 / 255.0
MEASURES = "region string, failure string, inside double, outside double, identity double, area double"


def nearest_places(have: int, want: int) -> np.ndarray:
    """For each of ``want`` cells the one of ``have`` cells under its middle."""
    return np.minimum(((np.arange(want) + 0.5) * have / want).astype(int), have - 1)


def region_of(mask: dict | None, box: list | None, height: int, width: int) -> tuple[str | None, np.ndarray | None, str | None]:
    """(region, raster, failure): the mask brought to the picture's size, else the box of 0..1000 coordinates, else nothing."""
    if mask is not None:
        data = np.asarray(mask["data"] or [], dtype=float)
        h, w = mask["height"] or 0, mask["width"] or 0
        if h <= 0 or w <= 0 or data.size != h * w:
            return None, None, "invalid_mask"
        raster = data.reshape(h, w) > 0
        return "mask", raster[np.ix_(nearest_places(h, height), nearest_places(w, width))], None
    if box is None or len(box) != 4 or any(v is None for v in box):
        return None, None, "missing_true_mask"
    left, top = (max(0, min(size, round(v * size / 1000))) for v, size in ((box[0], width), (box[1], height)))
    right, bottom = (max(low + 1, min(size, round(v * size / 1000))) for v, size, low in ((box[2], width, left), (box[3], height, top)))
    raster = np.zeros((height, width), dtype=bool)
    raster[top:bottom, left:right] = True
    return "box", raster, None


def measure(real: dict | None, fake: dict | None, mask: dict | None, box: list | None) -> tuple:
    """One frame's values of ``MEASURES``; a region that is empty or the whole picture has nulls and no failure."""
    pictures = []
    for p in (real, fake):
        if p is None or p["data"] is None or not p["height"] or not p["width"]:
            return None, "frame_missing", None, None, None, None
        data = np.asarray(p["data"], dtype=float)
        if not data.size or data.size % (p["height"] * p["width"]) or not np.isfinite(data).all():
            return None, "frame_not_readable", None, None, None, None
        pictures.append(data.reshape(p["height"], p["width"], -1))
    if pictures[0].shape != pictures[1].shape:
        return None, "shape_mismatch", None, None, None, None
    region, raster, failure = region_of(mask, box, *pictures[0].shape[:2])
    if failure:
        return region, failure, None, None, None, None
    if not raster.any() or raster.all():
        return region, None, None, None, None, None
    off = np.abs(pictures[1] - pictures[0]).mean(axis=2)
    rest = off[~raster]
    return region, None, float(off[raster].mean()), float(rest.mean()), float((rest <= IDENTICAL).mean()), float(raster.mean())


def frame_differences(frames: DataFrame, keys: list[str], real: Column, fake: Column, mask: Column, box: Column) -> DataFrame:
    """``keys`` and for each row region, failure, inside, outside, identity and area.

    Pictures are structs (height, width, data: rows of pixels of one or more channels from 0 to 1), masks likewise with one
    channel (above 0: inside), boxes arrays x1, y1, x2, y2 of 0..1000 that stand in for a null mask.  Inside and outside are mean
    absolute differences over channels and pixels, identity the share of outside pixels that hardly differ, area the share of inside
    pixels.  Rows are independent: nothing is shuffled, pixels never leave their task, and a task works on one row at a time."""
    picture = "struct<height:int,width:int,data:array<double>>"
    given = [real.cast(picture), fake.cast(picture), mask.cast(picture), box.cast("array<double>")]
    source = frames.select(*keys, *[c.alias(f"_{i}") for i, c in enumerate(given)])
    schema = T.StructType([*source.schema[: len(keys)], *T.StructType.fromDDL(MEASURES)])
    types = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measure(*(b.column(len(keys) + i)[r].as_py() for i in range(4))) for r in range(b.num_rows)]
            made = [pa.array([f[i] for f in found], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *made], names=schema.names)

    return source.mapInArrow(run, schema)


def pair_differences(frames: DataFrame, by: list[str], order: str) -> DataFrame:
    """``by`` with ok, failure, region, frames (measured ones) and the means over these: inside, outside, ratio, identity, area.

    A pair fails with its first frame (by ``order``) that does, or where no frame has both an inside and an outside."""
    means = [F.avg(c).alias(c) for c in ("inside", "outside", "identity", "area")]
    first = F.min(F.when(F.col("failure").isNotNull(), F.struct(F.col(order).alias("o"), F.col("failure").alias("f"))))["f"]
    x = frames.groupBy(*by).agg(first.alias("_f"), F.max("region").alias("region"), F.count("inside").alias("frames"), *means)
    failure = F.coalesce("_f", F.when(F.col("frames") == 0, "no_valid_masked_frames"))
    x = x.withColumn("failure", failure).withColumn("ok", F.col("failure").isNull())
    kept = [F.when(F.col("ok"), F.col(c)).alias(c) for c in ("inside", "outside", "identity", "area")]
    ratio = F.when(F.col("ok"), F.col("inside") / F.greatest("outside", F.lit(1e-8))).alias("ratio")
    return x.select(*by, "ok", "failure", "region", F.when(F.col("ok"), F.col("frames")).otherwise(0).alias("frames"), *kept, ratio)
