import io

import numpy as np
from pyspark.sql import functions as F

from millrace.sources import arrays


def tube(frames, masks):
    out = io.BytesIO()
    np.savez(out, frame_indices=np.array(frames, np.int32), masks=np.array(masks, np.uint8))
    return out.getvalue()


def test_mask_tubes(spark, tmp_path):
    m = np.zeros((2, 10, 12), np.uint8)
    m[0, 2:5, 3:7] = 1
    m[1, 9, 11] = 255
    (tmp_path / "a.npz").write_bytes(tube([3, 8], m))
    (tmp_path / "order.npz").write_bytes(tube([8, 3], m))
    (tmp_path / "empty.npz").write_bytes(tube([1, 2], np.stack([m[0], np.zeros_like(m[0])])))
    (tmp_path / "bad.npz").write_bytes(b"no archive")
    rows = arrays.mask_tubes(spark, str(tmp_path)).collect()
    good = sorted((r.frame, r.area, r.x1, r.y1, r.x2, r.y2) for r in rows if r.error is None)
    assert good == [(3, 12, 3, 2, 7, 5), (8, 1, 11, 9, 12, 10)]
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in rows if r.error}
    assert "increasing" in errors["order.npz"] and "empty" in errors["empty.npz"] and "bad.npz" in errors and len(errors) == 3


def test_nearest_mask_in_time(spark):
    times = spark.createDataFrame([("v", 0.0), ("v", 0.26), ("v", 0.5), ("w", 0.0)], "video string, time double")
    masks = spark.createDataFrame([("v", 0.0, 1), ("v", 0.2, 2), ("v", 0.8, 3)], "video string, mask_time double, area int")
    got = {(r.video, r.time): r.area for r in arrays.nearest_mask(times, masks, ["video"], 5.0).collect()}
    assert got == {("v", 0.0): 1, ("v", 0.26): 2, ("v", 0.5): None, ("w", 0.0): None}


def test_patch_scores(spark):
    df = spark.createDataFrame([("a", i, s, t) for i, (s, t) in enumerate([(0.9, 1), (0.9, 0), (0.2, 1), (0.1, 0)])], "k string, patch int, s double, t int")
    r = arrays.pointing_and_iou(df, ["k"], "s", F.col("t") == 1, 0.5).first()
    assert r.hit is True and r.iou == 1 / 3
    assert arrays.top_fraction_mean(df, ["k"], "s", 0.5).first().top_mean == 0.9
    assert abs(arrays.top_fraction_mean(df, ["k"], "s", 0.75).first().top_mean - 2.0 / 3) < 1e-9
