import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import signal

P = "struct<height:int,width:int,data:array<double>>"


def picture(a):
    return {"height": a.shape[0], "width": a.shape[1], "data": a.reshape(-1).tolist()}


def test_measures_equal_plain_numpy():
    rng = np.random.default_rng(5)
    real, mask = rng.random((6, 9, 3)), (rng.random((6, 9)) > 0.7)
    fake = real + mask[..., None] * 0.3 + rng.random((6, 9, 3)) * 0.01
    off = np.abs(fake - real).mean(axis=2)
    region, failure, inside, outside, same, area = signal.measure(picture(real), picture(fake), picture(mask.astype(float)), None)
    assert (region, failure) == ("mask", None) and inside == pytest.approx(off[mask].mean()) and outside == pytest.approx(off[~mask].mean())
    assert same == pytest.approx((off[~mask] <= 2 / 255).mean()) and area == pytest.approx(mask.mean())


def test_masks_are_resized_and_boxes_stand_in():
    a, b = np.zeros((4, 4)), np.ones((4, 4))
    small = picture(np.array([[1.0, 0.0], [0.0, 0.0]]))
    assert signal.measure(picture(a), picture(b), small, None)[5] == 0.25
    assert signal.measure(picture(a), picture(b), None, [0, 0, 500, 250])[5] == pytest.approx(2 / 16)
    assert signal.measure(picture(a), picture(b), None, [500, 500, 0, 0])[5] == pytest.approx(1 / 16)  # an empty box is a pixel
    assert signal.measure(picture(a), picture(b), None, None)[1] == "missing_true_mask" and signal.measure(picture(a), picture(b), {"height": 2, "width": 2, "data": [1.0]}, None)[1] == "invalid_mask"


def test_failures_and_means_by_pair(spark):
    a, b, m, none = np.zeros((2, 2)), np.full((2, 2), 0.5), picture(np.array([[1.0, 0.0], [0.0, 0.0]])), picture(np.zeros((2, 2)))
    rows = [
        ("whole", 0, picture(a), picture(b), m, None), ("whole", 1, picture(a), picture(b), none, None), ("empty", 0, picture(a), picture(b), none, None),
        ("shape", 0, picture(a), picture(b), m, None), ("shape", 1, picture(a), picture(np.zeros((1, 4))), m, None), ("gone", 0, None, picture(b), m, None),
        ("nan", 0, picture(a), picture(np.full((2, 2), np.nan)), m, None), (None, 0, picture(a), picture(a), m, None),
    ]
    df = spark.createDataFrame(rows, f"pair string, frame int, a {P}, b {P}, m {P}, box array<double>")
    frames = signal.frame_differences(df, ["pair", "frame"], F.col("a"), F.col("b"), F.col("m"), F.col("box"))
    got = {r.pair: r for r in signal.pair_differences(frames, ["pair"], "frame").collect()}
    assert {k: r.failure for k, r in got.items()} == {"whole": None, "empty": "no_valid_masked_frames", "shape": "shape_mismatch", "gone": "frame_missing", "nan": "frame_not_readable", None: None}
    assert (got["whole"].frames, got["whole"].inside, got["whole"].outside, got["whole"].ratio) == (1, 0.5, 0.5, 1.0)
    assert (got["shape"].frames, got["shape"].inside, got[None].ratio) == (0, None, 0.0)
    assert signal.pair_differences(signal.frame_differences(df.limit(0), ["pair", "frame"], F.col("a"), F.col("b"), F.col("m"), F.col("box")), ["pair"], "frame").count() == 0
