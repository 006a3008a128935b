import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import training as R


def test_all_violations_are_listed():
    assert R.SearchConfig().violations() == []
    with pytest.raises(ValueError, match="dm_span must be a multiple of 512; dm_span must not exceed dm_range; det_prob must be below 1"):
        R.SearchConfig(dm_span=5000, dm_stride=512, det_prob=1.0).checked()


def test_clipping_after_each_pulse_differs_from_clipping_once(spark):
    base = spark.createDataFrame([(0, 200.0), (1, 10.0)], "t long, v double")
    pulses = spark.createDataFrame([(0, 2, -50.0), (0, 1, 100.0)], "t long, ord long, add double")
    assert {r.t: r.v for r in R.fold_clipped(base, pulses).collect()} == {0: 205.0, 1: 10.0}


def test_tail_is_filled(spark):
    series = spark.createDataFrame([(c, t, float(t % 3 + 10 * c)) for c in (0, 1) for t in range(10 + 2 * c)], "chan int, t long, v double")
    out = {(r.chan, r.y): r.v for r in R.ragged_pool(series, 4, ["chan"]).collect()}
    assert out[0, 0] == 0.75 and set(out) == {(c, y) for c in (0, 1) for y in (0, 1, 2)} and 0 <= out[0, 2] <= 2.5
    assert [out[1, y] for y in (0, 1, 2)] == [10.75, 11.0, 11.25]  # a whole number of means is left as it is


def test_interference_is_seeded_and_scores_are_shares(spark):
    rows = [(i, y, x, float((i + y * x) % 7)) for i in range(4) for y in range(8) for x in range(8)]
    images = spark.createDataFrame(rows, "image long, py int, px int, v double")
    a, b = (sorted(map(tuple, R.with_interference(images, 8, seed=3).collect())) for _ in range(2))
    assert a == b and len(a) == 256
    scores = R.score_images(R.gather_images(images, 8), R.matched_filter_model(np.arange(64.0).reshape(8, 8)), 8, batch=3).collect()
    assert len(scores) == 4 and all(0 < r.score < 1 for r in scores)
    assert R.gather_images(images, 8).where("image = 1").first().img[9] == (1 + 1 * 1) % 7


def test_catalogues(spark):
    images = spark.createDataFrame([(1,), (2,)], "image long")
    boxes = spark.createDataFrame([(1, 4.0, 9.0, 0, 0), (1, 0.5, 9.0, 0, 0)], "image long, w double, h double, left int, top int")
    assert {(r.image, r.n_boxes, r.min_box) for r in R.detector_catalogue(images, boxes).collect()} == {(1, 1, 6.0), (2, 0, float("inf"))}
    assert {r.image: r.boxes for r in R.annotations_or_placeholder(images, boxes.where("w > 1")).collect()}[2] == "-1,-1,-1,-1"
    weights = spark.createDataFrame([(0, 99.0), (1, 99.0), (2, 3.0), (4, 99.0)], "n int, m double").select(R.box_weight(F.col("n"), F.col("m")).alias("w"))
    assert [r.w for r in weights.collect()] == [1, 3, 10, 8]
