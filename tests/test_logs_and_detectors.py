"""Log records of several lines and detectors behind the table-valued interface."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import detector as N
from pulsegrid.sources import logs

RECORD = "[Time] block 1 load=0.50s x\n freq_ds+norm=1.25s dedisp=2.00s\n detect+save=3s total=7s z bursts={}\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("logs")
    (path / "s1_cupy_big_model.log").write_text("head\n" + RECORD.format(3) + "noise\n" + RECORD.format(4) + "[Done] total_bursts=1 total_time=2.5s avg_per_block=1s\n[Done] total_bursts=7 total_time=1.5s avg_per_block=0.5s\n")
    (path / "s2_cupy_big_model.log").write_text(RECORD.format(1) + "[Fail] x\n")
    (path / "s3_numba_m.log").write_text("[Info] 1\n[Time] broken load=x\n")
    (path / "s4_numba_m.log").write_text("[Done] total_bursts=0 total_time=9s avg_per_block=3s\nTraceback later\n")
    (path / "other.log").write_text(RECORD.format(1))
    return str(path)


def test_patterns_lose_their_names():
    assert logs.compiled(r"(?P<a>x)(y)(?P<b_c>z)(?P=a)") == (r"(x)(y)(z)\1", {"a": 1, "b_c": 3})


def test_fields_are_typed(spark):
    rows = spark.createDataFrame([("k=12 v=1.5",), ("k=12 v=.",), ("none",), (None,)], "s string")
    cells = logs.fields(F.col("s"), r"k=(?P<k>\d+) v=(?P<v>[0-9.]+)", {"k": "long", "v": "double"})
    assert [tuple(r) for r in rows.select(cells["k"].alias("k"), cells["v"].alias("v")).collect()] == [(12, 1.5), (12, None), (None, None), (None, None)]


def test_logs_are_summarised(spark, folder):
    rows = {r.section: r for r in logs.summarise(logs.read_records(spark, folder)).collect()}
    assert {k: (r.backend, r.model, r.status, r.blocks, r.total_time, r.total_bursts, r.block_bursts) for k, r in rows.items()} == {
        1: ("cupy", "big_model", "ok", 2, 1.5, 7, 7), 2: ("cupy", "big_model", "failed", 1, None, None, 1), 3: ("numba", "m", "missing_done", 0, None, None, 0), 4: ("numba", "m", "ok", 0, 9.0, 0, 0),
    }
    assert (rows[1].load_avg, rows[1].prepare_avg, rows[1].dedisp_avg, rows[1].detect_avg, rows[1].block_total_avg) == (0.5, 1.25, 2.0, 3.0, 7.0) and rows[3].load_avg == 0.0
    table = {(r.backend, r.model): (r.sections, r.wall_est, r.avg_block, r.avg_dedisp) for r in logs.matrix(logs.summarise(logs.read_records(spark, folder))).collect()}
    assert table == {("cupy", "big_model"): (1, 1.5, 0.5, 2.0), ("numba", "m"): (1, 9.0, 3.0, 0.0)}


def test_records_survive_small_splits(spark, tmp_path):
    (tmp_path / "s1_cupy_m.log").write_text("".join(RECORD.format(i % 5) for i in range(400)) + "[Done] total_bursts=1 total_time=5s avg_per_block=1s\n" + "[Done] total_bursts=2 total_time=6s avg_per_block=1s\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        records = logs.read_records(spark, str(tmp_path))
        assert records.rdd.getNumPartitions() > 3
        row = logs.summarise(records).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (row.blocks, row.block_bursts, row.total_time) == (400, 800, 6.0)


@pytest.fixture
def corners():
    class Corners:
        """A detector that gives boxes in the corner of each image whose mean exceeds the threshold."""

        def __call__(self, images):
            assert len(images) <= 2
            return images.mean((1, 2))

        def decode(self, raw, conf, iou):
            two = np.array([[0.0, 0, 4, 4], [0, 0, 4, 3]])
            return [(np.array([m] * 2)[: 1 if iou < 0.7 else 2], two[: 1 if iou < 0.7 else 2]) if m > conf else (np.zeros(0), np.zeros((0, 4))) for m in raw]

    return Corners  # a class of its own here goes to the workers as it is


def test_any_detector_can_stand_behind_the_table(spark, corners):
    rows = [(i, 4, 4, [float(i)] * 16) for i in range(5)] + [(9, 2, 3, [7.0] * 6), (10, 4, 4, None), (None, 4, 4, [3.0] * 16)]
    images = spark.createDataFrame(rows, "image long, width int, height int, pixels array<double>").coalesce(1)
    found = N.detect(images, "corners", corners, 2.0, 0.5, batch=2).collect()
    assert sorted((str(r.image), r["rank"], r.score) for r in found) == [("3", 1, 3.0), ("4", 1, 4.0), ("9", 1, 7.0), ("None", 1, 3.0)]
    assert N.detect(images, "corners", corners, 2.0, 0.9, batch=2).count() == 8 and N.detect(images.limit(0), "corners", corners, 2.0, 0.5).count() == 0


def test_a_detector_is_loaded_once(corners):
    made = []
    for _ in range(3):
        N.loaded("one of its own", lambda: made.append(1) or corners())
    assert made == [1]


def test_peaks_and_overlaps():
    image = np.zeros((1, 8, 8))
    image[0, 2, 2], image[0, 2, 3], image[0, 5, 6], image[0, 6, 2] = 9, 8, 7, 7
    model = N.PeakDetector(3, 1.0, 3.0, lambda v: (np.zeros(len(v)), np.full(len(v), 0.5)))
    (scores, boxes), = model.decode(model(image), 1.0, 0.3)
    assert scores.tolist() == [9, 7, 7] and boxes[0].tolist() == [0.5, 1.0, 3.0, 3.0] and boxes[1, 0] == 4.5
    assert N.strongest(np.array([3, 2, 1]), np.array([[0.0, 0, 4, 4], [1, 0, 4, 4], [3, 0, 4, 4]]), 0.5).tolist() == [0, 2]
    assert N.overlap(np.zeros(4), np.zeros((1, 4))).tolist() == [0.0]
