"""Exact quantiles, ranks and detector scores against plain sorting."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.operators import metrics as A
from pulsegrid.operators import quantiles as Q


def test_quantiles_equal_numpy(spark):
    rnd = np.random.default_rng(2)
    groups = {
        "wide": np.exp(rnd.normal(0, 40, 900)) * rnd.choice([-1, 1], 900), "ties": rnd.integers(0, 3, 500).astype(float), "one": np.array([7.5]), "two": np.array([1.0, 2.0]),
        "same": np.full(50, -3.0), "far": np.array([-1.7e308, 1.0, 1.7e308, 2.0]), None: rnd.normal(size=77),
    }
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("one", None), ("one", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("_v", F.lit("x"))
    shares = (0.0, 0.1, 0.5, 0.5, 0.95, 1.0)
    got = {r.k: (r.n, r.q) for r in Q.exact_quantiles(df, ["k"], "v", shares).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k][0] == len(x) and got[k][1] == pytest.approx(np.percentile(x, [100 * s for s in shares]).tolist(), rel=1e-12)
    assert Q.exact_quantiles(df.limit(0), ["k"], "v", shares).count() == 0
    assert [r.q for r in Q.exact_quantiles(df.where("k = 'ties'"), [], "v", (0.5,)).collect()] == [[float(np.median(groups["ties"]))]]


def plain_score(rows, n_truth, reach):
    """The same by one sort of all rows (id, conf, tp, distance)."""
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    if not order or not n_truth:
        return dict(precision=0.0, recall=0.0, p90_center_dist=reach, center_quality=0.0, score=0.0)
    tp = np.cumsum([r[2] for r in order])
    k = np.arange(1, len(order) + 1)
    p, r = tp / (k + 1e-8), tp / n_truth
    best = int(np.argmax(np.round(0.5 * r + 0.2 * p, 12)))
    d = [x[3] for x in order[: best + 1] if x[2] and x[3] is not None]
    p90 = float(np.percentile(d, 90)) if d else reach
    quality = max(0.0, 1 - p90 / reach) if d else 0.0
    return dict(precision=p[best], recall=r[best], p90_center_dist=p90, center_quality=quality, score=0.5 * r[best] + 0.2 * p[best] + 0.3 * quality)


@pytest.mark.parametrize("case", ["usual", "ties", "nulls", "no true positive", "no truth", "nothing"])
def test_detector_score(spark, case):
    rnd = np.random.default_rng(len(case))
    rows = [(i, float(rnd.integers(0, 3) if case == "ties" else rnd.random()), int(rnd.random() < 0.4), float(rnd.random() * 8)) for i in range(120)]
    if case == "nulls":
        rows = [(i, None if i % 5 == 0 else c, t, None if i % 7 == 0 else d) for i, c, t, d in rows]
    if case == "no true positive":
        rows = [(i, c, 0, None) for i, c, *_ in rows]
    rows, n_truth = ([] if case == "nothing" else rows), 0 if case == "no truth" else 70
    got = A.detector_score(spark.createDataFrame(rows, "id long, conf double, tp int, distance double"), n_truth, 8.0).first().asDict()
    want = plain_score(rows, n_truth, 8.0)
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_ranks_with_nulls_and_one_frequent_confidence(spark):
    rows = [(i, 5.0 if i % 3 else (None if i % 2 else float(i)), i % 2) for i in range(200)]
    got = {r.id: (r["rank"], r.cum_tp) for r in A.pr_curve(spark.createDataFrame(rows, "id long, conf double, tp int")).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    cum = np.cumsum([r[2] for r in order])
    assert got == {r[0]: (k, cum[k - 1]) for k, r in enumerate(order, 1)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, 1.0, 2.0, 3.5]), st.integers(0, 1)), max_size=30))
def test_ranks_of_any_rows(spark, pairs):
    rows = [(i, c, t) for i, (c, t) in enumerate(pairs)]
    got = sorted((r["rank"], r.id) for r in A.ranked_by_confidence(spark.createDataFrame(rows, "id long, conf double, tp int")).collect())
    assert [i for _, i in got] == [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]


def test_cells_answer_every_threshold(spark):
    hist = spark.createDataFrame([("dm", "raw8", 300, 0, 1, 5), ("dm", "raw8", 301, 0, 1, 2), ("dm", "packed2", 900, 7, 6, 1), ("dm", "other", 900, 7, 6, 1), ("dm", "raw8", 900, None, 6, 1)], "parameter string, quant string, sigma_centi int, snr_bin int, param_bin int, n long")
    cells = A.cells_by_threshold(hist, [3.0, 3.001, 9.5], {"dm": A.DM_BINS}).collect()
    assert len(cells) == 3 * 2 * 7 * 8 and all(r.n_fp == 0 for r in cells if (r.quant, r.param_bin, r.snr_bin) not in (("raw8", 1, 0), ("packed2", 6, 7)))
    assert {r.threshold: r.n_fp for r in cells if (r.quant, r.param_bin, r.snr_bin) == ("raw8", 1, 0)} == {3.0: 7, 3.001: 2, 9.5: 0}
    assert all(r.n_fp == 0 for r in A.cells_by_threshold(hist.limit(0), [3.0], {"dm": A.DM_BINS}).collect())
