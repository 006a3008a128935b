"""Small cases of the other operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import catalog as C
from pulsegrid.operators import dedisperse as D
from pulsegrid.operators import images as I
from pulsegrid.operators import metrics as A
from pulsegrid.operators import sampling as P
from pulsegrid.operators import signals as S
from pulsegrid.operators import training as T


@pytest.fixture
def spectrum(spark):
    random = np.random.default_rng(1)
    v = random.integers(-50, 50, (40, 16))
    return v, spark.createDataFrame([(t, c, int(v[t, c])) for t in range(40) for c in range(16)], "t long, chan int, v long")


def test_dedispersion_equals_numpy_in_both_forms(spark, spectrum):
    v, frame = spectrum
    obs = D.Observation(n_chan=16, n_dm=5, dm_scale=60.0, dt_s=0.05)
    shifts = obs.shifts(spark)
    table = {(r.dm, r.chan): (r.idx, r.shift) for r in shifts.collect()}
    split = obs.n_kept // 2
    want = {}
    for (dm, c), (idx, s) in table.items():
        for y in range(40 - s):
            cell = want.setdefault((dm, y), [0, 0, 0])
            cell[0] += int(v[y + s, c])
            cell[1 if idx <= split else 2] += int(v[y + s, c])
    for got in (D.dedisperse(frame, shifts, split), D.dedisperse_blocks(frame, shifts, split, block=7)):
        assert {(r.dm, r.y): [r.v_full, r.v_lower, r.v_upper] for r in got.collect()} == want


def test_window_starts_end_with_the_range():
    assert D.window_starts(32, 16, 6) == [0, 6, 12, 16] and D.window_starts(32, 16, 16) == [0, 16] and D.window_starts(8, 16, 4) == [0]


def test_kth_value_is_rounded_half_to_even(spark):
    n = spark.range(1).select(I.order_index(F.lit(150), 0.995).alias("k"), I.order_index(F.lit(10), 0.01).alias("one")).first()
    assert (n.k, n.one) == (149, 1)


def test_constant_image_scales_to_zero(spark):
    flat = spark.createDataFrame([(0, y, x, 5) for y in range(3) for x in range(3)], "image long, py int, px int, v long")
    assert {r.scaled for r in I.kth_clip_minmax(flat).collect()} == {0.0}
    assert I.peaks(flat, 0).count() == 9  # a plateau keeps all ties


def test_bins(spark):
    values = spark.createDataFrame([(5.0,), (7.0,), (100.0,), (4.9,), (100.1,), (None,)], "v double")
    assert [r.b for r in values.select(A.bin_index(F.col("v"), A.SNR_BINS).alias("b")).collect()] == [0, 1, 7, None, None, None]
    hits = spark.createDataFrame([(100.0, True)], "dm double, detected boolean")
    assert [r.n_total for r in A.recall_by_bin(hits, "dm", A.DM_BINS).orderBy("bin").collect()] == [1, 0, 0, 0, 0, 0, 0]


def test_pack_and_unpack_round_trip(spark):
    levels = spark.createDataFrame([(t, 0, t * 7 % 4) for t in range(10)], "t long, chan int, level int")
    back = {r.t: r.level for r in S.unpack_2bit(S.pack_2bit(levels)).collect()}
    assert back == {t: t * 7 % 4 if t < 10 else 0 for t in range(12)}


def test_intervals_that_touch_merge(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 9, 10), ("a", 1, 2), ("b", 0, 1)], "k string, lo long, hi long")
    assert sorted((r.k, r.lo, r.hi, r.n) for r in S.merge_intervals(rows, ["k"]).collect()) == [("a", 0, 7, 3), ("a", 9, 10, 1), ("b", 0, 1, 1)]


def test_erfcx_matches_known_values():
    assert np.allclose(S.erfcx(np.array([0.0, 1.0, -1.0, 5.0, 1.999, 2.001])), [1.0, 0.427583576, 5.008980081, 0.110704638, 0.25550, 0.25529], rtol=1e-3)


def test_scattered_pulse_without_tail_is_a_gaussian():
    t = np.linspace(-5, 5, 21)
    assert np.allclose(S.scattered_pulse(t, 1.0, 0.0), np.exp(-0.5 * t**2))
    tail = S.scattered_pulse(np.linspace(-20, 60, 801), 2.0, 8.0)
    assert abs(tail.max() - 1) < 0.01 and tail[-1] < 0.02 and tail[0] < 1e-6


def test_sampling(spark):
    rows = spark.range(200).select(F.col("id").alias("injection_id"))
    units = P.latin_hypercube(rows, "injection_id", 2).toPandas()
    for u in ("u0", "u1"):
        assert sorted(np.floor(units[u] * 200).astype(int)) == list(range(200))
    placed = P.place_arrivals(np.array([0.1, 0.1, 9.9, 5.0]), 0.5, 10.0, 0.25)
    assert np.diff(np.sort(placed)).min() >= 0.25 - 1e-9 and placed.min() >= 0.5 and placed.max() <= 9.5
    with pytest.raises(ValueError):
        P.place_arrivals(np.zeros(100), 0.5, 2.0, 0.25)
    ranked = P.ranked_by_hash(rows.withColumn("label", F.col("injection_id") % 3), ["label"], F.col("injection_id")).toPandas()
    assert all(sorted(g["rank"]) == list(range(1, len(g) + 1)) and (g["n"] == len(g)).all() for _, g in ranked.groupby("label"))
    sizes = spark.createDataFrame([("a", 5), ("b", 5), ("c", 0)], "g string, n long")
    assert {r.g: r.split for r in P.group_split(sizes, "g", "n", 1.0).collect()} == {"a": "train", "b": "train", "c": "val"}


def test_singlepulse_lines(spark):
    lines = ["# dm sigma", "", "10 5 0.1 7", "10 x 0.1 7 2", "10 nan 0.1 7 2", "10 5.5 0.1 7 2", "10 5.5 0.1 99 2"]
    got = C.parse_singlepulse(spark.createDataFrame([(x,) for x in lines], "line string"), 5, 50).collect()
    assert [(r.dm, r.sigma, r.sample, r.center_sample) for r in got] == [(10.0, 5.5, 7, 2)]


def test_sections_and_flags(spark):
    assert [r.t for r in spark.createDataFrame([("True",), (" yes",), ("0",), (None,)], "x string").select(C.truthy(F.col("x")).alias("t")).collect()] == [True, True, False, None]
    files = spark.createDataFrame([("s", f"f{i}") for i in range(3)], "source string, path string")
    got = C.file_sections(files, ["source"], "path", 8, 5).collect()
    assert {r.section for r in got if r.searched} == {0, 1, 2} and len([r for r in got if r.section == 0]) == 3


def test_boxcar_sums_over_blocks_and_gaps(spark):
    rnd = np.random.default_rng(1)
    cells = {(dm, y): int(rnd.integers(-9, 9)) for dm in range(2) for y in range(-5, 60) if rnd.random() < 0.9}
    df = spark.createDataFrame([(d, y, v) for (d, y), v in cells.items()], "dm int, y long, v_full long")
    want = {(d, y, w): sum(cells[d, y + k] for k in range(w)) for d, y in cells for w in (1, 3, 9) if all((d, y + k) in cells for k in range(w))}
    for block in (4, 16, 4096):
        assert {(r.dm, r.y, r.width): r.total for r in D.boxcar_search(df, [1, 3, 9], block).collect()} == want


def test_shared_partial_sums_change_nothing(spark):
    rnd = np.random.default_rng(4)
    spec = spark.createDataFrame([(t, c, int(rnd.integers(-50, 50))) for t in range(90) for c in range(12) if rnd.random() < 0.95], "t long, chan int, v long")
    shifts = spark.createDataFrame([(dm, c, i, int(dm * (11 - c) * 0.7)) for dm in range(6) for i, c in enumerate(c for c in range(12) if c != 5)], "dm int, chan int, idx int, shift int")
    want = sorted(map(tuple, D.dedisperse(spec, shifts, 4).collect()))
    for block, band in ((8, 1), (64, 4), (500, 8)):
        assert sorted(map(tuple, D.dedisperse_blocks(spec, shifts, 4, block, band).collect())) == want


def test_strata_and_keys_may_be_null(spark):
    rows = [(k, label) for label in ("a", None, "b") for k in (*range(9), None)]
    out = P.stratified_split(spark.createDataFrame(rows, "k long, label string"), "label", "k", 0.5).collect()
    assert sorted(map(str, ((r.k, r.label) for r in out))) == sorted(map(str, rows)) and all(sum(r.split == "train" for r in out if r.label == x) == 5 for x in ("a", None, "b"))
    units = P.latin_hypercube(spark.createDataFrame([(1,), (2,), (None,)], "k long"), "k", 2).collect()
    assert len(units) == 3 and all(sorted(int(3 * r[f"u{d}"]) for r in units) == [0, 1, 2] for d in range(2))


def test_mosaics_keep_boxes_on_their_pixels(spark):
    pixels = spark.createDataFrame([(i, y, x, 100 if (y, x) == (2, 4) else 0) for i in range(3) for y in range(6) for x in range(6)], "image long, py int, px int, v long")
    boxes = spark.createDataFrame([(i, 7, 4.0, 2.0, 1.0, 1.0) for i in range(3)] + [(1, 8, -3.0, 0.0, 12.0, 6.0)], "image long, box int, left double, top double, width double, height double")
    for rows, cols in ((1, 3), (3, 1), (2, 2)):
        mosaic = {(r.py, r.px): r.v for r in I.mosaic_grid(pixels, rows, cols, 6).collect() if r.v}
        moved = [r for r in I.mosaic_boxes(boxes, rows, cols, 6).collect() if r.box == 7]
        assert {(int(r.top), int(r.left)) for r in moved} == set(mosaic) and set(mosaic.values()) == {100 / (rows * cols)}
    strip = [r for r in I.mosaic_boxes(boxes, 1, 3, 6).collect() if r.box == 8]
    assert [(r.left, r.width, r.height) for r in strip] == [(1.0, 4.0, 6.0)]


def test_short_blocks_are_filled_up(spark):
    spec = spark.createDataFrame([(t, c, 10 * c) for t in range(7) for c in range(2)], "t long, chan int, v long")
    rows = D.pad_blocks(D.halo_blocks(spec, 4, 2), 6, 2).collect()
    assert {(r.block_id, r.offset, r.chan) for r in rows} == {(b, o, c) for b in range(2) for o in range(6) for c in range(2)} and len(rows) == 24
    assert {(r.block_id, r.offset) for r in rows if r.padded} == {(1, o) for o in (3, 4, 5)} and all(5 <= r.v <= 10 for r in rows if r.padded)


def test_pixel_arrays_are_scaled_like_sorted_ones(spark):
    rnd = np.random.default_rng(7)
    images = [rnd.integers(0, 1000, n).tolist() for n in (1, 2, 16, 400)] + [[5] * 16, [], None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(images)], "i int, pixels array<long>")
    rows = {r.i: r for r in df.select("i", I.kth_clipped(F.col("pixels"), 0.1, 0.9).alias("k"), I.percentile_clipped(F.col("pixels"), 0.1, 0.9).alias("p"), T.column_normalised(F.col("pixels"), 4).alias("c")).collect()}
    for i, x in enumerate(images):
        if not x:
            assert not rows[i].k and not rows[i].p
            continue
        v = np.array(x, float)

        def scaled(v, lo, hi):
            c = np.clip(v, lo, hi)
            return (c - c.min()) / (c.max() - c.min() + 1e-8)

        at = lambda v, s: np.sort(v)[max(1, int(np.round(len(v) * s))) - 1]
        assert rows[i].k == pytest.approx(scaled(v, at(v, 0.1), at(v, 0.9)).tolist())
        assert rows[i].p == pytest.approx(scaled(v, *np.percentile(v, (10, 90))).tolist())
        if len(v) % 4 == 0:
            b = (v + 1).reshape(-1, 4)
            b = (b / b.mean(0)).ravel()
            assert rows[i].c == pytest.approx(scaled(b, at(b, 0.05), at(b, 0.95)).tolist())


def test_intervals_merge_over_blocks(spark):
    rnd = np.random.default_rng(3)
    rows = [(k, int(a), int(a + rnd.choice([0, 3, 40, 900]))) for k in ("a", None) for a in rnd.integers(-2000, 9000, 60)] + [("a", None, 5), ("a", 5, None)]
    df = spark.createDataFrame(rows, "k string, lo long, hi long")
    for slack in (0, 7):
        want = []
        for key in ("a", None):
            last = None
            for lo, hi in sorted((lo, hi) for k, lo, hi in rows if k == key and lo is not None and hi is not None):
                if last is None or lo > last[2] + slack:
                    last = [key, lo, hi, 0]
                    want.append(last)
                last[2], last[3] = max(last[2], hi), last[3] + 1
        for block in (1, 64, 100_000):
            got = S.merge_intervals(df, ["k"], slack, block).collect()
            assert sorted(map(str, ([r.k, r.lo, r.hi, r.n] for r in got))) == sorted(map(str, want))


def test_task_states_follow_allowed_steps(spark):
    events = [("t1", i, s) for i, s in enumerate(["running", "ready", "done", "active", "done"])] + [("t2", 5, "ready"), ("t2", 6, None), (None, 1, "running"), ("t3", None, "running"), ("t4", 2, "failed"), ("t4", 1, "running"), ("t4", 3, "pending")]
    df = spark.createDataFrame(events, "task string, at int, state string")
    states = C.task_states(df, "task", "at", "state")
    assert {r.task: (r.state, r.n_events, r.n_rejected) for r in states.collect()} == {"t1": ("done", 5, 1), "t2": ("pending", 1, 1), "t4": ("pending", 3, 0)}
    table = spark.createDataFrame([("a", "pending"), ("b", "running"), ("c", "pending"), ("d", "ready"), ("e", "pending")], "task string, state string")
    assert [r.task for r in C.startable(table, 3).collect()] == ["a"] and [r.task for r in C.startable(table, 9).collect()] == ["a", "c", "e"] and C.startable(table, 2).count() == 0


def test_settings_of_a_table_are_checked(spark):
    rows = spark.createDataFrame([(1, 1024, 0.4), (2, 0, 1.5), (3, None, None)], "run int, dm_span int, det_prob double")
    found = {r.run: r.violations for r in T.config_violations(rows).collect()}
    assert found[1] == found[3] == [] and found[2] == ["dm_span must be positive", "dm_stride must not exceed dm_span", "det_prob must be below 1"]
