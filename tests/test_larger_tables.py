"""Queries on small tables of the kinds that larger ones hold."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pulsegrid.operators import dedisperse as D
from pulsegrid.operators import labelling as L
from pulsegrid.operators import matching as M
from pulsegrid.operators import signals as S
from pulsegrid.plans import catalog, registry  # noqa: F401
from pulsegrid.sources import tables
from pulsegrid.streaming import sessions


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables given as DuckDB SQL."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for table, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{folder}/{table}.parquet'")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    want = con.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    return sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))), sorted(map(str, want.project(", ".join(f'"{c}"' for c in columns)).fetchall()))


def test_names_of_background_files_hold_long_numbers(spark, tmp_path):
    got, want = both(spark, tmp_path, "background_files", supplier="SELECT n AS s_suppkey FROM (VALUES (1234::BIGINT), (12340), (12346), (8), (80002)) x(n)")
    assert got == want and len(got) == 2


def test_sigma_at_half_a_hundredth_is_rounded_by_scaling(spark, tmp_path):
    got, want = both(spark, tmp_path, "fp_histograms", orders="SELECT n AS o_orderkey, 'F' AS o_orderstatus, (200 + 400 * n)::DOUBLE AS o_totalprice FROM range(1250) r(n)")
    assert got == want and np.sum([int(x.split(", ")[0][1:]) for x in got]) == 1250


def placed(rng, n, m, spread=60, copies=1):
    """Truths and candidates of one file as pandas, each place ``copies`` times."""
    truth = pd.DataFrame({"quant": "raw8", "stem": "f", "injection_id": range(n * copies), "sample": np.tile(rng.integers(0, spread, n), copies), "dm": np.tile(rng.integers(0, 8, n) / 2, copies)})
    found = pd.DataFrame({"quant": "raw8", "stem": "f", "cand_id": range(m * copies), "sample": np.tile(rng.integers(0, spread, m), copies), "dm": np.tile(rng.integers(0, 8, m) / 2, copies), "sigma": np.tile(rng.integers(0, 10, m) / 1.0, copies)})
    return truth, found


def tolerated(truth, found, time_tol, dm_tol, weight):
    pairs = truth.merge(found, on=["quant", "stem"], suffixes=("", "_c"))
    dt, ddm = abs(pairs["sample_c"] - pairs["sample"]), abs(pairs["dm_c"] - pairs["dm"])
    return pairs.assign(cost=dt / time_tol + ddm / dm_tol - pairs["sigma"] * weight)[(dt <= time_tol) & (ddm <= dm_tol)]


def test_assignment_from_rows(spark):
    """As many pairs at as little cost as the plain assignment, also where places are there many times."""
    for seed, n, m, copies in ((1, 40, 60, 1), (2, 60, 40, 1), (3, 12, 14, 6)):
        truth, found = placed(np.random.default_rng(seed), n, m, 60, copies)
        pairs = tolerated(truth, found, 4, 1.0, 0.05)
        want = M.assign(list(pairs[["injection_id", "cand_id", "cost"]].itertuples(index=False, name=None)))
        got = M.assign_near(spark.createDataFrame(truth), spark.createDataFrame(found), 4, 1.0, "sigma", 0.05).toPandas()
        assert len(got) == len(want) and abs(got["cost"].sum() - sum(c for *_, c in want)) < 1e-9
        assert got["injection_id"].is_unique and got["cand_id"].is_unique
        assert len(got.merge(pairs, on=["injection_id", "cand_id"]).query("abs(cost_x - cost_y) < 1e-12")) == len(got)
    # few stored ways, and a vertex whose ways are all taken
    near = [(np.array([0, 1, 2]), np.array([0.0, 0.1, 0.2])), (np.array([0, 1]), np.array([0.0, 0.3])), (np.array([0]), np.array([0.5]))]
    assert sorted(M.transport(near.__getitem__, np.array([1, 1, 1]), np.array([1, 1, 1]), 1)) == [(0, 2, 1), (1, 1, 1), (2, 0, 1)]
    assert sum(n for *_, n in M.transport(near.__getitem__, np.array([2, 3, 4]), np.array([5, 0, 1]), 2)) == 6


def test_sweep_from_rows(spark):
    truth, found = placed(np.random.default_rng(4), 50, 60, 60, 3)
    pairs = tolerated(truth, found, 4, 1.0, 0.001)
    got = M.sweep_near(spark.createDataFrame(truth), spark.createDataFrame(found), 4, 1.0, [0.0, 4.0, 20.0], 0.001).toPandas()
    for t in (0.0, 4.0, 20.0):
        want = M.greedy_in_truth_order(pairs[pairs["sigma"] >= t])
        assert sorted(got[got["threshold"] == t][["injection_id", "cand_id"]].itertuples(index=False, name=None)) == sorted(want[["injection_id", "cand_id"]].itertuples(index=False, name=None))


def test_many_pulses_of_few_places_are_few(spark):
    """Two million pulses at 40 places and tails, against a sum over the places."""
    pulses = spark.range(2_000_000).selectExpr("id % 20 * 30 - 10 as t0", "cast(id % 2 as double) * 3 as tau", "0.001D as amplitude")
    base = spark.range(600).selectExpr("id as t", "0 as chan", "1D as v")
    got = {r.t: r.v for r in S.inject_scattered(base, pulses, 2.0).collect()}
    want = np.ones(600)
    for n in range(20):
        x = np.arange(600.0) - (n * 30 - 10)
        want += np.where(abs(x) <= 64, 100 * S.scattered_pulse(x, 2.0, n % 2 * 3.0), 0)
    assert np.allclose([got[t] for t in range(600)], want)


def test_cut_outs_move_samples_and_no_cells(spark):
    """Against single cells, over the edges of blocks."""
    rng = np.random.default_rng(5)
    v = rng.integers(-9, 9, (900, 4))
    spec = spark.createDataFrame([(t, c, int(v[t, c])) for t in range(900) for c in range(4) if (t + c) % 7], "t long, chan int, v long")
    shifts = spark.createDataFrame([(d, c, d * (3 - c) * 9) for d in range(3) for c in range(4)], "dm int, chan int, shift int")
    asked = [(i, i % 4, int(t)) for i, t in enumerate(rng.integers(0, 920, 40))]
    out = D.cut_out(spark.createDataFrame(asked, "cand_id long, dm int, toa long"), spec, shifts, 8, 2, 16)
    want = {(i, k, b): 0 for i, d, _ in asked if d < 3 for k in range(8) for b in range(2)}
    for i, d, toa in asked:
        for k in range(8):
            for c in range(4 if d < 3 else 0):
                t = max(0, toa - 4) + d * (3 - c) * 9 + k
                want[i, k, c // 2] += int(v[t, c]) if t < 900 and (t + c) % 7 else 0
    rows = out.collect()
    assert {(r.cand_id, r.i, r.band): r.total for r in rows} == want and len(rows) == len(want)


def test_a_large_folder_is_several_tasks_work(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100000")
    try:
        tables.write_partitioned(spark.range(200_000).selectExpr("id", "uuid() as name", "'all' as kind"), str(tmp_path / "out"), "kind")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "out" / "kind=all").glob("*.parquet"))) > 1 and spark.read.parquet(str(tmp_path / "out")).count() == 200_000


def test_stamps_of_an_image_come_together(spark):
    """The cells' maxima against numpy; only targets are shuffled, once."""
    rng = np.random.default_rng(6)
    targets = [(i, int(rng.integers(0, 256)), int(rng.integers(1, 5))) for i in range(6) for _ in range(3)]
    out = L.stamped(spark.createDataFrame(targets, "image long, cell int, radius int"), 16)
    want = {}
    for i, cell, r in targets:
        for y in range(max(0, cell // 16 - r), min(15, cell // 16 + r) + 1):
            for x in range(max(0, cell % 16 - r), min(15, cell % 16 + r) + 1):
                h = np.exp(-((x - cell % 16) ** 2 + (y - cell // 16) ** 2) / (2 * ((2 * r + 1) / 6) ** 2))
                want[i, y, x] = max(h, want.get((i, y, x), 0))
    got = {(r.image, r.py, r.px): r.target for r in out.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert out.groupBy("image", "py").count()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_best_members_put_those_without_class_last(spark):
    """A null class made a null cost, which came first."""
    truth = spark.createDataFrame([(1, "a", "f", 100, 5.0)], "injection_id long, quant string, stem string, sample long, dm double")
    rows = [(7, "a", "f", 100, 5.0, None, "e"), (8, "a", "f", 104, 5.0, 0.5, "e"), (9, "a", "f", 104, 5.0, 0.5, "e"), (6, "a", "f", 99, 5.0, None, "g")]
    found = spark.createDataFrame(rows, "cand_id long, quant string, stem string, sample long, dm double, cls double, event string")
    for at_once in (1, 100):
        got = sorted(tuple(r) for r in M.best_members(truth, found, 10, 2.0, at_once).select("event", "cand_id", F.round("cost", 6)).collect())
        assert got == [("e", 8, 0.375), ("g", 6, None)]


def test_copies_share_their_nearest_truth(spark):
    truth = spark.createDataFrame([(i, "a", "f", 50 * (i % 3), 1.0, float(i)) for i in range(60)], "injection_id long, quant string, stem string, sample long, dm double, snr double")
    found = spark.createDataFrame([(i, "a", "f", 10 + 50 * (i % 3), 1.0) for i in range(90)], "cand_id long, quant string, stem string, sample long, dm double")
    got = M.nearest_truth(found, truth, 10.0, 1.0)
    assert sorted((r.cand_id, r.injection_id, r.assigned_snr, r.distance) for r in got.collect()) == [(i, i % 3, float(i % 3), 1.0) for i in range(90)]


def test_state_of_a_stream_packs_batches():
    rows = pd.DataFrame({"time_us": [1, 2, 3], "k": ["a", None, "b"], "x": [0.5, np.nan, 2.0]})
    back = sessions.unpacked([sessions.packed(rows[:2]), sessions.packed(rows[2:])])
    assert back["time_us"].tolist() == [1, 2, 3] and back["k"].tolist() == ["a", None, "b"] and np.allclose(back["x"], rows["x"], equal_nan=True)
