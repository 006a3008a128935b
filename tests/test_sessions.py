"""Sessions and islands closed by timers equal those of the whole table."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import matching as M
from pulsegrid.streaming import sessions as X

DAY = dt.datetime(2024, 1, 1)


def plain(rows, gap):
    """Sessions of (time, key, value) by walking each key in order of time."""
    out = []
    for key in {k for t, k, _ in rows if t is not None}:
        last = None
        for t, v in sorted(((t, v) for t, k, v in rows if k == key and t is not None), key=lambda x: x[0]):
            if last is None or t > last + gap:
                out.append([key, t, t, 0, None])
            last = t
            out[-1][2], out[-1][3] = t, out[-1][3] + 1
            out[-1][4] = v if out[-1][4] is None else out[-1][4] if v is None else max(v, out[-1][4])
    return sorted([(str(k), a, b + gap, n, s) for k, a, b, n, s in out])


def written(spark, folder, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)


def shown(df):
    return sorted((str(r.k), r.start, r.end, r.event_size, r.strongest) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(3)
    times = np.cumsum(rnd.choice([20, 60, 200, 400], 240, p=[0.4, 0.3, 0.2, 0.1]))
    return [(DAY + dt.timedelta(seconds=int(t), microseconds=int(rnd.integers(0, 10**6))), rnd.choice(["a", "b", None]), None if rnd.random() < 0.1 else float(rnd.integers(0, 99))) for t in times]


GAP = dt.timedelta(minutes=5)


def test_timers_close_sessions_over_batches(spark, rows, tmp_path):
    parts = [rows[i : i + 40] for i in range(0, 240, 40)]
    written(spark, str(tmp_path / "in"), parts, "ts timestamp, k string, value double")
    closed, left, late = X.stream_sessions(spark, str(tmp_path / "in"), "ts", ["k"], "5 minutes", "1 minute", files_per_trigger=1)
    done, still = shown(closed), shown(left)
    assert sorted(done + still) == plain(rows, GAP) and late == 0
    latest = max(t for t, _, _ in rows)
    assert {s[2] for s in still} <= {s[2] for s in plain(rows, GAP) if s[2] > latest - dt.timedelta(minutes=2)} and len(done) > 10


def test_any_order_of_files_is_exact_if_no_row_is_late(spark, rows, tmp_path):
    order = np.random.default_rng(5).permutation(240)
    parts = [[rows[i] for i in order[j : j + 30]] for j in range(0, 240, 30)] + [[(None, "a", 1.0), (rows[0][0], "a", 1.0), (rows[0][0], "a", 1.0)]]
    written(spark, str(tmp_path / "in"), parts, "ts timestamp, k string, value double")
    closed, left, late = X.stream_sessions(spark, str(tmp_path / "in"), "ts", ["k"], "5 minutes", "3 days", files_per_trigger=1)
    assert late == 0 and shown(closed.union(left)) == plain([r for p in parts for r in p], GAP)


def test_late_rows_are_counted(spark, tmp_path):
    at = lambda m: DAY + dt.timedelta(minutes=m)
    parts = [[(at(0), "a", 1.0), (at(1), "a", 2.0)], [(at(60), "a", 3.0)], [(at(60), "b", 1.0)], [(at(2), "a", 4.0), (at(3), "a", 5.0), (at(61), "a", 6.0)]]
    written(spark, str(tmp_path / "in"), parts, "ts timestamp, k string, value double")
    closed, left, late = X.stream_sessions(spark, str(tmp_path / "in"), "ts", ["k"], "5 minutes", "10 minutes", files_per_trigger=1)
    assert late == 2
    assert shown(closed) == [("a", at(0), at(6), 2, 2.0)] and shown(left) == [("a", at(60), at(66), 2, 6.0), ("b", at(60), at(65), 1, 1.0)]


def test_islands_build_their_events_when_they_close(spark, tmp_path):
    rnd = np.random.default_rng(8)
    t = np.cumsum(rnd.choice([5, 30, 400], 150, p=[0.5, 0.4, 0.1]))
    rows = [(DAY + dt.timedelta(seconds=int(x)), i, "raw8", "s", int(x), float(rnd.integers(0, 60)), float(rnd.random()), float(rnd.random()), i % 5) for i, x in enumerate(t)]
    schema = "ts timestamp, cand_id long, quant string, stem string, sample long, dm double, cls double, det double, candidate_index int"
    written(spark, str(tmp_path / "in"), [rows[i : i + 30] for i in range(0, 150, 30)], schema)
    closed, left, late = X.stream_islands(spark, str(tmp_path / "in"), lambda s: s, "ts", ["quant", "stem"], "100 seconds", "1 second", lambda p: M.events_of(p, 100, 20.0), "cand_id long, event long, event_size long", files_per_trigger=1)
    want = M.bounded_events(spark.createDataFrame(rows, schema), 100, 20.0)
    assert late == 0 and sorted(map(tuple, closed.union(left).collect())) == sorted(map(tuple, want.collect()))
    assert 20 < closed.count() < 150


def test_an_empty_stream(spark, tmp_path):
    written(spark, str(tmp_path / "in"), [[]], "ts timestamp, k string, value double")
    closed, _, late = X.stream_sessions(spark, str(tmp_path / "in"), "ts", ["k"], "5 minutes", "1 minute")
    assert closed.count() == 0 and late == 0
