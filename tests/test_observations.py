"""The observation data source: pushed filters, falling axes, pooling; writing in place, packing, failures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import observations as O
from pulsegrid.sources import psrfits

RISING = 1000.0 + np.arange(8) * 62.5


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path, rnd = tmp_path_factory.mktemp("obs"), np.random.default_rng(1)
    up, down, plain = (rnd.integers(0, 256, (24, 2, 8)) for _ in range(3))
    (path / "up_0001.fits").write_bytes(psrfits.encode(up, nsblk=4, axis=RISING, scales=True))
    (path / "down_0002.fits").write_bytes(psrfits.encode(down, nsblk=6, axis=RISING[::-1], tbin_s=100e-6))
    (path / "plain_0003.fits").write_bytes(psrfits.encode(plain, nsblk=8, obsbw=-500.0))
    return str(path), {"up_0001": up.mean(1), "down_0002": down.mean(1)[:, ::-1], "plain_0003": plain.mean(1)[:, ::-1]}


def values(df):
    return {(r.file, r.t, r.chan): r.v for r in df.collect()}


@pytest.mark.parametrize("stretch", [100, 700, 1 << 26])
def test_every_sample_comes_once_with_rising_frequencies(spark, folder, stretch):
    path, want = folder
    rows = O.read(spark, path, stretch_bytes=stretch)
    assert rows.count() == 3 * 24 * 8
    assert values(rows) == {(f, t, c): x[t, c] for f, x in want.items() for t in range(24) for c in range(8)}
    axes = {(r.file, r.chan): r.freq_mhz for r in rows.select("file", "chan", "freq_mhz").distinct().collect()}
    assert all(axes[f, c] == RISING[c] for f in ("up_0001", "down_0002") for c in range(8))
    assert [axes["plain_0003", c] for c in (0, 7)] == [1500 - 7 * 62.5, 1500.0]


def test_filters_are_pushed(spark, folder):
    path, want = folder
    rows = O.read(spark, path, stretch_bytes=700).where("file in ('up_0001', 'plain_0003') and t >= 5 and t < 9 and chan = 3 and v > 20")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    left = [x for x in plan.splitlines() if "Filter (" in x]
    assert len(left) == 1 and "(v#" in left[0] and "AND" not in left[0]  # all others are the source's
    assert values(rows) == {(f, t, 3): want[f][t, 3] for f in ("up_0001", "plain_0003") for t in range(5, 9) if want[f][t, 3] > 20}
    reader = O.ObservationReader({"path": path})
    left = list(reader.pushFilters([O.ds.In(("file",), ("up_0001",)), O.ds.LessThan(("t",), 9), O.ds.GreaterThan(("v",), 20.0), O.ds.EqualTo(("chan",), 3)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan"] and [O.stem(p.path) for p in reader.partitions()] == ["up_0001"]
    assert len(list(reader.read(reader.partitions()[0]))) == 3  # of six table rows, those with t < 9
    assert O.read(spark, path).where("file = 'none'").count() == 0 == O.read(spark, path).where("t > 99").count()


@pytest.mark.parametrize("stretch", [300, 1 << 26])
def test_pooling_rates_come_from_the_header(spark, folder, stretch):
    path, want = folder
    assert (O.time_pool(49.152e-6), O.time_pool(100e-6), O.time_pool(1.0), O.channel_pool(4096), O.channel_pool(64)) == (8, 3, 1, 8, 1)
    pooled = values(O.read(spark, path, pooled=True, stretch_bytes=stretch))
    whole = {f: x.reshape(-1, 3 if f == "down_0002" else 8, 8).mean(1) for f, x in want.items()}
    assert pooled == pytest.approx({(f, t, c): x[t, c] for f, x in whole.items() for t in range(len(x)) for c in range(8)})


def test_bad_files(spark, folder, tmp_path):
    (tmp_path / "a_1.fits").write_bytes(open(f"{folder[0]}/up_0001.fits", "rb").read())
    (tmp_path / "b_2.fits").write_bytes(b"SIMPLE  =                    T")
    (tmp_path / "c_3.fits").write_bytes(b"")
    with pytest.raises(Exception, match="b_2|c_3"):
        O.read(spark, str(tmp_path)).count()
    assert O.read(spark, str(tmp_path), bad_files="skip").count() == 24 * 8


def raw(path, name):
    table = None
    with open(f"{path}/{name}.fits", "rb") as f:
        data = f.read()
        table = O.described(f, len(data))
    rows = [data[table.at + i * table.stride : table.at + (i + 1) * table.stride] for i in range(table.rows)]
    return table, rows, data


def test_rows_are_written_in_place(spark, folder, tmp_path):
    path, _ = folder
    table, old, before = raw(path, "up_0001")
    width = table.columns["DATA"].width
    rows = spark.createDataFrame([("up_0001", 4, bytearray([9] * width)), ("up_0001", 1, bytearray([7] * width)), ("down_0002", 0, bytearray(6 * 16))], "file string, row int, data binary")
    O.write(rows, f"{tmp_path}/out", path)
    _, new, after = raw(f"{tmp_path}/out", "up_0001")
    begin = table.columns["DATA"].begin
    assert [r[begin:] for r in new] == [bytes([{1: 7, 4: 9}[i]]) * width if i in (1, 4) else old[i][begin:] for i in range(6)]
    assert [r[:begin] for r in new] == [r[:begin] for r in old] and len(after) == len(before) and after[: table.at] == before[: table.at]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["down_0002.fits", "up_0001.fits"]


def test_packed_rows_get_a_header_of_their_own(spark, folder, tmp_path):
    path, _ = folder
    levels = np.random.default_rng(4).integers(0, 4, (24, 1, 8))
    packed = (levels.reshape(6, -1, 4) << np.array([6, 4, 2, 0])).sum(2).astype(np.uint8)
    rows = spark.createDataFrame([("up_0001", i, bytearray(packed[i].tobytes())) for i in range(6)], "file string, row int, data binary")
    O.write(rows, str(tmp_path), path, bits=2)
    assert values(O.read(spark, str(tmp_path))) == {("up_0001", t, c): float(levels[t, 0, c]) for t in range(24) for c in range(8)}
    table, new, data = raw(str(tmp_path), "up_0001")
    assert table.shape == (4, 1, 8, 2) and len(data) % psrfits.BLOCK == 0 and table.cards["TBIN"] == 49.152e-6 and table.primary["OBSFREQ"] == 1250.0
    with open(f"{tmp_path}/up_0001.fits", "rb") as f:
        assert O.numbers(f, table, "DAT_OFFS", 5).tolist() == list(range(8)) and O.numbers(f, table, "DAT_SCL").tolist() == [i + 0.5 for i in range(8)]


@pytest.mark.parametrize("bits, rows", [(8, [("up_0001", 1, 64), ("up_0001", 2, 3)]), (8, [("up_0001", 6, 64)]), (2, [("up_0001", 0, 8), ("up_0001", 2, 8)]), (2, [("up_0001", 0, 8)]), (8, [("up_0001", 1, 64), ("nowhere_1", 0, 64)]), (8, [("up_0001", 1, 64), ("up_0001", 1, 64)])])
def test_failed_writes_leave_the_old_files(spark, folder, tmp_path, bits, rows):
    (tmp_path / "up_0001.fits").write_bytes(b"old")
    frame = spark.createDataFrame([(f, r, bytearray(n)) for f, r, n in rows], "file string, row int, data binary")
    with pytest.raises(Exception):
        O.write(frame, str(tmp_path), folder[0], bits=bits)
    assert [(p.name, p.read_bytes()) for p in tmp_path.iterdir() if not p.name.startswith(".")] == [("up_0001.fits", b"old")]


def test_nothing_to_write(spark, folder, tmp_path):
    O.write(spark.createDataFrame([], "file string, row int, data binary"), str(tmp_path), folder[0])
    assert list(tmp_path.iterdir()) == []
