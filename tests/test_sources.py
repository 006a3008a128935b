import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions import scalars
from pulsegrid.sources import psrfits, tables
from pulsegrid.streaming import streams


@pytest.fixture
def observations(tmp_path):
    random = np.random.default_rng(0)
    eight, two = random.integers(0, 256, (12, 2, 8)), random.integers(0, 4, (12, 1, 8))
    (tmp_path / "X-M01_0001.fits").write_bytes(psrfits.encode(eight, nsblk=4))
    (tmp_path / "X-M01_0002.fits").write_bytes(psrfits.encode(two, nbits=2, nsblk=6))
    whole = psrfits.encode(eight, nsblk=4)
    (tmp_path / "X-M01_0004.fits").write_bytes(whole[: 2 * psrfits.BLOCK + 10])
    (tmp_path / "X_N_-M01_0003.fits").write_bytes(b"")
    return tmp_path, eight, two


def test_fits_blocks(spark, observations):
    path, eight, two = observations
    blocks = psrfits.read_blocks(spark, str(path), "X-*.fits")
    rows = psrfits.spectrum(blocks).collect()
    got = {(r.path[-9:-5], r.t, r.chan): r.v for r in rows}
    assert all(got["0001", t, c] == eight[t, :, c].mean() and got["0002", t, c] == two[t, 0, c] for t in range(12) for c in range(8))
    assert [r.path[-9:-5] for r in psrfits.bad_files(blocks).collect()] == ["0004"]
    pooled = {(r.t, r.chan): r.v for r in psrfits.spectrum(blocks.where("nbits = 8"), reverse=True, pool=2).collect()}
    assert pooled[0, 0] == eight[:2, :, 7].mean() and len(pooled) == 48
    headers = psrfits.read_headers(spark, str(path), "X-*.fits")
    noise = psrfits.replace_bad(blocks, headers).collect()
    assert len(noise) == 12 * 8 and all(abs(r.v - 1.5) <= 0.5 * np.sqrt(15) for r in noise)
    assert {r.key for r in psrfits.inconsistent(headers).collect()} == {"nsblk", "npol", "nbits", "naxis2"}


def test_background_files(spark, observations):
    assert sorted(r.number for r in tables.read_background_files(spark, str(observations[0])).collect()) == [1, 2, 4]


def test_json_and_csv(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    (tmp_path / "run_candidates.jsonl").write_text('{"a": 1, "b": "x"}\n\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in tables.read_candidates(spark, str(tmp_path), schema).collect() if r.a) == [1, 2]
    assert tables.read_jsonl(spark, str(tmp_path / "none.jsonl"), schema).count() == 0
    with pytest.raises(Exception):
        tables.read_jsonl(spark, str(tmp_path / "run_candidates.jsonl"), schema, strict=True).collect()
    assert [r.line for r in tables.bad_json_lines(spark, str(tmp_path), schema).collect()] == ["broken"]
    with gzip.open(tmp_path / "matches.csv.gz", "wt") as f:
        f.write("a,quantization\n1,raw8\n2,\n")
    rows = tables.read_csv(spark, str(tmp_path))
    assert [(r.a, r.quantization) for r in rows.collect()] == [("1", "raw8"), ("2", None)]
    named = rows.withColumn("source_path", F.lit("/x/b_raw8/m.csv"))
    assert [r.quantization for r in tables.with_quantization(named).collect()] == ["raw8", "raw8"]
    for bad in (rows.withColumn("source_path", F.lit("/packed2/")), rows.withColumn("source_path", F.lit("/none/"))):
        with pytest.raises(Exception):
            tables.with_quantization(bad).collect()


def test_task_manifests(spark, tmp_path):
    tasks = [{"identifier": "t", "files": ["a", "b"], "info": {"beam": "M01"}}]
    for i, document in enumerate(({"version": 1, "tasks": tasks}, tasks)):
        (tmp_path / f"{i}.json").write_text(json.dumps(document, indent=1))
        assert [(r.identifier, r.files, r.info["beam"]) for r in tables.read_tasks(spark, str(tmp_path / f"{i}.json")).collect()] == [("t", ["a", "b"], "M01")]
    (tmp_path / "bad.json").write_text('[{"identifier": "t"}]')
    with pytest.raises(Exception):
        tables.read_tasks(spark, str(tmp_path / "bad.json")).collect()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "raw8")], "b int, a string, quantization string")
    tables.write_csv(rows, str(tmp_path / "c"), ["a", "b", "zz"])
    assert tables.read_csv(spark, str(tmp_path / "c")).collect()[0].asDict() == {"a": None, "b": "1", "zz": None}
    with pytest.raises(Exception):
        tables.write_csv(rows, str(tmp_path / "c"), ["a"])
    for _ in range(2):
        tables.write_jsonl(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    tables.write_for_quantizations(rows, str(tmp_path / "q"), ["raw8", "packed2"])
    assert {r.quantization for r in spark.read.parquet(str(tmp_path / "q")).collect()} == {"raw8", "packed2"}


def test_stream_appends_and_closes_sessions(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "a", float(m)) for m in (0, 1, 2, 20, 50)]
    spark.createDataFrame(rows, "ts string, k string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = streams.append_all(spark, str(tmp_path / "in"), lambda s: streams.session_events(s, "ts", ["k"], "5 minutes", "6 minutes")).collect()
    assert sorted((r.event_size, r.strongest) for r in out) == [(1, 20.0), (3, 2.0)]  # the last one is still open


def test_clusters_of_many_files_lose_no_row(spark, tmp_path):
    from pulsegrid.plans import discovery

    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", "a", float(h)) for h in range(12) for m in (0, 1, 2, 30)]
    for n, h in enumerate([11, *range(11)]):  # the latest hour is in the first file
        part = [r for r in rows if r[2] == h]
        spark.createDataFrame(part, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    out = discovery.stream_event_clusters(spark, str(tmp_path)).collect()
    assert sorted((r.strongest, r.event_size) for r in out) == sorted((float(h), n) for h in range(12) for n in (1, 3))


def test_scalars(spark):
    assert scalars.batches("0-3,7, 2") == [0, 1, 2, 3, 7]
    row = spark.range(1).select(scalars.mjd_to_timestamp(F.lit(60310.5)).cast("string").alias("t"), scalars.slug(F.lit(5.5)).alias("s"), scalars.slug(F.lit(5.0)).alias("u"), scalars.first_set(F.lit(0.0), F.lit(None).cast("double"), F.lit(3.0)).alias("f")).first()
    assert (row.t, row.s, row.u, row.f) == ("2024-01-01 12:00:00", "5p5", "5", 3.0)


def test_a_stream_takes_only_its_own_path(spark, tmp_path):
    from pulsegrid.streaming import streams

    for name, n in (("events.parquet", 5), ("events.parquet.bak", 7), ("events.parquet_old", 9)):
        spark.range(n).write.parquet(str(tmp_path / name))
    assert streams.append_all(spark, str(tmp_path / "events.parquet"), lambda frame: frame).count() == 5


def test_files_are_read_by_stretches_of_rows(spark, tmp_path):
    x = np.random.default_rng(5).integers(0, 256, (64, 2, 8))
    files = spark.createDataFrame([(f"{tmp_path}/in/a.fits", bytearray(psrfits.encode(x, nsblk=4))), (f"{tmp_path}/in/b.fits", bytearray(b"SIMPLE  =                    T")), (f"{tmp_path}/in/c.fits", bytearray(b""))], "path string, content binary")
    assert sorted(r.path[-6:] for r in psrfits.write_files(files).collect()) == ["a.fits", "b.fits", "c.fits"]
    assert sorted(p.name for p in (tmp_path / "in").iterdir() if not p.name.startswith(".")) == ["a.fits", "b.fits", "c.fits"]
    whole, parts = (psrfits.read_blocks(spark, str(tmp_path / "in"), range_bytes=n) for n in (1 << 26, 100))
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect())) and parts.where("error is null").count() == 16
    assert sorted(r.path[-6:] for r in psrfits.bad_files(parts).collect()) == ["b.fits"]  # empty files aren't listed
    got = {(r.t, r.chan): r.v for r in psrfits.spectrum(parts).collect()}
    assert all(got[t, c] == x[t, :, c].mean() for t in range(64) for c in range(8))
    found = {r.path[-6:]: (r.nchan, r.f, r.error is None) for r in psrfits.read_headers(spark, str(tmp_path / "in")).withColumn("f", psrfits.frequency(F.lit(4))).collect()}
    assert found["a.fits"] == (8, 1250.0, True) and not found["b.fits"][2] and "c.fits" not in found


def test_published_files_have_their_names(spark, tmp_path):
    rows = spark.createDataFrame([(2, "x"), (1, "y")], "b int, a string")
    tables.publish(rows, str(tmp_path / "p"), "run_candidates")
    assert {p.suffix for p in (tmp_path / "p").iterdir() if not p.name.startswith(".")} == {".jsonl"}
    assert sorted((r.a, r.b) for r in tables.read_candidates(spark, str(tmp_path / "p"), "a string, b int").collect()) == [("x", 2), ("y", 1)]
    with pytest.raises(FileExistsError):
        tables.publish(rows, str(tmp_path / "p"), "run_candidates")
    tables.publish(rows.select("a"), str(tmp_path / "p"), "lines", ".txt")
    tables.publish(rows, str(tmp_path / "p"), "table", ".csv.gz")
    assert sorted(r.a for r in tables.read_csv(spark, str(tmp_path / "p"), "table*").collect()) == ["x", "y"]
    assert spark.range(1).select(scalars.decoded(F.lit(b"a\xffb\xc3"))).first()[0] == "ab"


def test_catalogues_of_sample_and_frame_sets(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([(1, "20240101-02x", 1, "New"), (1, "20240101-03", 1, None), (2, "20240101-10", 1, "True_LPT_Old"), (3, None, 1, None)], "idx long, names string, labels long, sources string").write.parquet(f"{root}/True_LPT.parquet")
    spark.createDataFrame([(1, "20240101-02", 0)], "idx long, names string, labels long").write.parquet(f"{root}/Bad.parquet")
    rows = {r.sample_key: (r.name, r.label, r.source, r.repeat) for r in tables.read_sample_sets(spark, root, ["True_LPT", "Gone"], ["Bad"]).collect()}
    assert rows == {"True_LPT:1": ("20240101-02x", 1, "New", 6), "True_LPT:2": ("20240101-10", 1, "True_LPT_Old", 1), "True_LPT:3": (None, 1, "", 1), "Bad:1": ("20240101-02", 0, "", 2)}
    with pytest.raises(FileNotFoundError):
        tables.read_sample_sets(spark, root, ["Gone"], [])
    spark.createDataFrame([(1, [(0.0, 0.0, 4.0, 9.0), (0.0, 0.0, 0.5, 9.0), (None, 0.0, 1.0, 1.0), (-5.0, -5.0, 2.0, 8.0)]), (2, []), (3, None)], "frame long, boxes array<struct<left:double,top:double,width:double,height:double>>").write.parquet(f"{root}/f.parquet")
    frames = {r.frame: (r.n_boxes, r.has_annotation, r.min_box_size) for r in tables.read_frame_sets(spark, root, ["f", "g"]).collect()}
    assert frames == {1: (2, True, 4.0), 2: (0, False, float("inf")), 3: (0, False, float("inf"))}


def test_artefacts_in_nested_folders(spark, tmp_path):
    for name in ("a/r8/x-1_2-17.npy", "a/r8/x-1_2-18.npy", "r16/y-3.npy", "r16/y_3.npy", "r16/z-3.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert sorted(tuple(r) for r in tables.read_artefact_keys(spark, str(tmp_path)).collect()) == [("r16", "y", 3), ("r8", "x-1_2", 17), ("r8", "x-1_2", 18)]


def test_run_manifests_and_frame_sets(spark, tmp_path):
    truth = spark.createDataFrame([(1, 2.0), (2, 3.0)], "injection_id int, dm double")
    tables.write_run(truth, {"seed": 1}, f"{tmp_path}/run", ["raw8", "packed2"], "raw8")
    found, config = tables.read_run(spark, f"{tmp_path}/run", "seed int")
    assert {(r.quantization, r.seed, r.derived_from) for r in config.collect()} == {("raw8", 1, None), ("packed2", 1, "raw8")}
    assert sorted((r.quantization, r.injection_id) for r in found.collect()) == [("packed2", 1), ("packed2", 2), ("raw8", 1), ("raw8", 2)]
    with pytest.raises(Exception):
        tables.write_run(truth, {}, f"{tmp_path}/run", ["raw8"])
    images = spark.createDataFrame([(1, [0.5]), (2, [1.5])], "frame int, pixels array<double>")
    boxes = spark.createDataFrame([(1, 2, 3.0, 4.0, 5.0, 6.0), (1, 1, 7.0, 8.0, 9.0, 1.0)], "frame int, box int, left double, top double, width double, height double")
    tables.write_frame_set(images, boxes, f"{tmp_path}/f.parquet")
    side = {json.loads(r.value)["frame"]: json.loads(r.value)["annotations"] for r in spark.read.text(f"{tmp_path}/f.parquet.json").collect()}
    assert side == {1: [[7.0, 8.0, 9.0, 1.0], [3.0, 4.0, 5.0, 6.0]], 2: [[-1.0] * 4]}
    assert {r.frame: r.n_boxes for r in tables.read_frame_sets(spark, str(tmp_path), ["f"]).collect()} == {1: 2, 2: 0}
