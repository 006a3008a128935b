"""Driver queries: files written from the tables by the sinks, found and read again by the sources."""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as X
from ..operators import images as I
from ..operators import metrics as A
from ..operators import training as R
from ..sources import logs, psrfits, tables
from ..streaming.streams import shared_folder
from .discovery import _FILES, _files, _tasks
from .proxies import CANDIDATES, FALSE_POSITIVES, IMAGES, MATCHES, SPEC, TRUTH, candidates, false_positives, images, matches, pixel_rows, spec, table, truth
from .registry import query
from .spectra import _TOP

_CANDIDATE = "cand_id long, quant string, stem string, sample long, dm double, sigma double, cls double, det double, candidate_index int"


@query("candidate_archive", f"SELECT * FROM {CANDIDATES}")
def candidate_archive(spark, sf_dir):
    """Two candidate manifests, and a file beside them that is none."""
    root, rows = shared_folder(spark, "candidates"), candidates(spark, sf_dir)
    for quant in ("raw8", "packed2"):
        tables.publish(rows.where(F.col("quant") == quant), f"{root}/{quant}", f"x_{quant}_candidates")
    tables.publish(rows.where("sigma > 9"), root, "strong")
    return tables.read_candidates(spark, root, _CANDIDATE)


@query("truth_archive", f"SELECT injection_id, stem, sample, dm, snr, CAST(injection_id % 3 AS INT) AS batch, quant AS quantization FROM {TRUTH} WHERE injection_id % 3 IN (0, 2)")
def truth_archive(spark, sf_dir):
    """Truth manifests of three batches, of which those of a batch list are read."""
    root, rows = shared_folder(spark, "truth"), truth(spark, sf_dir)
    for batch in range(3):
        for quant in ("raw8", "packed2"):
            tables.publish(rows.where((F.col("injection_id") % 3 == batch) & (F.col("quant") == quant)).drop("quant"), root, f"x_b{batch:02d}_{quant}_truth")
    found = tables.read_truth_archive(spark, root, "injection_id long, stem string, sample long, dm double, snr double")
    return found.where(F.col("batch").isin(X.batches("0,2"))).drop("truth_manifest")


_ORDERS = "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 'raw8' ELSE 'packed2' END AS quantization FROM orders WHERE o_orderkey % 7 {} 0"


@query("campaign_tables", f"SELECT 'matches' AS name, * FROM ({_ORDERS.format('<>')}) UNION ALL SELECT 'false_positives' AS name, * FROM ({_ORDERS.format('=')})")
def campaign_tables(spark, sf_dir):
    """Tables of a campaign in folders by quantization, one kind with it in a field too, one compressed."""
    root, orders = shared_folder(spark, "campaign"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    for own, quant in ((0, "raw8"), (1, "packed2")):
        rows = orders.where(F.col("o_orderkey") % 2 == own)
        tables.publish(rows.where("o_orderkey % 7 <> 0"), f"{root}/{quant}", "matches", ".csv.gz")
        tables.publish(rows.where("o_orderkey % 7 = 0").withColumn("quantization", F.lit(quant)), f"{root}/{quant}", "false_positives", ".csv")
    found = [tables.read_campaign(spark, root, name).select(F.lit(name).alias("name"), "o_orderkey", "o_orderpriority", "quantization") for name in ("matches", "false_positives")]
    return found[0].union(found[1])


@query("task_manifests", f"SELECT source || '_' || date || '_' || beam AS identifier, string_agg(path, ',' ORDER BY path) AS files, CAST(count(*) AS INT) AS n_files, beam AS info_beam FROM {_FILES} WHERE source IS NOT NULL GROUP BY source, date, beam")
def task_manifests(spark, sf_dir):
    """Manifest documents of tasks by source and beam."""
    root = shared_folder(spark, "tasks")
    tables.write_task_manifests(_tasks(spark, sf_dir).select("source", "beam", "identifier", "files", F.struct("beam", "date").alias("info")), root, "source", "beam")
    found = tables.read_tasks(spark, root)
    return found.select("identifier", F.array_join("files", ",").alias("files"), F.size("files").alias("n_files"), F.col("info")["beam"].alias("info_beam"))


_STATUS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("state", T.StringType()), T.StructField("value", T.DoubleType())])


def _status_files(spark, sf_dir):
    root = shared_folder(spark, "status")
    line = F.to_json(F.struct("event_id", F.col("event_type").alias("state"), "value"))
    broken = F.when(F.col("event_id") % 17 == 0, F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "state"'))).when(F.col("event_id") % 19 == 0, "").otherwise(line)
    tables.publish(table(spark, sf_dir, "events").select(broken.alias("value")), root, "status", ".json")
    return root


@query("status_files", "SELECT event_id, event_type AS state, value FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0")
def status_files(spark, sf_dir):
    """Status lines, of which broken and blank ones are skipped."""
    return tables.read_jsonl(spark, _status_files(spark, sf_dir), _STATUS)


@query("broken_status_lines", """SELECT '{"event_id": ' || event_id || ', "state"' AS line, 'status' AS file FROM events WHERE event_id % 17 = 0""")
def broken_status_lines(spark, sf_dir):
    """Broken status lines with the file they are in."""
    return tables.bad_json_lines(spark, _status_files(spark, sf_dir), _STATUS).select("line", F.regexp_extract("path", r"/(\w+)-\d+\.json$", 1).alias("file"))


@query("threshold_tree", f"SELECT t AS threshold, quant, count(*) AS n_fp FROM {FALSE_POSITIVES} JOIN (VALUES ('3', 3.0::DOUBLE), ('5p5', 5.5::DOUBLE), ('7', 7.0::DOUBLE)) x(t, least) ON sigma >= least GROUP BY t, quant")
def threshold_tree(spark, sf_dir):
    """False positives in folders by threshold."""
    root = shared_folder(spark, "sweep")
    rows = false_positives(spark, sf_dir).withColumn("level", F.explode(F.array(*map(F.lit, (3.0, 5.5, 7.0))))).where("sigma >= level")
    tables.write_partitioned(rows.withColumn("threshold", F.concat(F.lit("sigma_ge_"), X.slug(F.col("level")))), root, "threshold")
    return spark.read.parquet(root).groupBy(F.substring_index("threshold", "_", -1).alias("threshold"), "quant").agg(F.count("*").alias("n_fp"))


@query("output_layout", f"SELECT source, CAST(substr(date, 1, 4) AS INT) AS year, beam, count(*) AS n_files FROM {_FILES} WHERE source IS NOT NULL AND number % 2 = 0 GROUP BY source, substr(date, 1, 4), beam")
def output_layout(spark, sf_dir):
    """Results in folders by source, year and beam; a second run doesn't overwrite them."""
    root = shared_folder(spark, "layout")
    rows = _files(spark, sf_dir).where("source is not null").withColumn("year", F.substring("date", 1, 4))
    tables.write_partitioned(rows.where("number % 2 = 0"), root, "source", "year", "beam")
    tables.write_partitioned(rows.where("number % 2 = 1"), root, "source", "year", "beam", mode="ignore")
    return spark.read.parquet(root).groupBy("source", "year", "beam").agg(F.count("*").alias("n_files"))


@query("truth_copies", f"SELECT injection_id, stem, sample, dm, snr, q AS quantization FROM {TRUTH}, (VALUES ('raw8'), ('packed2')) x(q)")
def truth_copies(spark, sf_dir):
    root = shared_folder(spark, "copies")
    tables.write_for_quantizations(truth(spark, sf_dir).drop("quant"), root, ["raw8", "packed2"])
    return spark.read.parquet(root)


_CUT = "(t // 128) % 5 = 3"
#: A spectrum file holds 128 samples (the last one fewer) in rows of as many samples as divide both its length and 32, 16 or 8.
_SHAPES = f"(SELECT t // 128 AS file, count(DISTINCT t) AS n, gcd(count(DISTINCT t), CASE t // 128 % 3 WHEN 0 THEN 32 WHEN 1 THEN 16 ELSE 8 END) AS nsblk FROM {SPEC} GROUP BY 1)"


def _observations(spark, sf_dir, nbits):
    """Files of 128 samples of two polarizations (one at 2 bits); every fifth one is cut short."""
    root = shared_folder(spark, "observations")
    levels, pols = 1 << nbits, 1 if nbits == 2 else 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf["t"].to_numpy() - pdf["t"].min()
        x = np.zeros((t.max() + 1, pols, 64), np.uint8)
        for p in range(pols):
            x[t, p, pdf["chan"]] = pdf["v"].to_numpy() // levels**p % levels
        number = int(pdf["t"].iloc[0]) // 128
        content = psrfits.encode(x, nbits, nsblk=gcd(len(x), 32 >> number % 3), imjd=60000 + number)
        return pd.DataFrame({"path": [f"{root}/X-M01_{number:07d}.fits"], "content": [content[:-psrfits.BLOCK] if number % 5 == 3 else content]})

    files = spec(spark, sf_dir).groupBy(F.expr("t div 128")).applyInPandas(run, "path string, content binary")
    psrfits.write_files(files).agg(F.sum("bytes")).first()
    return root


def _number():
    return F.regexp_extract("path", r"_(\d+)\.fits$", 1).cast("long").alias("file")


@query("fits_scan_8bit", f"SELECT t // 128 AS file, t % 128 AS t, CAST(63 - chan AS INT) AS chan, (((v % 256) + 256) % 256 + ((CAST(floor(v / 256::DOUBLE) AS BIGINT) % 256) + 256) % 256) / 2.0::DOUBLE AS v FROM {SPEC} WHERE NOT {_CUT}")
def fits_scan_8bit(spark, sf_dir):
    """Mean of two polarizations, channels reversed."""
    blocks = psrfits.read_blocks(spark, _observations(spark, sf_dir, 8), range_bytes=1 << 15)
    return psrfits.spectrum(blocks, reverse=True).select(_number(), "t", "chan", "v")


@query("fits_scan_2bit", f"SELECT t // 128 AS file, t % 128 AS t, chan, CAST(((v % 4) + 4) % 4 AS DOUBLE) AS v FROM {SPEC} WHERE NOT {_CUT}")
def fits_scan_2bit(spark, sf_dir):
    return psrfits.spectrum(psrfits.read_blocks(spark, _observations(spark, sf_dir, 2), range_bytes=1 << 12)).select(_number(), "t", "chan", "v")


@query("fits_headers", f"SELECT file, CASE WHEN file % 5 <> 3 THEN 64 END AS nchan, CASE WHEN file % 5 <> 3 THEN CAST(nsblk AS INT) END AS nsblk, CASE WHEN file % 5 <> 3 THEN CAST(n // nsblk AS INT) END AS naxis2, CASE WHEN file % 5 <> 3 THEN 60000.0::DOUBLE + file END AS start_mjd, CASE WHEN file % 5 <> 3 THEN 1000.0::DOUBLE END AS freq_0, CASE WHEN file % 5 <> 3 THEN 1000.0::DOUBLE + 63 * 500 / 64.0::DOUBLE END AS freq_63, CASE WHEN file % 5 = 3 THEN 'file is cut short' END AS error FROM {_SHAPES}")
def fits_headers(spark, sf_dir):
    """Shape, start and frequency axis of each file; a cut one is a row with its error."""
    found = psrfits.read_headers(spark, _observations(spark, sf_dir, 8))
    ends = [psrfits.frequency(F.lit(i)).alias(f"freq_{i}") for i in (0, 63)]
    return found.select(_number(), "nchan", "nsblk", "naxis2", X.start_mjd(F.col("stt_imjd"), F.col("stt_smjd"), F.col("stt_offs")).alias("start_mjd"), *ends, "error")


@query("header_consistency", f"""WITH g AS (SELECT count(DISTINCT nsblk) AS a, count(DISTINCT n // nsblk) AS b FROM {_SHAPES} WHERE file % 5 <> 3) SELECT 'nsblk' AS key, a AS n_values FROM g WHERE a > 1 UNION ALL SELECT 'naxis2', b FROM g WHERE b > 1""")
def header_consistency(spark, sf_dir):
    return psrfits.inconsistent(psrfits.read_headers(spark, _observations(spark, sf_dir, 8)))


@query("bad_file_noise", f"SELECT file, (SELECT max(n) FROM {_SHAPES} WHERE file % 5 <> 3) * 64 AS n_cells, true AS in_range FROM {_SHAPES} WHERE file % 5 = 3")
def bad_file_noise(spark, sf_dir):
    """Noise in the place of bad files, of the shape of a good one."""
    root = _observations(spark, sf_dir, 8)
    noise = psrfits.replace_bad(psrfits.read_blocks(spark, root), psrfits.read_headers(spark, root))
    return noise.groupBy(_number()).agg(F.count("*").alias("n_cells"), F.every(F.abs(F.col("v") - 1.5) <= 0.5 * float(np.sqrt(15))).alias("in_range"))


@query("file_tokens", "SELECT o_orderkey, o_orderpriority || '_' || CASE WHEN o_orderstatus = 'F' THEN 'packed2' ELSE 'raw8' END || '_' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '_ge' || replace(regexp_replace(CAST((o_orderkey % 40) / 8.0::DOUBLE AS VARCHAR), '\\.0$', ''), '.', 'p') AS token FROM orders")
def file_tokens(spark, sf_dir):
    quant = F.when(F.col("o_orderstatus") == "F", "packed2").otherwise("raw8")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.file_token(F.col("o_orderpriority"), quant, F.col("o_orderkey") % 10000, (F.col("o_orderkey") % 40) / 8.0).alias("token"))


@query("batch_members", "SELECT l_suppkey % 20 AS batch, count(*) AS n FROM lineitem WHERE l_suppkey % 20 IN (0, 1, 2, 3, 7, 12, 13) GROUP BY 1")
def batch_members(spark, sf_dir):
    batch = F.col("l_suppkey") % 20
    return table(spark, sf_dir, "lineitem").where(batch.isin(X.batches("0-3, 7,12-13"))).groupBy(batch.alias("batch")).agg(F.count("*").alias("n"))


@query("bin_labels", f"SELECT label, count(*) AS n FROM {MATCHES} JOIN (VALUES ('1-1.5', 1.0::DOUBLE, 1.5::DOUBLE), ('1.5-2.5', 1.5::DOUBLE, 2.5::DOUBLE), ('2.5-4', 2.5::DOUBLE, 4.0::DOUBLE), ('4-6.5', 4.0::DOUBLE, 6.5::DOUBLE), ('6.5-10', 6.5::DOUBLE, 10.0::DOUBLE), ('10-15', 10.0::DOUBLE, 15.0::DOUBLE), ('15-20', 15.0::DOUBLE, 20.0::DOUBLE)) x(label, lo, hi) ON width >= lo AND (width < hi OR (hi = 20 AND width = 20)) GROUP BY label")
def bin_labels(spark, sf_dir):
    binned = matches(spark, sf_dir).groupBy(A.bin_index(F.col("width"), A.WIDTH_BINS).alias("bin")).agg(F.count("*").alias("n"))
    return binned.join(F.broadcast(A.bins(spark, A.WIDTH_BINS)), "bin").select("label", "n")


@query("scene_sizing", f"SELECT injection_id, CAST(8192 + ceil(4150.0::DOUBLE * dm * (1 / (1000.0::DOUBLE * 1000.0::DOUBLE) - 1 / (1500.0::DOUBLE * 1500.0::DOUBLE)) / 0.001::DOUBLE) + 512 AS BIGINT) AS n_samples FROM {TRUTH}")
def scene_sizing(spark, sf_dir):
    return truth(spark, sf_dir).select("injection_id", X.scene_length(F.col("dm"), 1000.0, 1500.0, 0.001, 8192, 512).alias("n_samples"))


@query("decoded_names", "SELECT c_custkey, c_name AS name FROM customer")
def decoded_names(spark, sf_dir):
    """Names from bytes, some with bytes that are no text."""
    data = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))), F.encode("c_name", "UTF-8"), F.unhex(F.lit("C3")))
    return table(spark, sf_dir, "customer").select("c_custkey", X.decoded(data).alias("name"))


@query("sample_fetch", f"SELECT vec_id AS image, label, n, first, total FROM embeddings JOIN (SELECT image, count(*) AS n, CAST(max(v) FILTER (py = 0 AND px = 0) AS DOUBLE) AS first, sum(v)::DOUBLE AS total FROM {IMAGES} GROUP BY image) ON image = vec_id WHERE label % 2 = 0")
def sample_fetch(spark, sf_dir):
    """Images of the catalogue's rows."""
    catalogue = table(spark, sf_dir, "embeddings").where("label % 2 = 0").select(F.col("vec_id").alias("image"), "label")
    found = pixel_rows(spark, sf_dir).join(catalogue, "image")
    return found.select("image", "label", F.size("pixels").cast("long").alias("n"), F.col("pixels")[0].cast("double").alias("first"), F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x).alias("total"))


#: A log for each of three sections, two backends and the kinds of events, with a record of several lines for each event.
_LOGGED = "(SELECT *, user_id % 3 AS section, CASE WHEN user_id % 2 = 0 THEN 'cupy' ELSE 'numba' END AS backend, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_LOGS = f"""(SELECT section, backend, event_type AS model, count(*) AS n, sum(k) AS ks, NOT (section = 2 AND backend = 'numba') AS good, section = 2 AND event_type = 'click' AS broken FROM {_LOGGED} GROUP BY ALL)"""


def _log_files(spark, sf_dir):
    root = shared_folder(spark, "logs")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 3).alias("section"), F.when(F.col("user_id") % 2 == 0, "cupy").otherwise("numba").alias("backend"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    k = F.col("k")
    line = F.format_string("[Time] block %d load=%.2fs queued\n  freq_ds+norm=%.2fs dedisp=%.2fs\n  detect+save=%.2fs total=%.2fs wrote files, bursts=%d", "event_id", k / 100.0, k / 50.0, k / 20.0, k / 10.0, k / 4.0, k % 7)
    grouped = events.groupBy("section", "backend", "event_type").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("lines"), F.sum("k").alias("ks"), F.count("*").alias("n"))
    done = F.when((F.col("section") == 2) & (F.col("backend") == "numba"), F.when(F.col("event_type") == "click", "[Fail] no memory\nTraceback (most recent call last)").otherwise("[Info] stopped"))
    done = F.coalesce(done, F.format_string("[Done] total_bursts=0 total_time=1.0s avg_per_block=1.0s\n[Info] going on\n[Done] total_bursts=%d total_time=%.1fs avg_per_block=%.2fs", "n", F.col("ks") / 2.0, F.round(F.col("ks") / F.col("n"), 2)))
    text = F.concat(F.lit("search of a section\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"), done, F.lit("\n"))
    path = F.concat(F.lit(f"{root}/s"), F.col("section").cast("string"), F.lit("_"), F.col("backend"), F.lit("_"), F.col("event_type"), F.lit(".log"))
    psrfits.write_files(grouped.select(path.alias("path"), F.encode(text, "UTF-8").alias("content"))).agg(F.sum("bytes")).first()
    return root


@query("log_sections", f"""SELECT CAST(section AS INT) AS section, backend, model, CASE WHEN good THEN 'ok' WHEN broken THEN 'failed' ELSE 'missing_done' END AS status, n AS blocks, CASE WHEN good THEN round(ks / 2.0::DOUBLE, 1) END AS total_time, CASE WHEN good THEN n END AS total_bursts, b AS block_bursts, round(l, 4) AS load_avg, round(d, 4) AS dedisp_avg
FROM {_LOGS} JOIN (SELECT section, backend, event_type AS model, CAST(sum(k % 7) AS BIGINT) AS b, avg(round(k / 100.0::DOUBLE, 2)) AS l, avg(round(k / 20.0::DOUBLE, 2)) AS d FROM {_LOGGED} GROUP BY ALL) USING (section, backend, model)""")
def log_sections(spark, sf_dir):
    """Logs of a search matrix with records of several lines, one row for each log."""
    found = logs.summarise(logs.read_records(spark, _log_files(spark, sf_dir)))
    return found.select("section", "backend", "model", "status", "blocks", "total_time", "total_bursts", "block_bursts", F.round("load_avg", 4).alias("load_avg"), F.round("dedisp_avg", 4).alias("dedisp_avg"))


@query("log_matrix", f"SELECT backend, model, count_if(good)::BIGINT AS sections, max(round(ks / 2.0::DOUBLE, 1)) FILTER (good) AS wall_est, round(avg(round(ks / n, 2)) FILTER (good), 4) AS avg_block FROM {_LOGS} GROUP BY backend, model")
def log_matrix(spark, sf_dir):
    """Longest total and mean time of a block for each backend and model, over the sections that ended well."""
    found = logs.matrix(logs.summarise(logs.read_records(spark, _log_files(spark, sf_dir))))
    return found.select("backend", "model", "sections", "wall_est", F.round("avg_block", 4).alias("avg_block"))


_BACKGROUND = "(SELECT s_suppkey AS n, 'obs' || CASE s_suppkey % 7 WHEN 3 THEN '_N_' WHEN 5 THEN '_W_' ELSE '' END || '-M0' || CAST(1 + s_suppkey % 2 AS VARCHAR) || '_' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS name FROM supplier)"


@query("background_files", f"SELECT CAST(n AS INT) AS number, n % 5 AS bytes FROM {_BACKGROUND} WHERE n % 7 NOT IN (3, 5) AND n % 2 = 0 AND n % 5 > 0 AND n < 10000")
def background_files(spark, sf_dir):
    """Numbers and sizes of one beam's files in a folder that holds other beams' and tagged ones, too (empty files aren't listed)."""
    root, n = shared_folder(spark, "background"), F.col("s_suppkey")
    name = F.concat(F.lit(f"{root}/obs"), F.when(n % 7 == 3, "_N_").when(n % 7 == 5, "_W_").otherwise(""), F.lit("-M0"), (1 + n % 2).cast("string"), F.lit("_"), F.format_string("%04d", n), F.lit(".fits"))  # a longer number stays whole
    files = table(spark, sf_dir, "supplier").select(name.alias("path"), F.encode(F.repeat(F.lit("x"), (n % 5).cast("int")), "UTF-8").alias("content"))
    psrfits.write_files(files).agg(F.sum("bytes")).first()
    return tables.read_background_files(spark, root).select("number", "bytes")


@query("artefact_counts", "SELECT 'r' || CAST(s_nationkey % 4 AS VARCHAR) AS rate, count(*) AS n, count(DISTINCT s_suppkey % 5) AS n_files, CAST(max(s_suppkey) AS INT) AS last_block FROM supplier WHERE s_suppkey % 9 <> 0 GROUP BY 1")
def artefact_counts(spark, sf_dir):
    """Artefacts ``<file>-<block>`` in folders by rate; names of another form are left out."""
    root, n = shared_folder(spark, "artefacts"), F.col("s_suppkey")
    name = F.concat(F.lit(f"{root}/r"), (F.col("s_nationkey") % 4).cast("string"), F.lit("/a-b_"), (n % 5).cast("string"), F.when(n % 9 == 0, "_").otherwise("-"), n.cast("string"), F.lit(".npy"))
    psrfits.write_files(table(spark, sf_dir, "supplier").select(name.alias("path"), F.encode(F.lit("x"), "UTF-8").alias("content"))).agg(F.sum("bytes")).first()
    return tables.read_artefact_keys(spark, root).groupBy("rate").agg(F.count("*").alias("n"), F.count_distinct("file").alias("n_files"), F.max("block").alias("last_block"))


_SETS = ("True_LPT", "True_FRB", "True_RFI", "False_RFI", "False_LPT")
_SET = "CASE user_id % 5 WHEN 0 THEN 'True_LPT' WHEN 1 THEN 'True_FRB' WHEN 3 THEN 'False_RFI' ELSE 'False_LPT' END"
_SAMPLE_NAME = "strftime(ts, '%Y%m%d') || '-' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0')"


@query("sample_catalogue", f"""WITH s AS (SELECT {_SET} AS set, event_id // 2 AS idx, {_SAMPLE_NAME} AS name, user_id % 2 AS label, CASE WHEN user_id % 5 = 0 THEN CASE WHEN event_type = 'click' THEN 'True_LPT_Old' ELSE event_type END ELSE '' END AS source FROM events WHERE user_id % 5 <> 2),
o AS (SELECT *, row_number() OVER (PARTITION BY set, idx ORDER BY name, label, source) AS k FROM s)
SELECT set, idx, name, label, source, CASE WHEN set = 'True_LPT' AND regexp_matches(name, '^[0-9]{{8}}-(02|05|10)') AND source <> 'True_LPT_Old' THEN 6 WHEN set LIKE 'False%' THEN 2 ELSE 1 END AS repeat, set || ':' || idx AS sample_key FROM o WHERE k = 1""")
def sample_catalogue(spark, sf_dir):
    """The catalogue over four sample sets of five; one has sources, samples may be there twice."""
    root, events = shared_folder(spark, "samples"), table(spark, sf_dir, "events")
    name = F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("-"), F.lpad((F.col("user_id") % 12).cast("string"), 2, "0"))
    source = F.when(F.col("event_type") == "click", "True_LPT_Old").otherwise(F.col("event_type"))
    rows = events.select(F.expr("event_id div 2").alias("idx"), name.alias("names"), (F.col("user_id") % 2).alias("labels"), source.alias("sources"), (F.col("user_id") % 5).alias("of"))
    for of, kind in ((0, "True_LPT"), (1, "True_FRB"), (3, "False_RFI"), (4, "False_LPT")):
        rows.where(F.col("of") == of).drop(*(["of"] if of == 0 else ["of", "sources"])).write.parquet(f"{root}/{kind}.parquet")
    return tables.read_sample_sets(spark, root, _SETS[:3], _SETS[3:])


@query("frame_catalogue", """WITH b AS (SELECT l_orderkey AS frame, l_quantity AS w, l_discount * 300 AS h FROM lineitem), g AS (SELECT frame, count(*) FILTER (w >= 1 AND h >= 1) AS n, min(sqrt(w * h)) FILTER (w >= 1 AND h >= 1) AS m FROM b GROUP BY frame)
SELECT 'frames_' || CAST(o_orderkey % 3 AS VARCHAR) AS set, o_orderkey AS frame, CAST(coalesce(n, 0) AS INT) AS n_boxes, coalesce(n, 0) > 0 AS has_annotation, round(least(coalesce(m, 1e6), 1e6), 6) AS min_box_size FROM orders LEFT JOIN g ON frame = o_orderkey""")
def frame_catalogue(spark, sf_dir):
    """Frames of three sets (a fourth is missing) with their boxes."""
    root = shared_folder(spark, "frames")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.struct((F.col("l_quantity") - 5).alias("left"), (F.col("l_tax") * 200).alias("top"), F.col("l_quantity").alias("width"), (F.col("l_discount") * 300).alias("height")).alias("box"))
    boxes = line.groupBy("frame").agg(F.collect_list("box").alias("boxes"))  # the boxes of an image
    frames = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame")).join(boxes, "frame", "left")
    for of in range(3):
        frames.where(F.col("frame") % 3 == of).write.parquet(f"{root}/frames_{of}.parquet")
    found = tables.read_frame_sets(spark, root, [f"frames_{of}" for of in range(4)])
    return found.withColumn("min_box_size", F.round(F.least("min_box_size", F.lit(1e6)), 6))


@query("run_manifests", f"SELECT q AS quantization, CASE WHEN q = 'packed2' THEN 'raw8' END AS derived_from, 7 AS seed, count(*) AS n_truth FROM {TRUTH}, (VALUES ('raw8'), ('packed2')) x(q) GROUP BY q")
def run_manifests(spark, sf_dir):
    """Truth and configuration of a run, written for both quantizations and read back."""
    root = shared_folder(spark, "run")
    tables.write_run(truth(spark, sf_dir).drop("quant"), {"seed": 7, "source": "X"}, root, ["raw8", "packed2"], "raw8")
    found, config = tables.read_run(spark, root, "seed int, source string")
    return config.join(found.groupBy("quantization").agg(F.count("*").alias("n_truth")), "quantization").select("quantization", "derived_from", "seed", "n_truth")


@query("frame_set_round_trip", f"""WITH b AS (SELECT image, count(*) AS n, round(sum("rank" * 10 + px), 3)::DOUBLE AS total FROM {_TOP} GROUP BY image) SELECT vec_id AS frame, 64 AS n_pixels, CAST(coalesce(n, 0) AS INT) AS n_boxes, coalesce(total, -1.0::DOUBLE) AS total FROM embeddings LEFT JOIN b ON image = vec_id""")
def frame_set_round_trip(spark, sf_dir):
    """A training set with its side-car of annotations, written and read back; frames without a box have a placeholder."""
    root = shared_folder(spark, "frames")
    tops = I.top_pixels(I.peaks(images(spark, sf_dir), 100000), 4)
    boxes = tops.select(F.col("image").alias("frame"), F.col("rank").alias("box"), (F.col("rank") * 10 + F.col("px")).alias("left"), F.col("py").alias("top"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    tables.write_frame_set(pixel_rows(spark, sf_dir).withColumnRenamed("image", "frame"), boxes, f"{root}/set.parquet")
    side = tables.read_jsonl(spark, f"{root}/set.parquet.json", "frame long, annotations array<array<double>>", strict=True)
    totals = side.select("frame", F.aggregate("annotations", F.lit(0.0), lambda a, x: a + x[0]).alias("total"))
    frames = spark.read.parquet(f"{root}/set.parquet").select("frame", F.size("pixels").alias("n_pixels"), F.greatest(F.size("boxes"), F.lit(0)).alias("n_boxes"))
    return frames.join(totals, "frame").select("frame", "n_pixels", "n_boxes", "total")
