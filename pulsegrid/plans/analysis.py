"""Driver queries: candidate matching, clustering, recall and threshold analytics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import images as I
from ..operators import matching as M
from ..operators import metrics as A
from .proxies import CANDIDATES, FALSE_POSITIVES, IMAGES, MATCHES, TRUTH, candidates, false_positives, images, matches, table, truth
from . import sequential as Q
from .registry import query
from .spectra import _TOP

TIME_TOL, DM_TOL = 120, 60.0
_FILES = f"(SELECT DISTINCT stem, CAST(regexp_extract(stem, '_([0-9]+)$', 1) AS INT) - 1 AS file_index FROM {TRUTH} WHERE CAST(regexp_extract(stem, '_([0-9]+)$', 1) AS INT) % 3 = 0)"


@query("global_sample_alignment", f"""WITH b AS (SELECT min(CAST(regexp_extract(stem, '_([0-9]+)$', 1) AS INT) - file_index) AS base FROM {_FILES})
SELECT cand_id, coalesce(file_index, CAST(regexp_extract(stem, '_([0-9]+)$', 1) AS INT) - base) AS file_index, CAST(coalesce(file_index, CAST(regexp_extract(stem, '_([0-9]+)$', 1) AS INT) - base) AS BIGINT) * 86400 + sample AS global_sample
FROM {CANDIDATES} LEFT JOIN {_FILES} USING (stem), b""")
def global_sample_alignment(spark, sf_dir):
    number = M.file_number("stem")
    files = truth(spark, sf_dir).select("stem").distinct().where(number % 3 == 0).withColumn("file_index", number - 1)
    return M.align_to_files(candidates(spark, sf_dir), files, 86400).select("cand_id", "file_index", "global_sample")


_EDGES = f"(SELECT quant, stem, t.injection_id, c.cand_id, c.sample - t.sample AS dt, c.dm - t.dm AS ddm, c.cls FROM {TRUTH} t JOIN {CANDIDATES} c USING (quant, stem) WHERE abs(c.sample - t.sample) <= {TIME_TOL} AND abs(c.dm - t.dm) <= {DM_TOL})"


def _edges(spark, sf_dir):
    pairs = M.band_join(truth(spark, sf_dir), candidates(spark, sf_dir), M.KEY, TIME_TOL, DM_TOL)
    return pairs.select(*M.KEY, "injection_id", F.col("r_cand_id").alias("cand_id"), "dt", "ddm", F.col("r_cls").alias("cls"))


@query("band_edges", f"SELECT injection_id, cand_id, dt, round(ddm, 6) + 0.0 AS ddm FROM {_EDGES}")
def band_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("injection_id", "cand_id", "dt", (F.round("ddm", 6) + 0.0).alias("ddm"))


_MEMBERS = f"(SELECT *, quant || ':' || stem || ':' || CAST(sample // 900 AS VARCHAR) AS event FROM {CANDIDATES})"


def _members(spark, sf_dir):
    return candidates(spark, sf_dir).withColumn("event", F.concat_ws(":", "quant", "stem", F.expr("sample div 900")))


@query("event_truth_best_member", f"""SELECT injection_id, event, cand_id, round(cost, 6) + 0.0 AS cost FROM (SELECT *, row_number() OVER (PARTITION BY injection_id, event ORDER BY cost, cand_id) AS k FROM
(SELECT t.injection_id, m.event, m.cand_id, abs(m.sample - t.sample) / {float(TIME_TOL)}::DOUBLE + abs(m.dm - t.dm) / {DM_TOL}::DOUBLE - m.cls * 0.05::DOUBLE AS cost FROM {TRUTH} t JOIN {_MEMBERS} m USING (quant, stem)
WHERE abs(m.sample - t.sample) <= {TIME_TOL} AND abs(m.dm - t.dm) <= {DM_TOL})) WHERE k = 1""")
def event_truth_best_member(spark, sf_dir):
    return M.best_members(truth(spark, sf_dir), _members(spark, sf_dir), TIME_TOL, DM_TOL).withColumn("cost", F.round("cost", 6) + 0.0)


@query("false_positive_antijoin", f"""SELECT event, count(*) AS n_members FROM {_MEMBERS} m WHERE event NOT IN (SELECT m.event FROM {_MEMBERS} m JOIN {TRUTH} t USING (quant, stem)
WHERE abs(m.sample - t.sample) <= {TIME_TOL} AND abs(m.dm - t.dm) <= {DM_TOL}) GROUP BY event""")
def false_positive_antijoin(spark, sf_dir):
    return M.unexplained_events(_members(spark, sf_dir), truth(spark, sf_dir), TIME_TOL, DM_TOL)


def _nearest_sql(time_unit, dm_unit):
    return f"""SELECT cand_id, injection_id, assigned_snr, round(distance, 6) AS distance FROM (SELECT c.cand_id, t.injection_id, t.snr AS assigned_snr, abs(t.sample - c.sample) / {time_unit}::DOUBLE + abs(t.dm - c.dm) / {dm_unit}::DOUBLE AS distance,
row_number() OVER (PARTITION BY c.cand_id ORDER BY abs(t.sample - c.sample) / {time_unit}::DOUBLE + abs(t.dm - c.dm) / {dm_unit}::DOUBLE, t.injection_id) AS k FROM {CANDIDATES} c JOIN {TRUTH} t USING (quant, stem)) WHERE k = 1"""


@query("nearest_truth_attribution", _nearest_sql(1000.0, 100.0))
def nearest_truth_attribution(spark, sf_dir):
    return M.nearest_truth(candidates(spark, sf_dir), truth(spark, sf_dir), 1000.0, 100.0).withColumn("distance", F.round("distance", 6))


@query("nearest_truth_baseline", _nearest_sql(1.0, 2.0))
def nearest_truth_baseline(spark, sf_dir):
    return M.nearest_truth(candidates(spark, sf_dir), truth(spark, sf_dir), 1.0, 2.0).withColumn("distance", F.round("distance", 6))


#: Nine parameters of an injection, of its signal-to-noise ratio and DM alone.
_PARAMETERS = {
    "snr": "snr", "dm_pc_cm3": "dm", "width_ms_fwhm": "snr / 5 + 1", "bandwidth_mhz_fwhm": "100 + dm", "scattering_ms_at_1ghz": "snr * dm / 997", "scattering_ms_at_highest_freq": "snr * dm / 3989",
    "center_freq_mhz": "1000 + snr * 5", "effective_channels_fwhm": "64 + dm * 2", "per_channel_peak_snr": "snr / 8",
}


@query("assigned_parameters", f"SELECT cand_id, injection_id, {', '.join(f'round(assigned_{c}, 6) AS assigned_{c}' for c in _PARAMETERS)} FROM (SELECT c.cand_id, t.injection_id, {', '.join(f'({e.replace('snr', 't.snr').replace('dm', 't.dm')})::DOUBLE AS assigned_{c}' for c, e in _PARAMETERS.items())}, row_number() OVER (PARTITION BY c.cand_id ORDER BY abs(t.sample - c.sample) / 1000.0::DOUBLE + abs(t.dm - c.dm) / 100.0::DOUBLE, t.injection_id) AS k FROM {CANDIDATES} c JOIN {TRUTH} t USING (quant, stem)) WHERE k = 1")
def assigned_parameters(spark, sf_dir):
    """All parameters of the nearest injection beside each candidate."""
    known = truth(spark, sf_dir)
    known = known.select("injection_id", "quant", "stem", "sample", "dm", *(F.expr(e).cast("double").alias(c) for c, e in _PARAMETERS.items()))
    found = M.nearest_truth(candidates(spark, sf_dir), known, 1000.0, 100.0, tuple(_PARAMETERS)).drop("distance")
    return found.withColumns({f"assigned_{c}": F.round(f"assigned_{c}", 6) for c in _PARAMETERS})


@query("cluster_bounded_events", Q.bounded_events(600, DM_TOL))
def cluster_bounded_events(spark, sf_dir):
    return M.bounded_events(candidates(spark, sf_dir), 600, DM_TOL)


@query("cluster_grid_events", Q.grid_events(600, DM_TOL))
def cluster_grid_events(spark, sf_dir):
    return M.grid_events(candidates(spark, sf_dir), 600, DM_TOL)


@query("physical_dedup", f"{Q.greedy_kept(CANDIDATES, 600, DM_TOL)} SELECT * FROM {CANDIDATES} JOIN kept USING (cand_id)")
def physical_dedup(spark, sf_dir):
    return M.physical_dedup(candidates(spark, sf_dir), 600, DM_TOL)


@query("optimal_assignment", Q.assignment(TIME_TOL, DM_TOL))
def optimal_assignment(spark, sf_dir):
    found = M.assign_near(truth(spark, sf_dir), candidates(spark, sf_dir), TIME_TOL, DM_TOL, "cls", 0.05)
    return truth(spark, sf_dir).select("injection_id", "snr", "dm").join(found, "injection_id", "left").withColumns({"cost": F.round("cost", 6), "detected": F.col("cand_id").isNotNull()})


_REAL = f"(SELECT * FROM (SELECT image, py, px, row_number() OVER (PARTITION BY image ORDER BY v % 1009 DESC, py, px) AS \"rank\" FROM {IMAGES} WHERE v > 0) WHERE \"rank\" <= 3)"
CENTRE_MATCHES = Q.centre_matches(_TOP, _REAL, 2.0)


def _real_centres(pixels):
    return I.top_pixels(pixels.where("v > 0").withColumn("v", F.pmod("v", F.lit(1009))), 3)


def _centre_matches(spark, sf_dir):
    pixels = images(spark, sf_dir)
    found = I.top_pixels(I.peaks(pixels, 100000), 4).select("image", F.lit(0).alias("side"), "rank", "px", "py")
    real = _real_centres(pixels).select("image", F.lit(1).alias("side"), "rank", "px", "py")

    side = lambda n: F.sort_array(F.collect_list(F.when(F.col("side") == n, F.struct("rank", "px", "py"))))
    lists = found.union(real).groupBy("image").agg(side(0).alias("own"), side(1).alias("gt"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for image, own, gt in zip(pdf["image"], pdf["own"], pdf["gt"]):
                centres = [np.array([(r["px"], r["py"]) for r in x], float).reshape(-1, 2) for x in (own, gt)]
                rows += [(image, r["rank"], j, d) for r, (j, d) in zip(own, M.greedy_centres(*centres, 2.0))]
            yield pd.DataFrame(rows, columns=["image", "rank", "truth", "distance"])

    return lists.mapInPandas(run, "image long, rank int, truth int, distance double")  # one row for each image, as images are small


@query("greedy_center_match", f'SELECT image, "rank", truth, round(distance, 6) AS distance FROM {CENTRE_MATCHES}')
def greedy_center_match(spark, sf_dir):
    return _rounded(_centre_matches(spark, sf_dir), "distance")


@query("tolerant_block_match", Q.TOLERANT_BLOCKS)
def tolerant_block_match(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.expr("l_orderkey div 64").alias("block"), F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("side")).distinct()

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf.loc[pdf.side == s, "block"].tolist() for s in (0, 1))
        return pd.DataFrame([(pdf["file"].iloc[0], len(a), len(b), M.tolerant_matches(a, b))], columns=["file", "n_left", "n_right", "n_matched"])

    return M.grouped_greedy(line, ["file"], pick, "file long, n_left long, n_right long, n_matched long")


_KEYSETS = "(SELECT l_suppkey, l_orderkey // 16 AS block, max((l_linestatus = 'F')::INT) AS a, max((l_linestatus = 'O')::INT) AS b FROM lineitem GROUP BY ALL)"


@query("exact_key_metrics", f"SELECT l_suppkey AS file, CAST(sum(a) AS BIGINT) AS n_left, CAST(sum(b) AS BIGINT) AS n_right, CAST(sum(a * b) AS BIGINT) AS n_common, round(sum(a * b) / greatest(sum(b), 1), 6) AS recall FROM {_KEYSETS} GROUP BY l_suppkey")
def exact_key_metrics(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file"), F.expr("l_orderkey div 16").alias("block"))
    sides = keys.agg(F.max((F.col("l_linestatus") == "F").cast("int")).alias("a"), F.max((F.col("l_linestatus") == "O").cast("int")).alias("b"))
    common = F.sum(F.col("a") * F.col("b"))
    return sides.groupBy("file").agg(F.sum("a").alias("n_left"), F.sum("b").alias("n_right"), common.alias("n_common"), F.round(common / F.greatest(F.sum("b"), F.lit(1)), 6).alias("recall"))


def _bin_sql(value, edges):
    last = len(edges) - 2
    return "CASE " + " ".join(f"WHEN {value} >= {lo} AND {value} {'<=' if i == last else '<'} {hi} THEN {i}" for i, (lo, hi) in enumerate(zip(edges, edges[1:]))) + " END"


def _bins_sql(edges):
    return "(VALUES " + ", ".join(f"({i}, {float(lo)}::DOUBLE, {float(hi)}::DOUBLE, '{lo:g}-{hi:g}')" for i, (lo, hi) in enumerate(zip(edges, edges[1:]))) + ")"


PARAMETERS = {"dm": A.DM_BINS, "width": A.WIDTH_BINS}


@query("recall_by_bins", f"""SELECT CAST(b AS INT) AS bin, lo, hi, label, coalesce(n, 0) AS n_total, CAST(coalesce(d, 0) AS BIGINT) AS n_detected, round(d / nullif(n, 0), 6) AS recall FROM {_bins_sql(A.DM_BINS)} x(b, lo, hi, label)
LEFT JOIN (SELECT {_bin_sql('dm', A.DM_BINS)} AS b, count(*) AS n, count_if(detected) AS d FROM {MATCHES} GROUP BY 1) USING (b)""")
def recall_by_bins(spark, sf_dir):
    return A.recall_by_bin(matches(spark, sf_dir), "dm", A.DM_BINS).withColumn("recall", F.round("recall", 6))


@query("recall_heatmap_inclusive", f"""SELECT CAST(x.b AS INT) AS x_bin, CAST(y.b AS INT) AS y_bin, count(*) AS n_total, CAST(count_if(detected) AS BIGINT) AS n_detected FROM {MATCHES} JOIN {_bins_sql(A.SNR_BINS)} x(b, lo, hi, l) ON snr >= x.lo AND snr <= x.hi
JOIN {_bins_sql(A.WIDTH_BINS)} y(b, lo, hi, l) ON width >= y.lo AND width <= y.hi GROUP BY ALL""")
def recall_heatmap_inclusive(spark, sf_dir):
    return A.recall_heatmap_inclusive(matches(spark, sf_dir), "snr", A.SNR_BINS, "width", A.WIDTH_BINS)


def _long_sql(source, kept=""):
    return " UNION ALL ".join(f"SELECT quant, '{p}' AS parameter, {_bin_sql(p, e)} AS param_bin, {_bin_sql('snr', A.SNR_BINS)} AS snr_bin{kept} FROM {source}" for p, e in PARAMETERS.items())


_GRID = "(SELECT quant, parameter, CAST(param_bin AS INT) AS param_bin, CAST(snr_bin AS INT) AS snr_bin FROM (VALUES ('raw8'), ('packed2')) q(quant), (VALUES ('dm', 7), ('width', 7)) p(parameter, n), range(7) b(param_bin), range(8) s(snr_bin))"
CUBE = f"""(WITH h AS (SELECT quant, parameter, param_bin, snr_bin, count(*) AS n, count_if(detected) AS d FROM ({_long_sql(MATCHES, ', detected')}) GROUP BY 1, 2, 3, 4), f AS (SELECT quant, parameter, param_bin, snr_bin, count(*) AS w FROM ({_long_sql(FALSE_POSITIVES)}) GROUP BY 1, 2, 3, 4)
SELECT quant, parameter, param_bin, snr_bin, coalesce(n, 0) AS n_total, CAST(coalesce(d, 0) AS BIGINT) AS n_detected, coalesce(w, 0) AS n_fp, round(d / nullif(n, 0), 6) AS recall, round(coalesce(d, 0) / nullif(coalesce(d, 0) + coalesce(w, 0), 0), 6) AS precision_proxy
FROM {_GRID} LEFT JOIN h USING (quant, parameter, param_bin, snr_bin) LEFT JOIN f USING (quant, parameter, param_bin, snr_bin))"""


def _cube(spark, sf_dir):
    return A.cell_cube(matches(spark, sf_dir), false_positives(spark, sf_dir), PARAMETERS)


@query("cell_cube", f"SELECT * FROM {CUBE}")
def cell_cube(spark, sf_dir):
    return _cube(spark, sf_dir).withColumns({"recall": F.round("recall", 6), "precision_proxy": F.round("precision_proxy", 6)})


@query("campaign_summary", f"""SELECT quant, n AS n_total, CAST(d AS BIGINT) AS n_detected, CAST(l AS BIGINT) AS n_localised, coalesce(w, 0) AS n_fp, round(d / n, 6) AS recall, round(d / (d + coalesce(w, 0)), 6) AS precision_proxy, round(l / d, 6) AS localised
FROM (SELECT quant, count(*) AS n, count_if(detected) AS d, count_if(detected AND abs(dm_error) <= 2) AS l FROM {MATCHES} GROUP BY quant) LEFT JOIN (SELECT quant, count(*) AS w FROM {FALSE_POSITIVES} GROUP BY quant) USING (quant)""")
def campaign_summary(spark, sf_dir):
    return A.campaign_summary(matches(spark, sf_dir), false_positives(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("recall", "precision_proxy", "localised")})


@query("loss_map", f"SELECT parameter, param_bin, snr_bin, round(max(recall) FILTER (quant = 'raw8') - max(recall) FILTER (quant = 'packed2'), 5) + 0.0 AS loss FROM {CUBE} GROUP BY 1, 2, 3")
def loss_map(spark, sf_dir):
    rounded = _cube(spark, sf_dir).withColumn("recall", F.round("recall", 6))
    return A.loss_map(rounded).withColumn("loss", F.round("loss", 5) + 0.0)


@query("snr_rows", f"SELECT quant, CAST(b AS INT) AS bin, round(sqrt(lo * hi), 6) AS centre, n AS n_total, CAST(d AS BIGINT) AS n_detected, round(d / n, 6) AS recall FROM (SELECT quant, {_bin_sql('snr', A.SNR_BINS)} AS b, count(*) AS n, count_if(detected) AS d FROM {MATCHES} GROUP BY 1, 2) JOIN {_bins_sql(A.SNR_BINS)} x(b, lo, hi, label) USING (b)")
def snr_rows(spark, sf_dir):
    return A.snr_rows(matches(spark, sf_dir)).withColumns({"centre": F.round("centre", 6), "recall": F.round("recall", 6)})


@query("error_percentiles", f"""SELECT quant, count(*) AS n, round(count_if(detected) / count(*), 6) AS recall, round(count_if(detected AND snr >= 10) / greatest(1, count_if(snr >= 10)), 6) AS recall_snr10, round(count_if(detected AND snr >= 20) / greatest(1, count_if(snr >= 20)), 6) AS recall_snr20,
round(quantile_cont(abs(dm_error), 0.5) FILTER (detected), 6) AS error_median, round(quantile_cont(abs(dm_error), 0.9) FILTER (detected), 6) AS error_p90 FROM {MATCHES} GROUP BY quant""")
def error_percentiles(spark, sf_dir):
    return A.error_summary(matches(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("recall", "recall_snr10", "recall_snr20", "error_median", "error_p90")})


_HISTOGRAM = f"(SELECT quant, CAST(round_even(sigma * 100, 0) AS INT) AS sigma_centi, count(*) AS n FROM {FALSE_POSITIVES} GROUP BY 1, 2)"


@query("fp_histograms", f"SELECT * FROM {_HISTOGRAM}")
def fp_histograms(spark, sf_dir):
    return A.fp_histogram(false_positives(spark, sf_dir))


@query("fp_cell_histograms", f"SELECT parameter, quant, sigma_centi, snr_bin, param_bin, count(*) AS n FROM ({_long_sql(FALSE_POSITIVES, ', CAST(round_even(sigma * 100, 0) AS INT) AS sigma_centi')}) WHERE snr_bin IS NOT NULL AND param_bin IS NOT NULL GROUP BY 1, 2, 3, 4, 5")
def fp_cell_histograms(spark, sf_dir):
    return A.fp_cell_histogram(false_positives(spark, sf_dir), PARAMETERS)


LEVELS = [0.5, 2.25, 4.0, 7.0, 50.0]


@query("cells_by_threshold", f"""WITH h AS (SELECT parameter, quant, sigma_centi, snr_bin, param_bin FROM ({_long_sql(FALSE_POSITIVES, ', CAST(round_even(sigma * 100, 0) AS INT) AS sigma_centi')}))
SELECT t AS threshold, g.parameter, g.quant, g.param_bin, g.snr_bin, count(h.quant) AS n_fp FROM {_GRID} g CROSS JOIN (VALUES {', '.join(f'({t}::DOUBLE)' for t in LEVELS)}) x(t) LEFT JOIN h ON h.parameter = g.parameter AND h.quant = g.quant AND h.param_bin = g.param_bin AND h.snr_bin = g.snr_bin AND sigma_centi >= ceil(t * 100 - 1e-9) GROUP BY ALL""")
def cells_by_threshold(spark, sf_dir):
    return A.cells_by_threshold(A.fp_cell_histogram(false_positives(spark, sf_dir), PARAMETERS), LEVELS, PARAMETERS)


@query("threshold_rollup", f"SELECT t AS threshold, quant, CAST(coalesce(sum(n) FILTER (sigma_centi >= ceil(t * 100 - 1e-9)), 0) AS BIGINT) AS n_fp FROM (VALUES (3.0::DOUBLE), (5.5::DOUBLE), (7.0::DOUBLE), (50.0::DOUBLE)) x(t), {_HISTOGRAM} GROUP BY 1, 2")
def threshold_rollup(spark, sf_dir):
    return A.threshold_rollup(A.fp_histogram(false_positives(spark, sf_dir)), [3.0, 5.5, 7.0, 50.0])


SWEPT = [1.0, 3.0, 5.0, 8.0]


@query("threshold_sweep", Q.threshold_sweep(SWEPT, TIME_TOL, DM_TOL))
def threshold_sweep(spark, sf_dir):
    thresholds = spark.createDataFrame([(t,) for t in SWEPT], "threshold double")
    found = M.sweep_near(truth(spark, sf_dir), candidates(spark, sf_dir), TIME_TOL, DM_TOL, SWEPT, 0.001)
    total = truth(spark, sf_dir).agg(F.count("*").alias("n_total"))
    return thresholds.join(found.groupBy("threshold").agg(F.count("*").alias("n_detected")), "threshold", "left").fillna(0).crossJoin(total)


_SCORED = "(SELECT doc_id AS id, n_chars AS conf, quality AS tp FROM documents JOIN labels USING (doc_id))"
_CURVE = f"""(SELECT id, conf, n AS "rank", tps AS cum_tp, tps / (n + 1e-8::DOUBLE) AS "precision", tps / (p + 1e-8::DOUBLE) AS recall FROM (SELECT id, conf, row_number() OVER w AS n, CAST(sum(tp) OVER (ORDER BY conf DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tps, CAST(sum(tp) OVER () AS BIGINT) AS p FROM {_SCORED} WINDOW w AS (ORDER BY conf DESC, id)))"""
_F1 = '2 * "precision" * recall / ("precision" + recall + 1e-8::DOUBLE)'


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("conf"), F.col("quality").alias("tp"))


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("pr_curve", f'SELECT id, conf, "rank", cum_tp, round("precision", 6) AS "precision", round(recall, 6) AS recall, round({_F1}, 6) AS f1 FROM {_CURVE}')
def pr_curve(spark, sf_dir):
    return _rounded(A.pr_curve(_scored(spark, sf_dir)), "precision", "recall", "f1")


@query("operating_point", f'SELECT id, conf, "rank", round("precision", 6) AS "precision", round(recall, 6) AS recall, round({_F1}, 6) AS f1 FROM {_CURVE} ORDER BY round(recall * 0.5 + "precision" * 0.2, 12) DESC, "rank" LIMIT 1')
def operating_point(spark, sf_dir):
    return _rounded(A.operating_point(A.pr_curve(_scored(spark, sf_dir))), "precision", "recall", "f1")


#: Detections are the matched centres of greedy_center_match; equal confidences go by image and rank.
_FOUND = f"(SELECT image * 10 + \"rank\" AS id, v AS conf, CASE WHEN truth >= 0 THEN 1 ELSE 0 END AS tp, CASE WHEN truth >= 0 THEN distance END AS distance FROM {CENTRE_MATCHES} JOIN {_TOP} USING (image, \"rank\"))"


@query("detector_score", f"""WITH n AS (SELECT count(*) AS n FROM {_REAL}), c AS (SELECT *, row_number() OVER (ORDER BY conf DESC, id) AS k, sum(tp) OVER (ORDER BY conf DESC, id ROWS UNBOUNDED PRECEDING) AS t FROM {_FOUND}), s AS (SELECT c.*, t / (k + 1e-8::DOUBLE) AS p, t / n::DOUBLE AS r FROM c, n),
b AS (SELECT * FROM s ORDER BY round(r * 0.5 + p * 0.2, 12) DESC, k LIMIT 1), d AS (SELECT avg(s.distance) AS m, quantile_cont(s.distance, [0.5, 0.9, 0.95]) AS q FROM s, b WHERE s.k <= b.k AND s.tp = 1)
SELECT round(2 * p * r / (p + r + 1e-8::DOUBLE), 6) AS f1, CAST(conf AS DOUBLE) AS f1_conf, round(p, 6) AS "precision", round(r, 6) AS recall, round(m, 6) AS mean_center_dist, round(q[1], 6) AS p50_center_dist, round(q[2], 6) AS p90_center_dist, round(q[3], 6) AS p95_center_dist,
round(greatest(0.0, 1 - q[2] / 2.0::DOUBLE), 6) AS center_quality, round(0.5 * r + 0.2 * p + 0.3 * greatest(0.0, 1 - q[2] / 2.0::DOUBLE), 6) AS score FROM b, d""")
def detector_score(spark, sf_dir):
    """Operating point, centre distances and score of the detector over all images."""
    pixels = images(spark, sf_dir)
    conf = I.top_pixels(I.peaks(pixels, 100000), 4).select("image", "rank", F.col("v").alias("conf"))
    n_truth = _real_centres(pixels).count()
    found = _centre_matches(spark, sf_dir).join(conf, ["image", "rank"])
    rows = found.select((F.col("image") * 10 + F.col("rank")).alias("id"), "conf", (F.col("truth") >= 0).cast("int").alias("tp"), F.when(F.col("truth") >= 0, F.col("distance")).alias("distance"))
    out = A.detector_score(rows, n_truth, 2.0)
    return _rounded(out, *(c for c in out.columns if c != "f1_conf"))


@query("binary_metrics", """SELECT n, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp + 1e-8::DOUBLE), 6) AS "precision", round(tp / (tp + fn + 1e-8::DOUBLE), 6) AS recall FROM (SELECT count(*) AS n, count_if(quality = 1 AND p = 1)::BIGINT AS tp, count_if(quality = 0 AND p = 1)::BIGINT AS fp,
count_if(quality = 1 AND p = 0)::BIGINT AS fn, count_if(quality = 0 AND p = 0)::BIGINT AS tn FROM (SELECT quality, (n_chars > 1500)::INT AS p FROM documents JOIN labels USING (doc_id)))""")
def binary_metrics(spark, sf_dir):
    scored = _scored(spark, sf_dir).select(F.col("tp").alias("label"), (F.col("conf") > 1500).cast("int").alias("pred"))
    return _rounded(A.binary_metrics(scored), "accuracy", "precision", "recall")
