"""Driver queries: scalar functions and the smaller operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import images as I
from ..operators import metrics as A
from ..operators import signals as S
from .analysis import _F1, CENTRE_MATCHES, CUBE, _centre_matches, _cube, _rounded
from .proxies import CANDIDATES, IMAGES, MATCHES, SPEC, TRUTH, candidates, images, matches, spec, table, truth
from .registry import query
from .spectra import _PEAKS, _TOP


@query("derived_truth", f"""SELECT injection_id, round(greatest(1.0, bw / (500.0::DOUBLE / 4096)), 6) AS effective_channels, round(snr / sqrt(greatest(1.0, bw / (500.0::DOUBLE / 4096))), 6) AS per_channel_snr FROM (SELECT injection_id, snr, dm * 1.5 AS bw FROM {TRUTH})""")
def derived_truth(spark, sf_dir):
    rows = truth(spark, sf_dir).withColumn("bw", F.col("dm") * 1.5)
    n = F.lit(4096)
    return rows.select("injection_id", F.round(X.effective_channels(F.col("bw"), n), 6).alias("effective_channels"), F.round(X.per_channel_snr(F.col("snr"), F.col("bw"), n), 6).alias("per_channel_snr"))


# 2e-8 days keep values that are ties in decimal, but not in binary, on one side of the rounding
@query("mjd_projection", "SELECT event_id, round(epoch_us(ts) / 86400000000.0::DOUBLE + 40587 + 2e-8::DOUBLE, 6) AS mjd, round(60310 + (user_id * 60 + value) / 86400.0::DOUBLE + 2e-8::DOUBLE, 6) AS start_mjd, round(60310 + (user_id * 60 + value) / 86400.0::DOUBLE + value / 86400.0::DOUBLE + 2e-8::DOUBLE, 6) AS signal_mjd FROM events")
def mjd_projection(spark, sf_dir):
    start = X.start_mjd(F.lit(60310), F.col("user_id") * 60, F.col("value"))
    shown = lambda c: F.round(c + 2e-8, 6)
    return table(spark, sf_dir, "events").select("event_id", shown(X.timestamp_to_mjd(F.col("ts"))).alias("mjd"), shown(start).alias("start_mjd"), shown(start + F.col("value") / 86400.0).alias("signal_mjd"))


@query("dispersion_delay", f"""SELECT injection_id, round(4150.0::DOUBLE * dm * (1 / (f * f) - 1 / (1500.0::DOUBLE * 1500.0)), 9) AS search_s, round(4148.808::DOUBLE * dm * (1 / (f * f) - 1 / (1500.0::DOUBLE * 1500.0)), 9) AS injection_s,
CAST(ceil(trunc(4150.0::DOUBLE * dm * (1 / (f * f) - 1 / (1500.0::DOUBLE * 1500.0)) / 0.00005::DOUBLE) / 1000) AS BIGINT) AS n_files FROM (SELECT injection_id, dm, 1000.0::DOUBLE + injection_id % 400 AS f FROM {TRUTH})""")
def dispersion_delay(spark, sf_dir):
    rows, top = truth(spark, sf_dir).withColumn("f", F.lit(1000.0) + F.col("injection_id") % 400), F.lit(1500.0)
    search = X.search_delay(F.col("dm"), F.col("f"), top)
    return rows.select("injection_id", F.round(search, 9).alias("search_s"), F.round(X.injection_delay(F.col("dm"), F.col("f"), top), 9).alias("injection_s"), X.span_files(search / 0.00005, 1000).alias("n_files"))


@query("tolerance_samples", f"SELECT injection_id, greatest(1, CAST(round_even(snr / 8.0::DOUBLE, 0) AS BIGINT)) AS samples, greatest(25.0::DOUBLE, coalesce(nullif(dm, 0), 25.0)) AS source_tol, CAST(ceil(dm * 100 - 1e-9) AS INT) AS centi FROM {TRUTH}")
def tolerance_samples(spark, sf_dir):
    samples = F.greatest(F.lit(1), F.bround(F.col("snr") / 8.0).cast("long"))
    return truth(spark, sf_dir).select("injection_id", samples.alias("samples"), X.source_tolerance(F.lit(25.0), X.first_set(F.col("dm"), F.lit(25.0))).alias("source_tol"), X.sigma_threshold(F.col("dm")).alias("centi"))


@query("valid_series", f"SELECT t // 10 AS series, round(stddev_pop(v), 4) AS std, count(*) AS n FROM {SPEC} GROUP BY 1 HAVING stddev_pop(v) > 124000 AND bool_and(isfinite(v::DOUBLE))")
def valid_series(spark, sf_dir):
    grouped = spec(spark, sf_dir).groupBy(F.expr("t div 10").alias("series")).agg(F.stddev_pop("v").alias("std"), F.count("*").alias("n"), F.bool_and(~F.isnan(F.col("v").cast("double"))).alias("finite"))
    return grouped.where("finite and std > 124000").select("series", F.round("std", 4).alias("std"), "n")


@query("valid_boxes", "SELECT l_orderkey, l_linenumber, l_quantity - 25 AS \"left\", l_tax * 100 AS w FROM lineitem WHERE l_tax * 100 >= 1 AND l_quantity / 10 >= 1")
def valid_boxes(spark, sf_dir):
    left, w, h = F.col("l_quantity") - 25, F.col("l_tax") * 100, F.col("l_quantity") / 10
    return table(spark, sf_dir, "lineitem").where(X.valid_box(w, h, left, left)).select("l_orderkey", "l_linenumber", left.alias("left"), w.alias("w"))


@query("crop_mapping", f"""SELECT cand_id, start, CASE WHEN (sample - start) / 4096.0::DOUBLE * 512 >= 0 AND (sample - start) / 4096.0::DOUBLE * 512 < 512 THEN round((sample - start) / 4096.0::DOUBLE * 512, 6) END AS pixel
FROM (SELECT cand_id, sample, least(greatest(CAST(round_even(sample - candidate_index * 40 / 512.0::DOUBLE * 4096, 0) AS INT), 0), 86400 - 4096) AS start FROM {CANDIDATES})""")
def crop_mapping(spark, sf_dir):
    start = X.crop_start(F.col("sample"), F.col("candidate_index") * 40, F.lit(4096), 86400)
    rows = candidates(spark, sf_dir).withColumn("start", start)
    return rows.select("cand_id", "start", F.round(X.in_crop(F.col("sample"), F.col("start"), F.lit(4096.0)), 6).alias("pixel"))


@query("repeat_weights", "SELECT source, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(source, 'new.*LPT') THEN 6 WHEN regexp_matches(source, '(?i)neg|rfi') THEN 2 ELSE 1 END) AS BIGINT) AS weighted FROM documents GROUP BY source")
def repeat_weights(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(X.repeat_weight(F.col("source"))).alias("weighted"))


@query("prediction_rows", "SELECT doc_id, quality AS label, (p >= 0.5)::INT AS pred, round(1 - p, 6) AS prob_false, round(p, 6) AS prob_true FROM (SELECT doc_id, quality, exp(n_chars / 2000.0::DOUBLE) / (exp(1.0::DOUBLE) + exp(n_chars / 2000.0::DOUBLE)) AS p FROM documents JOIN labels USING (doc_id))")
def prediction_rows(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    p = X.softmax_true(F.lit(1.0), F.col("n_chars") / 2000.0)
    return joined.select("doc_id", F.col("quality").alias("label"), (p >= 0.5).cast("int").alias("pred"), F.round(1 - p, 6).alias("prob_false"), F.round(p, 6).alias("prob_true"))


@query("weighted_losses", "SELECT l_suppkey AS \"rank\", round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS loss FROM lineitem GROUP BY 1")
def weighted_losses(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("rank")).agg(F.round(F.sum(F.col("l_tax") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("loss"))


@query("weight_average", f"SELECT chan, round(avg(v), 3) + 0.0 AS averaged, arg_max(v, t) AS last FROM {SPEC} WHERE t >= (SELECT max(t) - 4 FROM {SPEC}) GROUP BY chan")
def weight_average(spark, sf_dir):
    rows = spec(spark, sf_dir)
    last = rows.agg(F.max("t").alias("top"))
    return rows.crossJoin(F.broadcast(last)).where("t >= top - 4").groupBy("chan").agg((F.round(F.avg("v"), 3) + 0.0).alias("averaged"), F.max_by("v", "t").alias("last"))


@query("waterfall_groups", f"SELECT f // 5 AS \"group\", y, CAST(band AS INT) AS band, CAST(sum(v) AS BIGINT) AS total FROM (SELECT t // 32 AS f, t % 32 // 8 AS y, chan // 8 AS band, v FROM {SPEC}) WHERE f // 5 IN (SELECT f // 5 FROM (SELECT DISTINCT t // 32 AS f FROM {SPEC}) GROUP BY 1 HAVING count(*) = 5) GROUP BY 1, 2, 3")
def waterfall_groups(spark, sf_dir):
    rows = spec(spark, sf_dir).select(F.expr("t div 32").alias("f"), F.expr("t % 32 div 8").alias("y"), F.expr("chan div 8").cast("int").alias("band"), "v").withColumn("group", F.expr("f div 5"))
    full = rows.select("group", "f").distinct().groupBy("group").agg(F.count("*").alias("n")).where("n = 5").select("group")
    return rows.join(full, "group", "left_semi").groupBy("group", "y", "band").agg(F.sum("v").alias("total"))


@query("recall_matrix", f"SELECT quant, param_bin, {', '.join(f'max(recall) FILTER (snr_bin = {i}) AS s{i}' for i in range(8))} FROM {CUBE} WHERE parameter = 'dm' GROUP BY 1, 2")
def recall_matrix(spark, sf_dir):
    cube = _cube(spark, sf_dir).where("parameter = 'dm'").withColumn("recall", F.round("recall", 6))
    wide = cube.groupBy("quant", "param_bin").pivot("snr_bin", list(range(8))).agg(F.max("recall"))
    return wide.withColumnsRenamed({str(i): f"s{i}" for i in range(8)})


@query("center_frequency_bins", f"WITH b AS (SELECT floor(min(dm) / 10) * 10 AS lo, ceil(max(dm) / 10) * 10 AS hi FROM {MATCHES}) SELECT CAST(i AS INT) AS edge, round(lo + (hi - lo) * i / 8, 3) AS value FROM b, range(9) r(i)")
def center_frequency_bins(spark, sf_dir):
    ends = matches(spark, sf_dir).agg((F.floor(F.min("dm") / 10) * 10).alias("lo"), (F.ceil(F.max("dm") / 10) * 10).alias("hi"))
    return ends.select(F.explode(F.sequence(F.lit(0), F.lit(8))).alias("edge"), "lo", "hi").select("edge", F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("edge") / 8, 3).alias("value"))


@query("nearest_other_center", f"SELECT a.image, a.py, a.px, round(min(sqrt((a.py - b.py) ** 2 + (a.px - b.px) ** 2)), 6) AS distance FROM {_PEAKS} a LEFT JOIN {_PEAKS} b ON a.image = b.image AND (a.py <> b.py OR a.px <> b.px) GROUP BY ALL")
def nearest_other_center(spark, sf_dir):
    found = I.peaks(images(spark, sf_dir), 100000)
    other = found.select("image", F.col("py").alias("qy"), F.col("px").alias("qx"))
    far = F.when((F.col("py") != F.col("qy")) | (F.col("px") != F.col("qx")), F.hypot(F.col("py") - F.col("qy"), F.col("px") - F.col("qx")))
    return found.join(other, "image", "left").groupBy("image", "py", "px").agg(F.round(F.min(far), 6).alias("distance"))


@query("ownership_mask", f"""WITH d AS (SELECT p.image, p.py, p.px, min((p.py - k.py) ** 2 + (p.px - k.px) ** 2) FILTER (k.k = 1) AS own, min((p.py - k.py) ** 2 + (p.px - k.px) ** 2) FILTER (k.k > 1) AS other FROM {IMAGES} p
JOIN (SELECT *, row_number() OVER (PARTITION BY image ORDER BY v DESC, py, px) AS k FROM {_PEAKS}) k USING (image) GROUP BY 1, 2, 3) SELECT image, count(*) FILTER (other IS NULL OR own <= 0.92 * other) AS n_owned FROM d GROUP BY image""")
def ownership_mask(spark, sf_dir):
    pixels = images(spark, sf_dir)
    centres = I.top_pixels(I.peaks(pixels, 100000), 64).select("image", "rank", F.col("py").alias("cy"), F.col("px").alias("cx"))
    d2 = F.pow(F.col("py") - F.col("cy"), 2) + F.pow(F.col("px") - F.col("cx"), 2)
    near = pixels.join(centres, "image").groupBy("image", "py", "px").agg(F.min(F.when(F.col("rank") == 1, d2)).alias("own"), F.min(F.when(F.col("rank") > 1, d2)).alias("other"))
    return near.groupBy("image").agg(F.count_if(F.col("other").isNull() | (F.col("own") <= F.col("other") * 0.92)).alias("n_owned"))


@query("completed_jobs", f"SELECT injection_id, quant, stem FROM {TRUTH} WHERE (quant, stem) IN (SELECT (quant, stem) FROM {CANDIDATES} WHERE sigma >= 9.9)")
def completed_jobs(spark, sf_dir):
    done = candidates(spark, sf_dir).where("sigma >= 9.9").select("quant", "stem").distinct()
    return truth(spark, sf_dir).join(done, ["quant", "stem"], "left_semi").select("injection_id", "quant", "stem")


@query("dm_plan", f"""WITH i AS (SELECT stem, floor(dm / 2) * 2 - 4 AS lo, floor(dm / 2) * 2 + 4 AS hi FROM {TRUTH}), o AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY stem ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS opens FROM i),
p AS (SELECT *, sum(opens) OVER (PARTITION BY stem ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS part FROM o) SELECT stem, min(lo)::BIGINT AS lo, max(hi)::BIGINT AS hi, count(*) AS n FROM p GROUP BY stem, part""")
def dm_plan(spark, sf_dir):
    even = (F.floor(F.col("dm") / 2) * 2).cast("long")
    return S.merge_intervals(truth(spark, sf_dir).select("stem", (even - 4).alias("lo"), (even + 4).alias("hi")), ["stem"], slack=1)


@query("detector_evaluation", f"""WITH m AS (SELECT image * 8 + "rank" AS id, v AS conf, (truth >= 0)::INT AS tp FROM {CENTRE_MATCHES} JOIN {_TOP} USING (image, "rank")),
c AS (SELECT id, conf, row_number() OVER w AS n, CAST(sum(tp) OVER (ORDER BY conf DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tps, CAST(sum(tp) OVER () AS BIGINT) AS p FROM m WINDOW w AS (ORDER BY conf DESC, id)),
q AS (SELECT id, conf, n AS "rank", tps AS cum_tp, tps / (n + 1e-8::DOUBLE) AS "precision", tps / (p + 1e-8::DOUBLE) AS recall FROM c)
SELECT id, conf, "rank", cum_tp, round("precision", 6) AS "precision", round(recall, 6) AS recall, round({_F1}, 6) AS f1 FROM q""")
def detector_evaluation(spark, sf_dir):
    pairs = _centre_matches(spark, sf_dir)
    scored = pairs.join(I.top_pixels(I.peaks(images(spark, sf_dir), 100000), 4).select("image", "rank", "v"), ["image", "rank"])
    curve = A.pr_curve(scored.select((F.col("image") * 8 + F.col("rank")).alias("id"), F.col("v").alias("conf"), (F.col("truth") >= 0).cast("int").alias("tp")))
    return _rounded(curve, "precision", "recall", "f1")


@query("display_range", f"SELECT t // 50 AS block, 2 AS vmin, round(avg(v) * 1.2, 6) + 0.0 AS vmax FROM {SPEC} GROUP BY 1")
def display_range(spark, sf_dir):
    return spec(spark, sf_dir).groupBy(F.expr("t div 50").alias("block")).agg(F.lit(2).alias("vmin"), (F.round(F.avg("v") * 1.2, 6) + 0.0).alias("vmax"))


@query("center_file_jobs", f"SELECT quant, stem, CAST((row_number() OVER (PARTITION BY quant ORDER BY stem) - 1) % 4 AS INT) AS worker FROM (SELECT DISTINCT quant, stem FROM {CANDIDATES})")
def center_file_jobs(spark, sf_dir):
    stems = candidates(spark, sf_dir).select("quant", "stem").distinct()
    return stems.withColumn("worker", ((F.row_number().over(Window.partitionBy("quant").orderBy("stem")) - 1) % 4).cast("int"))


@query("detector_bench", f"SELECT count(*) AS n_found, count_if(cy * 2 > 30)::BIGINT AS n_over FROM (SELECT cy FROM ({'SELECT image, py, px, v FROM ' + _PEAKS}) p, LATERAL (SELECT (p.py * 1.0::DOUBLE) * 4 AS cy))")
def detector_bench(spark, sf_dir):
    found = I.peaks(images(spark, sf_dir), 100000).withColumn("cy", F.col("py") * 4.0)
    return found.agg(F.count("*").alias("n_found"), F.count_if(F.col("cy") * 2 > 30).alias("n_over"))
