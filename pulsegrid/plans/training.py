"""Driver queries: training catalogues, boxes, planning and augmentation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import matching as M
from ..operators import metrics as A
from ..operators import training as R
from ..operators.sampling import ranked_by_hash
from .proxies import CANDIDATES, FALSE_POSITIVES, IMAGES, MATCHES, SPEC, TRUTH, candidates, false_positives, images, matches, pixel_rows, spec, table, truth, unrolled
from . import sequential as Q
from .registry import query
from .spectra import OBS

_BOXES = "(SELECT l_orderkey AS image, l_linenumber AS box, l_quantity - 5 AS \"left\", l_tax * 200 AS top, l_quantity AS w, l_discount * 300 AS h FROM lineitem)"


def _boxes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("box"), (F.col("l_quantity") - 5).alias("left"), (F.col("l_tax") * 200).alias("top"), F.col("l_quantity").alias("w"), (F.col("l_discount") * 300).alias("h"))


_CATALOGUE = f"(SELECT o_orderkey AS image, coalesce(n, 0) AS n_boxes, coalesce(m, 'inf'::DOUBLE) AS min_box FROM orders LEFT JOIN (SELECT image, count(*) AS n, min(sqrt(w * h)) AS m FROM {_BOXES} WHERE w >= 1 AND h >= 1 GROUP BY image) ON image = o_orderkey)"


def _catalogue(spark, sf_dir):
    return R.detector_catalogue(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image")), _boxes(spark, sf_dir))


@query("detector_catalog", f"SELECT image, n_boxes, round(least(min_box, 1e6), 6) AS min_box FROM {_CATALOGUE}")
def detector_catalog(spark, sf_dir):
    return _catalogue(spark, sf_dir).withColumn("min_box", F.round(F.least("min_box", F.lit(1e6)), 6))


@query("box_count_oversampling", f"SELECT n_boxes, count(*) AS n_images, CAST(sum(CASE WHEN n_boxes = 0 THEN 1 WHEN n_boxes = 1 THEN 3 WHEN n_boxes <= 3 THEN 5 ELSE 8 END * CASE WHEN min_box < 16 THEN 2 ELSE 1 END) AS BIGINT) AS n_after FROM {_CATALOGUE} GROUP BY n_boxes")
def box_count_oversampling(spark, sf_dir):
    return _catalogue(spark, sf_dir).groupBy("n_boxes").agg(F.count("*").alias("n_images"), F.sum(R.box_weight(F.col("n_boxes"), F.col("min_box"))).alias("n_after"))


@query("annotation_placeholder", "SELECT o_orderkey AS image, coalesce(b, '-1,-1,-1,-1') AS boxes FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(concat_ws(',', l_linenumber, l_linenumber + 1, l_suppkey, l_partkey), ';' ORDER BY concat_ws(',', l_linenumber, l_linenumber + 1, l_suppkey, l_partkey)) AS b FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def annotation_placeholder(spark, sf_dir):
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("left"), (F.col("l_linenumber") + 1).alias("top"), F.col("l_suppkey").alias("w"), F.col("l_partkey").alias("h"))
    return R.annotations_or_placeholder(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image")), boxes)


@query("classifier_catalog", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1")
def classifier_catalog(spark, sf_dir):
    return R.catalogue(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("clipped_boxes", f"""SELECT image, box, l AS "left", t AS top, round(w * sqrt(s), 6) AS width, round(h * sqrt(s), 6) AS height FROM (SELECT *, greatest(0.0, r - l) * greatest(0.0, b - t) / (w * h) AS s FROM (SELECT image, box, w, h, greatest(0.0::DOUBLE, "left" - w / 2) AS l, least(32.0::DOUBLE, "left" + w / 2) AS r,
greatest(0.0::DOUBLE, top - h / 2) AS t, least(32.0::DOUBLE, top + h / 2) AS b FROM {_BOXES} WHERE h > 0 AND "left" < 32 AND top < 32))""")
def clipped_boxes(spark, sf_dir):
    boxes = _boxes(spark, sf_dir).where("h > 0 and left < 32 and top < 32")
    out = R.clip_box(F.col("left"), F.col("top"), F.col("w"), F.col("h"), 32)
    return boxes.select("image", "box", out["left"].alias("left"), out["top"].alias("top"), F.round(out["width"], 6).alias("width"), F.round(out["height"], 6).alias("height"))


@query("affine_boxes", f"""SELECT image, box, round(least(x0, x1) * 0.8::DOUBLE + 2, 6) + 0.0 AS "left", round(least(32 - y0 * 1.0, 32 - y1 * 1.0), 6) + 0.0 AS top, round(abs(x1 - x0) * 0.8::DOUBLE, 6) AS w, round(abs(y1 - y0), 6) AS h FROM (SELECT image, box, "left" AS x0, top AS y0, "left" + w AS x1, top + h AS y1 FROM {_BOXES})
WHERE (x0 + x1) / 2 * 0.8::DOUBLE + 2 >= 0 AND (x0 + x1) / 2 * 0.8::DOUBLE + 2 < 32 AND 32 - (y0 + y1) / 2 >= 0 AND 32 - (y0 + y1) / 2 < 32""")
def affine_boxes(spark, sf_dir):
    out = R.affine_boxes(_boxes(spark, sf_dir), (0.8, 0.0, 0.0, -1.0), (2.0, 32.0), 32)
    return out.select("image", "box", (F.round("left", 6) + 0.0).alias("left"), (F.round("top", 6) + 0.0).alias("top"), F.round("w", 6).alias("w"), F.round("h", 6).alias("h"))


@query("visible_energy", f"""SELECT injection_id AS id, round(sqrt(sum(CASE WHEN x >= 0 AND x < 0.5 THEN e ELSE 0.0 END) / greatest(sum(e), 1e-300)), 6) AS share FROM (SELECT injection_id, i / 63.0::DOUBLE AS x, exp(-pow((i / 63.0::DOUBLE - snr / 100) / greatest(dm / 1000, 1e-6), 2)) AS e FROM {TRUTH}, range(64) r(i)) GROUP BY 1""")
def visible_energy(spark, sf_dir):
    signals = truth(spark, sf_dir).select(F.col("injection_id").alias("id"), (F.col("snr") / 100).alias("centre"), (F.col("dm") / 1000).alias("sigma"), F.lit(0.0).alias("lo"), F.lit(0.5).alias("hi"))
    return R.visible_share(signals).withColumn("share", F.round("share", 6))


@query("envelope_channels", f"SELECT injection_id, count_if(exp(-0.5 * pow((f - (1000.0::DOUBLE + snr * 5)) / greatest(dm / 4, 1e-6), 2)) > 0.5)::BIGINT AS n_channels FROM {TRUTH}, (SELECT 1000.0::DOUBLE + c * 500.0::DOUBLE / 64.0::DOUBLE AS f FROM range(64) r(c) WHERE c < 10 OR (c >= 12 AND c < 63)) GROUP BY 1")
def envelope_channels(spark, sf_dir):
    rows = truth(spark, sf_dir).select("injection_id", (F.lit(1000.0) + F.col("snr") * 5).alias("center_mhz"), (F.col("dm") / 4).alias("sigma_mhz"))
    return R.envelope_channels(rows, OBS.channels(spark))


@query("fold_clipped", """WITH RECURSIVE p AS (SELECT user_id AS t, event_id, value - 60 AS add, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), f AS (SELECT DISTINCT user_id AS t, 0::BIGINT AS k, CAST(user_id % 200 AS DOUBLE) AS v FROM events
UNION ALL SELECT f.t, p.k, least(greatest(f.v + p.add, 0.0), 255.0) FROM f JOIN p ON p.t = f.t AND p.k = f.k + 1) SELECT t, round(arg_max(v, k), 6) AS v FROM f GROUP BY t""")
def fold_clipped(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    base = e.select(F.col("user_id").alias("t"), (F.col("user_id") % 200).cast("double").alias("v")).distinct()
    pulses = e.select(F.col("user_id").alias("t"), F.col("event_id").alias("ord"), (F.col("value") - 60).alias("add"))
    return R.fold_clipped(base, pulses).withColumn("v", F.round("v", 6))


@query("classifier_normalise", f"""WITH a AS (SELECT image, py, px, abs(v) % 1000 + 1 AS a FROM {IMAGES}), b AS (SELECT image, py, px, a / avg(a) OVER (PARTITION BY image, px) AS b FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY b) AS k, count(*) OVER (PARTITION BY image) AS n FROM b),
q AS (SELECT image, max(b) FILTER (k = greatest(1, CAST(round_even(n * 0.05, 0) AS INT))) AS lo, max(b) FILTER (k = greatest(1, CAST(round_even(n * 0.95, 0) AS INT))) AS hi FROM r GROUP BY image), c AS (SELECT image, py, px, least(greatest(b, lo), hi) AS c FROM r JOIN q USING (image))
SELECT image, py, px, round((c - min(c) OVER w) / (max(c) OVER w - min(c) OVER w + 1e-8::DOUBLE), 6) + 0.0 AS scaled FROM c WINDOW w AS (PARTITION BY image)""")
def classifier_normalise(spark, sf_dir):
    rows = pixel_rows(spark, sf_dir).withColumn("pixels", F.transform("pixels", lambda v: F.abs(v) % 1000))
    return unrolled(rows, R.column_normalised(F.col("pixels"), 8)).withColumn("scaled", F.round("scaled", 6) + 0.0)


@query("proposal_flags", f"""{Q.greedy_kept(f"(SELECT * FROM {CANDIDATES} WHERE cls > 0.5)", 600, 60.0)} SELECT c.*, cls > 0.5 AS passed_classifier_threshold, kept.cand_id IS NOT NULL AS kept_after_dedup,
CASE WHEN kept.cand_id IS NOT NULL THEN 'candidate' ELSE 'proposal' END AS candidate_stage FROM {CANDIDATES} c LEFT JOIN kept USING (cand_id)""")
def proposal_flags(spark, sf_dir):
    rows = candidates(spark, sf_dir).withColumn("passed_classifier_threshold", F.col("cls") > 0.5)
    kept = M.physical_dedup(rows.where("passed_classifier_threshold").drop("passed_classifier_threshold"), 600, 60.0).select("cand_id").withColumn("kept_after_dedup", F.lit(True))
    return rows.join(kept, "cand_id", "left").fillna(False, ["kept_after_dedup"]).withColumn("candidate_stage", F.when(F.col("kept_after_dedup"), "candidate").otherwise("proposal"))


@query("slim_truth", f"SELECT injection_id, quant, stem, dm, snr, CASE WHEN snr >= 5 AND snr < 7 THEN 0 WHEN snr >= 7 AND snr < 10 THEN 1 WHEN snr >= 10 AND snr < 15 THEN 2 WHEN snr >= 15 AND snr < 22 THEN 3 WHEN snr >= 22 AND snr < 33 THEN 4 WHEN snr >= 33 AND snr < 50 THEN 5 WHEN snr >= 50 AND snr < 75 THEN 6 WHEN snr >= 75 AND snr <= 100 THEN 7 END AS snr_bin FROM {TRUTH}")
def slim_truth(spark, sf_dir):
    return truth(spark, sf_dir).select("injection_id", "quant", "stem", "dm", "snr", A.bin_index(F.col("snr"), A.SNR_BINS).alias("snr_bin"))


@query("near_truth_events", f"SELECT DISTINCT cand_id, quant, stem, c.sigma FROM {CANDIDATES} c JOIN {TRUTH} t USING (quant, stem) WHERE abs(c.sample - t.sample) <= 240 AND abs(c.dm - t.dm) <= 120.0")
def near_truth_events(spark, sf_dir):
    pairs = M.band_join(candidates(spark, sf_dir), truth(spark, sf_dir).withColumnRenamed("snr", "power"), M.KEY, 240, 120.0)
    return pairs.select("cand_id", "quant", "stem", "sigma").distinct()


@query("quantization_deltas", f"""WITH s AS (SELECT quant, count(*) AS n, count_if(detected) AS d FROM {MATCHES} GROUP BY quant), f AS (SELECT quant, count(*) AS w FROM {FALSE_POSITIVES} GROUP BY quant)
SELECT round(max(d / n) FILTER (quant = 'packed2') - max(d / n) FILTER (quant = 'raw8'), 6) + 0.0 AS recall_delta, max(w) FILTER (quant = 'packed2') - max(w) FILTER (quant = 'raw8') AS fp_delta FROM s JOIN f USING (quant)""")
def quantization_deltas(spark, sf_dir):
    wide = A.campaign_summary(matches(spark, sf_dir), false_positives(spark, sf_dir)).groupBy().pivot("quant", ["raw8", "packed2"]).agg(F.first("recall").alias("recall"), F.first("n_fp").alias("fp"))
    return wide.select((F.round(F.col("packed2_recall") - F.col("raw8_recall"), 6) + 0.0).alias("recall_delta"), (F.col("packed2_fp") - F.col("raw8_fp")).alias("fp_delta"))


@query("strided_samples", f"SELECT t, chan, v FROM {SPEC} WHERE t IN (SELECT CAST(floor(i * (n - 1) / 15) AS BIGINT) FROM (SELECT count(DISTINCT t) AS n FROM {SPEC}), range(16) r(i))")
def strided_samples(spark, sf_dir):
    rows = spec(spark, sf_dir)
    wanted = rows.agg(F.count_distinct("t").alias("n")).select(F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"), "n").select(F.floor(F.col("i") * (F.col("n") - 1) / 15).alias("t"))
    return rows.join(F.broadcast(wanted), "t", "left_semi").select("t", "chan", "v")


@query("hash_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)) LIMIT 200")
def hash_sample(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy(F.md5(F.col("o_orderkey").cast("string").cast("binary"))).limit(200)


@query("key_set_operations", "SELECT 'both' AS part, * FROM (SELECT l_suppkey AS file, l_orderkey // 64 AS block FROM lineitem WHERE l_linestatus = 'F' INTERSECT SELECT l_suppkey, l_orderkey // 64 FROM lineitem WHERE l_linestatus = 'O') UNION ALL SELECT 'left', * FROM (SELECT l_suppkey AS file, l_orderkey // 64 AS block FROM lineitem WHERE l_linestatus = 'F' EXCEPT SELECT l_suppkey, l_orderkey // 64 FROM lineitem WHERE l_linestatus = 'O')")
def key_set_operations(spark, sf_dir):
    keys = lambda s: table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == s).select(F.col("l_suppkey").alias("file"), F.expr("l_orderkey div 64").alias("block"))
    both, left = keys("F").intersect(keys("O")), keys("F").subtract(keys("O"))
    return both.select(F.lit("both").alias("part"), "*").union(left.select(F.lit("left").alias("part"), "*"))


@query("rate_counts", "SELECT l_returnflag AS model, l_linenumber AS rate, count(*) AS n FROM lineitem GROUP BY 1, 2")
def rate_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("rate")).agg(F.count("*").alias("n"))


@query("window_read", f"SELECT t // 128 AS file_idx, t % 128 AS sample, chan, v FROM {SPEC} WHERE t >= 100 AND t < 300")
def window_read(spark, sf_dir):
    """A window over two files; the bounds reach the scan."""
    inside = spec(spark, sf_dir).where(F.col("t").between(100, 299))
    return inside.select(F.expr("t div 128").alias("file_idx"), (F.col("t") % 128).alias("sample"), "chan", "v")


@query("scene_plan")
def scene_plan(spark, sf_dir):
    return R.scene_plan(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("scene")).agg(F.count("*").alias("n_signals")), 4)


@query("interference")
def interference(spark, sf_dir):
    return R.with_interference(images(spark, sf_dir), 8)


_CORRELATION = f"""(SELECT image, corr(CAST(v AS DOUBLE), exp(-0.5::DOUBLE * (pow(py - 3.5::DOUBLE, 2) + pow(px - 3.5::DOUBLE, 2)) / 4)) AS r FROM {IMAGES} GROUP BY image)"""


@query("classifier_scores", f"SELECT image, round(1 / (1 + exp(-8 * r)), 6) AS score FROM {_CORRELATION}")
def classifier_scores(spark, sf_dir):
    template = np.exp(-0.5 * ((np.arange(8)[:, None] - 3.5) ** 2 + (np.arange(8)[None] - 3.5) ** 2) / 4)
    return R.score_images(R.gather_images(images(spark, sf_dir), 8), R.matched_filter_model(template), 8).withColumn("score", F.round("score", 6))


@query("ragged_pool")
def ragged_pool(spark, sf_dir):
    return R.ragged_pool(spec(spark, sf_dir), 7, ["chan"])


@query("union_roots", "SELECT 'a_' || o_orderstatus AS root, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'b_' || l_linestatus AS root, count(*) AS n FROM lineitem GROUP BY 1")
def union_roots(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.concat_ws("_", F.lit("a"), "o_orderstatus").alias("root"))
    b = table(spark, sf_dir, "lineitem").select(F.concat_ws("_", F.lit("b"), "l_linestatus").alias("root"))
    return C.union_all_columns(a, b).groupBy("root").agg(F.count("*").alias("n"))


_SETTING = {"dm_span": "p_size * 256", "block_size": "p_partkey % 5 * 512", "det_prob": "p_retailprice / 1500", "class_block_size": "1000 + p_partkey % 3 * 8", "class_time_downsample": "p_partkey % 7"}


@query("config_violations", f"""WITH c AS (SELECT p_partkey, {', '.join(f'{e} AS {n}' for n, e in _SETTING.items())} FROM part)
SELECT p_partkey, concat_ws('; ', CASE WHEN dm_span <= 0 THEN 'dm_span must be positive' END, CASE WHEN block_size <= 0 THEN 'block_size must be positive' END, CASE WHEN class_time_downsample <= 0 THEN 'class_time_downsample must be positive' END, CASE WHEN det_prob <= 0 THEN 'det_prob must be positive' END,
CASE WHEN dm_span > 0 AND dm_span % 512 <> 0 THEN 'dm_span must be a multiple of 512' END, CASE WHEN dm_span > 4096 THEN 'dm_span must not exceed dm_range' END, CASE WHEN 1024 > dm_span THEN 'dm_stride must not exceed dm_span' END, CASE WHEN block_size % 512 <> 0 THEN 'block_size must be a multiple of 512' END,
CASE WHEN class_time_downsample > 0 AND class_block_size % class_time_downsample <> 0 THEN 'class_time_downsample must divide class_block_size' END, CASE WHEN det_prob >= 1 THEN 'det_prob must be below 1' END) AS violations FROM c""")
def config_violations(spark, sf_dir):
    """All that is wrong with the settings of a table of searches."""
    rows = table(spark, sf_dir, "part").select("p_partkey", *(F.expr(e).alias(n) for n, e in _SETTING.items()))
    return R.config_violations(rows).select("p_partkey", F.array_join("violations", "; ").alias("violations"))
