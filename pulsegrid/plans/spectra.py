"""Driver queries: spectra, de-dispersion and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedisperse as D
from ..operators import images as I
from .proxies import IMAGES, SPEC, images, pixel_rows, spec, unrolled
from .registry import query

OBS = D.Observation()
SPLIT = OBS.n_kept // 2

_CHANNELS = "(SELECT chan, CAST(row_number() OVER (ORDER BY chan) - 1 AS INT) AS idx, 1.0::DOUBLE / ((1000.0::DOUBLE + chan * 500.0::DOUBLE / 64.0::DOUBLE) * (1000.0::DOUBLE + chan * 500.0::DOUBLE / 64.0::DOUBLE)) AS inv2 FROM range(64) c(chan) WHERE chan < 10 OR (chan >= 12 AND chan < 63))"
_LAST = "(1.0::DOUBLE / ((1000.0::DOUBLE + 63 * 500.0::DOUBLE / 64.0::DOUBLE) * (1000.0::DOUBLE + 63 * 500.0::DOUBLE / 64.0::DOUBLE)))"
SHIFTS = f"(SELECT CAST(dm AS INT) AS dm, CAST(chan AS INT) AS chan, idx, CAST(trunc(4150.0::DOUBLE * (dm * 20.0::DOUBLE + 0.0::DOUBLE) * (inv2 - {_LAST}) / 0.01::DOUBLE) AS BIGINT) AS shift FROM range(32) d(dm), {_CHANNELS})"
CELLS = f"(SELECT dm, t - shift AS y, CAST(sum(v) AS BIGINT) AS v_full, CAST(sum(CASE WHEN idx <= {SPLIT} THEN v ELSE 0 END) AS BIGINT) AS v_lower, CAST(sum(CASE WHEN idx <= {SPLIT} THEN 0 ELSE v END) AS BIGINT) AS v_upper FROM {SPEC} s JOIN {SHIFTS} USING (chan) WHERE t - shift >= 0 GROUP BY dm, t - shift)"


def cells(spark, sf_dir):
    return D.dedisperse_blocks(spec(spark, sf_dir), OBS.shifts(spark), SPLIT)


@query("dedisperse_full_split", f"SELECT dm, y, v_full, v_lower, v_upper FROM {CELLS}")
def dedisperse_full_split(spark, sf_dir):
    return cells(spark, sf_dir)


@query("dedisperse_topk", f"SELECT dm, y, v_full, v_lower, v_upper FROM {CELLS} ORDER BY v_full DESC, dm, y LIMIT 50")
def dedisperse_topk(spark, sf_dir):
    return D.strongest(cells(spark, sf_dir), 50)


@query("dedisperse_fixed_dm", f"SELECT t - shift AS y, chan, v FROM {SPEC} s JOIN {SHIFTS} USING (chan) WHERE dm = 17 AND t - shift >= 0")
def dedisperse_fixed_dm(spark, sf_dir):
    return D.align_at_dm(spec(spark, sf_dir), OBS.shifts(spark), 17)


@query("dedisperse_block_kernel", f"SELECT dm, y, v_full, v_lower, v_upper FROM {CELLS}")
def dedisperse_block_kernel(spark, sf_dir):
    return D.dedisperse_blocks(spec(spark, sf_dir), OBS.shifts(spark), SPLIT, block=512, band=4)


@query("time_pool", f"SELECT t // 8 AS y, chan, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM {SPEC} GROUP BY ALL")
def time_pool(spark, sf_dir):
    return D.time_pool(spec(spark, sf_dir), 8)


@query("freq_pool", f"SELECT t, CAST(chan // 4 AS INT) AS band, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM {SPEC} GROUP BY ALL")
def freq_pool(spark, sf_dir):
    return D.frequency_pool(spec(spark, sf_dir), 4)


@query("bandpass_normalize", f"SELECT t, chan, round(v / (m + 1e-8::DOUBLE), 6) + 0.0 AS ratio FROM {SPEC} JOIN (SELECT chan, CAST(sum(v) AS DOUBLE) / count(*) AS m FROM {SPEC} GROUP BY chan) USING (chan)")
def bandpass_normalize(spark, sf_dir):
    return D.bandpass_normalise(spec(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6) + 0.0)


@query("halo_blocks", f"SELECT b AS block_id, t - b * 128 AS \"offset\", chan, v FROM {SPEC} JOIN (SELECT unnest(range(CAST((SELECT max(vec_id) // 128 + 1 FROM embeddings) AS BIGINT))) AS b) ON t >= b * 128 AND t < b * 128 + 128 + 32")
def halo_blocks(spark, sf_dir):
    return D.halo_blocks(spec(spark, sf_dir), 128, 32)


#: The last block's tail is filled: how many cells, and whether they lie between the mean and one deviation above it.
@query("padded_blocks", f"""WITH n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), b AS (SELECT b AS block_id, least(n - b * 128, 160) AS have FROM n, range(0, (n + 127) // 128) r(b))
SELECT block_id, CAST(160 * 64 AS BIGINT) AS cells, CAST((160 - have) * 64 AS BIGINT) AS n_padded, true AS in_range FROM b""")
def padded_blocks(spark, sf_dir):
    blocks = D.halo_blocks(spec(spark, sf_dir), 128, 32)
    padded = D.pad_blocks(blocks, 160, 64)
    stats = blocks.groupBy("block_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    inside = ~F.col("padded") | ((F.col("v") >= F.col("m")) & (F.col("v") <= F.col("m") + F.col("s")))
    return padded.join(stats, "block_id").groupBy("block_id").agg(F.count("*").alias("cells"), F.count_if("padded").alias("n_padded"), F.every(inside).alias("in_range"))


def _pool_sql(starts):
    dims = ", ".join(f"({i}, {s})" for i, s in enumerate(starts))
    return f"SELECT CAST(i AS INT) AS dm_chunk, CAST(s AS INT) AS dm_start, CAST((dm - s) // 2 AS INT) AS py, y // 16 AS px, CAST(sum(v_full) AS BIGINT) AS total, count(*) AS n FROM {CELLS} JOIN (VALUES {dims}) w(i, s) ON dm >= s AND dm < s + 16 GROUP BY ALL"


@query("dm_window_pool", _pool_sql([0, 16]))
def dm_window_pool(spark, sf_dir):
    return D.dm_window_pool(cells(spark, sf_dir), spark, 32, 16, 16, 2, 16)


@query("dm_window_pool_overlap", _pool_sql([0, 6, 12, 16]))
def dm_window_pool_overlap(spark, sf_dir):
    return D.dm_window_pool(cells(spark, sf_dir), spark, 32, 16, 6, 2, 16)


@query("cutout_gather", f"""WITH c AS (SELECT vec_id AS cand_id, CAST(vec_id % 32 AS INT) AS dm, greatest(0, vec_id - 16) AS start FROM embeddings),
w AS (SELECT cand_id, i, sh.chan, start + shift + i AS t FROM c JOIN {SHIFTS} sh USING (dm), (SELECT unnest(range(32)) AS i))
SELECT cand_id, CAST(i AS INT) AS i, CAST(w.chan // 8 AS INT) AS band, CAST(coalesce(sum(v), 0) AS BIGINT) AS total FROM w LEFT JOIN {SPEC} s ON s.chan = w.chan AND s.t = w.t GROUP BY ALL""")
def cutout_gather(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("cand_id"), (F.col("vec_id") % 32).cast("int").alias("dm"), F.col("vec_id").alias("toa"))
    return D.cut_out(found, spec(spark, sf_dir), OBS.shifts(spark), 32, 8)


@query("multiscale_pool", f"SELECT dm, CAST(rate AS INT) AS rate, y // rate AS slot, CAST(sum(v_full) AS BIGINT) AS total, count(*) AS n FROM {CELLS}, (VALUES (2), (8), (32)) r(rate) GROUP BY ALL")
def multiscale_pool(spark, sf_dir):
    trials = cells(spark, sf_dir).select("dm", "y", F.col("v_full").alias("v"))
    return D.multiscale_pool(trials, spark, [2, 8, 32], ["dm"])


@query("matched_filter_search", f"SELECT dm, y, CAST(w AS INT) AS width, total FROM (SELECT dm, y, w, CASE w WHEN 1 THEN v_full WHEN 4 THEN CAST(sum(v_full) OVER f4 AS BIGINT) ELSE CAST(sum(v_full) OVER f16 AS BIGINT) END AS total, CASE w WHEN 1 THEN 1 WHEN 4 THEN count(*) OVER f4 ELSE count(*) OVER f16 END AS n FROM {CELLS}, (VALUES (1), (4), (16)) x(w) WINDOW f4 AS (PARTITION BY dm, w ORDER BY y RANGE BETWEEN CURRENT ROW AND 3 FOLLOWING), f16 AS (PARTITION BY dm, w ORDER BY y RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING)) WHERE n = w")
def matched_filter_search(spark, sf_dir):
    return D.boxcar_search(cells(spark, sf_dir), [1, 4, 16])


@query("kth_clip_minmax", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY v) AS k, count(*) OVER (PARTITION BY image) AS n FROM {IMAGES}),
b AS (SELECT image, max(v) FILTER (k = greatest(1, CAST(round_even(n * 0.010, 0) AS INT))) AS lo, max(v) FILTER (k = greatest(1, CAST(round_even(n * 0.995, 0) AS INT))) AS hi FROM r GROUP BY image),
c AS (SELECT image, py, px, least(greatest(v, lo), hi) AS c FROM r JOIN b USING (image))
SELECT image, py, px, round((c - min(c) OVER w) / (max(c) OVER w - min(c) OVER w + 1e-8::DOUBLE), 6) AS scaled FROM c WINDOW w AS (PARTITION BY image)""")
def kth_clip_minmax(spark, sf_dir):
    return unrolled(pixel_rows(spark, sf_dir), I.kth_clipped(F.col("pixels"))).withColumn("scaled", F.round("scaled", 6))


@query("percentile_clip_minmax", f"""WITH b AS (SELECT image, quantile_cont(v::DOUBLE, 0.05) AS lo, quantile_cont(v::DOUBLE, 0.95) AS hi FROM {IMAGES} GROUP BY image),
c AS (SELECT image, py, px, least(greatest(v::DOUBLE, lo), hi) AS c FROM {IMAGES} JOIN b USING (image))
SELECT image, py, px, round((c - min(c) OVER w) / (max(c) OVER w - min(c) OVER w + 1e-8::DOUBLE), 6) AS scaled FROM c WINDOW w AS (PARTITION BY image)""")
def percentile_clip_minmax(spark, sf_dir):
    return unrolled(pixel_rows(spark, sf_dir), I.percentile_clipped(F.col("pixels"))).withColumn("scaled", F.round("scaled", 6))


_PEAKS = f"(SELECT a.image, a.py, a.px, a.v FROM {IMAGES} a JOIN {IMAGES} b ON a.image = b.image AND abs(a.py - b.py) <= 1 AND abs(a.px - b.px) <= 1 GROUP BY ALL HAVING a.v = max(b.v) AND a.v > 100000)"


@query("heatmap_nms", f"SELECT * FROM {_PEAKS}")
def heatmap_nms(spark, sf_dir):
    return I.peaks(images(spark, sf_dir), 100000)


_TOP = f"(SELECT * FROM (SELECT image, py, px, v, CAST(row_number() OVER (PARTITION BY image ORDER BY v DESC, py, px) AS INT) AS \"rank\" FROM {_PEAKS}) WHERE \"rank\" <= 4)"


@query("heatmap_topk", f"SELECT * FROM {_TOP}")
def heatmap_topk(spark, sf_dir):
    return I.top_pixels(I.peaks(images(spark, sf_dir), 100000), 4)


_OFFSETS = f"(SELECT image, py, px, (v % 1000) / 1000.0::DOUBLE AS dx, (v // 1000 % 1000) / 1000.0::DOUBLE AS dy FROM {IMAGES})"
_CENTRES = f"(SELECT image, \"rank\", v AS score, (px + dx) * 4 AS cx, (py + dy) * 4 AS cy FROM {_TOP} JOIN {_OFFSETS} USING (image, py, px))"


def _centres(spark, sf_dir):
    pixels = images(spark, sf_dir)
    offsets = pixels.select("image", "py", "px", ((F.col("v") % 1000) / 1000.0).alias("dx"), (F.expr("v div 1000 % 1000") / 1000.0).alias("dy"))
    return I.decode_centres(I.top_pixels(I.peaks(pixels, 100000), 4), offsets)


@query("decode_centers", f"SELECT image, \"rank\", score, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy FROM {_CENTRES}")
def decode_centers(spark, sf_dir):
    return _centres(spark, sf_dir).withColumns({"cx": F.round("cx", 6) + 0.0, "cy": F.round("cy", 6) + 0.0})


@query("pixel_to_physical", f"""SELECT * FROM (SELECT image, "rank", CAST(image // 4 % 3 AS INT) AS plane, CAST(image % 4 AS INT) AS dm_chunk, (CAST(trunc(cy) AS INT) * 2.0::DOUBLE + image % 4 * 64) * 0.5::DOUBLE + 1.0::DOUBLE AS dm,
 CAST(CAST(trunc(cx) AS INT) * 16 + image // 12 * 4096 AS BIGINT) AS toa FROM {_CENTRES} WHERE score > 150000) WHERE dm > 20""")
def pixel_to_physical(spark, sf_dir):
    return I.to_physical(_centres(spark, sf_dir), 2.0, 64, 0.5, 1.0, 16, 4096, 4, 20.0, 150000)


@query("gaussian_targets", f"""WITH c AS (SELECT image, px AS cx, py AS cy FROM {_TOP}), g AS (SELECT c.image, y.i AS py, x.i AS px, max(exp(-((x.i - cx) * (x.i - cx) + (y.i - cy) * (y.i - cy)) / (2 * 1.5::DOUBLE * 1.5::DOUBLE))) AS target
FROM c, (SELECT unnest(range(8)) AS i) y, (SELECT unnest(range(8)) AS i) x GROUP BY ALL) SELECT image, CAST(py AS INT) AS py, CAST(px AS INT) AS px, round(target, 6) AS target FROM g""")
def gaussian_targets(spark, sf_dir):
    tops = I.top_pixels(I.peaks(images(spark, sf_dir), 100000), 4)
    return I.gaussian_targets(tops.select("image", F.col("px").alias("cx"), F.col("py").alias("cy")), 8, 1.5).withColumn("target", F.round("target", 6))


@query("mixup_max", f"SELECT image // 2 AS pair, py, px, max(v) AS v FROM {IMAGES} GROUP BY ALL")
def mixup_max(spark, sf_dir):
    return I.mixup_max(images(spark, sf_dir))


@query("mosaic_pool", f"SELECT image // 4 AS mosaic, CAST(py // 2 + (image % 4) // 2 * 4 AS INT) AS py, CAST(px // 2 + image % 2 * 4 AS INT) AS px, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM {IMAGES} GROUP BY image // 4, 2, 3")
def mosaic_pool(spark, sf_dir):
    return I.mosaic_pool(images(spark, sf_dir))


@query("area_resample", f"""SELECT image, CAST(y.i AS INT) AS py, CAST(x.i AS INT) AS px, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM {IMAGES} p JOIN (SELECT unnest(range(3)) AS i) y ON p.py >= floor(y.i * 8 / 3) AND p.py < ceil((y.i + 1) * 8 / 3)
JOIN (SELECT unnest(range(3)) AS i) x ON p.px >= floor(x.i * 8 / 3) AND p.px < ceil((x.i + 1) * 8 / 3) GROUP BY ALL""")
def area_resample(spark, sf_dir):
    return I.area_resample(images(spark, sf_dir), 8, 3)


@query("mosaic_strip", f"SELECT image // 3 AS mosaic, py, CAST((image % 3 * 8 + px) // 3 AS INT) AS px, round(sum(v) / 3.0::DOUBLE, 4) AS v FROM {IMAGES} GROUP BY ALL")
def mosaic_strip(spark, sf_dir):
    """Three images side by side, pooled to the size of one."""
    return I.mosaic_grid(images(spark, sf_dir), 1, 3, 8).withColumn("v", F.round("v", 4))


@query("mosaic_boxes", f"SELECT image // 4 AS mosaic, \"rank\", (px - 1 + image % 2 * 8) / 2.0::DOUBLE AS \"left\", (py - 2 + image % 4 // 2 * 8) / 2.0::DOUBLE AS top, 1.5::DOUBLE AS width, 2.0::DOUBLE AS height FROM {_TOP}")
def mosaic_boxes(spark, sf_dir):
    """Boxes around the peaks of four images in their mosaic of two by two."""
    tops = I.top_pixels(I.peaks(images(spark, sf_dir), 100000), 4)
    boxes = tops.select("image", "rank", (F.col("px") - 1.0).alias("left"), (F.col("py") - 2.0).alias("top"), F.lit(3.0).alias("width"), F.lit(4.0).alias("height"))
    return I.mosaic_boxes(boxes, 2, 2, 8)
