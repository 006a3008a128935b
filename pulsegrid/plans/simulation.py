"""Driver queries: noise, quantisation, injection, sampling and labelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as P
from ..operators import signals as S
from ..operators.dedisperse import INJECTION_CONSTANT
from .proxies import IMAGES, SPEC, TRUTH, images, spec, table, truth
from . import sequential as Q
from .registry import query
from .spectra import _CHANNELS, _LAST, OBS


@query("robust_channel_std", f"""WITH m AS (SELECT chan, quantile_cont(v::DOUBLE, 0.5) AS m, stddev_pop(v) AS sd FROM {SPEC} GROUP BY chan), r AS (SELECT chan, quantile_cont(abs(v - m), 0.5) * 1.4826 AS mad, first(sd) AS sd FROM {SPEC} JOIN m USING (chan) GROUP BY chan),
s AS (SELECT chan, CASE WHEN mad <= 0.1 OR isnan(mad) THEN sd ELSE mad END AS robust FROM r) SELECT chan, round(CASE WHEN robust > 0 THEN robust ELSE (SELECT quantile_cont(robust, 0.5) FROM s WHERE robust > 0) END, 4) AS robust FROM s""")
def robust_channel_std(spark, sf_dir):
    return S.robust_channel_std(spec(spark, sf_dir)).withColumn("robust", F.round("robust", 4))


@query("global_channel_std", f"SELECT chan, round(quantile_cont(sd, 0.5), 4) AS std, count(*) AS n_files FROM (SELECT chan, t // 100 AS f, stddev_pop(v) AS sd FROM {SPEC} GROUP BY 1, 2) GROUP BY chan")
def global_channel_std(spark, sf_dir):
    return S.global_channel_std(spec(spark, sf_dir), 100).withColumn("std", F.round("std", 4))


_SUMS = f"(SELECT t, chan, ((v % 511) + 511) % 511 AS v FROM {SPEC})"
_LEVELS = f"""(WITH h AS (SELECT chan, v, count(*) AS n FROM {_SUMS} GROUP BY 1, 2), c AS (SELECT chan, v, sum(n) OVER (PARTITION BY chan ORDER BY v) AS cdf, sum(n) OVER (PARTITION BY chan) AS total FROM h),
q AS (SELECT chan, min(v) FILTER (cdf > total * 0.25) AS q1, min(v) FILTER (cdf > total * 0.5) AS q2, min(v) FILTER (cdf > total * 0.75) AS q3 FROM c GROUP BY chan) SELECT t, chan, (v > q1)::INT + (v > q2)::INT + (v > q3)::INT AS level FROM {_SUMS} JOIN q USING (chan))"""
_PACKED = f"(SELECT t // 4 AS slot, chan, CAST(sum(level * CASE t % 4 WHEN 0 THEN 64 WHEN 1 THEN 16 WHEN 2 THEN 4 ELSE 1 END) AS INT) AS byte FROM {_LEVELS} GROUP BY 1, 2)"


def _levels(spark, sf_dir):
    return S.quantise_2bit(spec(spark, sf_dir).withColumn("v", F.pmod("v", F.lit(511))))


@query("quantize_2bit", f"SELECT * FROM {_LEVELS}")
def quantize_2bit(spark, sf_dir):
    return _levels(spark, sf_dir)


@query("pack_2bit", f"SELECT * FROM {_PACKED}")
def pack_2bit(spark, sf_dir):
    return S.pack_2bit(_levels(spark, sf_dir))


@query("unpack_2bit", f"SELECT slot * 4 + k AS t, chan, CAST(byte // CAST(pow(4, 3 - k) AS INT) % 4 AS INT) AS level FROM {_PACKED}, range(4) x(k)")
def unpack_2bit(spark, sf_dir):
    return S.unpack_2bit(S.pack_2bit(_levels(spark, sf_dir)))


_PULSES = f"(SELECT injection_id, injection_id % 1999 AS t0, dm / 2 AS dm, injection_id % 64 AS centre, snr / 2 AS amplitude FROM {TRUTH})"


def _pulses(spark, sf_dir):
    rows = truth(spark, sf_dir)
    return rows.select("injection_id", (F.col("injection_id") % 1999).alias("t0"), (F.col("dm") / 2).alias("dm"), (F.col("injection_id") % 64).alias("centre"), (F.col("snr") / 2).alias("amplitude"))


@query("inject_gaussian", f"""WITH a AS (SELECT t0 + CAST(trunc({INJECTION_CONSTANT}::DOUBLE * dm * (inv2 - {_LAST}) / 0.01::DOUBLE) AS BIGINT) + d AS t, chan, sum(amplitude * exp(-0.5 * pow((chan - centre) / 8.0::DOUBLE, 2)) * exp(-0.5 * pow(d / 2.0::DOUBLE, 2))) AS x
FROM {_PULSES}, {_CHANNELS}, (SELECT unnest(range(-6, 7)) AS d) GROUP BY 1, 2) SELECT b.t, b.chan, CAST(least(greatest(round_even(round(((b.v % 200) + 200) % 200 + coalesce(x, 0.0), 6), 0), 0), 255) AS INT) AS v FROM {SPEC} b LEFT JOIN a ON a.t = b.t AND a.chan = b.chan""")
def inject_gaussian(spark, sf_dir):
    base = spec(spark, sf_dir).withColumn("v", F.pmod("v", F.lit(200)))
    return S.inject(base, _pulses(spark, sf_dir), OBS.channels(spark), OBS.last_inv2, OBS.dt_s, 2.0, 8.0, 6)


@query("inject_scattered")
def inject_scattered(spark, sf_dir):
    base = spec(spark, sf_dir).withColumn("v", F.pmod("v", F.lit(200)).cast("double"))
    pulses = _pulses(spark, sf_dir).select("t0", (F.col("centre") / 8.0).alias("tau"), "amplitude")
    return S.inject_scattered(base, pulses, 2.0)


@query("interval_merge", f"""WITH i AS (SELECT quant, stem, sample - 900 AS lo, sample + 900 AS hi FROM {TRUTH}), o AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY quant, stem ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM i),
p AS (SELECT *, sum(opens) OVER (PARTITION BY quant, stem ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS part FROM o) SELECT quant, stem, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM p GROUP BY quant, stem, part""")
def interval_merge(spark, sf_dir):
    rows = truth(spark, sf_dir).select("quant", "stem", (F.col("sample") - 900).alias("lo"), (F.col("sample") + 900).alias("hi"))
    return S.merge_intervals(rows, ["quant", "stem"])


@query("morphology_boxes", Q.MORPHOLOGY)
def morphology_boxes(spark, sf_dir):
    return S.morphology_boxes(images(spark, sf_dir), 8)


_SPLIT_SQL = "SELECT doc_id, toxic, CASE WHEN row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR))) <= round(count(*) OVER (PARTITION BY toxic) * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM labels"


@query("stratified_split", _SPLIT_SQL)
def stratified_split(spark, sf_dir):
    return P.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 0.8)


@query("group_split", """WITH s AS (SELECT source AS "group", count(*) AS n FROM documents GROUP BY source), c AS (SELECT *, sum(n) OVER (ORDER BY "group") AS cum, row_number() OVER (ORDER BY "group") AS pos, sum(n) OVER () AS total, count(*) OVER () AS g FROM s),
b AS (SELECT pos AS cut FROM c WHERE pos < g ORDER BY abs(cum - total * 0.8::DOUBLE), pos LIMIT 1) SELECT "group", n, CASE WHEN pos <= cut THEN 'train' ELSE 'val' END AS split FROM c, b""")
def group_split(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("group")).agg(F.count("*").alias("n"))
    return P.group_split(sizes, "group", "n", 0.8)


@query("oversample", "SELECT doc_id, toxic, CAST(k AS INT) AS \"copy\" FROM labels JOIN range(1, 7) r(k) ON k <= CASE WHEN toxic = 1 THEN 6 WHEN quality = 0 THEN 2 ELSE 1 END")
def oversample(spark, sf_dir):
    repeats = F.when(F.col("toxic") == 1, 6).when(F.col("quality") == 0, 2).otherwise(1)
    return P.oversample(table(spark, sf_dir, "labels"), repeats).select("doc_id", "toxic", "copy")


@query("oversample_shuffled", "SELECT doc_id, CAST(k AS INT) AS \"copy\", row_number() OVER (ORDER BY md5(doc_id || ':' || k)) AS position FROM labels JOIN range(1, 7) r(k) ON k <= CASE WHEN toxic = 1 THEN 6 WHEN quality = 0 THEN 2 ELSE 1 END")
def oversample_shuffled(spark, sf_dir):
    """Repeated rows in an order of their own."""
    repeats = F.when(F.col("toxic") == 1, 6).when(F.col("quality") == 0, 2).otherwise(1)
    rows = P.oversample(table(spark, sf_dir, "labels"), repeats).withColumn("all", F.lit(0))
    return P.ranked_by_hash(rows, ["all"], F.concat_ws(":", "doc_id", "copy")).select("doc_id", "copy", F.col("rank").cast("long").alias("position"))


@query("lhs_sample")
def lhs_sample(spark, sf_dir):
    units = P.latin_hypercube(truth(spark, sf_dir).select("injection_id"), "injection_id", 4)
    zero = F.col("u3") < 0.15
    scatter = F.when(zero, 0.0).otherwise(P.log_uniform((F.col("u3") - 0.15) / 0.85, 0.03, 10))
    return units.select("injection_id", (100 + F.col("u0") * 1900).alias("dm"), P.log_uniform(F.col("u1"), 5, 100).alias("snr"), P.log_uniform(F.col("u2"), 1, 20).alias("width_ms"), scatter.alias("scattering_ms"))


@query("toa_placement")
def toa_placement(spark, sf_dir):
    rows = truth(spark, sf_dir).select("injection_id", "stem", (F.pmod(F.xxhash64("injection_id"), F.lit(1 << 20)) / float(1 << 20)).alias("u"))
    return P.arrivals_by_file(rows, 86400.0, 0.18, 0.24)


@query("image_statistics", f"SELECT image, min(v) AS least, max(v) AS largest, CAST(sum(v) AS BIGINT) AS total, count_if(v > 0)::BIGINT AS n_positive FROM {IMAGES} GROUP BY image")
def image_statistics(spark, sf_dir):
    return images(spark, sf_dir).groupBy("image").agg(F.min("v").alias("least"), F.max("v").alias("largest"), F.sum("v").alias("total"), F.count_if(F.col("v") > 0).alias("n_positive"))
