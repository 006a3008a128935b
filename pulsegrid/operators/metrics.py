"""Recall, false-positive, precision and threshold analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import checkpointed
from .quantiles import exact_quantiles

#: Bin edges of campaign tables (fixed values).
SNR_BINS = (5, 7, 10, 15, 22, 33, 50, 75, 100)
DM_BINS = (100, 300, 500, 800, 1100, 1400, 1700, 2000)
WIDTH_BINS = (1, 1.5, 2.5, 4, 6.5, 10, 15, 20)


def bin_index(value: Column, edges: tuple) -> Column:
    """Half-open bins, the last one closed; null outside. One expression, so no join is needed."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        inside = (value >= edges[i]) & ((value <= edges[i + 1]) if i == len(edges) - 2 else (value < edges[i + 1]))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def bins(spark: SparkSession, edges: tuple, name: str = "bin") -> DataFrame:
    """The bins as a dimension: ``(bin, lo, hi, label)``."""
    rows = [(i, float(lo), float(hi), f"{lo:g}-{hi:g}") for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    return spark.createDataFrame(rows, f"{name} int, lo double, hi double, label string")


def recall_by_bin(matches: DataFrame, value: str, edges: tuple) -> DataFrame:
    """``(bin, lo, hi, label, n_total, n_detected, recall)``; empty bins stay, with null recall."""
    counted = matches.withColumn("bin", bin_index(F.col(value), edges)).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n_total"), F.count_if("detected").alias("n_detected"))
    out = bins(matches.sparkSession, edges).join(counted, "bin", "left").fillna(0, ["n_total", "n_detected"])
    return out.withColumn("recall", F.try_divide("n_detected", "n_total"))


def recall_heatmap_inclusive(matches: DataFrame, x: str, x_edges: tuple, y: str, y_edges: tuple) -> DataFrame:
    """Recall over cells with both ends included: a value on an inner edge counts in both bins."""

    def owners(value: Column, edges: tuple) -> Column:
        return F.filter(F.array(*[F.when((value >= lo) & (value <= hi), F.lit(i)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]), lambda i: i.isNotNull())

    cells = matches.withColumn("x_bin", F.explode(owners(F.col(x), x_edges))).withColumn("y_bin", F.explode(owners(F.col(y), y_edges)))
    return cells.groupBy("x_bin", "y_bin").agg(F.count("*").alias("n_total"), F.count_if("detected").alias("n_detected"))


def _long(rows: DataFrame, parameters: dict[str, tuple], *kept: str) -> DataFrame:
    """One row for each parameter: ``(quant, parameter, param_bin, snr_bin, ...)``, binned."""
    cells = F.array(*[F.struct(F.lit(p).alias("parameter"), bin_index(F.col(p), e).alias("param_bin")) for p, e in parameters.items()])
    out = rows.withColumn("snr_bin", bin_index(F.col("snr"), SNR_BINS)).where("snr_bin is not null").select("quant", "snr_bin", *kept, F.explode(cells).alias("c"))
    return out.select("quant", "c.parameter", "c.param_bin", "snr_bin", *kept).where("param_bin is not null")


def cell_cube(matches: DataFrame, false_positives: DataFrame, parameters: dict[str, tuple]) -> DataFrame:
    """Totals, detections, false positives, recall and precision proxy of every (quant, parameter, bin, S/N bin), empty cells included."""
    spark = matches.sparkSession
    grid = spark.createDataFrame([(q, p, i, s) for q in ("raw8", "packed2") for p, e in parameters.items() for i in range(len(e) - 1) for s in range(len(SNR_BINS) - 1)], "quant string, parameter string, param_bin int, snr_bin int")
    keys = ["quant", "parameter", "param_bin", "snr_bin"]
    hits = _long(matches, parameters, "detected").groupBy(*keys).agg(F.count("*").alias("n_total"), F.count_if("detected").alias("n_detected"))
    wrong = _long(false_positives, parameters).groupBy(*keys).agg(F.count("*").alias("n_fp"))
    out = grid.join(hits, keys, "left").join(wrong, keys, "left").fillna(0, ["n_total", "n_detected", "n_fp"])
    return out.withColumns({"recall": F.try_divide("n_detected", "n_total"), "precision_proxy": F.try_divide(F.col("n_detected"), F.col("n_detected") + F.col("n_fp"))})


def campaign_summary(matches: DataFrame, false_positives: DataFrame) -> DataFrame:
    """Per quantization: injections, detections, false positives, recall, precision proxy and the localised share."""
    hits = matches.groupBy("quant").agg(F.count("*").alias("n_total"), F.count_if("detected").alias("n_detected"), F.count_if(F.col("detected") & (F.abs("dm_error") <= 2)).alias("n_localised"))
    out = hits.join(false_positives.groupBy("quant").agg(F.count("*").alias("n_fp")), "quant", "left").fillna(0, ["n_fp"])
    return out.withColumns({"recall": F.try_divide("n_detected", "n_total"), "precision_proxy": F.try_divide(F.col("n_detected"), F.col("n_detected") + F.col("n_fp")), "localised": F.try_divide("n_localised", "n_detected")})


def loss_map(cube: DataFrame) -> DataFrame:
    """Recall of raw8 minus packed2 in each cell; null unless both have injections."""
    wide = cube.groupBy("parameter", "param_bin", "snr_bin").pivot("quant", ["raw8", "packed2"]).agg(F.first("recall"))
    return wide.select("parameter", "param_bin", "snr_bin", (F.col("raw8") - F.col("packed2")).alias("loss"))


def snr_rows(matches: DataFrame) -> DataFrame:
    """Recall by quantization and S/N bin with the bins' geometric centres."""
    spark = matches.sparkSession
    counted = matches.withColumn("bin", bin_index(F.col("snr"), SNR_BINS)).where("bin is not null").groupBy("quant", "bin").agg(F.count("*").alias("n_total"), F.count_if("detected").alias("n_detected"))
    return counted.join(F.broadcast(bins(spark, SNR_BINS)), "bin").select("quant", "bin", F.sqrt(F.col("lo") * F.col("hi")).alias("centre"), "n_total", "n_detected", F.try_divide("n_detected", "n_total").alias("recall"))


def error_summary(matches: DataFrame) -> DataFrame:
    """Recall, recall above S/N 10 and 20, and median and 90th percentile of the absolute DM error of the detected."""
    strong = lambda s: F.count_if((F.col("snr") >= s) & F.col("detected")) / F.greatest(F.lit(1), F.count_if(F.col("snr") >= s))
    error = exact_quantiles(matches.where("detected").withColumn("_error", F.abs("dm_error")), ["quant"], "_error", (0.5, 0.9), "e").drop("n")
    out = matches.groupBy("quant").agg(F.count("*").alias("n"), (F.count_if("detected") / F.count("*")).alias("recall"), strong(10).alias("recall_snr10"), strong(20).alias("recall_snr20"))
    out = out.join(error.withColumnRenamed("quant", "_quant"), F.col("quant").eqNullSafe(F.col("_quant")), "left")
    return out.select("quant", "n", "recall", "recall_snr10", "recall_snr20", F.col("e")[0].alias("error_median"), F.col("e")[1].alias("error_p90"))


def centi(sigma: Column) -> Column:
    """Sigma in hundredths, rounded half to even."""
    return F.bround(sigma * 100).cast("int")


def fp_histogram(false_positives: DataFrame) -> DataFrame:
    """Counts by quantization and hundredths of sigma."""
    return false_positives.groupBy("quant", centi(F.col("sigma")).alias("sigma_centi")).agg(F.count("*").alias("n"))


def fp_cell_histogram(false_positives: DataFrame, parameters: dict[str, tuple]) -> DataFrame:
    """Counts by parameter, quantization, hundredths of sigma and cell."""
    rows = false_positives.withColumn("sigma_centi", centi(F.col("sigma")))
    return _long(rows, parameters, "sigma_centi").groupBy("parameter", "quant", "sigma_centi", "snr_bin", "param_bin").agg(F.count("*").alias("n"))


def threshold_rollup(histogram: DataFrame, thresholds: list[float]) -> DataFrame:
    """False positives at or above each threshold, zero where there is none, from the histogram alone."""
    spark = histogram.sparkSession
    dims = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double").withColumn("least", F.ceil(F.col("threshold") * 100 - 1e-9).cast("int"))
    grid = dims.crossJoin(histogram.select("quant").distinct())
    n = F.coalesce(F.sum(F.when(F.col("sigma_centi") >= F.col("least"), F.col("n"))), F.lit(0))
    return grid.join(histogram, "quant").groupBy("threshold", "quant").agg(n.alias("n_fp"))


def ranked_by_confidence(scored: DataFrame) -> DataFrame:
    """Add ``rank``, ``cum_tp`` and ``positives`` to ``(id, conf, tp, ...)``: by falling confidence, ties by id (a number).

    The running sums are taken within ranges of confidence, cut at approximate quantiles, and joined to the ranges' offsets,
    so no task sorts all rows; rows of one confidence are dealt by ranges of their ids. Null confidences come last (null ids
    first among equals); NaN counts as the largest."""
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = ",".join(f"{i / parts}D" for i in range(1, parts)) or "0.5D"
    cuts = scored.agg(F.expr(f"percentile_approx(conf, array({shares}), {100 * parts})").alias("q")).first()["q"] or []  # fewer than the partitions
    cuts = sorted(set(cuts))
    # a cut is a range of its own: the rows of a frequent confidence lie in it, and are cut by id once more
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda q: q > F.col("conf"))) if cuts else F.lit(0)
    equal = F.col("conf").isin(cuts) if cuts else F.lit(False)
    ranged = scored.withColumn("part", F.when(F.col("conf").isNull(), 2 * len(cuts) + 2).otherwise(2 * above + F.when(equal, 1).otherwise(0)))
    tied = ranged.where(equal | F.col("conf").isNull()).agg(F.expr(f"percentile_approx(id, array({shares}), {100 * parts})").alias("q")).first()["q"] or []
    among = F.size(F.filter(F.array(*map(F.lit, sorted(set(tied)))), lambda q: q < F.col("id"))) if tied else F.lit(0)
    ranged = ranged.withColumn("tie", F.when((equal | F.col("conf").isNull()) & F.col("id").isNotNull(), among + 1).otherwise(0))
    own = Window.partitionBy("part", "tie").orderBy(F.desc_nulls_last("conf"), "id")
    inner = ranged.withColumns({"n_in": F.row_number().over(own), "tp_in": F.sum("tp").over(own.rowsBetween(Window.unboundedPreceding, 0))})
    before = Window.orderBy("part", "tie").rowsBetween(Window.unboundedPreceding, -1)  # some rows for each partition
    sums = inner.groupBy("part", "tie").agg(F.count("*").alias("n_part"), F.sum("tp").alias("tp_part"))
    offsets = sums.select("part", "tie", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("tp_part").over(before), F.lit(0)).alias("tp0"), F.sum("tp_part").over(Window.partitionBy()).alias("positives"))
    joined = inner.join(F.broadcast(offsets), ["part", "tie"])
    return joined.select(*scored.columns, (F.col("n_in") + F.col("n0")).alias("rank"), (F.col("tp_in") + F.col("tp0")).alias("cum_tp"), "positives")


def pr_curve(scored: DataFrame) -> DataFrame:
    """Precision-recall points of ``(id, conf, tp)`` by falling confidence (ties by id), with 1e-8 in the quotients. Every row
    is a point; those without a confidence come last."""
    ranked = ranked_by_confidence(scored)
    precision, recall = F.col("cum_tp") / (F.col("rank") + 1e-8), F.col("cum_tp") / (F.col("positives") + 1e-8)
    out = ranked.select("id", "conf", "rank", "cum_tp", precision.alias("precision"), recall.alias("recall"))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8))


def operating_point(curve: DataFrame) -> DataFrame:
    """The first point with the largest 0.5 recall + 0.2 precision."""
    merit = F.round(F.col("recall") * 0.5 + F.col("precision") * 0.2, 12)
    return curve.withColumn("merit", merit).orderBy(F.desc("merit"), "rank").limit(1).select("id", "conf", "rank", "precision", "recall", "f1")


#: Weights of recall, precision and centre quality in a detector's score (fixed values).
RECALL_WEIGHT, PRECISION_WEIGHT, QUALITY_WEIGHT = 0.5, 0.2, 0.3


def detector_score(found: DataFrame, n_truth: int, reach: float) -> DataFrame:
    """One row: the operating point of ``found(id, conf, tp, distance)`` and how well it places centres.

    The operating point is the first rank with the largest 0.5 recall + 0.2 precision (recall of ``n_truth``). Over the true
    positives up to it come the mean, median, 90th and 95th percentile of their distance, the centre quality
    ``max(0, 1 - p90 / reach)`` and the score with all three weights. Without a true positive up to there the distances are
    ``reach`` and the quality is 0; without any detection or truth, all rates are 0, too. Detections without a confidence come
    last; a true positive without a distance counts for the rates and not for the distances.

    Rows are ranked by ranges and the distances' quantiles selected by histograms: nothing is sorted as a whole."""
    ranked = checkpointed(ranked_by_confidence(found.select("id", "conf", F.col("tp").cast("long").alias("tp"), F.col("distance").cast("double").alias("distance"))))
    recall, precision = F.col("cum_tp") / F.lit(max(n_truth, 1)), F.col("cum_tp") / (F.col("rank") + 1e-8)
    merit = recall * RECALL_WEIGHT + precision * PRECISION_WEIGHT
    best = ranked.agg(F.max_by(F.struct("rank", "conf", precision.alias("p"), recall.alias("r")), F.struct(F.round(merit, 12).alias("m"), (-F.col("rank")).alias("k"))).alias("b")).first()["b"]
    names = ("mean_center_dist", "p50_center_dist", "p90_center_dist", "p95_center_dist")
    if best is None or n_truth <= 0:
        row = (0.0, None, 0.0, 0.0, *[float(reach)] * 4, 0.0, 0.0)
    else:
        near = ranked.where((F.col("rank") <= best["rank"]) & (F.col("tp") == 1) & F.col("distance").isNotNull() & ~F.isnan("distance"))
        stats = exact_quantiles(near, [], "distance", (0.5, 0.9, 0.95)).first()
        mean = near.agg(F.avg("distance")).first()[0]
        away = [float(reach)] * 4 if stats is None else [mean, *stats["q"]]
        quality = 0.0 if stats is None else max(0.0, 1.0 - away[2] / float(reach))
        p, r = best["p"], best["r"]
        row = (2 * p * r / (p + r + 1e-8), None if best["conf"] is None else float(best["conf"]), p, r, *away, quality, RECALL_WEIGHT * r + PRECISION_WEIGHT * p + QUALITY_WEIGHT * quality)
    schema = ", ".join(f"{n} double" for n in ("f1", "f1_conf", "precision", "recall", *names, "center_quality", "score"))
    return found.sparkSession.createDataFrame([row], schema)


def cells_by_threshold(histogram: DataFrame, thresholds: list[float], parameters: dict[str, tuple]) -> DataFrame:
    """``(threshold, parameter, quant, param_bin, snr_bin, n_fp)``: false positives at or above each threshold in every cell,
    zeros included, from ``fp_cell_histogram`` alone.

    Thresholds stand among the histogram's rows of each cell, where the running sum from the largest sigma down is
    their count: one scan answers all thresholds. Rows of other parameters, quantizations or bins are left out."""
    spark = histogram.sparkSession
    grid = spark.createDataFrame(
        [(p, q, b, s) for p, e in parameters.items() for q in ("raw8", "packed2") for b in range(len(e) - 1) for s in range(len(SNR_BINS) - 1)], "parameter string, quant string, param_bin int, snr_bin int"
    )
    asked = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.ceil(F.lit(t * 100 - 1e-9)).cast("int").alias("sigma_centi")) for t in thresholds])
    cell = ["parameter", "quant", "param_bin", "snr_bin"]
    looks = grid.select(*cell, F.explode(asked).alias("a")).select(*cell, "a.threshold", "a.sigma_centi", F.lit(0).cast("long").alias("n"))
    rows = histogram.join(F.broadcast(grid), cell, "left_semi").select(*cell, F.lit(None).cast("double").alias("threshold"), "sigma_centi", "n")
    down = Window.partitionBy(*cell).orderBy(F.desc("sigma_centi"), F.asc_nulls_first("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.unionByName(looks).withColumn("n_fp", F.sum("n").over(down)).where("threshold is not null").select("threshold", *cell, "n_fp")


def binary_metrics(scored: DataFrame) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 of ``(label, pred)``."""
    hit = lambda a, b: F.count_if((F.col("label") == a) & (F.col("pred") == b))
    out = scored.agg(F.count("*").alias("n"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    return out.withColumns({"accuracy": (F.col("tp") + F.col("tn")) / F.greatest(F.lit(1), "n"), "precision": F.col("tp") / (F.col("tp") + F.col("fp") + 1e-8), "recall": F.col("tp") / (F.col("tp") + F.col("fn") + 1e-8)})
