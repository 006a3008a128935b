"""Sampling, splitting and ordering without a global sort."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_by_hash(rows: DataFrame, strata: list[str], key: Column) -> DataFrame:
    """Add ``rank`` (from 1) and ``n`` of each row within its stratum, in order of the MD5 of ``key`` (unique in the stratum).

    Rows are ranked within hash prefixes, whose counts are then added up; no stratum meets in one task. Null strata are
    strata; rows with a null key come first in theirs, in any order, as do rows with equal keys among each other."""
    hashed = rows.withColumn("_h", F.md5(key.cast("string").cast("binary"))).withColumn("_p", F.substring("_h", 1, 3))
    counts = hashed.groupBy(*strata, "_p").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*strata)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(by.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("_n").over(by)).drop("_n")
    local = hashed.withColumn("_r", F.row_number().over(Window.partitionBy(*strata, "_p").orderBy("_h")))
    at = F.struct(*strata, "_p").alias("_at")  # equal structs may hold nulls
    placed = local.withColumn("_at", at).join(offsets.select(at, "_before", "n"), "_at")
    return placed.withColumn("rank", F.col("_r") + F.col("_before")).drop("_at", "_h", "_p", "_r", "_before")


def stratified_split(rows: DataFrame, label: str, key: str, train_share: float) -> DataFrame:
    """Add ``split``: of each label (null is one) the first ``train_share`` by hash of the key train, the rest validate."""
    ranked = ranked_by_hash(rows, [label], F.col(key))
    return ranked.withColumn("split", F.when(F.col("rank") <= F.round(F.col("n") * train_share), "train").otherwise("val")).drop("rank", "n")


def group_split(sizes: DataFrame, group: str, size: str, share: float) -> DataFrame:
    """Assign whole groups, in order of name, to ``train`` up to the position whose running size is nearest to the share
    (the first of equals; neither side empty), the rest to ``val``. Works on one row per group."""
    order, whole = Window.orderBy(group), Window.partitionBy()
    running = sizes.select(group, size).withColumns({"_cum": F.sum(size).over(order), "_pos": F.row_number().over(order), "_total": F.sum(size).over(whole), "_groups": F.count("*").over(whole)})
    inner = running.where("_pos < _groups").agg(F.min(F.struct(F.abs(F.col("_cum") - F.col("_total") * share), F.col("_pos"))).alias("_best"))
    return running.crossJoin(F.broadcast(inner)).select(group, size, F.when(F.col("_pos") <= F.col("_best._pos"), "train").otherwise("val").alias("split"))


def oversample(rows: DataFrame, repeats: Column) -> DataFrame:
    """Each row ``repeats`` times, numbered by ``copy``."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), repeats))).where("copy >= 1")


def latin_hypercube(rows: DataFrame, key: str, dims: int) -> DataFrame:
    """Unit coordinates ``u0 .. u<dims-1>`` for each row: each dimension is cut into n strata and every stratum is used once,
    in an order of its own given by a hash of the key, which must be unique (one row may have none). Deterministic; no
    generator state."""
    out = rows
    for d in range(dims):
        ranked = ranked_by_hash(rows.select(key).withColumn("_all", F.lit(0)), ["_all"], F.concat_ws(":", F.lit(str(d)), F.col(key)))
        jitter = F.pmod(F.xxhash64(F.lit(d), F.col(key)), F.lit(1 << 20)) / float(1 << 20)
        units = ranked.select(F.struct(key).alias("_key"), ((F.col("rank") - 1 + jitter) / F.col("n")).alias(f"u{d}"))
        out = out.withColumn("_key", F.struct(key)).join(units, "_key").drop("_key")
    return out


def log_uniform(u: Column, low: float, high: float) -> Column:
    """Map 0..1 to a log-uniform value."""
    return F.exp(F.lit(float(np.log(low))) + u * float(np.log(high) - np.log(low)))


def place_arrivals(wanted: np.ndarray, guard: float, end: float, apart: float) -> np.ndarray:
    """Arrival times near the wanted ones, inside the guard bands and ``apart`` seconds from each other: wanted times in
    order, each moved behind the one before it if too close. Raises if they don't fit."""
    order = np.argsort(wanted, kind="stable")
    times = np.clip(wanted[order], guard, end - guard)
    for i in range(1, len(times)):
        times[i] = max(times[i], times[i - 1] + apart)
    top = end - guard
    for i in range(len(times) - 1, -1, -1):  # pull back what was pushed over the end
        times[i] = min(times[i], top)
        top = times[i] - apart
    if len(times) and times[0] < guard - 1e-9:
        raise ValueError("too many arrivals for the window")
    out = np.empty_like(times)
    out[order] = times
    return out


def arrivals_by_file(rows: DataFrame, length_s: float, guard: float, apart: float) -> DataFrame:
    """Arrival times of the injections ``(injection_id, stem, u)`` of each file: ``(injection_id, stem, toa)``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("injection_id")
        return pd.DataFrame({"injection_id": pdf["injection_id"], "stem": pdf["stem"], "toa": place_arrivals(pdf["u"].to_numpy() * length_s, guard, length_s, apart)})

    return rows.groupBy("stem").applyInPandas(run, "injection_id long, stem string, toa double")
