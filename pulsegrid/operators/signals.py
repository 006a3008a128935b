"""Noise statistics, quantisation, injection and labelling of signals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedisperse import INJECTION_CONSTANT
from .quantiles import exact_quantiles


def robust_channel_std(spec: DataFrame) -> DataFrame:
    """``(chan, robust)``: 1.4826 times the median absolute deviation of each channel; where that is 0.1 or less the
    standard deviation; never below the median of the positive ones. Channels are few, so their statistics are broadcast;
    medians are selected by histograms, as a channel has as many values as samples. Null samples are ignored."""
    centre = exact_quantiles(spec, ["chan"], "v", [0.5], "m").select("chan", F.col("m")[0].alias("m"))
    away = spec.join(F.broadcast(centre), "chan").select("chan", F.abs(F.col("v") - F.col("m")).alias("d"))
    spread = exact_quantiles(away, ["chan"], "d", [0.5], "mad").select("chan", (F.col("mad")[0] * 1.4826).alias("mad"))
    deviation = spec.groupBy("chan").agg(F.stddev_pop("v").alias("std"))
    raw = deviation.join(spread, "chan").select("chan", F.when((F.col("mad") <= 0.1) | F.isnan("mad"), F.col("std")).otherwise(F.col("mad")).alias("robust"))
    floor = raw.where("robust > 0").agg(F.expr("percentile(robust, 0.5D)").alias("floor"))  # a value for each channel
    return raw.crossJoin(F.broadcast(floor)).select("chan", F.when(F.col("robust") > 0, F.col("robust")).otherwise(F.col("floor")).alias("robust"))


def global_channel_std(spec: DataFrame, file_length: int) -> DataFrame:
    """Median over files of each channel's standard deviation in the file."""
    per_file = spec.groupBy("chan", F.expr(f"t div {file_length}").alias("file")).agg(F.stddev_pop("v").alias("std"))
    return per_file.groupBy("chan").agg(F.expr("percentile(std, 0.5D)").alias("std"), F.count("*").alias("n_files"))


def quantise_2bit(sums: DataFrame, *keys: str) -> DataFrame:
    """Levels 0-3 of ``(t, chan, v)``: how many of the channel's quartile values (first value whose running count exceeds a
    quarter, half, three quarters) a value exceeds. Quartiles come from the channel's histogram of distinct values;
    ``keys``, such as a file, have quartiles of their own."""
    counts = sums.groupBy(*keys, "chan", "v").agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys, "chan")
    running = counts.withColumn("cdf", F.sum("n").over(by.orderBy("v"))).withColumn("total", F.sum("n").over(by))
    cut = lambda share, name: F.min(F.when(F.col("cdf") > F.col("total") * share, F.col("v"))).alias(name)
    quartiles = running.groupBy(*keys, "chan").agg(cut(0.25, "q1"), cut(0.5, "q2"), cut(0.75, "q3"))
    quartiles = quartiles if keys else F.broadcast(quartiles)  # a row for each channel
    above = sum(((F.col("v") > F.col(q)).cast("int") for q in ("q1", "q2", "q3")), F.lit(0))
    return sums.join(quartiles, [*keys, "chan"]).select(*keys, "t", "chan", above.alias("level"))


def pack_2bit(levels: DataFrame) -> DataFrame:
    """Four levels to a byte, the first in the upper bits: ``(slot, chan, byte)``; missing samples count as 0."""
    place = F.expr("cast(level * case t % 4 when 0 then 64 when 1 then 16 when 2 then 4 else 1 end as int)")
    return levels.groupBy(F.expr("t div 4").alias("slot"), "chan").agg(F.sum(place).cast("int").alias("byte"))


def packed_rows(levels: DataFrame, nsblk: Column) -> DataFrame:
    """Table rows ``(file, row, data)`` of ``(file, t, chan, level)``, ``nsblk`` samples each: four neighbouring channels to a
    byte, the first in the upper bits. Channels must be a multiple of four and all cells there."""
    place = F.expr("cast(level * case chan % 4 when 0 then 64 when 1 then 16 when 2 then 4 else 1 end as int)")
    coded = levels.withColumn("_row", F.call_function("div", F.col("t"), nsblk).cast("int")).groupBy("file", "_row", "t", F.expr("chan div 4").alias("_slot")).agg(F.sum(place).alias("_byte"))
    rows = coded.groupBy("file", F.col("_row").alias("row")).agg(F.array_sort(F.collect_list(F.struct("t", "_slot", "_byte"))).alias("_bytes"))  # the bytes of a table row
    return rows.select("file", "row", F.unhex(F.array_join(F.transform("_bytes", lambda b: F.lpad(F.hex(b["_byte"]), 2, "0")), "")).alias("data"))


def unpack_2bit(packed: DataFrame) -> DataFrame:
    """The four levels of each byte: ``(t, chan, level)``."""
    four = packed.withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    return four.select((F.col("slot") * 4 + F.col("k")).alias("t"), "chan", F.expr("cast(byte div cast(pow(4, 3 - k) as int) % 4 as int)").alias("level"))


def delay_samples(dm: Column, inv2: Column, last_inv2: float, dt_s: float) -> Column:
    """Delay of a channel against the last one by the injection's constant, in whole samples towards zero."""
    return (F.lit(INJECTION_CONSTANT) * dm * (inv2 - F.lit(last_inv2)) / F.lit(dt_s)).cast("long")


def inject(base: DataFrame, truths: DataFrame, channels: DataFrame, last_inv2: float, dt_s: float, sigma_t: float, sigma_f: float, support: int) -> DataFrame:
    """Add dispersed Gaussian pulses ``truths(injection_id, t0, dm, centre, amplitude)`` to ``base(t, chan, v)``; sums are
    rounded half to even and clipped to 0..255 once, after all pulses. A pulse reaches ``support`` samples to either side.
    Truths and channels are small beside the spectrum: the pulses' cells are made from them and summed before the join."""
    cells = truths.crossJoin(F.broadcast(channels)).withColumn("d", F.explode(F.sequence(F.lit(-support), F.lit(support))))
    envelope = F.exp(-0.5 * F.pow((F.col("chan") - F.col("centre")) / sigma_f, 2))
    pulse = F.exp(-0.5 * F.pow(F.col("d") / sigma_t, 2))
    placed = cells.select((F.col("t0") + delay_samples(F.col("dm"), F.col("inv2"), last_inv2, dt_s) + F.col("d")).alias("t"), "chan", (F.col("amplitude") * envelope * pulse).alias("add"))
    added = placed.groupBy("t", "chan").agg(F.sum("add").alias("add"))
    out = F.rint(F.round(F.col("v") + F.coalesce("add", F.lit(0.0)), 6))
    return base.join(added, ["t", "chan"], "left").select("t", "chan", F.least(F.greatest(out, F.lit(0.0)), F.lit(255.0)).cast("int").alias("v"))


def merge_intervals(rows: DataFrame, keys: list[str], slack: float = 0, block: float = 4096) -> DataFrame:
    """Union of the intervals ``(lo, hi)`` of each key; intervals that touch or are ``slack`` apart merge: ``(keys, lo, hi, n)``.

    Runs are found within blocks of ``block`` units of ``lo``; what reaches over from earlier blocks, and how many runs these
    opened, comes from sums of a row for each block, so no key is sorted whole. Null keys are keys; intervals with a null end
    are left out."""
    placed = rows.where("lo is not null and hi is not null").withColumn("_block", F.floor(F.col("lo") / block))
    order = Window.partitionBy(*keys, "_block").orderBy("lo", "hi")
    at = F.struct(*keys, "_block").alias("_at")  # equal structs may hold nulls
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    reach = placed.groupBy(*keys, "_block").agg(F.max("hi").alias("_hi")).select(at, F.max("_hi").over(earlier).alias("_over"))
    inner = placed.withColumn("_at", at).join(reach, "_at").withColumn("_before", F.greatest("_over", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))))
    opened = inner.withColumn("_opens", F.when(F.col("_before").isNull() | (F.col("lo") > F.col("_before") + slack), 1).otherwise(0))
    numbered = opened.withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy(*keys, "_block", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"))
    runs = parts.groupBy(*keys, "_block").agg(F.max("_run").alias("_runs")).select(at, F.coalesce(F.sum("_runs").over(earlier), F.lit(0)).alias("_first"))
    whole = parts.withColumn("_at", at).join(runs, "_at").groupBy(*keys, (F.col("_first") + F.col("_run")).alias("_part"))
    return whole.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).drop("_part")


def erfcx(x: np.ndarray) -> np.ndarray:
    """exp(x^2) erfc(x) for x >= -20: a continued fraction from 2 on, a power series below 2, and the reflection 2 exp(x^2) - erfcx(-x) for negative x."""
    x = np.asarray(x, float)
    a = np.abs(x)
    far = np.zeros_like(a)
    for k in range(60, 0, -1):
        far = (k / 2) / (np.maximum(a, 2.0) + far)
    far = 1 / (np.sqrt(np.pi) * (np.maximum(a, 2.0) + far))
    near = np.minimum(a, 2.0)
    term, series = near.copy(), near.copy()
    for n in range(1, 80):  # erf(x) = 2 / sqrt(pi) exp(-x^2) sum of 2^n x^(2n+1) / (1 3 ... (2n+1))
        term = term * 2 * near * near / (2 * n + 1)
        series = series + term
    close = np.exp(near * near) - 2 / np.sqrt(np.pi) * series
    positive = np.where(a >= 2, far, close)
    return np.where(x >= 0, positive, 2 * np.exp(np.minimum(a * a, 700)) - positive)


def scattered_pulse(t: np.ndarray, sigma: float, tau: float) -> np.ndarray:
    """A Gaussian of width ``sigma`` convolved with an exponential tail ``tau``, its peak scaled to 1. Without a notable tail the Gaussian itself."""
    t = np.asarray(t, float)
    if tau <= 1e-3 or sigma / tau > 8:
        return np.exp(-0.5 * (t / sigma) ** 2)

    def shape(x: np.ndarray) -> np.ndarray:
        z = np.clip((sigma / tau - x / sigma) / np.sqrt(2), -25, 25)
        tail = np.exp(np.clip(sigma**2 / (2 * tau**2) - x / tau, -700, 50)) * 2
        return np.where(z < -20, tail, np.exp(-0.5 * (x / sigma) ** 2) * erfcx(np.maximum(z, -20)))

    grid = np.linspace(-4 * sigma, 4 * sigma + 4 * tau, 513)
    return shape(t) / max(shape(grid).max(), 1e-300)


def inject_scattered(base: DataFrame, truths: DataFrame, sigma_t: float, block: int = 512, reach: int = 64) -> DataFrame:
    """Add scattered pulses ``truths(t0, tau, amplitude)`` to all channels of ``base(t, chan, v)``: ``(t, chan, v double)``.

    Pulses of one place and tail are one with the sum of their amplitudes. Each goes to the one or two blocks of samples that it
    can touch; blocks are independent groups. In a block, a tail's shape is worked out once for each distance that occurs."""

    def run(key: tuple, samples: pd.DataFrame, pulses: pd.DataFrame) -> pd.DataFrame:
        times, own = np.unique(samples["t"].to_numpy(), return_inverse=True)
        add = np.zeros(len(times))
        for tau, same in pulses.groupby("tau", dropna=False):
            t0 = same["t0"].to_numpy(float)
            x = times.astype(float)[:, None] - t0
            at, pulse = np.nonzero((x >= -reach) & (x <= reach))
            away, of = np.unique(x[at, pulse], return_inverse=True)
            add += np.bincount(at, same["amplitude"].to_numpy(float)[pulse] * scattered_pulse(away, sigma_t, tau)[of], len(times))
        return pd.DataFrame({"t": samples["t"], "chan": samples["chan"], "v": samples["v"] + add[own]})

    summed = truths.groupBy("t0", "tau").agg(F.sum("amplitude").alias("amplitude"))
    blocks = F.sequence(F.floor((F.col("t0") - reach) / block), F.floor((F.col("t0") + reach) / block))
    near = summed.withColumn("block", F.explode(blocks))
    return base.withColumn("block", F.floor(F.col("t") / block)).groupBy("block").cogroup(near.groupBy("block")).applyInPandas(run, "t long, chan int, v double")


def blobs(image: np.ndarray, least: float) -> list[tuple[int, int, int, int, float]]:
    """Boxes (left, top, width, height, sum) of 4-connected regions above ``least``, closed by a 2 x 3 window, in scan order."""
    mask = image > least
    wide = mask.copy()
    wide[1:] |= mask[:-1]
    for shift in (1, -1):
        rolled = np.roll(mask, shift, axis=1)
        rolled[:, 0 if shift == 1 else -1] = False
        wide |= rolled
    out, seen = [], np.zeros(wide.shape, bool)
    for y, x in zip(*np.nonzero(wide)):
        if seen[y, x]:
            continue
        seen[y, x], queue, cells = True, [(y, x)], []
        while queue:
            a, b = queue.pop()
            cells.append((a, b))
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < wide.shape[0] and 0 <= d < wide.shape[1] and wide[c, d] and not seen[c, d]:
                    seen[c, d] = True
                    queue.append((c, d))
        ys, xs = np.array(cells).T
        out.append((int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1, float(image[ys, xs].sum())))
    return out


def morphology_boxes(images: DataFrame, size: int, n_sigma: float = 1.5) -> DataFrame:
    """Boxes of bright regions of each image, above mean + n_sigma std of its border, that are at least 2 pixels: ``(image, box, left, top, width, height, total)``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((size, size))
        image[pdf["py"], pdf["px"]] = pdf["v"]
        edge = np.concatenate([image[0], image[-1], image[1:-1, 0], image[1:-1, -1]])
        found = [b for b in blobs(image, edge.mean() + n_sigma * edge.std()) if b[2] * b[3] >= 2]
        return pd.DataFrame([(pdf["image"].iloc[0], i, *b) for i, b in enumerate(found)], columns=["image", "box", "left", "top", "width", "height", "total"])

    return images.groupBy("image").applyInPandas(run, "image long, box int, left int, top int, width int, height int, total double")
