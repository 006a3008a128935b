"""De-dispersion: shifted sums over the channels of a dynamic spectrum."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Dispersion constants of the search and of the injection model (fixed values; they differ in the fourth digit).
SEARCH_CONSTANT = 4.15e3
INJECTION_CONSTANT = 4148.808
#: Channels kept of 4096 (fixed values), scaled to the number of channels at hand.
KEPT_CHANNELS = ((10, 650), (820, 4050))


@dataclass(frozen=True)
class Observation:
    """Frequencies and timing of an observation, and the trial dispersion measures."""

    n_chan: int = 64
    low_mhz: float = 1000.0
    band_mhz: float = 500.0
    dt_s: float = 0.01
    n_dm: int = 32
    dm_scale: float = 20.0
    dm_offset: float = 0.0

    def channels(self, spark: SparkSession) -> DataFrame:
        """``(chan, freq, inv2, idx)``: kept channels with their rank among those kept."""
        bounds = [(lo * self.n_chan // 4096, hi * self.n_chan // 4096) for lo, hi in KEPT_CHANNELS]
        freq = F.lit(self.low_mhz) + F.col("id") * F.lit(self.band_mhz) / F.lit(float(self.n_chan))
        rank, before = F.lit(None).cast("int"), 0
        for lo, hi in bounds:
            rank = F.when((F.col("id") >= lo) & (F.col("id") < hi), (F.col("id") - lo + before).cast("int")).otherwise(rank)
            before += hi - lo
        dims = spark.range(self.n_chan).select(F.col("id").cast("int").alias("chan"), freq.alias("freq"), rank.alias("idx"))
        return dims.where("idx is not null").withColumn("inv2", F.lit(1.0) / (F.col("freq") * F.col("freq")))

    @property
    def n_kept(self) -> int:
        return sum(hi * self.n_chan // 4096 - lo * self.n_chan // 4096 for lo, hi in KEPT_CHANNELS)

    @property
    def last_inv2(self) -> float:
        last = self.low_mhz + (self.n_chan - 1) * self.band_mhz / float(self.n_chan)
        return 1.0 / (last * last)

    def shifts(self, spark: SparkSession) -> DataFrame:
        """``(dm, chan, idx, shift)``: samples by which each kept channel lags the last one, cut towards zero.

        The table's size is set by the configuration (trials x channels), not by the data."""
        trial = spark.range(self.n_dm).select(F.col("id").cast("int").alias("dm"), (F.col("id") * self.dm_scale + self.dm_offset).alias("dm_value"))
        delay = F.lit(SEARCH_CONSTANT) * F.col("dm_value") * (F.col("inv2") - F.lit(self.last_inv2)) / F.lit(self.dt_s)
        return trial.crossJoin(self.channels(spark)).select("dm", "chan", "idx", delay.cast("int").alias("shift"))


def dedisperse(spec: DataFrame, shifts: DataFrame, split: int) -> DataFrame:
    """Sums of ``spec(t, chan, v)`` along each trial: ``(dm, y, v_full, v_lower, v_upper)``; the lower half takes ``idx <= split``."""
    shifted = spec.join(F.broadcast(shifts), "chan").withColumn("y", F.col("t") - F.col("shift")).where("y >= 0")
    lower = F.col("idx") <= split
    return shifted.groupBy("dm", "y").agg(F.sum("v").alias("v_full"), F.sum(F.when(lower, F.col("v")).otherwise(0)).alias("v_lower"), F.sum(F.when(lower, 0).otherwise(F.col("v"))).alias("v_upper"))


def _shared_sums(table: pd.DataFrame, split: int, band: int) -> tuple[list[tuple[np.ndarray, np.ndarray, bool]], list[tuple[int, list[tuple[int, int]]]]]:
    """Partial sums that trials share, and how each trial is made of them.

    Channels of one half are taken ``band`` at a time. Trials whose shifts within a band are the same but for a common one
    need the same sum of its channels: (channels, relative shifts, in the lower half). A trial is a list of (sum, common shift)."""
    sums: list[tuple[np.ndarray, np.ndarray, bool]] = []
    known: dict[tuple, int] = {}
    trials = []
    for dm, g in table.sort_values(["dm", "idx"]).groupby("dm"):
        parts = []
        for low in (True, False):
            half = g[(g["idx"] <= split) == low]
            for i in range(0, len(half), band):
                chans, shift = half["chan"].to_numpy()[i : i + band], half["shift"].to_numpy()[i : i + band]
                least = int(shift.min())
                key = (low, i, tuple(chans), tuple(shift - least))
                if key not in known:
                    known[key] = len(sums)
                    sums.append((chans, shift - least, low))
                parts.append((known[key], least))
        trials.append((int(dm), parts))
    return sums, trials


def dedisperse_blocks(spec: DataFrame, shifts: DataFrame, split: int, block: int = 256, band: int = 8) -> DataFrame:
    """The sums of ``dedisperse`` by a block kernel: each block of output samples gathers its look-ahead, and numpy adds
    shifted channel rows, ``band`` neighbouring channels first, whose sums serve all trials with the same delays among them.
    Blocks have ``block`` samples, or as many as the longest delay, so that a row goes to two blocks at most instead of to
    every trial."""
    table = shifts.toPandas()  # trials x channels, a configuration's size
    reach = int(table["shift"].max()) if len(table) else 0
    block = max(block, reach, 1)
    shared, trials = _shared_sums(table, split, band)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(pdf["block"].iloc[0]) * block
        chans, at = pdf["chan"].to_numpy(), pdf["t"].to_numpy() - start
        cube = np.zeros((2, int(max(chans.max(), table["chan"].max())) + 1, block + reach), np.int64)  # values, and whether there are any
        np.add.at(cube[0], (chans, at), pdf["v"].to_numpy())
        cube[1, chans, at] = 1
        partial = []
        for channel, shift, _ in shared:
            total = np.zeros((2, block + reach), np.int64)
            for c, s in zip(channel, shift):
                total[:, : block + reach - s] += cube[:, c, s:]
            partial.append(total)
        out = []
        for dm, parts in trials:
            sums = np.zeros((2, 2, block), np.int64)
            for k, s in parts:
                sums[0 if shared[k][2] else 1] += partial[k][:, s : s + block]
            y = np.flatnonzero(sums[:, 1].any(axis=0))
            out.append(pd.DataFrame({"dm": dm, "y": y + start, "v_full": sums[:, 0][:, y].sum(axis=0), "v_lower": sums[0, 0, y], "v_upper": sums[1, 0, y]}))
        return pd.concat(out)

    first = F.greatest(F.lit(0), F.floor((F.col("t") - reach) / block))
    halo = spec.withColumn("block", F.explode(F.sequence(first.cast("long"), F.floor(F.col("t") / block).cast("long"))))
    return halo.groupBy("block").applyInPandas(kernel, "dm int, y long, v_full long, v_lower long, v_upper long")


def align_at_dm(spec: DataFrame, shifts: DataFrame, dm: int) -> DataFrame:
    """The spectrum with each channel moved by its delay at one trial: ``(y, chan, v)``, no sum over channels."""
    one = shifts.where(F.col("dm") == dm).select("chan", "shift")
    return spec.join(F.broadcast(one), "chan").select((F.col("t") - F.col("shift")).alias("y"), "chan", "v").where("y >= 0")


def strongest(cells: DataFrame, k: int) -> DataFrame:
    """The ``k`` cells with the largest full sums; ties by dm, then y."""
    return cells.orderBy(F.desc("v_full"), "dm", "y").limit(k)


def time_pool(spec: DataFrame, rate: int) -> DataFrame:
    """Means of ``rate`` consecutive samples of each channel, as exact sums and counts: ``(y, chan, total, n)``."""
    return spec.groupBy(F.expr(f"t div {rate}").alias("y"), "chan").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def frequency_pool(spec: DataFrame, factor: int) -> DataFrame:
    """Sums of ``factor`` neighbouring channels: ``(t, band, total, n)``."""
    return spec.groupBy("t", F.expr(f"chan div {factor}").cast("int").alias("band")).agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def bandpass_normalise(spec: DataFrame) -> DataFrame:
    """Each value over its channel's time mean plus 1e-8: ``(t, chan, ratio)``. One value per channel is broadcast."""
    mean = spec.groupBy("chan").agg((F.sum("v") / F.count("*")).alias("mean"))
    return spec.join(F.broadcast(mean), "chan").select("t", "chan", (F.col("v") / (F.col("mean") + 1e-8)).alias("ratio"))


def halo_blocks(spec: DataFrame, block: int, halo: int) -> DataFrame:
    """Rows of each block of ``block`` samples with its look-ahead of ``halo`` samples: ``(block_id, offset, chan, v)``."""
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - block - halo + 1) / block)).cast("long")
    ids = F.sequence(first, F.floor(F.col("t") / block).cast("long"))
    return spec.select("t", "chan", "v", F.explode(ids).alias("block_id")).select("block_id", (F.col("t") - F.col("block_id") * block).alias("offset"), "chan", "v")


def pad_blocks(blocks: DataFrame, length: int, n_chan: int) -> DataFrame:
    """``(block_id, offset, chan, v double, padded)``: ``halo_blocks`` with the missing end of each block filled up to
    ``length`` samples of all channels: the mean of the block's own samples plus a share of their standard deviation, a
    hash of block, offset and channel between 0 and 1."""
    held = blocks.groupBy("block_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), (F.max("offset") + 1).alias("have"))
    short = held.where(F.col("have") < length)
    cells = short.select("block_id", "m", "s", F.explode(F.sequence(F.col("have"), F.lit(length - 1).cast("long"))).alias("offset"))
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_chan - 1))).alias("chan"))
    share = F.pmod(F.xxhash64("block_id", "offset", "chan"), F.lit(1 << 24)) / float(1 << 24)
    filled = cells.select("block_id", "offset", "chan", (F.col("m") + share * F.col("s")).alias("v"), F.lit(True).alias("padded"))
    return blocks.select("block_id", "offset", "chan", F.col("v").cast("double").alias("v"), F.lit(False).alias("padded")).unionByName(filled)


def window_starts(n_dm: int, span: int, stride: int) -> list[int]:
    """Starts of DM windows: every ``stride``, and a last one that ends with the range."""
    starts = list(range(0, max(1, n_dm - span + 1), stride))
    return starts if starts[-1] == n_dm - span or n_dm <= span else [*starts, n_dm - span]


def dm_window_pool(cells: DataFrame, spark: SparkSession, n_dm: int, span: int, stride: int, dm_pool: int, y_pool: int) -> DataFrame:
    """Mean-pooled DM-time images of each window: ``(dm_chunk, dm_start, py, px, total, n)``."""
    starts = list(enumerate(window_starts(n_dm, span, stride)))
    owners = [(dm, i, s) for dm in range(n_dm) for i, s in starts if s <= dm < s + span]
    dims = spark.createDataFrame(owners, "dm int, dm_chunk int, dm_start int")
    placed = cells.join(F.broadcast(dims), "dm")
    return placed.groupBy("dm_chunk", "dm_start", F.expr(f"(dm - dm_start) div {dm_pool}").cast("int").alias("py"), F.expr(f"y div {y_pool}").alias("px")).agg(F.sum("v_full").alias("total"), F.count("*").alias("n"))


def cut_out(candidates: DataFrame, spec: DataFrame, shifts: DataFrame, width: int, pool: int, block: int = 256) -> DataFrame:
    """De-dispersed cut-outs around candidates ``(cand_id, dm, toa)``: from ``max(0, toa - width / 2)``, along the
    trial's delays, zero beyond the data, channels pooled by ``pool``: ``(cand_id, i, band, total)``.

    A candidate goes to the block of samples in which its cut-out begins, and a sample to its block and those just before that
    reach it (two in all where blocks are as long as the reach), so no cell of a cut-out is shuffled. Candidates without a
    trial of ``shifts`` are left out; rows of one candidate add up where they begin in one block."""
    table = shifts.toPandas()  # trials x channels, a configuration's size
    delays = {dm: (own["chan"].to_numpy(), own["shift"].to_numpy()) for dm, own in table.groupby("dm")}
    reach = width + (int(table["shift"].max()) if len(table) else 0)
    block = max(block, reach)
    chans = int(table["chan"].max()) + 1 if len(table) else 1

    def run(key: tuple, found: pd.DataFrame, samples: pd.DataFrame) -> pd.DataFrame:
        if not len(found):
            return pd.DataFrame(columns=["cand_id", "i", "band", "total"])
        first = int(key[0]) * block
        cube = np.zeros((chans, block + reach), np.int64)
        held = samples[(samples["chan"] < chans) & samples["v"].notna()]
        np.add.at(cube, (held["chan"].to_numpy(int), held["t"].to_numpy(int) - first), held["v"].to_numpy(np.int64))
        names, number = np.unique(found["cand_id"].to_numpy(), return_inverse=True)
        bands = np.unique(table["chan"] // pool)
        totals, known = np.zeros((len(names), width, len(bands)), np.int64), np.zeros((len(names), len(bands)), bool)
        for at, start, dm in zip(number, found["start"].to_numpy(int) - first, found["dm"]):
            chan, shift = delays[dm]
            cells = cube[chan[:, None], start + shift[:, None] + np.arange(width)]
            band = np.searchsorted(bands, chan // pool)
            np.add.at(totals[at].T, band, cells)
            known[at, band] = True
        at, band = np.nonzero(known)
        n = len(at)
        return pd.DataFrame({"cand_id": np.repeat(names[at], width), "i": np.tile(np.arange(width), n), "band": np.repeat(bands[band], width), "total": totals[at, :, band].reshape(-1)})

    start = F.greatest(F.lit(0), F.col("toa") - width // 2)
    wanted = candidates.withColumn("start", start).join(F.broadcast(shifts.select("dm").distinct()), "dm", "left_semi").select("cand_id", "dm", "start", F.floor(F.col("start") / block).alias("block"))
    at = F.col("t") - F.col("block") * block
    copies = F.sequence(F.greatest(F.lit(0), F.floor((F.col("t") - reach) / block)), F.floor(F.col("t") / block))
    near = spec.where("t >= 0 and chan >= 0").select("t", "chan", "v", F.explode(copies).alias("block")).where(at < block + reach)
    return wanted.groupBy("block").cogroup(near.groupBy("block")).applyInPandas(run, "cand_id long, i int, band int, total long")


def multiscale_pool(series: DataFrame, spark: SparkSession, rates: list[int], keys: list[str]) -> DataFrame:
    """Sums of the de-dispersed series ``(y, v)`` of each trial (``keys``) at several pooling rates: ``(keys, rate, slot, total, n)``."""
    dims = spark.createDataFrame([(r,) for r in rates], "rate int")
    return series.crossJoin(F.broadcast(dims)).groupBy(*keys, "rate", F.expr("y div rate").alias("slot")).agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def boxcar_search(cells: DataFrame, widths: list[int], block: int = 4096) -> DataFrame:
    """Matched-filter search of this library: sums over ``width`` samples from each position of every trial:
    ``(dm, y, width, total)``, full windows only.

    A window is the difference of two running sums. They run within blocks of ``block`` samples that also hold the rows their
    last windows reach into, so a row goes to its block and those just before that reach it, whatever the widths, and no trial
    is sorted whole. Positions must be unique in a trial."""
    first = F.floor((F.col("y") - (max(widths) - 1)) / block)
    rows = cells.select("dm", "y", "v_full", F.explode(F.sequence(first, F.floor(F.col("y") / block))).alias("_block"))
    order = Window.partitionBy("dm", "_block").orderBy("y")
    running = rows.withColumn("_run", F.sum("v_full").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sums = [F.struct(F.lit(w).alias("width"), F.when(F.lead("y", w - 1).over(order) == F.col("y") + (w - 1), F.lead("_run", w - 1).over(order) - F.col("_run") + F.col("v_full")).alias("total")) for w in widths]
    found = running.withColumn("_sums", F.array(*sums)).where(F.floor(F.col("y") / block) == F.col("_block"))
    return found.select("dm", "y", F.inline("_sums")).where("total is not null")
