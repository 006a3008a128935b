"""Training-set catalogues, boxes, planning and augmentation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .images import kth_clipped, named


@dataclass(frozen=True)
class SearchConfig:
    """Settings of a search; ``violations`` lists all that is wrong with them."""

    dm_range: int = 4096
    dm_span: int = 1024
    dm_stride: int = 1024
    dm_scale: float = 1.0
    block_size: int = 4096
    class_block_size: int = 1024
    class_time_downsample: int = 1
    det_prob: float = 0.45
    class_threshold: float = 0.5
    sections: int = 32

    def violations(self) -> list[str]:
        found = [f"{f.name} must be positive" for f in fields(self) if getattr(self, f.name) <= 0]
        if self.dm_span > 0 and self.dm_span % 512:
            found.append("dm_span must be a multiple of 512")
        if self.dm_span > self.dm_range:
            found.append("dm_span must not exceed dm_range")
        if self.dm_stride > self.dm_span:
            found.append("dm_stride must not exceed dm_span")
        if self.block_size % 512:
            found.append("block_size must be a multiple of 512")
        if self.class_time_downsample > 0 and self.class_block_size % self.class_time_downsample:
            found.append("class_time_downsample must divide class_block_size")
        found += [f"{n} must be below 1" for n in ("det_prob", "class_threshold") if getattr(self, n) >= 1]
        return found

    def checked(self) -> SearchConfig:
        if found := self.violations():
            raise ValueError("; ".join(found))
        return self


def catalogue(samples: DataFrame, key: str, order: str) -> DataFrame:
    """Samples by key, the first in order of each kept."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return samples.withColumn("_n", first).where("_n = 1").drop("_n")


def detector_catalogue(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """``(image, n_boxes, min_box)`` of ``images(image)`` and ``boxes(image, w, h)``: box counts and the least square root of
    an area, infinite without boxes. Boxes under a pixel don't count."""
    held = boxes.where("w >= 1 and h >= 1").groupBy("image").agg(F.count("*").alias("n_boxes"), F.min(F.sqrt(F.col("w") * F.col("h"))).alias("min_box"))
    return images.join(held, "image", "left").fillna(0, ["n_boxes"]).fillna(float("inf"), ["min_box"])


def annotations_or_placeholder(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes of each image as text, or ``-1,-1,-1,-1`` where it has none."""
    text = F.concat_ws(",", *[F.col(c).cast("string") for c in ("left", "top", "w", "h")])
    held = boxes.groupBy("image").agg(F.array_join(F.sort_array(F.collect_list(text)), ";").alias("boxes"))
    return images.join(held, "image", "left").fillna("-1,-1,-1,-1", ["boxes"])


def box_weight(n_boxes: Column, min_box: Column) -> Column:
    """Repeats of an image: 1, 3, 5, 8 for none, one, two to three, more boxes, twice that with a small one."""
    base = F.when(n_boxes == 0, 1).when(n_boxes == 1, 3).when(n_boxes <= 3, 5).otherwise(8)
    return base * F.when(min_box < 16, 2).otherwise(1)


def clip_box(centre_x: Column, centre_y: Column, w: Column, h: Column, size: int) -> dict[str, Column]:
    """A centred box cut to the image, shrunk by the root of its visible share: left, top, width, height."""
    left, right = F.greatest(F.lit(0.0), centre_x - w / 2), F.least(F.lit(float(size)), centre_x + w / 2)
    top, bottom = F.greatest(F.lit(0.0), centre_y - h / 2), F.least(F.lit(float(size)), centre_y + h / 2)
    seen = F.greatest(F.lit(0.0), right - left) * F.greatest(F.lit(0.0), bottom - top) / (w * h)
    return {"left": left, "top": top, "width": w * F.sqrt(seen), "height": h * F.sqrt(seen)}


def visible_share(signals: DataFrame, points: int = 64) -> DataFrame:
    """Share of a Gaussian envelope's energy inside a band: root of (sum of squares inside / all) on a grid of ``points``
    over the band 0..1, for ``signals(id, centre, sigma, lo, hi)``."""
    grid = signals.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("i") / float(points - 1))
    e2 = F.exp(-F.pow((F.col("x") - F.col("centre")) / F.greatest("sigma", F.lit(1e-6)), 2))
    inside = F.when((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")), e2).otherwise(0.0)
    return grid.groupBy("id").agg(F.sqrt(F.sum(inside) / F.greatest(F.sum(e2), F.lit(1e-300))).alias("share"))


def envelope_channels(truths: DataFrame, channels: DataFrame) -> DataFrame:
    """Channels in which each truth's envelope exceeds one half: ``(injection_id, n_channels)``."""
    cells = truths.crossJoin(F.broadcast(channels.select("freq")))
    return cells.groupBy("injection_id").agg(F.count_if(F.exp(-0.5 * F.pow((F.col("freq") - F.col("center_mhz")) / F.greatest("sigma_mhz", F.lit(1e-6)), 2)) > 0.5).alias("n_channels"))


def fold_clipped(base: DataFrame, pulses: DataFrame) -> DataFrame:
    """Add ``pulses(t, ord, add)`` to ``base(t, v)`` one after the other in order, clipping to 0..255 after each."""
    held = pulses.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("ord", "add"))).alias("p"))
    step = lambda acc, p: F.least(F.greatest(acc + p["add"], F.lit(0.0)), F.lit(255.0))
    none = F.expr("cast(array() as array<struct<ord:bigint,add:double>>)")
    return base.join(held, "t", "left").select("t", F.aggregate(F.coalesce("p", none), F.col("v").cast("double"), step).alias("v"))


def ragged_pool(series: DataFrame, rate: int, keys: list[str]) -> DataFrame:
    """Means of ``rate`` samples of each series of ``keys`` (``t`` from 0, ``v``), whose ragged tail is filled up with its
    mean plus seeded noise of its spread."""
    stats = series.groupBy(*keys).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), (F.max("t") + 1).alias("n"))
    padded = stats.withColumn("id", F.explode(F.expr(f"filter(sequence(0L, {rate - 1}L), i -> i < pmod(-n, {rate}))"))).withColumn("id", F.col("id") + F.col("n"))
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 24)) / float(1 << 24)
    filled = series.select(*keys, "t", F.col("v").cast("double")).union(padded.select(*keys, "id", u * F.col("s") + F.col("m")))
    return filled.groupBy(*keys, F.expr(f"t div {rate}").alias("y")).agg(F.avg("v").alias("v"))


def column_normalised(pixels: Column, width: int) -> Column:
    """Classifier normalisation of an array of pixels, row by row: add 1, divide by each column's mean, clip at the 5 % and 95 % order
    statistics, scale to 0..1."""

    def lifted(pixels: Column) -> Column:
        """Each pixel and 1, over the mean of these in its column."""
        rows = F.call_function("div", F.size(pixels), F.lit(width)).cast("int")
        total = lambda j: F.aggregate(F.sequence(F.lit(0), rows - 1), F.lit(0.0), lambda a, i: a + F.get(pixels, i * width + j) + 1)
        means = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: total(j) / rows)
        return named(means, lambda m: F.transform(pixels, lambda v, i: (v + 1) / F.get(m, i % width)))

    return kth_clipped(named(pixels, lifted), 0.05, 0.95)


def affine_boxes(boxes: DataFrame, matrix: tuple[float, float, float, float], shift: tuple[float, float], size: int) -> DataFrame:
    """Boxes under an affine map by their corners; those whose centre leaves the frame go: ``(image, box, left, top, w, h)``."""
    a, b, c, d = matrix
    dx, dy = shift
    move = lambda x, y: (x * a + y * b + dx, x * c + y * d + dy)
    x0, y0, x1, y1 = F.col("left"), F.col("top"), F.col("left") + F.col("w"), F.col("top") + F.col("h")
    corners = [move(x, y) for x in (x0, x1) for y in (y0, y1)]
    cx, cy = move((x0 + x1) / 2, (y0 + y1) / 2)
    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
    kept = boxes.where((cx >= 0) & (cx < size) & (cy >= 0) & (cy < size))
    return kept.select("image", "box", F.least(*xs).alias("left"), F.least(*ys).alias("top"), (F.greatest(*xs) - F.least(*xs)).alias("w"), (F.greatest(*ys) - F.least(*ys)).alias("h"))


def scene_plan(scenes: DataFrame, crops: int) -> DataFrame:
    """Crop plan of ``scenes(scene, n_signals)``: for each crop a plane (full, lower, upper in 55, 22.5, 22.5 %), the signal it
    shows and the pixel it should show it at, all from hashes: ``(scene, crop, plane, signal, pixel_x, pixel_y)``."""
    spread = scenes.where("n_signals > 0").withColumn("crop", F.explode(F.sequence(F.lit(0), F.lit(crops - 1))))
    u = lambda i: F.pmod(F.xxhash64(F.lit(i), F.col("scene"), F.col("crop")), F.lit(1 << 20)) / float(1 << 20)
    plane = F.when(u(0) < 0.55, 0).when(u(0) < 0.775, 1).otherwise(2)
    return spread.select("scene", "crop", plane.alias("plane"), F.floor(u(1) * F.col("n_signals")).cast("int").alias("signal"), F.floor(u(2) * 512).cast("int").alias("pixel_x"), F.floor(u(3) * 512).cast("int").alias("pixel_y"))


def interference(image: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """An image (time, channel) with synthetic interference: each kind by its own chance."""
    out = image.astype(float).copy()
    n, m = out.shape
    level = float(np.abs(out).mean() + 1e-6)
    kinds: list[tuple[float, Callable[[], None]]] = [
        (0.3, lambda: out.__setitem__((slice(None), int(random.integers(m))), out.max() + level)),  # a steady narrow band
        (0.3, lambda: out.__setitem__((int(random.integers(n)), slice(None)), out.max() + level)),  # a broadband spike
        (0.2, lambda: out.__setitem__(slice(int(random.integers(n)), None), out[-1:] * 0)),  # a drop-out
        (0.2, lambda: out.__iadd__(level * np.sin(np.arange(n) * 2 * np.pi / max(2, n // 3))[:, None])),  # a periodic baseline
        (0.2, lambda: out.__imul__(np.linspace(0.5, 1.5, m)[None])),  # a bandpass slope
        (0.2, lambda: out.__iadd__(level * np.eye(n, m))),  # a chirp
        (0.2, lambda: out.__iadd__(level * (random.random((n, m)) < 0.02) * 5)),  # salt
        (0.2, lambda: out.__iadd__(level * random.standard_normal((n, m)) * 0.3)),  # noise
        (0.1, lambda: np.clip(out, None, np.quantile(out, 0.9), out=out)),  # saturation
    ]
    for chance, act in kinds:
        if random.random() < chance:
            act()
    return out


def with_interference(images: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Each image with interference from a generator seeded by its number: ``(image, py, px, v)``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        square = np.zeros((size, size))
        square[pdf["py"], pdf["px"]] = pdf["v"]
        noisy = interference(square, np.random.default_rng([seed, int(pdf["image"].iloc[0])]))
        return pdf.assign(v=noisy[pdf["py"], pdf["px"]])[["image", "py", "px", "v"]]

    return images.groupBy("image").applyInPandas(run, "image long, py int, px int, v double")


def score_images(images: DataFrame, model: Callable[[np.ndarray], np.ndarray], size: int, batch: int = 32) -> DataFrame:
    """Scores of ``images(image, img array<float>)`` by a batch model (n, size, size) -> (n, 2) logits: ``(image, score)``, the
    softmax of the second. The model goes to the tasks; any detector or classifier fits behind this."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                logits = model(np.stack(part["img"].to_numpy()).reshape(-1, size, size))
                e = np.exp(logits - logits.max(axis=1, keepdims=True))
                yield pd.DataFrame({"image": part["image"], "score": (e / e.sum(axis=1, keepdims=True))[:, 1]})

    return images.mapInPandas(run, "image long, score double")


def matched_filter_model(template: np.ndarray, gain: float = 4.0) -> Callable[[np.ndarray], np.ndarray]:
    """A deterministic stand-in for a network: logits from the correlation of an image with a template. Not a trained model."""

    def model(x: np.ndarray) -> np.ndarray:
        flat, t = x.reshape(len(x), -1), template.reshape(-1) - template.mean()
        flat = flat - flat.mean(axis=1, keepdims=True)
        r = flat @ t / (np.linalg.norm(flat, axis=1) * np.linalg.norm(t) + 1e-9)
        return np.stack([-gain * r, gain * r], axis=1)

    return model


def gather_images(pixels: DataFrame, size: int) -> DataFrame:
    """Long pixels to one row per image with its values in row order."""
    cells = F.array_sort(F.collect_list(F.struct((F.col("py") * size + F.col("px")).alias("i"), F.col("v").cast("double").alias("v"))))
    return pixels.groupBy("image").agg(F.transform(cells, lambda c: c["v"]).alias("img"))


def config_violations(settings: DataFrame) -> DataFrame:
    """``settings`` with ``violations array<string>``: all that is wrong with each row's search settings. Columns that are fields
    of ``SearchConfig`` set them; others, and nulls, leave the default."""
    kinds = {f.name: type(f.default) for f in fields(SearchConfig)}
    names = [c for c in settings.columns if c in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in names)) if names else [()] * batch.num_rows
            found = [SearchConfig(**{n: kinds[n](v) for n, v in zip(names, row) if v is not None}).violations() for row in rows]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, "violations"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in settings.schema)
    return settings.mapInArrow(run, f"{columns}, violations array<string>")
