"""Boxes of visible signals in detector images: response boxes from the image, physical ones as a fallback, targets for training.

Images are rows of arrays ``(image, width, height, pixels)`` (row by row), so an image and its signals are one row of work."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Local window around a signal (half width and height), and how it shrinks with the nearest other signal (fixed values).
WINDOW = (150.0, 110.0)
CLOSE, CLOSE_SHARE, CLOSE_LEAST = 180.0, (0.58, 0.50), (36.0, 30.0)
#: Blur, reach of the seed and of a component that doesn't hold it, and what a seed must stand out by (fixed values).
BLUR, SEED_REACH, COMPONENT_REACH = 1.15, 15, 28.0
CONTRAST, NOISE_SHARE, LEAST_SNR = 0.035, 1.05, 1.25
#: Threshold ladders as shares of the contrast for weak, middling and strong responses (fixed values).
LADDERS = ((0.64, 0.72, 0.80, 0.88), (0.56, 0.64, 0.74, 0.84), (0.44, 0.52, 0.62, 0.74))
#: Limits of boxes: absolute, least limit, times the physical size; with another signal near, its share of the distance (fixed values).
LIMIT, LIMIT_LEAST, LIMIT_SIZES = (230.0, 210.0), 42.0, 7.5
LIMIT_CLOSE, LIMIT_CLOSE_LEAST = (0.88, 0.78), (34.0, 30.0)
LARGEST_SHARE, OVERSIZE, ASPECT = 0.18, 1.35, (0.12, 9.0)
MARGIN, MARGIN_SHARE = 3.0, (0.05, 0.08)
OWNED = 0.92


def blurred(image: np.ndarray, sigma: float = BLUR) -> np.ndarray:
    """Gaussian blur, one axis after the other, over four sigmas to both sides; edges are mirrored."""
    reach = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    out = np.asarray(image, np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        out = np.tensordot(np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis), weights, 1)
    return out


def closed(image: np.ndarray) -> np.ndarray:
    """Grey closing by a window of 2 x 3 pixels, nothing outside the image. Its pixels at or above a threshold are those
    of the binary closing at that threshold, for every threshold at once."""

    def moved(a: np.ndarray, rows: tuple[int, int], best) -> np.ndarray:
        padded = np.pad(a, 1, constant_values=-np.inf)
        h, w = a.shape
        return best.reduce([padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in rows for dx in (-1, 0, 1)])

    return moved(moved(image, (0, 1), np.maximum), (-1, 0), np.minimum)


class ComponentTree:
    """The 4-connected components of all upper level sets of an image down to ``least`` (a max-tree).

    Pixels join in order of falling value; a pixel takes over the components that it touches. So each pixel stands for
    the component that it completes, with its size, extent, first pixel and least squared distance to ``point`` (x, y)."""

    def __init__(self, image: np.ndarray, least: float, point: tuple[int, int]):
        height, width = image.shape
        flat = image.ravel()
        order = np.flatnonzero(flat >= least)
        order = order[np.argsort(-flat[order], kind="stable")]
        self.values = flat[order]
        self.place = {p: i for i, p in enumerate(order.tolist())}
        y, x = np.divmod(order, width)
        columns = (np.ones(len(order), np.int64), x, x, y, y, order, (x - point[0]) ** 2 + (y - point[1]) ** 2)
        size, x0, x1, y0, y1, first, near = (c.tolist() for c in columns)
        up, root = [-1] * len(order), list(range(len(order)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, p in enumerate(order.tolist()):
            px = p % width
            for q in (p - width, p + width, p - 1 if px else -1, p + 1 if px + 1 < width else -1):
                j = self.place.get(q, i)
                if j < i and (r := top(j)) != i:
                    up[r] = root[r] = i
                    size[i] += size[r]
                    x0[i], x1[i], y0[i], y1[i] = min(x0[i], x0[r]), max(x1[i], x1[r]), min(y0[i], y0[r]), max(y1[i], y1[r])
                    first[i], near[i] = min(first[i], first[r]), min(near[i], near[r])
        self.up = np.array(up, np.int64)
        self.size, self.x0, self.x1, self.y0, self.y1, self.first, self.near = (np.array(c, np.int64) for c in (size, x0, x1, y0, y1, first, near))

    def holding(self, pixel: int, threshold: float) -> int:
        """The component at ``threshold`` with a pixel in it; -1 if it lies below."""
        i = self.place.get(pixel, -1)
        if i < 0 or self.values[i] < threshold:
            return -1
        while self.up[i] >= 0 and self.values[self.up[i]] >= threshold:
            i = int(self.up[i])
        return i

    def nearest(self, threshold: float, reach: float, least_size: int = 3) -> int:
        """The component at ``threshold`` nearest to the point, larger ones slightly preferred; -1 if none is in reach."""
        above = self.values >= threshold
        whole = above & ((self.up < 0) | (self.values[self.up] < threshold)) & (self.size >= least_size) & (self.near <= reach * reach)
        found = np.flatnonzero(whole)
        if not len(found):
            return -1
        score = np.sqrt(self.near[found]) - 0.01 * np.sqrt(self.size[found])
        return int(found[np.lexsort((self.first[found], score))[0]])


@dataclass(frozen=True)
class Signal:
    cx: float
    cy: float
    snr: float  # as visible in the image
    least: tuple[float, float]  # physical width and height


def _window(centre: float, half: float, size: int) -> tuple[int, int]:
    return max(0, int(np.floor(centre - half))), min(size, int(np.ceil(centre + half + 1)))


def owned(shape: tuple[int, int], corner: tuple[int, int], centre: tuple[float, float], others: list[tuple[float, float]]) -> np.ndarray:
    """Pixels that are nearer to ``centre`` than to any other one, by a margin."""
    y, x = np.indices(shape, dtype=np.float64)
    distance = lambda c: (x + corner[0] - c[0]) ** 2 + (y + corner[1] - c[1]) ** 2
    out = np.ones(shape, bool)
    for other in others:
        out &= distance(centre) <= OWNED * distance(other)
    return out


def _extent(low: float, high: float, margin: float, size: int) -> float:
    """Length of an extent with its margins inside the image, at least one pixel."""
    low, high = min(max(low - margin, 0.0), size - 1.0), min(max(high + margin, 1.0), float(size))
    return max(high - low, 1.0)


def response_size(image: np.ndarray, signal: Signal, others: list[tuple[float, float]]) -> tuple[float, float] | None:
    """Width and height of the bright response around a signal's centre; None if nothing stands out there.

    A seed is the brightest pixel of the blurred local window near the centre. Thresholds rise along a ladder of shares of
    its contrast to the window's border; the first one whose component is neither too large nor too long gives the size."""
    height, width = image.shape
    nearest = min((float(np.hypot(signal.cx - x, signal.cy - y)) for x, y in others), default=np.inf)
    half = WINDOW if nearest >= CLOSE else tuple(max(least, min(most, share * nearest)) for least, most, share in zip(CLOSE_LEAST, WINDOW, CLOSE_SHARE))
    (x0, x1), (y0, y1) = _window(signal.cx, half[0], width), _window(signal.cy, half[1], height)
    if x1 <= x0 or y1 <= y0:
        return None
    smooth = blurred(image[y0:y1, x0:x1])
    h, w = smooth.shape
    sx, sy = (int(np.clip(np.rint(c) - o, 0, n - 1)) for c, o, n in ((signal.cx, x0, w), (signal.cy, y0, h)))
    left, top = max(0, sx - SEED_REACH), max(0, sy - SEED_REACH)
    near = smooth[top : sy + SEED_REACH + 1, left : sx + SEED_REACH + 1]
    dy, dx = np.unravel_index(int(near.argmax()), near.shape)
    seed = (top + int(dy)) * w + left + int(dx)

    edge = max(1, min(h, w) // 8)
    border = np.concatenate([smooth[:edge].ravel(), smooth[-edge:].ravel(), smooth[:, :edge].ravel(), smooth[:, -edge:].ravel()])
    middle, p85, p90 = np.percentile(border, (50, 85, 90))
    contrast, noise = smooth.flat[seed] - middle, max(p90 - middle, 1e-4)
    snr = contrast / noise
    if contrast < max(CONTRAST, NOISE_SHARE * noise) or snr < LEAST_SNR:
        return None

    ladder = LADDERS[0 if snr < 2.2 or signal.snr < 3 else 1 if snr < 4 or signal.snr < 8 else 2]
    most = [min(a, max(LIMIT_LEAST, LIMIT_SIZES * s)) for a, s in zip(LIMIT, signal.least)]
    if np.isfinite(nearest):
        most = [min(m, max(least, share * nearest)) for m, least, share in zip(most, LIMIT_CLOSE_LEAST, LIMIT_CLOSE)]
    floor = max(p85, p90) if snr < 2.2 else p85
    thresholds = [max(floor, middle + share * contrast) for share in ladder]
    mine = np.where(owned((h, w), (x0, y0), (signal.cx, signal.cy), others), smooth, -np.inf)
    tree = ComponentTree(closed(mine), thresholds[0], (sx, sy))
    for step, threshold in enumerate(thresholds):
        c = tree.holding(seed, threshold)
        c = tree.nearest(threshold, COMPONENT_REACH) if c < 0 else c
        if c < 0:
            continue
        long, tall = float(tree.x1[c] - tree.x0[c] + 1), float(tree.y1[c] - tree.y0[c] + 1)
        if tree.size[c] > LARGEST_SHARE * h * w and step + 1 < len(thresholds):
            continue
        if long > OVERSIZE * most[0] or tall > OVERSIZE * most[1] or not ASPECT[0] <= long / tall <= ASPECT[1]:
            continue
        measured = (
            _extent(float(tree.x0[c]) + x0, float(tree.x1[c]) + x0 + 1, max(MARGIN, MARGIN_SHARE[0] * long), width),
            _extent(float(tree.y0[c]) + y0, float(tree.y1[c]) + y0 + 1, max(MARGIN, MARGIN_SHARE[1] * tall), height),
        )
        return tuple(min(max(m, s, 2.0), limit) for m, s, limit in zip(measured, signal.least, most))
    return None


#: Share of a signal that must be visible, least physical box, and the share from which a box is not shrunk (fixed values).
LEAST_VISIBLE, FALLBACK_SIZE, WHOLE = 0.04, 18.0, 0.98


def visible_share(centre: Column, sigma: Column, half: Column, low: float, high: float, points: int = 1024) -> Column:
    """Root of the share of a Gaussian envelope's energy in half 1 (lower) or 2 (upper) of the band ``low..high``, on an
    even grid, the middle counted in both; 1 for any other half."""
    step = (high - low) / (points - 1)
    middle = 0.5 * (low + high)
    energy = lambda i: F.exp(-F.pow((F.lit(low) + i * F.lit(step) - centre) / F.greatest(sigma, F.lit(1e-6)), 2))
    grid = F.sequence(F.lit(0), F.lit(points - 1))
    inside = lambda i: F.when(half == 1, F.lit(low) + i * F.lit(step) <= middle).otherwise(F.lit(low) + i * F.lit(step) >= middle)
    both = F.aggregate(
        grid, F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("own")),
        lambda s, i: F.struct((s["all"] + energy(i)).alias("all"), (s["own"] + F.when(inside(i), energy(i)).otherwise(0.0)).alias("own")),
        lambda s: F.when(s["all"] > 0, F.sqrt(s["own"] / s["all"])).otherwise(0.0),
    )
    return F.when(half.isin(1, 2), both).otherwise(1.0)


def _boxed(least_snr: float, fallback_snr: float):
    """The signals that each image shows, with their squared distance from the owner (-1 for itself) and their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                name, width, height, signals = (batch.column(c)[i].as_py() for c in ("image", "width", "height", "signals"))
                image = batch.column("pixels")[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(height, width)
                owner = next((s for s in signals if s["owner"]), None)
                seen = [s | {"effective": s["snr"] * s["visible"]} for s in signals if 0 <= s["cx"] < width and 0 <= s["cy"] < height and s["visible"] >= LEAST_VISIBLE and s["snr"] * s["visible"] >= least_snr]
                for s in seen:
                    others = [(o["cx"], o["cy"]) for o in seen if o["signal"] != s["signal"]]
                    least = (s["least_width"], s["least_height"])
                    size = response_size(image, Signal(s["cx"], s["cy"], s["effective"], least), others)
                    if size is None and s["effective"] < fallback_snr:
                        continue
                    scale = 1.0 if s["visible"] >= WHOLE else min(max(0.55 + 0.45 * np.sqrt(s["visible"]), 0.55), 1.0)
                    w, h = (max(1.0, max(1.0, x) * scale) for x in size or (max(x, FALLBACK_SIZE) for x in least))
                    apart = -1.0 if s["owner"] else 0.0 if owner is None else (s["cx"] - owner["cx"]) ** 2 + (s["cy"] - owner["cy"]) ** 2
                    rows.append((name, s["signal"], apart, s["cx"] - w / 2, s["cy"] - h / 2, w, h, size is not None))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [batch.schema.field("image").type, pa.int64(), *[pa.float64()] * 5, pa.bool_()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["image", "signal", "apart", "left", "top", "width", "height", "from_response"])

    return run


def annotate(images: DataFrame, signals: DataFrame, least_snr: float, fallback_snr: float, max_objects: int) -> DataFrame:
    """``(image, rank, signal, left, top, width, height, from_response)``: boxes of the signals in each image's own crop.

    ``images(image, width, height, pixels array<double>)``; ``signals(image, signal, owner boolean, cx, cy, snr, visible,
    least_width, least_height)`` with centres in pixels and ``visible``, the share of the signal that the image shows. A
    signal counts if its centre lies in the image, ``visible`` is 0.04 or more and ``snr * visible`` is ``least_snr`` or
    more. Its size is that of the response; without one, signals of ``fallback_snr`` or more get their physical size.
    Boxes are centred on the signal (they may reach out of the image) and shrink with the visible share. The owner of
    the crop comes first, then the signals nearest to it, ``max_objects`` at most.

    Signals with a null in any of their columns and signals of unknown images are left out, as are images without signals;
    repeated signals of an image (by number) are one. One row holds an image and its signals (as many as its scene plan
    has); the cap is taken in each task before the shuffle and again behind it.
    """
    cells = ("cx", "cy", "snr", "visible", "least_width", "least_height")
    known = signals.select("image", F.col("signal").cast("long").alias("signal"), F.col("owner").cast("boolean").alias("owner"), *(F.col(c).cast("double").alias(c) for c in cells)).dropna()
    one = known.groupBy("image", "signal").agg(F.min(F.struct("owner", *cells)).alias("s"))
    listed = one.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("signal", "s.*"))).alias("signals"))
    kind = images.schema["image"].dataType.simpleString()
    boxes = images.select("image", "width", "height", "pixels").join(listed, "image").mapInArrow(_boxed(least_snr, fallback_snr), f"image {kind}, signal long, apart double, left double, top double, width double, height double, from_response boolean")
    rank = F.row_number().over(Window.partitionBy("image").orderBy("apart", "signal"))
    return boxes.withColumn("rank", rank).where(F.col("rank") <= max_objects).select("image", "rank", "signal", "left", "top", "width", "height", "from_response")


def adaptive_radius(width: Column, height: Column, overlap: float = 0.7) -> Column:
    """The largest radius by which a box of this size may be shifted, shrunk or grown at its corners and still overlap its
    original by ``overlap`` (intersection over union): the least root of the three cases, not below 0."""
    around, area = width + height, width * height
    root = lambda b, ac: F.sqrt(F.greatest(b * b - 4 * ac, F.lit(0.0)))
    shifted_area = area * ((1 - overlap) / (1 + overlap))
    shifted = (around - root(around, shifted_area)) / 2
    shrunk = (2 * around - root(2 * around, 4 * area * (1 - overlap))) / 8
    grown_b = around * (-2 * overlap)
    grown = (grown_b + root(grown_b, area * (4 * overlap * (overlap - 1)))) / (8 * overlap)
    return F.greatest(F.least(shifted, shrunk, grown), F.lit(0.0))


def centre_targets(boxes: DataFrame, size: int, stride: int = 4, max_objects: int = 128, least_radius: int = 3) -> DataFrame:
    """``(image, slot, box, cell, dx, dy, radius)``: the targets of ``boxes(image, box, left, top, width, height)``.

    Centres are on a grid of ``size`` cells, ``stride`` pixels each; ``cell`` is row * size + column, ``dx`` and ``dy`` the
    rest. Boxes with a null or with their centre outside are no targets; of the others the first ``max_objects`` by ``box``
    (then by place and size) are, in this order (``slot`` from 0)."""
    cx, cy = ((F.col(a) + F.col(b) / 2.0) / stride for a, b in (("left", "width"), ("top", "height")))
    inside = (F.col("cx") >= 0) & (F.col("cx") < size) & (F.col("cy") >= 0) & (F.col("cy") < size)
    placed = boxes.select("image", "box", cx.alias("cx"), cy.alias("cy"), *(F.greatest(F.col(c) / stride, F.lit(1.0)).alias(c) for c in ("width", "height"))).dropna().where(inside)
    slot = F.row_number().over(Window.partitionBy("image").orderBy("box", "cx", "cy", "width", "height")) - 1
    kept = placed.withColumn("slot", slot).where(F.col("slot") < max_objects)
    x, y = F.floor("cx").cast("int"), F.floor("cy").cast("int")
    radius = F.greatest(F.bround(adaptive_radius(F.col("width"), F.col("height"))).cast("int"), F.lit(least_radius))
    return kept.select("image", "slot", "box", (y * size + x).alias("cell"), (F.col("cx") - x).alias("dx"), (F.col("cy") - y).alias("dy"), radius.alias("radius"))


def stamped(targets: DataFrame, size: int) -> DataFrame:
    """``(image, py, px, target)``: the non-zero cells of the target maps of ``targets(image, cell, radius)``.

    A target stamps a Gaussian of a sixth of its diameter over its own neighbourhood only; cells keep the largest stamp.
    The targets of an image come together in one row, from which its cells are made, so that cells are not shuffled."""
    x, y = F.col("cell") % size, F.call_function("div", F.col("cell"), F.lit(size)).cast("int")
    images = targets.select("image", F.struct("radius", x.alias("x"), y.alias("y")).alias("s")).dropna(subset=["s.radius", "s.x", "s.y"]).groupBy("image").agg(F.collect_list("s").alias("stamps"))

    def reach(axis: str):
        return lambda s: F.sequence(F.greatest(F.lit(0), s[axis] - s["radius"]), F.least(F.lit(size - 1), s[axis] + s["radius"]))

    rows = images.withColumn("py", F.explode(F.array_distinct(F.flatten(F.transform("stamps", reach("y"))))))
    rows = rows.withColumn("stamps", F.filter("stamps", lambda s: F.abs(F.col("py") - s["y"]) <= s["radius"]))
    cells = rows.withColumn("px", F.explode(F.array_distinct(F.flatten(F.transform("stamps", reach("x"))))))

    def height(s: Column) -> Column:
        sigma = (2 * s["radius"] + 1) / 6.0
        return F.when(F.abs(F.col("px") - s["x"]) <= s["radius"], F.exp(-(F.pow(F.col("px") - s["x"], 2) + F.pow(F.col("py") - s["y"], 2)) / (2 * sigma * sigma)))

    tiny = float(np.finfo(np.float64).eps)
    return cells.select("image", "py", "px", F.array_max(F.transform("stamps", height)).alias("target")).where(F.col("target") >= tiny)
