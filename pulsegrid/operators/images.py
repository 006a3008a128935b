"""Operators on images in long form ``(image, py, px, v)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_index(n: Column, share: float) -> Column:
    """k of the k-th smallest value at a share of n: rounded half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(n * share).cast("int"))


def by_rows(images: DataFrame, scaled: Column) -> DataFrame:
    """Long pixels ``(image, py, px, v)`` as one row an image, and back with ``scaled``, an expression over their values ``pixels``:
    ``(image, py, px, scaled)``. An image is a row of its pixels (a detector's has 512 x 512)."""
    cells = images.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("py", "px", "v"))).alias("cells")).withColumn("pixels", F.transform("cells", lambda c: c["v"]))
    out = cells.select("image", F.inline(F.arrays_zip(F.transform("cells", lambda c: c["py"]).alias("py"), F.transform("cells", lambda c: c["px"]).alias("px"), scaled.alias("scaled"))))
    return out.toDF("image", "py", "px", "scaled")


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, also where ``use`` takes it for every element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _clipped(pixels: Column, bounds: Callable[[Column], tuple[Column, Column]]) -> Column:
    """Pixels cut at two values that ``bounds`` takes from them in order, which lie among or between them and so are the least
    and the largest then, scaled to 0..1."""

    def cut(pixels: Column) -> Column:
        pair = named(F.array_sort(pixels), lambda ordered: F.struct(*(x.alias(n) for x, n in zip(bounds(ordered), ("lo", "hi")))))
        return named(pair, lambda b: F.transform(pixels, lambda v: (F.least(F.greatest(v, b["lo"]), b["hi"]) - b["lo"]) / (b["hi"] - b["lo"] + 1e-8)))

    return named(pixels, cut)


def kth_clipped(pixels: Column, low: float = 0.010, high: float = 0.995) -> Column:
    """An array of pixels clipped at its k-th smallest values, then scaled to 0..1 with 1e-8 added to the range."""
    return _clipped(pixels, lambda ordered: tuple(F.get(ordered, order_index(F.size(ordered), share) - 1) for share in (low, high)))


def percentile_clipped(pixels: Column, low: float = 0.05, high: float = 0.95) -> Column:
    """As ``kth_clipped`` with linearly interpolated percentiles."""

    def at(ordered: Column, share: float) -> Column:
        place = (F.size(ordered) - 1) * F.lit(share)
        a, b = F.get(ordered, F.floor(place).cast("int")), F.get(ordered, F.ceil(place).cast("int"))
        return a + (b - a) * (place - F.floor(place))

    return _clipped(F.transform(pixels, lambda v: v.cast("double")), lambda ordered: (at(ordered, low), at(ordered, high)))


def kth_clip_minmax(images: DataFrame, low: float = 0.010, high: float = 0.995) -> DataFrame:
    """``kth_clipped`` of long pixels: ``(image, py, px, scaled)``."""
    return by_rows(images, kth_clipped(F.col("pixels"), low, high))


def percentile_clip_minmax(images: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``percentile_clipped`` of long pixels: ``(image, py, px, scaled)``."""
    return by_rows(images, percentile_clipped(F.col("pixels"), low, high))


def peaks(images: DataFrame, least: int) -> DataFrame:
    """Pixels above ``least`` that equal the largest value of their 3 x 3 surroundings (ties all stay)."""
    row = Window.partitionBy("image", "py").orderBy("px").rangeBetween(-1, 1)
    column = Window.partitionBy("image", "px").orderBy("py").rangeBetween(-1, 1)
    wide = images.withColumn("r", F.max("v").over(row)).withColumn("m", F.max("r").over(column))
    return wide.where((F.col("v") == F.col("m")) & (F.col("v") > least)).select("image", "py", "px", "v")


def top_pixels(images: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest pixels of each image with their rank; ties by row, then column."""
    rank = F.row_number().over(Window.partitionBy("image").orderBy(F.desc("v"), "py", "px"))
    return images.withColumn("rank", rank).where(F.col("rank") <= k)


def decode_centres(top: DataFrame, offsets: DataFrame, stride: int = 4) -> DataFrame:
    """Centres ``(x + dx) * stride, (y + dy) * stride`` of peaks with the offsets ``(image, py, px, dx, dy)`` at their pixel."""
    found = top.join(offsets, ["image", "py", "px"])
    return found.select("image", "rank", F.col("v").alias("score"), ((F.col("px") + F.col("dx")) * stride).alias("cx"), ((F.col("py") + F.col("dy")) * stride).alias("cy"))


def to_physical(centres: DataFrame, dm_per_pixel: float, dm_span: int, dm_scale: float, dm_offset: float, time_pool: int, block: int, n_chunks: int, dm_threshold: float, score_threshold: int) -> DataFrame:
    """Centres to DM and arrival sample. Coordinates are first cut to integers; the plane and DM chunk come from the image
    number; scores must exceed their threshold and DMs theirs."""
    plane, chunk = F.expr(f"(image div {n_chunks}) % 3"), F.col("image") % n_chunks
    cx, cy = F.col("cx").cast("int"), F.col("cy").cast("int")
    out = centres.where(F.col("score") > score_threshold).select(
        "image", "rank", plane.cast("int").alias("plane"), chunk.cast("int").alias("dm_chunk"), ((cy * dm_per_pixel + chunk * dm_span) * dm_scale + dm_offset).alias("dm"),
        (cx * time_pool + F.expr(f"image div {3 * n_chunks}") * block).cast("long").alias("toa"),
    )
    return out.where(F.col("dm") > dm_threshold)


def gaussian_targets(centres: DataFrame, size: int, sigma: float) -> DataFrame:
    """Target maps: at each pixel the largest Gaussian of the image's centres ``(image, cx, cy)``: ``(image, py, px, target)``."""
    grid = centres.withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    dx, dy = F.col("px") - F.col("cx"), F.col("py") - F.col("cy")
    return grid.groupBy("image", "py", "px").agg(F.max(F.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))).alias("target"))


def mixup_max(images: DataFrame) -> DataFrame:
    """Pixel maxima of image pairs 2k and 2k + 1: ``(pair, py, px, v)``."""
    return images.groupBy(F.expr("image div 2").alias("pair"), "py", "px").agg(F.max("v").alias("v"))


def mosaic_pool(images: DataFrame) -> DataFrame:
    """Mosaics of images 4k to 4k + 3 in quarters, each image pooled by two: ``(mosaic, py, px, total, n)``."""
    tile = F.col("image") % 4
    py, px = F.expr("py div 2") + F.expr("(image % 4) div 2") * 4, F.expr("px div 2") + (tile % 2) * 4
    return images.groupBy(F.expr("image div 4").alias("mosaic"), py.cast("int").alias("py"), px.cast("int").alias("px")).agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def _tile(rows: int, cols: int) -> tuple[Column, Column, Column]:
    """Mosaic of an image number, and the row and column of its tile there."""
    tile = F.col("image") % (rows * cols)
    return F.call_function("div", F.col("image"), F.lit(rows * cols)).alias("mosaic"), F.call_function("div", tile, F.lit(cols)), tile % cols


def mosaic_grid(images: DataFrame, rows: int, cols: int, size: int) -> DataFrame:
    """Mosaics of ``rows`` x ``cols`` neighbouring images of ``size`` pixels, whole ones side by side, mean-pooled back to ``size``
    pixels: ``(mosaic, py, px, v)``. Missing images are zeros."""
    mosaic, r, c = _tile(rows, cols)
    py, px = F.call_function("div", r * size + F.col("py"), F.lit(rows)), F.call_function("div", c * size + F.col("px"), F.lit(cols))
    return images.groupBy(mosaic, py.cast("int").alias("py"), px.cast("int").alias("px")).agg((F.sum("v") / (rows * cols)).alias("v"))


def mosaic_boxes(boxes: DataFrame, rows: int, cols: int, size: int) -> DataFrame:
    """``boxes(image, left, top, width, height, ...)`` in the mosaics of ``mosaic_grid``: moved to their tile and shrunk with it,
    not cut where they reach out of it. Other columns stay; ``image`` gives way to ``mosaic``."""
    mosaic, r, c = _tile(rows, cols)
    moved = {"left": (F.col("left") + c * size) / cols, "top": (F.col("top") + r * size) / rows, "width": F.col("width") / cols, "height": F.col("height") / rows}
    return boxes.select(mosaic, *(moved.get(x, F.col(x)).alias(x) for x in boxes.columns if x != "image"))


def area_resample(images: DataFrame, source: int, target: int) -> DataFrame:
    """Area resampling of square images from ``source`` to ``target`` pixels: each target pixel sums the source pixels
    from floor(i * source / target) to ceil((i + 1) * source / target): ``(image, py, px, total, n)``."""

    def owners(axis: str) -> Column:
        low = F.expr(f"greatest(0, ({axis} * {target}) div {source} - 1)")
        high = F.expr(f"least({target - 1}, (({axis} + 1) * {target} - 1) div {source} + 1)")
        spread = F.sequence(low.cast("int"), high.cast("int"))
        return F.filter(spread, lambda i: (F.col(axis) >= F.floor(i * source / target)) & (F.col(axis) < F.ceil((i + 1) * source / target)))

    spread = images.withColumn("ty", F.explode(owners("py"))).withColumn("tx", F.explode(owners("px")))
    return spread.groupBy("image", F.col("ty").alias("py"), F.col("tx").alias("px")).agg(F.sum("v").alias("total"), F.count("*").alias("n"))
