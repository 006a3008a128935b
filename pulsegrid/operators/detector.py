"""Detectors as table-valued functions: any model that turns images into scored boxes, loaded once for each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: (scores, boxes) of an image; a box is left, top, width, height.
Found = tuple[np.ndarray, np.ndarray]


class Detector(Protocol):
    def __call__(self, images: np.ndarray) -> Any:
        """Raw output for a stack of images of one size."""

    def decode(self, raw: Any, conf: float, iou: float) -> list[Found]:
        """Scored boxes of each image: scores above ``conf``; of boxes that overlap by more than ``iou`` the strongest."""


_LOADED: dict[str, Detector] = {}


def loaded(name: str, load: Callable[[], Detector]) -> Detector:
    """The detector of that name in this worker; ``load`` runs the first time only."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def overlap(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Intersection over union of a box with others; 0 where both are empty."""
    low, high = np.maximum(box[:2], others[:, :2]), np.minimum(box[:2] + box[2:], others[:, :2] + others[:, 2:])
    shared = np.prod(np.maximum(high - low, 0), axis=1)
    whole = box[2] * box[3] + others[:, 2] * others[:, 3] - shared
    return np.divide(shared, whole, out=np.zeros(len(others)), where=whole > 0)


def strongest(scores: np.ndarray, boxes: np.ndarray, iou: float) -> np.ndarray:
    """Places of the boxes that stay when each, in the given order, takes away those it overlaps by more than ``iou``."""
    kept: list[int] = []
    for i in range(len(scores)):
        if not kept or not (overlap(boxes[i], boxes[kept]) > iou).any():
            kept.append(i)
    return np.array(kept, np.int64)


class PeakDetector:
    """Boxes around the brightest local maxima: pixels that equal the largest of their 3 x 3 surroundings, ``most`` an image,
    refined by offsets that ``offset`` reads from the pixel values, ``stride`` pixels to a cell, ``size`` wide and high."""

    def __init__(self, most: int, stride: float, size: float, offset: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]):
        self.most, self.stride, self.size, self.offset = most, stride, size, offset

    def __call__(self, images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.pad(images, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
        around = np.lib.stride_tricks.sliding_window_view(padded, (3, 3), (1, 2)).max((3, 4))
        return images, images == around

    def decode(self, raw: tuple[np.ndarray, np.ndarray], conf: float, iou: float) -> list[Found]:
        out = []
        for image, peak in zip(*raw):
            y, x = np.nonzero(peak & (image > conf))
            order = np.lexsort((x, y, -image[y, x]))[: self.most]
            y, x = y[order], x[order]
            scores = image[y, x]
            dx, dy = self.offset(scores)
            centres = np.stack([x + dx, y + dy], 1) * self.stride
            boxes = np.concatenate([centres - self.size / 2, np.full_like(centres, self.size)], 1)
            kept = strongest(scores, boxes, iou)
            out.append((scores[kept], boxes[kept]))
        return out


def detect(images: DataFrame, name: str, load: Callable[[], Detector], conf: float, iou: float, batch: int = 16) -> DataFrame:
    """``(image, rank, score, left, top, width, height)`` of ``images(image, width, height, pixels array<double>)``, ranks from 1
    in the order in which the detector gives its boxes.

    ``load`` makes the detector in a worker, once for all its tasks; ``name`` tells detectors apart. Images of one size go to
    it ``batch`` at a time. Images without pixels have no boxes."""
    kind = images.schema["image"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(name, load)
        for rows in batches:
            sizes = list(zip(rows.column("height").to_pylist(), rows.column("width").to_pylist()))
            groups: dict[tuple, list[int]] = {}
            for i, size in enumerate(sizes):
                if rows.column("pixels")[i].is_valid and all(size):
                    groups.setdefault(size, []).append(i)
            found: dict[int, Found] = {}
            for (h, w), members in groups.items():
                for at in range(0, len(members), batch):
                    some = members[at : at + batch]
                    stack = np.stack([rows.column("pixels")[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(h, w) for i in some])
                    found |= zip(some, model.decode(model(stack), conf, iou))
            each = [len(found[i][0]) if i in found else 0 for i in range(len(sizes))]
            names = rows.column("image").take(pa.array(np.repeat(np.arange(len(sizes)), each)))
            ranks = pa.array(np.concatenate([np.arange(1, n + 1) for n in each] or [[]]), pa.int32())
            cells = np.concatenate([np.column_stack(found[i]) for i in sorted(found)] or [np.zeros((0, 5))])
            yield pa.record_batch([names, ranks, *(pa.array(c, pa.float64()) for c in cells.T)], names=["image", "rank", "score", "left", "top", "width", "height"])

    return images.select("image", "width", "height", "pixels").mapInArrow(run, f"image {kind}, rank int, score double, left double, top double, width double, height double")
