"""Response boxes, scene annotations and centre targets."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.operators import labelling as L


def flooded(mask):
    """Components of a mask, each a set of (y, x), by the first pixel."""
    left, out = {tuple(map(int, p)) for p in zip(*np.nonzero(mask))}, []
    for start in sorted(left):
        if start in left:
            left.discard(start)
            queue, found = [start], {start}
            while queue:
                y, x = queue.pop()
                for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if q in left:
                        left.discard(q)
                        found.add(q)
                        queue.append(q)
            out.append(found)
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(1, 9))
def test_one_tree_answers_every_threshold(seed, h, w):
    image = np.random.default_rng(seed).integers(0, 6, (h, w)).astype(float)
    point = (seed % w, seed // 7 % h)
    tree = L.ComponentTree(image, 1.0, point)
    for t in (1.0, 2.0, 3.5, 5.0, 6.0):
        parts = flooded(image >= t)
        for part in parts:
            y, x = next(iter(part))
            c = tree.holding(y * w + x, t)
            ys, xs = zip(*part)
            assert (tree.size[c], tree.x0[c], tree.x1[c], tree.y0[c], tree.y1[c]) == (len(part), min(xs), max(xs), min(ys), max(ys))
        assert all(tree.holding(y * w + x, t) == -1 for y, x in zip(*np.nonzero(image < t)))
        near = [(min((x - point[0]) ** 2 + (y - point[1]) ** 2 for y, x in p), p) for p in parts if len(p) >= 3]
        near = sorted((np.sqrt(d) - 0.01 * np.sqrt(len(p)), min(p), len(p)) for d, p in near if d <= 16)
        c = tree.nearest(t, 4.0)
        assert (c >= 0) == bool(near) and (not near or tree.size[c] == near[0][2])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_grey_closing_is_the_binary_one_at_every_threshold(seed):
    image = np.random.default_rng(seed).integers(0, 4, (6, 7)).astype(float)

    def binary(mask):
        h, w = mask.shape
        at = lambda m, y, x: 0 <= y < h and 0 <= x < w and m[y, x]
        wide = np.array([[any(at(mask, y + a, x + b) for a in (0, 1) for b in (-1, 0, 1)) for x in range(w)] for y in range(h)])
        return np.array([[all(at(wide, y + a, x + b) for a in (-1, 0) for b in (-1, 0, 1)) for x in range(w)] for y in range(h)])

    for t in (1, 2, 3):
        assert ((L.closed(image) >= t) == binary(image >= t)).all()


def blob(size=128, at=(60.0, 70.0), widths=(9.0, 6.0), noise=0.02, seed=0):
    y, x = np.indices((size, size))
    return np.random.default_rng(seed).normal(0, noise, (size, size)) + np.exp(-0.5 * ((x - at[0]) / widths[0]) ** 2 - 0.5 * ((y - at[1]) / widths[1]) ** 2)


def test_response_size_follows_the_blob():
    small, large = (L.response_size(blob(widths=w), L.Signal(61, 69, 20, (10, 10)), []) for w in ((5, 4), (12, 9)))
    assert small[0] < large[0] and small[1] < large[1] and 12 < small[0] < 26 and 25 < large[0] < 50
    assert L.response_size(blob(), L.Signal(61, 69, 20, (30.0, 28.0)), [])[1] == 28.0  # not below the physical size
    assert L.response_size(np.zeros((40, 40)), L.Signal(20, 20, 20, (10, 10)), []) is None
    assert L.response_size(blob(), L.Signal(10, 10, 20, (10, 10)), []) is None  # nothing stands out there
    near = L.response_size(blob(widths=(20, 15)), L.Signal(60, 70, 20, (10, 10)), [(80.0, 70.0)])
    alone = L.response_size(blob(widths=(20, 15)), L.Signal(60, 70, 20, (10, 10)), [])
    assert near is None or near[0] < alone[0]  # pixels nearer to another signal don't count


def test_annotations_with_odd_rows(spark):
    image = blob().ravel().tolist()
    images = spark.createDataFrame([(1, 128, 128, image, "x"), (2, 128, 128, [0.0] * 128**2, "x"), (3, 128, 128, image, "x")], "image long, width int, height int, pixels array<double>, signal string")
    rows = [
        (1, 1, False, 61.0, 69.0, 20.0, 1.0, 10.0, 10.0), (1, 1, False, 61.0, 69.0, 20.0, 1.0, 10.0, 10.0), (1, 2, True, 20.0, 20.0, 30.0, 0.25, 40.0, 8.0), (1, 3, False, 30.0, 20.0, 30.0, 1.0, 8.0, 8.0),
        (1, 4, False, 200.0, 20.0, 30.0, 1.0, 8.0, 8.0), (1, 5, False, 20.0, 30.0, 30.0, 0.01, 8.0, 8.0), (1, 6, None, 20.0, 30.0, 30.0, 1.0, 8.0, 8.0), (1, None, True, 20.0, 30.0, 30.0, 1.0, 8.0, 8.0),
        (2, 1, True, 50.0, 50.0, 6.0, 1.0, 8.0, 8.0), (9, 1, True, 50.0, 50.0, 60.0, 1.0, 8.0, 8.0),
    ]
    signals = spark.createDataFrame(rows, "image long, signal long, owner boolean, cx double, cy double, snr double, visible double, least_width double, least_height double")
    got = {(r.image, r["rank"]): r for r in L.annotate(images, signals, 2.0, 7.0, 3).collect()}
    assert [(k, r.signal, r.from_response) for k, r in sorted(got.items())] == [((1, 1), 2, False), ((1, 2), 3, False), ((1, 3), 1, True)]
    scale = 0.55 + 0.45 * 0.5
    assert (got[1, 1].width, got[1, 1].height, got[1, 1].left) == pytest.approx((40 * scale, 18 * scale, 20 - 20 * scale))
    assert got[1, 3].left + got[1, 3].width / 2 == pytest.approx(61.0)
    assert L.annotate(images, signals, 2.0, 7.0, 1).count() == 1
    assert L.annotate(images.limit(0), signals, 2.0, 7.0, 3).count() == 0 == L.annotate(images, signals.limit(0), 2.0, 7.0, 3).count()


def test_adaptive_radius_keeps_the_overlap(spark):
    rows = spark.createDataFrame([(float(w), float(h)) for w in (1, 5, 17, 60) for h in (1, 8, 33)], "w double, h double")
    for r in rows.withColumn("r", L.adaptive_radius(F.col("w"), F.col("h"))).collect():
        area = r.w * r.h
        shifted = (r.w - r.r) * (r.h - r.r)
        assert shifted / (2 * area - shifted) >= 0.7 - 1e-9
        assert (r.w - 2 * r.r) * (r.h - 2 * r.r) / area >= 0.7 - 1e-9
        assert area / ((r.w + 2 * r.r) * (r.h + 2 * r.r)) >= 0.7 - 1e-9


def test_targets_of_odd_boxes(spark):
    boxes = spark.createDataFrame([(1, 2, 10.0, 10.0, 8.0, 8.0), (1, 1, None, 0.0, 1.0, 1.0), (1, 1, -90.0, 0.0, 8.0, 8.0), (1, 3, 40.0, 40.0, 200.0, 160.0), (1, 4, 1.0, 1.0, 2.0, 2.0), (2, 1, 254.0, 0.0, 2.0, 2.0)], "image int, box int, left double, top double, width double, height double")
    rows = L.centre_targets(boxes, 64, 4, max_objects=2).orderBy("image", "slot").collect()
    assert [(r.image, r.slot, r.box, r.cell, r.dx, r.dy, r.radius) for r in rows] == [(1, 0, 2, 3 * 64 + 3, 0.5, 0.5, 3), (1, 1, 3, 30 * 64 + 35, 0.0, 0.0, 4), (2, 0, 1, 63, 0.75, 0.25, 3)]
    cells = {(r.image, r.py, r.px): r.target for r in L.stamped(L.centre_targets(boxes, 64, 4), 64).collect()}
    assert cells[1, 3, 3] == 1.0 and cells[1, 30, 35] == 1.0 and cells[2, 0, 63] == 1.0 and max(cells.values()) == 1.0
    assert {px for i, py, px in cells if i == 2} == {60, 61, 62, 63}
    assert L.stamped(L.centre_targets(boxes.limit(0), 64), 64).count() == 0
