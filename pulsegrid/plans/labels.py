"""Driver queries: boxes of signals in images and training targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detector as N
from ..operators import labelling as L
from .proxies import spec, table
from .registry import query
from .spectra import _CENTRES
from .training import _BOXES, _boxes

#: Images of 64 channels by 64 samples; six signals each, two thirds of them near to each other.
_SCENES = """s AS (SELECT image, s AS signal, s = image % 6 AS owner, (image * 37 + s * (CASE WHEN s < 4 THEN 9 ELSE 23 END)) % 64 + 0.25::DOUBLE AS cx, (image * 29 + s * (CASE WHEN s < 4 THEN 13 ELSE 17 END)) % 64 + 0.5::DOUBLE AS cy,
 2.0::DOUBLE + (image * 7 + s * 5) % 12 AS snr, s % 3 AS half, 1000.0::DOUBLE + 75 * s AS centre, 60.0::DOUBLE + 30 * (image % 4) AS sigma, 2.0::DOUBLE + s * 1.5 AS lw, 3.0::DOUBLE + (image + s) % 5 AS lh FROM (SELECT DISTINCT vec_id // 64 AS image FROM embeddings), range(6) r(s))"""


def _scenes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    image = F.expr("vec_id div 64").alias("image")
    rows = vectors.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows"))  # 64 rows
    pixels = F.flatten(F.transform("rows", lambda r: r["embedding"])).cast("array<double>")
    images = rows.select("image", F.lit(64).alias("width"), F.size("rows").alias("height"), pixels.alias("pixels"))
    signals = vectors.select(image).distinct().select("image", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("signal"))
    i, s = F.col("image"), F.col("signal")
    signals = signals.select(
        "image", s.cast("long").alias("signal"), (s == i % 6).alias("owner"), ((i * 37 + s * F.when(s < 4, 9).otherwise(23)) % 64 + 0.25).alias("cx"), ((i * 29 + s * F.when(s < 4, 13).otherwise(17)) % 64 + 0.5).alias("cy"),
        ((i * 7 + s * 5) % 12 + 2.0).alias("snr"), L.visible_share(s * 75 + 1000.0, (i % 4) * 30 + 60.0, s % 3, 1000.0, 1500.0).alias("visible"), (s * 1.5 + 2).alias("least_width"), ((i + s) % 5 + 3.0).alias("least_height"),
    )
    return images, signals


#: The same by definition: every threshold is a mask of its own, whose components grow pixel by pixel.
_ANNOTATIONS = f"""WITH RECURSIVE {_SCENES}, im AS (SELECT vec_id // 64 AS image, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) - 1 AS y, embedding AS e FROM embeddings), dim AS (SELECT image, count(*) AS h FROM im GROUP BY image),
g AS (SELECT i, 1000.0::DOUBLE + i * (500.0::DOUBLE / 1023) AS f FROM range(1024) r(i)),
vis AS (SELECT image, signal, CASE WHEN half = 0 THEN 1.0 ELSE sqrt(sum(CASE WHEN half = 1 AND f <= 1250 OR half = 2 AND f >= 1250 THEN exp(-pow((f - centre) / sigma, 2)) ELSE 0 END) / sum(exp(-pow((f - centre) / sigma, 2)))) END AS visible FROM s, g GROUP BY image, signal, half),
k AS (SELECT s.*, h, visible, snr * visible AS eff FROM s JOIN vis USING (image, signal) JOIN dim USING (image) WHERE cy < h AND visible >= 0.04 AND snr * visible >= 2.5),
nn AS (SELECT a.image, a.signal, min(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2))) AS near FROM k a LEFT JOIN k b ON a.image = b.image AND a.signal <> b.signal GROUP BY ALL),
w0 AS (SELECT k.*, near, CASE WHEN near < 180 THEN greatest(36, least(150, 0.58::DOUBLE * near)) ELSE 150 END AS hw, CASE WHEN near < 180 THEN greatest(30, least(110, 0.5::DOUBLE * near)) ELSE 110 END AS hh FROM k JOIN nn USING (image, signal)),
w AS (SELECT *, greatest(0, floor(cx - hw))::INT AS x0, least(64, ceil(cx + hw + 1))::INT AS x1, greatest(0, floor(cy - hh))::INT AS y0, least(h, ceil(cy + hh + 1))::INT AS y1,
 least(230, greatest(42, 7.5::DOUBLE * lw)) AS mw0, least(210, greatest(42, 7.5::DOUBLE * lh)) AS mh0 FROM w0),
wx AS (SELECT *, x1 - x0 AS nx, y1 - y0 AS ny, CASE WHEN near IS NULL THEN mw0 ELSE least(mw0, greatest(34, 0.88::DOUBLE * near)) END AS mw, CASE WHEN near IS NULL THEN mh0 ELSE least(mh0, greatest(30, 0.78::DOUBLE * near)) END AS mh FROM w),
tap AS (SELECT o, exp(-0.5 * pow(o / 1.15::DOUBLE, 2)) / sum(exp(-0.5 * pow(o / 1.15::DOUBLE, 2))) OVER () AS wt FROM range(-5, 6) r(o)),
px AS (SELECT wx.image, signal, nx, ny, u.y, v.x, CAST(e[x0 + v.x + 1] AS DOUBLE) AS p FROM wx JOIN im ON im.image = wx.image JOIN range(64) u(y) ON u.y < ny AND im.y = y0 + u.y JOIN range(64) v(x) ON v.x < nx),
b1 AS (SELECT a.image, a.signal, a.nx, a.ny, a.y, a.x, sum(wt * b.p) AS p FROM px a, tap JOIN px b ON b.image = a.image AND b.signal = a.signal AND b.x = a.x AND b.y = (CASE WHEN ((a.y + o) % (2 * a.ny) + 2 * a.ny) % (2 * a.ny) < a.ny THEN ((a.y + o) % (2 * a.ny) + 2 * a.ny) % (2 * a.ny) ELSE 2 * a.ny - 1 - ((a.y + o) % (2 * a.ny) + 2 * a.ny) % (2 * a.ny) END) GROUP BY ALL),
sm AS (SELECT a.image, a.signal, a.nx, a.ny, a.y, a.x, sum(wt * b.p) AS p FROM b1 a, tap JOIN b1 b ON b.image = a.image AND b.signal = a.signal AND b.y = a.y AND b.x = (CASE WHEN ((a.x + o) % (2 * a.nx) + 2 * a.nx) % (2 * a.nx) < a.nx THEN ((a.x + o) % (2 * a.nx) + 2 * a.nx) % (2 * a.nx) ELSE 2 * a.nx - 1 - ((a.x + o) % (2 * a.nx) + 2 * a.nx) % (2 * a.nx) END) GROUP BY ALL),
ct AS (SELECT *, CAST(least(greatest(round_even(cx, 0) - x0, 0), nx - 1) AS INT) AS sx, CAST(least(greatest(round_even(cy, 0) - y0, 0), ny - 1) AS INT) AS sy, greatest(1, least(nx, ny) // 8) AS edge FROM wx),
bd AS (SELECT sm.image, sm.signal, quantile_cont(p, [0.5, 0.85, 0.9]) AS q FROM sm JOIN ct USING (image, signal), range(4) t(z) WHERE CASE z WHEN 0 THEN y < edge WHEN 1 THEN y >= sm.ny - edge WHEN 2 THEN x < edge ELSE x >= sm.nx - edge END GROUP BY ALL),
sd AS (SELECT sm.image, sm.signal, arg_max(y * sm.nx + x, p) AS seed, max(p) AS top FROM sm JOIN ct USING (image, signal) WHERE abs(x - sx) <= 15 AND abs(y - sy) <= 15 GROUP BY ALL),
st0 AS (SELECT ct.*, seed, q[1] AS med, q[2] AS p85, q[3] AS p90, top - q[1] AS contrast, greatest(q[3] - q[1], 1e-4) AS noise FROM ct JOIN bd USING (image, signal) JOIN sd USING (image, signal)),
st AS (SELECT *, contrast / noise AS local FROM st0 WHERE contrast >= greatest(0.035, 1.05::DOUBLE * noise) AND contrast / noise >= 1.25),
ow AS (SELECT sm.image, sm.signal, sm.nx, sm.ny, y, x, CASE WHEN bool_and(b.signal IS NULL OR pow(x + x0 - st.cx, 2) + pow(y + y0 - st.cy, 2) <= 0.92::DOUBLE * (pow(x + x0 - b.cx, 2) + pow(y + y0 - b.cy, 2))) THEN any_value(p) ELSE -1e300 END AS p FROM sm JOIN st USING (image, signal) LEFT JOIN k b ON b.image = sm.image AND b.signal <> sm.signal GROUP BY ALL),
six(dy, dx) AS (SELECT dy, dx FROM range(2) a(dy), range(-1, 2) b(dx)),
dl AS (SELECT a.image, a.signal, a.nx, a.ny, a.y, a.x, max(b.p) AS p FROM ow a, six JOIN ow b ON b.image = a.image AND b.signal = a.signal AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL),
er AS (SELECT a.image, a.signal, a.nx, a.ny, a.y, a.x, CASE WHEN count(*) = 6 THEN min(b.p) ELSE -1e300 END AS p FROM dl a, six JOIN dl b ON b.image = a.image AND b.signal = a.signal AND b.y = a.y - dy AND b.x = a.x + dx GROUP BY ALL),
ld AS (SELECT st.*, t.i AS step, greatest(CASE WHEN local < 2.2 THEN greatest(p85, p90) ELSE p85 END, med + (CASE WHEN local < 2.2 OR eff < 3 THEN [0.64::DOUBLE, 0.72, 0.80, 0.88] WHEN local < 4 OR eff < 8 THEN [0.56::DOUBLE, 0.64, 0.74, 0.84] ELSE [0.44::DOUBLE, 0.52, 0.62, 0.74] END)[t.i] * contrast) AS thr FROM st, range(1, 5) t(i)),
mk AS (SELECT image, signal, step, y * er.nx + x AS c, x, y, er.nx AS nx FROM er JOIN ld USING (image, signal) WHERE p >= thr),
lk AS (SELECT a.image, a.signal, a.step, a.c AS c, b.c AS d FROM mk a JOIN mk b ON a.image = b.image AND a.signal = b.signal AND a.step = b.step AND (b.c = a.c + 1 AND b.y = a.y OR b.c = a.c - 1 AND b.y = a.y OR b.c = a.c + a.nx OR b.c = a.c - a.nx)),
rc AS (SELECT image, signal, step, c AS root, c FROM mk UNION SELECT rc.image, rc.signal, rc.step, rc.root, lk.d FROM rc JOIN lk ON lk.image = rc.image AND lk.signal = rc.signal AND lk.step = rc.step AND lk.c = rc.c WHERE lk.d > rc.root),
lb AS (SELECT image, signal, step, c, min(root) AS lab FROM rc GROUP BY ALL),
cp AS (SELECT lb.image, lb.signal, lb.step, lab, count(*) AS size, min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb, min((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS d2, bool_or(lb.c = seed) AS holds FROM lb JOIN mk USING (image, signal, step, c) JOIN ld USING (image, signal, step) GROUP BY ALL),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, signal, step ORDER BY holds DESC, sqrt(d2) - 0.01::DOUBLE * sqrt(size), lab) AS n FROM cp WHERE holds OR size >= 3 AND d2 <= 784) WHERE n = 1),
ok AS (SELECT ld.*, xa, xb, ya, yb, xb - xa + 1.0::DOUBLE AS rw, yb - ya + 1.0::DOUBLE AS rh FROM ch JOIN ld USING (image, signal, step) WHERE NOT (size > 0.18::DOUBLE * nx * ny AND step < 4) AND xb - xa + 1 <= 1.35::DOUBLE * mw AND yb - ya + 1 <= 1.35::DOUBLE * mh AND (xb - xa + 1) / (yb - ya + 1.0::DOUBLE) BETWEEN 0.12 AND 9),
fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, signal ORDER BY step) AS n FROM ok) WHERE n = 1),
rs AS (SELECT image, signal, least(greatest(greatest(least(greatest(xb + x0 + 1 + greatest(3, 0.05::DOUBLE * rw), 1), 64) - least(greatest(xa + x0 - greatest(3, 0.05::DOUBLE * rw), 0), 63), 1), lw, 2), mw) AS bw,
 least(greatest(greatest(least(greatest(yb + y0 + 1 + greatest(3, 0.08::DOUBLE * rh), 1), h) - least(greatest(ya + y0 - greatest(3, 0.08::DOUBLE * rh), 0), h - 1), 1), lh, 2), mh) AS bh FROM fs),
bx AS (SELECT k.*, rs.image IS NOT NULL AS from_response, CASE WHEN visible >= 0.98 THEN 1.0 ELSE least(greatest(0.55 + 0.45::DOUBLE * sqrt(visible), 0.55), 1.0) END AS sc, greatest(1, coalesce(bw, greatest(lw, 18))) AS bw, greatest(1, coalesce(bh, greatest(lh, 18))) AS bh FROM k LEFT JOIN rs USING (image, signal) WHERE rs.image IS NOT NULL OR eff >= 9),
rk AS (SELECT bx.*, greatest(1, bw * sc) AS w2, greatest(1, bh * sc) AS h2, row_number() OVER (PARTITION BY bx.image ORDER BY CASE WHEN bx.owner THEN -1 ELSE pow(bx.cx - o.cx, 2) + pow(bx.cy - o.cy, 2) END, bx.signal) AS n FROM bx JOIN s o ON o.image = bx.image AND o.owner)
SELECT image, CAST(n AS INT) AS "rank", signal, round(cx - w2 / 2, 6) + 0.0 AS "left", round(cy - h2 / 2, 6) + 0.0 AS top, round(w2, 6) AS width, round(h2, 6) AS height, from_response FROM rk WHERE n <= 4"""


@query("scene_annotations", _ANNOTATIONS)
def scene_annotations(spark, sf_dir):
    images, signals = _scenes(spark, sf_dir)
    out = L.annotate(images, signals, 2.5, 9.0, 4)
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("left", "top")} | {c: F.round(c, 6) for c in ("width", "height")})


_TARGETS = f"""(SELECT image, CAST(n - 1 AS INT) AS slot, box, CAST(floor(cy) * 64 + floor(cx) AS INT) AS cell, cx - floor(cx) AS dx, cy - floor(cy) AS dy, greatest(1, CAST(round_even(greatest(0.0, least(r1, r2, r3)), 0) AS INT)) AS radius FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY box, cx, cy, bw, bh) AS n,
 ((bw + bh) - sqrt(greatest(0.0, pow(bw + bh, 2) - 4 * bw * bh * (0.3::DOUBLE / 1.7)))) / 2 AS r1, (2 * (bw + bh) - sqrt(greatest(0.0, 4 * pow(bw + bh, 2) - 16 * 0.3::DOUBLE * bw * bh))) / 8 AS r2,
 (-1.4::DOUBLE * (bw + bh) + sqrt(greatest(0.0, pow(1.4::DOUBLE * (bw + bh), 2) + 4 * 2.8::DOUBLE * 0.3 * bw * bh))) / 5.6 AS r3 FROM (SELECT image, box, "left" + w / 2 AS cx, top + h / 2 AS cy, greatest(1, w) AS bw, greatest(1, h) AS bh FROM {_BOXES}) WHERE cx >= 0 AND cx < 64 AND cy >= 0 AND cy < 64) WHERE n <= 3)"""


def _targets(spark, sf_dir):
    return L.centre_targets(_boxes(spark, sf_dir).withColumnsRenamed({"w": "width", "h": "height"}), 64, 1, 3, 1)


@query("centre_targets", f"SELECT image, slot, box, cell, round(dx, 6) AS dx, round(dy, 6) AS dy, radius FROM {_TARGETS}")
def centre_targets(spark, sf_dir):
    return _targets(spark, sf_dir).withColumns({"dx": F.round("dx", 6), "dy": F.round("dy", 6)})


#: Rows of the maps: their cells, largest and total target.
@query("adaptive_heatmap", f"""SELECT image, py, count(*) AS cells, round(max(target), 6) AS largest, round(sum(target), 6) AS total FROM (SELECT image, CAST(y.i AS INT) AS py, x.i AS px, max(exp(-(pow(x.i - cell % 64, 2) + pow(y.i - cell // 64, 2)) / (2 * pow((2 * radius + 1) / 6.0::DOUBLE, 2)))) AS target FROM {_TARGETS}
JOIN range(64) y(i) ON abs(y.i - cell // 64) <= radius JOIN range(64) x(i) ON abs(x.i - cell % 64) <= radius GROUP BY ALL) GROUP BY image, py""")
def adaptive_heatmap(spark, sf_dir):
    maps = L.stamped(_targets(spark, sf_dir), 64)
    return maps.groupBy("image", "py").agg(F.count("*").alias("cells"), F.round(F.max("target"), 6).alias("largest"), F.round(F.sum("target"), 6).alias("total"))


#: Boxes of 9 pixels around the centres, strongest first; one goes if it overlaps a kept one by more than a fifth.
@query("detector_boxes", f"""WITH RECURSIVE b AS (SELECT image, "rank", score, cx - 4.5::DOUBLE AS x, cy - 4.5::DOUBLE AS y FROM {_CENTRES}), k AS (SELECT image, 0 AS step, []::STRUCT(score BIGINT, x DOUBLE, y DOUBLE)[] AS kept FROM (SELECT DISTINCT image FROM b)
UNION ALL SELECT k.image, step + 1, CASE WHEN len(list_filter(kept, lambda o: greatest(0, 9 - abs(o.x - b.x)) * greatest(0, 9 - abs(o.y - b.y)) / (162 - greatest(0, 9 - abs(o.x - b.x)) * greatest(0, 9 - abs(o.y - b.y))) > 0.2::DOUBLE)) = 0 THEN list_append(kept, {{'score': b.score, 'x': b.x, 'y': b.y}}) ELSE kept END FROM k JOIN b ON b.image = k.image AND b."rank" = step + 1),
e AS (SELECT image, arg_max(kept, step) AS kept FROM k GROUP BY image), u AS (SELECT image, unnest(kept) AS o, unnest(range(1, len(kept) + 1)) AS n FROM e)
SELECT image, CAST(n AS INT) AS "rank", CAST(o.score AS DOUBLE) AS score, round(o.x, 6) + 0.0 AS "left", round(o.y, 6) + 0.0 AS top, 9.0::DOUBLE AS width, 9.0::DOUBLE AS height FROM u""")
def detector_boxes(spark, sf_dir):
    """A peak detector behind the detector interface."""
    rows = spec(spark, sf_dir).groupBy(F.col("t").alias("image")).agg(F.array_sort(F.collect_list(F.struct("chan", F.col("v").cast("double").alias("v")))).alias("cells"))  # an image's pixels
    images = rows.select("image", F.lit(8).alias("width"), F.lit(8).alias("height"), F.transform("cells", lambda c: c["v"]).alias("pixels"))

    def load():
        return N.PeakDetector(4, 4.0, 9.0, lambda v: (v % 1000 / 1000, v // 1000 % 1000 / 1000))

    found = N.detect(images, "peaks of four, boxes of nine", load, 100000, 0.2)
    return found.withColumns({c: F.round(c, 6) + 0.0 for c in ("left", "top")})
