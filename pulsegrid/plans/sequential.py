"""DuckDB SQL of the queries whose rows are taken one after the other: recursions over the rows' order, all groups at once."""

from __future__ import annotations

from .proxies import CANDIDATES, IMAGES, TRUTH


def greedy_kept(rows: str, time_tol: int, dm_tol: float) -> str:
    """WITH clause whose ``kept(cand_id)`` are the rows that no stronger kept row of their file suppresses."""
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT cand_id, quant, stem, sample, dm, row_number() OVER (PARTITION BY quant, stem ORDER BY det DESC, cls DESC, cand_id) AS i FROM {rows}),
s AS (SELECT quant, stem, i, cand_id, true AS keep, [{{'t': sample, 'd': dm}}] AS held FROM o WHERE i = 1
UNION ALL SELECT quant, stem, i, cand_id, near = 0 AS keep, CASE WHEN near = 0 THEN list_append(held, {{'t': t, 'd': d}}) ELSE held END AS held FROM (
 SELECT o.quant, o.stem, o.i, o.cand_id, o.sample AS t, o.dm AS d, s.held, len(list_filter(s.held, lambda k: abs(o.sample - k.t) <= {time_tol} AND abs(o.dm - k.d) <= {dm_tol})) AS near
 FROM s JOIN o ON o.quant = s.quant AND o.stem = s.stem AND o.i = s.i + 1)),
kept AS (SELECT cand_id FROM s WHERE keep)"""


def bounded_events(time_tol: int, dm_tol: float) -> str:
    """Events of bounded diameter: the state of a file is the list of its open events."""
    fits = f"t - e.t0 <= {time_tol} AND e.t1 - t <= {time_tol} AND d - e.d0 <= {dm_tol} AND e.d1 - d <= {dm_tol}"
    distance = f"abs(t - e.rt) / {time_tol}::DOUBLE + abs(d - e.rd) / {dm_tol}::DOUBLE"
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT cand_id, quant, stem, CAST(sample AS DOUBLE) AS t, dm AS d, row_number() OVER (PARTITION BY quant, stem ORDER BY cls DESC, det DESC, candidate_index, cand_id) AS i FROM {CANDIDATES}),
s AS (SELECT quant, stem, i, cand_id, cand_id AS event, [{{'first': cand_id, 't0': t, 't1': t, 'd0': d, 'd1': d, 'rt': t, 'rd': d}}] AS events FROM o WHERE i = 1
UNION ALL SELECT quant, stem, i, cand_id, coalesce(events[best.n].first, cand_id) AS event, CASE WHEN best IS NULL THEN list_append(events, {{'first': cand_id, 't0': t, 't1': t, 'd0': d, 'd1': d, 'rt': t, 'rd': d}})
 ELSE list_transform(events, lambda e, n: CASE WHEN n = best.n THEN {{'first': e.first, 't0': least(e.t0, t), 't1': greatest(e.t1, t), 'd0': least(e.d0, d), 'd1': greatest(e.d1, d), 'rt': e.rt, 'rd': e.rd}} ELSE e END) END AS events
FROM (SELECT quant, stem, i, cand_id, t, d, events, list_min(list_filter(list_transform(events, lambda e, n: CASE WHEN {fits} THEN {{'distance': {distance}, 'n': n}} END), lambda x: x IS NOT NULL)) AS best
 FROM (SELECT o.quant, o.stem, o.i, o.cand_id, o.t, o.d, s.events FROM s JOIN o ON o.quant = s.quant AND o.stem = s.stem AND o.i = s.i + 1)))
SELECT cand_id, event, count(*) OVER (PARTITION BY event) AS event_size FROM s"""


def grid_events(time_tol: int, dm_tol: float) -> str:
    """Grid-bucketed bounded clustering in order of cand_id."""
    opened = "{'x': x, 'y': y, 't0': t, 't1': t, 'd0': d, 'd1': d, 'sigma': sigma, 'cand_id': cand_id, 'n': 1::BIGINT}"
    fits = f"abs(e.x - x) <= 1 AND abs(e.y - y) <= 1 AND greatest(e.t1, t) - least(e.t0, t) <= {time_tol} AND greatest(e.d1, d) - least(e.d0, d) <= {dm_tol}"
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT cand_id, quant, stem, sample AS t, dm AS d, sigma, CAST(floor(dm / {dm_tol}::DOUBLE) AS BIGINT) AS x, sample // {time_tol} AS y, row_number() OVER (PARTITION BY quant, stem ORDER BY cand_id) AS i, count(*) OVER (PARTITION BY quant, stem) AS size FROM {CANDIDATES}),
s AS (SELECT quant, stem, i, size, [{opened}] AS events FROM o WHERE i = 1
UNION ALL SELECT quant, stem, i, size, CASE WHEN best IS NULL THEN list_append(events, {opened})
 ELSE list_transform(events, lambda e, n: CASE WHEN n = best.n THEN {{'x': e.x, 'y': e.y, 't0': least(e.t0, t), 't1': greatest(e.t1, t), 'd0': least(e.d0, d), 'd1': greatest(e.d1, d), 'sigma': greatest(e.sigma, sigma), 'cand_id': CASE WHEN sigma > e.sigma THEN cand_id ELSE e.cand_id END, 'n': e.n + 1}} ELSE e END) END AS events
FROM (SELECT quant, stem, i, size, cand_id, t, d, sigma, x, y, events, list_min(list_filter(list_transform(events, lambda e, n: CASE WHEN {fits} THEN {{'x': e.x, 'y': e.y, 'n': n}} END), lambda z: z IS NOT NULL)) AS best
 FROM (SELECT o.quant, o.stem, o.i, o.size, o.cand_id, o.t, o.d, o.sigma, o.x, o.y, s.events FROM s JOIN o ON o.quant = s.quant AND o.stem = s.stem AND o.i = s.i + 1)))
SELECT quant, stem, CAST(number - 1 AS BIGINT) AS event_number, events[number].cand_id AS cand_id, events[number].sigma AS sigma, events[number].n AS event_size, events[number].d0 AS dm_min, events[number].d1 AS dm_max, events[number].t0 AS sample_min, events[number].t1 AS sample_max
FROM (SELECT quant, stem, events, unnest(range(1, len(events) + 1)) AS number FROM s WHERE i = size)"""


def threshold_sweep(levels: list[float], time_tol: int, dm_tol: float) -> str:
    """Greedy matches in order of the truths at each threshold."""
    values = ", ".join(f"({x}::DOUBLE)" for x in levels)
    cost = f"abs(c.sample - t.sample) / {time_tol}::DOUBLE + abs(c.dm - t.dm) / {dm_tol}::DOUBLE - c.sigma * 0.001::DOUBLE"
    return f"""WITH RECURSIVE l AS MATERIALIZED (SELECT threshold FROM (VALUES {values}) x(threshold)),
w AS MATERIALIZED (SELECT threshold, quant, stem, injection_id, list(cand_id ORDER BY cost, cand_id) AS near, row_number() OVER (PARTITION BY threshold, quant, stem ORDER BY injection_id) AS i
 FROM l JOIN (SELECT quant, stem, injection_id, cand_id, {cost} AS cost, c.sigma FROM {TRUTH} t JOIN {CANDIDATES} c USING (quant, stem) WHERE abs(c.sample - t.sample) <= {time_tol} AND abs(c.dm - t.dm) <= {dm_tol}) ON sigma >= threshold GROUP BY threshold, quant, stem, injection_id),
s AS (SELECT threshold, quant, stem, i, near[1] AS pick, [near[1]] AS used FROM w WHERE i = 1
UNION ALL SELECT threshold, quant, stem, i, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END AS used FROM (
 SELECT w.threshold, w.quant, w.stem, w.i, s.used, list_filter(w.near, lambda c: NOT list_contains(s.used, c))[1] AS pick FROM s JOIN w ON w.threshold = s.threshold AND w.quant = s.quant AND w.stem = s.stem AND w.i = s.i + 1))
SELECT threshold, count(pick) AS n_detected, (SELECT count(*) FROM {TRUTH}) AS n_total FROM l LEFT JOIN s USING (threshold) GROUP BY threshold"""


#: Blocks in order; a block can only have lost itself or the one before it to the two matches made last.
TOLERANT_BLOCKS = """WITH RECURSIVE k AS MATERIALIZED (SELECT DISTINCT l_suppkey AS file, l_orderkey // 64 AS block, l_linestatus = 'F' AS own FROM lineitem),
a AS MATERIALIZED (SELECT file, block, row_number() OVER (PARTITION BY file ORDER BY block) AS i, count(*) OVER (PARTITION BY file) AS n,
 list_filter([block, block - 1, block + 1], lambda b: list_contains(others, b)) AS near FROM (SELECT file, block FROM k WHERE own) LEFT JOIN (SELECT file, list(block) AS others FROM k WHERE NOT own GROUP BY file) USING (file)),
s AS (SELECT file, 0::BIGINT AS i, []::BIGINT[] AS used, 0::BIGINT AS n_matched FROM (SELECT DISTINCT file FROM k)
UNION ALL SELECT file, i, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick)[-2:] END AS used, n_matched + (pick IS NOT NULL)::BIGINT AS n_matched FROM (
 SELECT a.file, a.i, s.used, s.n_matched, list_filter(a.near, lambda b: NOT list_contains(s.used, b))[1] AS pick FROM s JOIN a ON a.file = s.file AND a.i = s.i + 1))
SELECT file, n_left, n_right, n_matched FROM (SELECT file, count_if(own)::BIGINT AS n_left, count_if(NOT own)::BIGINT AS n_right FROM k GROUP BY file) JOIN (SELECT file, max(n_matched) AS n_matched FROM s GROUP BY file) USING (file)"""


def centre_matches(found: str, real: str, reach: float) -> str:
    """``(image, rank, truth, distance)``: each found centre takes the nearest truth that is free, if within reach."""
    return f"""(WITH RECURSIVE o AS MATERIALIZED (SELECT image, "rank", px, py, coalesce(truths, []) AS truths FROM {found} LEFT JOIN (SELECT image, list({{'x': px, 'y': py}} ORDER BY "rank") AS truths FROM {real} GROUP BY image) USING (image)),
d AS MATERIALIZED (SELECT image, "rank", list_transform(truths, lambda t, j: {{'distance': sqrt(CAST((t.x - px) * (t.x - px) + (t.y - py) * (t.y - py) AS DOUBLE)), 'j': j}}) AS away FROM o),
s AS (SELECT image, "rank", best, CASE WHEN best.distance <= {reach} THEN [best.j] ELSE [] END AS used FROM (SELECT image, "rank", list_min(away) AS best FROM d WHERE "rank" = 1)
UNION ALL SELECT image, "rank", best, CASE WHEN best.distance <= {reach} THEN list_append(used, best.j) ELSE used END AS used FROM (
 SELECT d.image, d."rank", s.used, list_min(list_filter(d.away, lambda t: NOT list_contains(s.used, t.j))) AS best FROM s JOIN d ON d.image = s.image AND d."rank" = s."rank" + 1))
SELECT image, "rank", CAST(CASE WHEN best.distance <= {reach} THEN best.j - 1 ELSE -1 END AS INT) AS truth, best.distance AS distance FROM s)"""


#: Regions grow from each pixel to all that it is joined to; a region is named by its first pixel in scan order.
MORPHOLOGY = f"""WITH RECURSIVE e AS (SELECT image, avg(v) + 1.5::DOUBLE * stddev_pop(v) AS least FROM {IMAGES} WHERE px IN (0, 7) OR py IN (0, 7) GROUP BY image),
m AS MATERIALIZED (SELECT image, py, px FROM {IMAGES} JOIN e USING (image) WHERE v > least),
w AS MATERIALIZED (SELECT DISTINCT image, py, px FROM (SELECT image, py, px FROM m UNION ALL SELECT image, py + 1, px FROM m WHERE py < 7 UNION ALL SELECT image, py, px - 1 FROM m WHERE px > 0 UNION ALL SELECT image, py, px + 1 FROM m WHERE px < 7)),
r AS (SELECT image, py, px, py * 8 + px AS origin FROM w UNION SELECT w.image, w.py, w.px, r.origin FROM r JOIN w ON w.image = r.image AND abs(w.py - r.py) + abs(w.px - r.px) = 1),
b AS (SELECT image, region, min(px) AS "left", min(py) AS top, max(px) - min(px) + 1 AS width, max(py) - min(py) + 1 AS height, sum(v)::DOUBLE AS total FROM (SELECT image, py, px, min(origin) AS region FROM r GROUP BY image, py, px) JOIN {IMAGES} USING (image, py, px) GROUP BY image, region)
SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY region) - 1 AS INT) AS box, CAST("left" AS INT) AS "left", CAST(top AS INT) AS top, CAST(width AS INT) AS width, CAST(height AS INT) AS height, total FROM b WHERE width * height >= 2"""

#: A row opens a session if all rows of its kind before it ended earlier.
SESSIONS = """WITH o AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
p AS (SELECT *, sum(opens) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM o)
SELECT event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS "start", strftime(max(ts) + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS event_size, max(value) AS strongest FROM p GROUP BY event_type, part"""


def assignment(time_tol: int, dm_tol: float) -> str:
    """The most pairs and, of those, the least cost in each connected component, from all of its one-to-one matchings."""
    cost = f"abs(c.sample - t.sample) / {time_tol}::DOUBLE + abs(c.dm - t.dm) / {dm_tol}::DOUBLE - c.cls * 0.05::DOUBLE"
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT t.injection_id, c.cand_id, {cost} AS cost FROM {TRUTH} t JOIN {CANDIDATES} c USING (quant, stem) WHERE abs(c.sample - t.sample) <= {time_tol} AND abs(c.dm - t.dm) <= {dm_tol}),
n AS MATERIALIZED (SELECT DISTINCT a.injection_id AS own, b.injection_id AS other FROM e a JOIN e b USING (cand_id)),
r AS (SELECT own, other FROM n UNION SELECT r.own, n.other FROM r JOIN n ON n.own = r.other),
w AS MATERIALIZED (SELECT injection_id, component, near, row_number() OVER (PARTITION BY component ORDER BY injection_id) AS i, count(*) OVER (PARTITION BY component) AS size
 FROM (SELECT own AS injection_id, min(other) AS component FROM r GROUP BY own) JOIN (SELECT injection_id, list({{'cand_id': cand_id, 'cost': cost}}) AS near FROM e GROUP BY injection_id) USING (injection_id)),
s AS (SELECT DISTINCT component, 0::BIGINT AS i, size, []::BIGINT[] AS used, 0.0::DOUBLE AS cost, []::STRUCT(injection_id BIGINT, cand_id BIGINT, cost DOUBLE)[] AS pairs FROM w
UNION ALL SELECT component, i, size, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.cand_id) END AS used, cost + coalesce(pick.cost, 0) AS cost, CASE WHEN pick IS NULL THEN pairs ELSE list_append(pairs, {{'injection_id': injection_id, 'cand_id': pick.cand_id, 'cost': pick.cost}}) END AS pairs FROM (
 SELECT w.component, w.i, w.size, w.injection_id, s.used, s.cost, s.pairs, unnest(list_append(list_filter(w.near, lambda c: NOT list_contains(s.used, c.cand_id)), NULL)) AS pick FROM s JOIN w ON w.component = s.component AND w.i = s.i + 1)),
b AS (SELECT p.injection_id, p.cand_id, p.cost FROM (SELECT unnest(pairs) AS p FROM (SELECT pairs, row_number() OVER (PARTITION BY component ORDER BY len(pairs) DESC, cost) AS k FROM s WHERE i = size) WHERE k = 1))
SELECT injection_id, snr, dm, cand_id, round(cost, 6) AS cost, cand_id IS NOT NULL AS detected FROM {TRUTH} LEFT JOIN b USING (injection_id)"""
