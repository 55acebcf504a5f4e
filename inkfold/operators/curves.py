"""Curve operators over rings read as chains of cubics, and distances between outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.functions import expressions as E
from inkfold.operators.copies import classes, firsts, next_rings
from inkfold.operators.pairs import shared_sides
from inkfold.operators.rings import nearest_by_grid
from inkfold.operators.template import Operator

# Every third point starts a cubic; the next two are its handles. The last cubic ends in the ring's first point, where handles that are missing lie too.
_CUBICS = f"""cubics AS (
  SELECT * FROM (
    SELECT ring_id, pos, x AS x0, y AS y0, {', '.join(f"coalesce(lead({c}, {k}) OVER w, first_value({c}) OVER w) AS {c}{k}" for k in (1, 2, 3) for c in "xy")}
    FROM {{rings}} WINDOW w AS (PARTITION BY ring_id ORDER BY pos)) q WHERE pos % 3 = 0
)"""


def _bezier(axis: str) -> str:
    return f"(power(1 - t, 3) * {axis}0 + 3 * t * power(1 - t, 2) * {axis}1 + 3 * t * t * (1 - t) * {axis}2 + power(t, 3) * {axis}3)"


_T = "(SELECT CAST(0.25 AS DOUBLE) AS t UNION ALL SELECT 0.5 UNION ALL SELECT 0.75 UNION ALL SELECT 1.0)"
bezier_samples = Operator(f"WITH {_CUBICS} SELECT ring_id, pos, CAST(t AS DOUBLE) AS t, {E.rounded(_bezier('x'))} AS x, {E.rounded(_bezier('y'))} AS y FROM cubics JOIN {_T} s ON true")

bending_energy = Operator(f"""
WITH {_CUBICS},
second AS (
  SELECT ring_id, pos, 6 * ((1 - t) * (x2 - 2 * x1 + x0) + t * (x3 - 2 * x2 + x1)) AS ddx, 6 * ((1 - t) * (y2 - 2 * y1 + y0) + t * (y3 - 2 * y2 + y1)) AS ddy FROM cubics JOIN {_T} s ON true
),
per AS (SELECT ring_id, pos, avg(ddx * ddx + ddy * ddy) AS energy FROM second GROUP BY ring_id, pos)
SELECT ring_id, count(*) AS segments, {E.rounded('sum(energy) / 1000')} AS total, {E.rounded('max(energy) / 1000')} AS worst, CAST(sum(CASE WHEN energy < 15 THEN 1 ELSE 0 END) AS BIGINT) AS straight FROM per GROUP BY ring_id""")

tangent_breaks = Operator(f"""
WITH {_CUBICS},
joined AS (SELECT ring_id, pos, x3 - x2 AS ax, y3 - y2 AS ay, coalesce(lead(x1 - x0) OVER w, first_value(x1 - x0) OVER w) AS bx, coalesce(lead(y1 - y0) OVER w, first_value(y1 - y0) OVER w) AS b_y FROM cubics WINDOW w AS (PARTITION BY ring_id ORDER BY pos)),
turns AS (SELECT ring_id, {E.rounded(E.turn_degrees('ax', 'ay', 'bx', 'b_y'))} AS turn FROM joined)
SELECT ring_id, count(*) AS joints, CAST(sum(CASE WHEN turn > 15 THEN 1 ELSE 0 END) AS BIGINT) AS g1_breaks, CAST(sum(CASE WHEN turn > 5 AND turn < 90 THEN 1 ELSE 0 END) AS BIGINT) AS soft_breaks, {E.rounded('avg(turn)')} AS mean_turn,
       {E.rounded(E.editability('count(*)', 'avg(CASE WHEN turn <= 15 THEN 1e0 ELSE 0e0 END)'))} AS editability
FROM turns GROUP BY ring_id""")

feature_persistence = Operator(f"""
WITH scales AS (SELECT 1 AS s UNION ALL SELECT 2 UNION ALL SELECT 4),
arms AS (
  SELECT c.ring_id, c.pos, s.s, c.x - p.x AS ax, c.y - p.y AS ay, q.x - c.x AS bx, q.y - c.y AS b_y
  FROM {{rings}} c JOIN scales s ON c.n > 2 * s.s JOIN {{rings}} p ON p.ring_id = c.ring_id AND p.pos = (c.pos + c.n - s.s) % c.n JOIN {{rings}} q ON q.ring_id = c.ring_id AND q.pos = (c.pos + s.s) % c.n
),
turns AS (SELECT ring_id, pos, {E.rounded(E.turn_degrees('ax', 'ay', 'bx', 'b_y'))} AS turn FROM arms),
kept AS (SELECT ring_id, pos, sum(CASE WHEN turn >= 45 THEN 1 ELSE 0 END) AS seen FROM turns GROUP BY ring_id, pos)
SELECT ring_id, CAST(seen AS BIGINT) AS scales_seen, count(*) AS points FROM kept GROUP BY ring_id, seen""")

# Every point of either outline to the nearest side of the other, closing sides included.
# Sides meet points in the cells around them; only points without a side within a cell's width look at the whole outline.
_REACH = 8
_FOOT = E.clamp("((x - x1) * vx + (y - y1) * vy) / (vx * vx + vy * vy)", "0e0", "1e0")
_TO_SIDE = E.distance(("x", "x1 + t * vx"), ("y", "y1 + t * vy"))


def _cells(low: str, high: str) -> str:
    return f"explode(sequence({E.whole(f'{low} / {_REACH}')}, {E.whole(f'{high} / {_REACH}')}))"


_point_to_segment = Operator(f"""
WITH segs AS (SELECT ring_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM {{rings}} WINDOW w AS (PARTITION BY ring_id ORDER BY pos)),
sides AS (SELECT ring_id, x1, y1, x2 - x1 AS vx, y2 - y1 AS vy, least(x1, x2) AS lx, greatest(x1, x2) AS hx, least(y1, y2) AS ly, greatest(y1, y2) AS hy FROM segs),
lines AS (SELECT *, {_cells('lx', 'hx')} AS gx FROM sides),
placed AS (SELECT ring_id, x1, y1, vx, vy, gx, {_cells('ly', 'hy')} AS gy FROM lines),
asked AS (SELECT w.pair_id, w.way, w.to_id, a.pos, a.x, a.y, {E.whole(f'a.x / {_REACH}')} AS cx, {E.whole(f'a.y / {_REACH}')} AS cy FROM {{ways}} w JOIN {{rings}} a ON a.ring_id = w.from_id),
rows3 AS (SELECT *, explode(array(cx - 1, cx, cx + 1)) AS gx FROM asked),
around AS (SELECT *, explode(array(cy - 1, cy, cy + 1)) AS gy FROM rows3),
feet AS (SELECT /*+ MERGE(s) */ p.pair_id, p.way, p.pos, x, y, x1, y1, vx, vy, CASE WHEN vx * vx + vy * vy = 0 THEN 0e0 ELSE {_FOOT} END AS t FROM around p JOIN placed s ON s.ring_id = p.to_id AND s.gx = p.gx AND s.gy = p.gy),
close AS (SELECT pair_id, way, pos, min({_TO_SIDE}) AS d FROM feet GROUP BY pair_id, way, pos),
left_over AS (SELECT /*+ MERGE(c) */ a.pair_id, a.way, a.to_id, a.pos, a.x, a.y FROM asked a LEFT JOIN close c ON c.pair_id = a.pair_id AND c.way = a.way AND c.pos = a.pos WHERE c.d IS NULL OR c.d > {_REACH}),
far_feet AS (SELECT /*+ MERGE(s) */ p.pair_id, p.way, p.pos, x, y, x1, y1, vx, vy, CASE WHEN vx * vx + vy * vy = 0 THEN 0e0 ELSE {_FOOT} END AS t FROM left_over p JOIN sides s ON s.ring_id = p.to_id),
near AS (SELECT pair_id, way, pos, d FROM close WHERE d <= {_REACH} UNION ALL SELECT pair_id, way, pos, min({_TO_SIDE}) AS d FROM far_feet GROUP BY pair_id, way, pos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pair_id, way ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY pair_id, way) AS n FROM near),
ways2 AS (
  SELECT pair_id, way, count(*) AS points, avg(d) AS mean, max(d) AS most, max(CASE WHEN k = {E.whole('n * 0.5')} THEN d END) AS p50, max(CASE WHEN k = {E.whole('n * 0.95')} THEN d END) AS p95 FROM ranked GROUP BY pair_id, way
)
SELECT pair_id, CAST(sum(points) AS BIGINT) AS points, {E.rounded('avg(mean)')} AS chamfer, {E.rounded('max(most)')} AS hausdorff, {E.rounded('max(CASE WHEN way = 0 THEN p50 END)')} AS p50, {E.rounded('max(CASE WHEN way = 0 THEN p95 END)')} AS p95
FROM ways2 GROUP BY pair_id HAVING count(*) = 2""")


def point_to_segment(rings: DataFrame) -> DataFrame:
    """pair_id, points, chamfer, hausdorff, p50, p95 of every ring and the ring of the next number."""
    return next_rings(rings, lambda first, ways: _point_to_segment(rings=first, ways=ways))


_boundary_distance = Operator(f"WITH {nearest_by_grid()} SELECT pair_id, count(*) AS points, {E.rounded('avg(d)')} AS chamfer, {E.rounded('max(d)')} AS hausdorff FROM gaps GROUP BY pair_id")


def boundary_distance(rings: DataFrame) -> DataFrame:
    """pair_id, points, chamfer, hausdorff of the points of every ring and the ring of the next number, both ways."""
    return next_rings(rings, lambda first, ways: _boundary_distance(rings=first, ways=ways))


ground_truth_fidelity = Operator(f"""
WITH sides AS (SELECT ring_id, pos, n, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM {{rings}} WINDOW w AS (PARTITION BY ring_id ORDER BY pos)),
raw AS (
  SELECT ring_id, sum(x * ny - nx * y) / 2 AS area, sum({E.distance(('x', 'nx'), ('y', 'ny'))}) AS perimeter, sum((x + nx) * (x * ny - nx * y)) / 6 AS mx, sum((y + ny) * (x * ny - nx * y)) / 6 AS my, avg(x) AS ax, avg(y) AS ay FROM sides GROUP BY ring_id
),
sums AS (SELECT ring_id, abs(area) AS area, perimeter, CASE WHEN area = 0 THEN ax ELSE mx / area END AS cx, CASE WHEN area = 0 THEN ay ELSE my / area END AS cy FROM raw)
SELECT c.ring_id, {E.rounded('CASE WHEN t.area > 0 THEN abs(c.area - t.area) / t.area ELSE 0 END')} AS area_drift, {E.rounded('CASE WHEN t.perimeter > 0 THEN abs(c.perimeter - t.perimeter) / t.perimeter ELSE 0 END')} AS perimeter_drift,
       {E.rounded(E.distance(('c.cx', 't.cx'), ('c.cy', 't.cy')))} AS centroid_drift
FROM sums c JOIN sums t ON t.ring_id = c.ring_id + 1""")

# Edges are matched on a canonical key of their end points, snapped to a grid of 10, and counted by ring before they meet.
_shared_edges = Operator("""
WITH sides AS (
  SELECT ring_id, least(x, nx) AS ex0, greatest(x, nx) AS ex1, CASE WHEN x <= nx THEN y ELSE ny END AS ey0, CASE WHEN x <= nx THEN ny ELSE y END AS ey1
  FROM (SELECT ring_id, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM (SELECT ring_id, pos, floor(x / 10) AS x, floor(y / 10) AS y FROM {rings}) g WINDOW w AS (PARTITION BY ring_id ORDER BY pos)) q WHERE nx IS NOT NULL
)
SELECT ring_id, ex0, ex1, ey0, ey1, count(*) AS n FROM sides GROUP BY ring_id, ex0, ex1, ey0, ey1""")


def shared_edge_absorption(rings: DataFrame) -> DataFrame:
    """ring_a, ring_b, shared_edges: rings and how many of their sides fall together; equal rings are compared once in a block, also with themselves."""
    of = classes(rings)
    return shared_sides(_shared_edges(rings=firsts(rings, of)), of)


light_region_audit = Operator(f"""
WITH beside AS (
  SELECT *, CASE WHEN lag(x) OVER across = x - 1 AND lag(label) OVER across = label THEN 1 ELSE 0 END + CASE WHEN lag(y) OVER down = y - 1 AND lag(label) OVER down = label THEN 1 ELSE 0 END AS inner_sides
  FROM {{labels_map}} WINDOW across AS (PARTITION BY image_id, y ORDER BY x), down AS (PARTITION BY image_id, x ORDER BY y)
),
shape AS (SELECT image_id, label, count(*) AS area, 4 * count(*) - 2 * CAST(sum(inner_sides) AS BIGINT) AS perimeter, avg({E.luminance('r', 'g', 'b')}) AS light FROM beside GROUP BY image_id, label)
SELECT image_id, label, area, {E.rounded('2e0 * area / perimeter')} AS thickness, {E.rounded('CAST(perimeter AS DOUBLE) * perimeter / (4 * 3.141592653589793e0 * area)')} AS elongation, {E.rounded('light')} AS light,
       CASE WHEN 2e0 * area / perimeter < 1 THEN 'SLIVER' WHEN light > 150 THEN 'LIGHT' ELSE 'BODY' END AS provenance FROM shape""")
