"""Contour operators over rings(ring_id, pos, n, x, y), closed without a repeated last point."""

from __future__ import annotations

from pyspark.sql import DataFrame

from inkfold.functions import expressions as E
from inkfold.operators.copies import classes, firsts, next_rings
from inkfold.operators.pairs import points_in_rings
from inkfold.operators.template import Operator

# Cyclic neighbours: the window's end wraps to its other side.
_CYCLE = """cyc AS (
  SELECT ring_id, pos, n, x, y,
         coalesce(lag(x) OVER w, last_value(x) OVER whole) AS px, coalesce(lag(y) OVER w, last_value(y) OVER whole) AS py,
         coalesce(lead(x) OVER w, first_value(x) OVER whole) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER whole) AS ny
  FROM {rings} WINDOW w AS (PARTITION BY ring_id ORDER BY pos), whole AS (PARTITION BY ring_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)"""
_TURN = E.turn_degrees("x - px", "y - py", "nx - x", "ny - y")

ring_metrics = Operator(f"""
WITH {_CYCLE},
sums AS (
  SELECT ring_id, count(*) AS points, sum(x * ny - nx * y) / 2 AS area, sum({E.distance(('x', 'nx'), ('y', 'ny'))}) AS perimeter,
         sum((x + nx) * (x * ny - nx * y)) / 6 AS mx, sum((y + ny) * (x * ny - nx * y)) / 6 AS my, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y
  FROM cyc GROUP BY ring_id
)
SELECT ring_id, points, {E.rounded('area')} AS signed_area, {E.rounded('perimeter')} AS perimeter,
       CASE WHEN area = 0 THEN NULL ELSE {E.rounded('mx / area')} END AS centroid_x, CASE WHEN area = 0 THEN NULL ELSE {E.rounded('my / area')} END AS centroid_y,
       {E.rounded('CASE WHEN perimeter = 0 THEN 0 ELSE 4 * 3.141592653589793e0 * abs(area) / (perimeter * perimeter) END')} AS compactness,
       min_x, max_x, min_y, max_y, CASE WHEN area < 0 THEN 'CW' ELSE 'CCW' END AS winding
FROM sums""")

path_redundancy = Operator(f"""
WITH seq AS (SELECT ring_id, pos, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM {{rings}} WINDOW w AS (PARTITION BY ring_id ORDER BY pos)),
shares AS (
  SELECT *, (nx - px) * (nx - px) + (ny - py) * (ny - py) AS len2, (x - px) * (nx - px) + (y - py) * (ny - py) AS dot, {E.distance(('x', 'px'), ('y', 'py'))} AS step FROM seq
),
flags AS (
  SELECT ring_id, CASE WHEN step < 0.0001 THEN 1 ELSE 0 END AS zero,
         CASE WHEN len2 > 0 AND dot > 0 AND dot < len2 AND abs((x - px) * (ny - py) - (y - py) * (nx - px)) / sqrt(len2) <= 0.005 THEN 1 ELSE 0 END AS collinear
  FROM shares
)
SELECT ring_id, count(*) AS points, CAST(sum(zero) AS BIGINT) AS zero_length, CAST(sum(collinear) AS BIGINT) AS collinear, count(*) > 500 AS excessive FROM flags GROUP BY ring_id""")

# Outlines without equal neighbours, then, in one pass, without points on the straight line between theirs; an outline that would lose its area stays as it was.
# One order of the points serves all windows: points that go are passed over, not taken out.
path_simplify = Operator(f"""
WITH {_CYCLE},
apart AS (SELECT ring_id, pos, x, y, coalesce({E.distance(('x', 'px'), ('y', 'py'))} >= 0.0001, false) AS left_over FROM cyc),
ends AS (SELECT ring_id, pos, x, y, left_over, CASE WHEN left_over THEN x END AS kx, CASE WHEN left_over THEN y END AS ky FROM apart),
again AS (
  SELECT ring_id, pos, x, y, left_over, coalesce(lag(kx) IGNORE NULLS OVER w, last_value(kx) IGNORE NULLS OVER whole) AS px, coalesce(lag(ky) IGNORE NULLS OVER w, last_value(ky) IGNORE NULLS OVER whole) AS py,
         coalesce(lead(kx) IGNORE NULLS OVER w, first_value(kx) IGNORE NULLS OVER whole) AS nx, coalesce(lead(ky) IGNORE NULLS OVER w, first_value(ky) IGNORE NULLS OVER whole) AS ny
  FROM ends WINDOW w AS (PARTITION BY ring_id ORDER BY pos), whole AS (PARTITION BY ring_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
),
spans AS (SELECT *, (nx - px) * (nx - px) + (ny - py) * (ny - py) AS len2, (x - px) * (nx - px) + (y - py) * (ny - py) AS dot FROM again),
judged AS (SELECT ring_id, pos, x, y, coalesce(left_over AND NOT (len2 > 0 AND dot > 0 AND dot < len2 AND abs((x - px) * (ny - py) - (y - py) * (nx - px)) / sqrt(len2) <= 0.005), false) AS kept FROM spans),
counted AS (SELECT *, sum(CASE WHEN kept THEN 1 ELSE 0 END) OVER (PARTITION BY ring_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) >= 3 AND ring_id IS NOT NULL AS enough FROM judged)
SELECT ring_id, CAST(row_number() OVER (PARTITION BY ring_id ORDER BY pos) - 1 AS BIGINT) AS pos, x, y FROM counted WHERE kept OR NOT enough""")

corner_classes = Operator(f"""
WITH {_CYCLE},
sized AS (SELECT *, least(8, greatest(1, {E.whole('(n - 1) / 2')})) AS w FROM cyc),
far AS (
  SELECT s.*, b.x AS bx, b.y AS bby, f.x AS fx, f.y AS fy FROM sized s
  JOIN {{rings}} b ON b.ring_id = s.ring_id AND b.pos = (s.pos + s.n - s.w) % s.n JOIN {{rings}} f ON f.ring_id = s.ring_id AND f.pos = (s.pos + s.w) % s.n
),
turns AS (
  SELECT ring_id, pos, n, w, {_TURN} AS near_turn, {E.turn_degrees('x - bx', 'y - bby', 'fx - x', 'fy - y')} AS wide_turn,
         least({E.distance(('x', 'px'), ('y', 'py'))}, {E.distance(('x', 'nx'), ('y', 'ny'))}) AS arms
  FROM far WHERE n >= 3
),
exact AS (SELECT ring_id, pos, n, w, {E.rounded('near_turn')} AS near_turn, {E.rounded('wide_turn')} AS wide_turn, arms FROM turns),
around AS (SELECT ring_id, pos, n, wide_turn, explode(sequence(-w, w)) AS d FROM exact WHERE n > 8),
beaten AS (
  SELECT DISTINCT t.ring_id, t.pos FROM around t JOIN exact o ON o.ring_id = t.ring_id AND o.pos = (t.pos + t.d + t.n) % t.n
  WHERE t.d <> 0 AND (o.wide_turn > t.wide_turn OR (o.wide_turn = t.wide_turn AND o.pos < t.pos))
)
SELECT t.ring_id, CASE WHEN near_turn >= 45 AND wide_turn >= 35 AND arms >= 0.75 AND b.pos IS NULL THEN 'HARD_CORNER' WHEN wide_turn >= 20 OR near_turn >= 12 THEN 'SOFT_CORNER' ELSE 'REGULAR' END AS class,
       count(*) AS points
FROM exact t LEFT JOIN beaten b ON b.ring_id = t.ring_id AND b.pos = t.pos GROUP BY 1, 2""")

junction_metrics = Operator(f"""
WITH {_CYCLE}, turns AS (SELECT ring_id, {E.rounded(_TURN)} AS turn FROM cyc),
classed AS (SELECT ring_id, turn, CASE WHEN turn >= 38 THEN 'INTENTIONAL_CORNER' WHEN turn <= 25 THEN 'SMOOTH_JUNCTION' ELSE 'AMBIGUOUS_JUNCTION' END AS class FROM turns)
SELECT ring_id, class, count(*) AS junctions, {E.rounded('avg(turn)')} AS mean_turn, max(turn) AS max_turn,
       {E.rounded("avg(CASE class WHEN 'INTENTIONAL_CORNER' THEN least(1e0, 0.7e0 + (turn - 38e0) / 50e0) WHEN 'SMOOTH_JUNCTION' THEN least(1e0, 0.7e0 + (25e0 - turn) / 25e0) ELSE 0.5e0 END)")} AS confidence
FROM classed GROUP BY ring_id, class""")

long_range_runs = Operator(f"""
WITH {_CYCLE}, turns AS (SELECT ring_id, pos, x, y, px, py, CASE WHEN {_TURN} >= 38 THEN 1 ELSE 0 END AS cut FROM cyc),
runs AS (SELECT *, sum(cut) OVER (PARTITION BY ring_id ORDER BY pos) AS run FROM turns)
SELECT ring_id, CAST(run AS BIGINT) AS run, count(*) AS points, min(pos) AS first_pos, max(pos) AS last_pos,
       {E.rounded('sum(CASE WHEN cut = 0 THEN ' + E.distance(('x', 'px'), ('y', 'py')) + ' ELSE 0e0 END)')} AS length
FROM runs GROUP BY ring_id, run""")

chord_parameters = Operator(f"""
WITH steps AS (SELECT ring_id, pos, coalesce({E.distance(('x', 'lag(x) OVER w'), ('y', 'lag(y) OVER w'))}, 0e0) AS step FROM {{rings}} WINDOW w AS (PARTITION BY ring_id ORDER BY pos)),
sums AS (SELECT ring_id, pos, sum(step) OVER (PARTITION BY ring_id ORDER BY pos) AS walked, sum(step) OVER (PARTITION BY ring_id) AS total FROM steps)
SELECT ring_id, pos, CASE WHEN total = 0 THEN 0e0 ELSE {E.rounded('walked / total')} END AS t FROM sums""")

residual_alternation = Operator(f"""
WITH {_CYCLE},
offs AS (SELECT ring_id, pos, y - (py + ny) / 2 AS off FROM cyc),
signs AS (SELECT ring_id, pos, abs(off) AS size, CASE WHEN off > 0.05 THEN 1 WHEN off < -0.05 THEN -1 ELSE 0 END AS sign FROM offs),
flips AS (SELECT ring_id, size, CASE WHEN sign * lag(sign) OVER (PARTITION BY ring_id ORDER BY pos) < 0 THEN 1 ELSE 0 END AS flip FROM signs)
SELECT ring_id, {E.rounded('avg(size)')} AS mean_off, {E.rounded('max(size)')} AS max_off, {E.rounded('CAST(sum(flip) AS DOUBLE) / greatest(1, count(*) - 1)')} AS alternation,
       CAST(sum(flip) AS DOUBLE) / greatest(1, count(*) - 1) >= 0.40 AND max(size) <= 1.4 AS stair_step
FROM flips GROUP BY ring_id""")

# Segments meet only others of their ring that reach into the same strip of eight units; the higher of two first strips makes a pair unique.
_STRIP = 8
_SEGMENTS = f"""segs AS (
  SELECT ring_id, pos, n, x AS x1, y AS y1, nx AS x2, ny AS y2, least(x, nx) AS lx, greatest(x, nx) AS hx, least(y, ny) AS ly, greatest(y, ny) AS hy,
         {E.whole(f'least(y, ny) / {_STRIP}')} AS first_strip FROM cyc
),
cut AS (SELECT *, explode(sequence(first_strip, {E.whole(f'hy / {_STRIP}')})) AS strip FROM segs)"""


def _side(a: str, b: str, c: str) -> str:
    return f"((x_{b} - x_{a}) * (y_{c} - y_{a}) - (y_{b} - y_{a}) * (x_{c} - x_{a}))"


segment_intersections = Operator(f"""
WITH {_CYCLE}, {_SEGMENTS},
pairs AS (
  SELECT p.ring_id, p.x1 AS x_a, p.y1 AS y_a, p.x2 AS x_b, p.y2 AS y_b, q.x1 AS x_c, q.y1 AS y_c, q.x2 AS x_d, q.y2 AS y_d
  FROM cut p JOIN cut q ON q.ring_id = p.ring_id AND q.strip = p.strip AND p.strip = greatest(p.first_strip, q.first_strip) AND q.pos > p.pos + 1 AND NOT (p.pos = 0 AND q.pos = p.n - 1)
    AND p.lx <= q.hx AND q.lx <= p.hx AND p.ly <= q.hy AND q.ly <= p.hy
)
SELECT ring_id, count(*) AS close_pairs,
       CAST(sum(CASE WHEN {_side('a', 'b', 'c')} * {_side('a', 'b', 'd')} < 0 AND {_side('c', 'd', 'a')} * {_side('c', 'd', 'b')} < 0 THEN 1 ELSE 0 END) AS BIGINT) AS crossings,
       CAST(sum(CASE WHEN {_side('a', 'b', 'c')} = 0 AND {_side('a', 'b', 'd')} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS overlaps
FROM pairs GROUP BY ring_id""")

# The centroid of every ring, and its sides that a ray to the right may cross.
_point_in_ring = Operator(f"""
WITH {_CYCLE}
SELECT ring_id, avg(x) AS qx, avg(y) AS qy, collect_list(CASE WHEN y <> ny AND x IS NOT NULL AND nx IS NOT NULL THEN named_struct('x', x, 'y', y, 'nx', nx, 'ny', ny) END) AS sides FROM cyc GROUP BY ring_id""")


def point_in_ring(rings: DataFrame) -> DataFrame:
    """probe_id, ring_id, crossings: rings and the centroids of other rings that lie in them; equal rings are probed once in a block."""
    of = classes(rings)
    return points_in_rings(_point_in_ring(rings=firsts(rings, of)), of)


# Equal boxes are compared once, with their number and the smallest node among them; a parent is larger, so never one of them.
containment_tree = Operator("""
WITH boxes AS (SELECT doc_id, node_id, x_mm AS x0, y_mm AS y0, x_mm + w_mm AS x1, y_mm + h_mm AS y1, w_mm * h_mm AS area FROM {nodes} WHERE w_mm > 0 AND type <> 'technical_guide'),
kinds AS (SELECT doc_id, x0, y0, x1, y1, area, min(node_id) AS node_id, count(*) AS n FROM boxes GROUP BY doc_id, x0, y0, x1, y1, area),
holds AS (
  SELECT c.doc_id, c.x0, c.y0, c.x1, c.y1, c.area, min(named_struct('area', p.area, 'node_id', p.node_id)) AS parent, sum(p.n) AS depth
  FROM kinds c JOIN kinds p ON p.doc_id = c.doc_id AND p.area > c.area AND p.x0 <= c.x0 + 0.01 AND p.y0 <= c.y0 + 0.01 AND p.x1 >= c.x1 - 0.01 AND p.y1 >= c.y1 - 0.01
  GROUP BY c.doc_id, c.x0, c.y0, c.x1, c.y1, c.area
)
SELECT b.doc_id, b.node_id, h.parent.node_id AS parent_region, CAST(coalesce(h.depth, 0) AS BIGINT) AS depth
FROM boxes b LEFT JOIN holds h ON h.doc_id = b.doc_id AND h.x0 = b.x0 AND h.y0 = b.y0 AND h.x1 = b.x1 AND h.y1 = b.y1 AND h.area = b.area""")

_CELL = 8


def nearest_by_grid() -> str:
    """gaps(pair_id, way, pos, d): distance of every point of one outline to the nearest of another, for ways(pair_id, way, from_id, to_id).

    The nine cells around a point answer if their nearest lies within a cell's width; only the other points look at the whole outline.
    """
    gap = E.distance(("q.x", "s.x"), ("q.y", "s.y"))
    return f"""spots AS (SELECT ring_id, pos, x, y, {E.whole(f'x / {_CELL}')} AS cx, {E.whole(f'y / {_CELL}')} AS cy FROM {{rings}}),
asked AS (SELECT w.pair_id, w.way, w.to_id, s.pos, s.x, s.y, s.cx, s.cy FROM {{ways}} w JOIN spots s ON s.ring_id = w.from_id),
around AS (SELECT -1 AS d UNION ALL SELECT 0 UNION ALL SELECT 1),
cells AS (SELECT a.pair_id, a.way, a.to_id, a.pos, a.x, a.y, a.cx + i.d AS gx, a.cy + j.d AS gy FROM asked a JOIN around i ON true JOIN around j ON true),
close AS (SELECT /*+ MERGE(s) */ q.pair_id, q.way, q.pos, min({gap}) AS d FROM cells q JOIN spots s ON s.ring_id = q.to_id AND s.cx = q.gx AND s.cy = q.gy GROUP BY q.pair_id, q.way, q.pos),
far AS (
  SELECT /*+ MERGE(c, s) */ q.pair_id, q.way, q.pos, min({gap}) AS d FROM asked q LEFT JOIN close c ON c.pair_id = q.pair_id AND c.way = q.way AND c.pos = q.pos JOIN spots s ON s.ring_id = q.to_id
  WHERE c.d IS NULL OR c.d > {_CELL} GROUP BY q.pair_id, q.way, q.pos
),
gaps AS (SELECT pair_id, way, pos, d FROM close WHERE d <= {_CELL} UNION ALL SELECT pair_id, way, pos, d FROM far)"""


_chamfer_hausdorff = Operator(f"""
WITH {nearest_by_grid()},
ranked AS (SELECT pair_id, d, row_number() OVER (PARTITION BY pair_id ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY pair_id) AS n FROM gaps)
SELECT pair_id, count(*) AS points, {E.rounded('avg(d)')} AS chamfer, {E.rounded('max(d)')} AS hausdorff, {E.rounded(f"max(CASE WHEN k = {E.whole('n * 0.95')} THEN d END)")} AS p95
FROM ranked GROUP BY pair_id""")


def chamfer_hausdorff(rings: DataFrame) -> DataFrame:
    """a_id, b_id, points, chamfer, hausdorff, p95 of the points of every ring to the ring of the next number."""
    told = next_rings(rings, lambda first, ways: _chamfer_hausdorff(rings=first, ways=ways.where("way = 0")))
    return told.selectExpr("pair_id AS a_id", "pair_id + 1 AS b_id", "points", "chamfer", "hausdorff", "p95")
