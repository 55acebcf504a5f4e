"""Registered queries of geometry on free outlines and label maps, with oracles by plain means: every point against every side, walks from every edge."""

from __future__ import annotations

from inkfold.operators import arrangement, clustering, contours, coupling, fields, fitting, hierarchy, kernels, planar, reassignment, selection
from inkfold.operators.graph import cut
from inkfold.plans.registry import register
from inkfold.plans.views import oracle, view
from inkfold.sources import svg

def _r4(x: str) -> str:
    return f"floor({x} * 10000 + 0.5) / 10000"


_P = "0.3137"  # offset of the sample grid of covered_cells


def _covered(spark, sf_dir):
    return arrangement.covered_cells(arrangement.union(view(spark, sf_dir, "art_outlines")))


_WINDING = f"""
WITH sides AS (
  SELECT doc_id, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM art_outlines WINDOW w AS (PARTITION BY doc_id, ring_id ORDER BY pos)
),
bounds AS (SELECT doc_id, CAST(floor(min(x) / 4) AS BIGINT) - 1 AS c0, CAST(floor(max(x) / 4) AS BIGINT) + 2 AS c1, CAST(floor(min(y) / 4) AS BIGINT) - 1 AS r0, CAST(floor(max(y) / 4) AS BIGINT) + 2 AS r1 FROM sides GROUP BY doc_id),
lines AS (SELECT doc_id, c0, c1, unnest(range(r0, r1)) AS row FROM bounds),
spots AS (SELECT doc_id, row, unnest(range(c0, c1)) AS col FROM lines),
turns AS (
  SELECT p.doc_id, p.row, p.col, sum(CASE WHEN ny > y THEN 1 ELSE -1 END) AS winding FROM spots p JOIN sides s ON s.doc_id = p.doc_id AND least(y, ny) <= row * 4 + {_P} AND row * 4 + {_P} < greatest(y, ny)
  WHERE x + (nx - x) * (row * 4 + {_P} - y) / (ny - y) < col * 4 + {_P} GROUP BY p.doc_id, p.row, p.col
)
SELECT doc_id, row, CAST(count(*) AS BIGINT) AS cells FROM turns WHERE winding <> 0 GROUP BY doc_id, row"""
register("outline_union_cells", _covered, oracle(_WINDING, ["art_outlines"]))
register("outline_union", lambda spark, sf_dir: arrangement.ring_areas(arrangement.union(view(spark, sf_dir, "art_outlines"))))
register("cut_contours", lambda spark, sf_dir: arrangement.ring_areas(arrangement.cut_contours(view(spark, sf_dir, "art_outlines"))))

# Sides of pixels by comparing neighbours; the outline goes on at the side that turns most to the right.
_SIDES = """
WITH cells AS (SELECT image_id, x, y, label FROM {0} WHERE label IS NOT NULL),
ways(dx, dy, ax, ay, bx, by_) AS (VALUES (0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0)),
sides AS (
  SELECT c.image_id, c.label, o.label AS other, c.x + ax AS x0, c.y + ay AS y0, c.x + bx AS x1, c.y + by_ AS y1, row_number() OVER (PARTITION BY c.image_id ORDER BY c.y, c.x, dy, dx) AS e
  FROM cells c CROSS JOIN ways LEFT JOIN cells o ON o.image_id = c.image_id AND o.x = c.x + dx AND o.y = c.y + dy WHERE o.label IS DISTINCT FROM c.label
)"""
_TRACED = (
    _SIDES.format("mosaic")
    + """,
links AS (
  SELECT a.image_id, a.e, arg_max(b.e, (a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0)) AS nxt
  FROM sides a JOIN sides b ON b.image_id = a.image_id AND b.label = a.label AND b.x0 = a.x1 AND b.y0 = a.y1 GROUP BY a.image_id, a.e
),
walk AS (SELECT image_id, e AS root, e FROM sides UNION SELECT w.image_id, w.root, l.nxt FROM walk w JOIN links l ON l.image_id = w.image_id AND l.e = w.e AND l.nxt > w.root),
owned AS (SELECT image_id, e, min(root) AS ring FROM walk GROUP BY image_id, e)
SELECT s.image_id, s.label, row_number() OVER (PARTITION BY s.image_id, s.label ORDER BY min(y0 * 100000 + x0)) - 1 AS ring_no, sum(x0 * y1 - x1 * y0) < 0 AS is_hole, count(*) AS points, abs(sum(x0 * y1 - x1 * y0)) / 2.0 AS area
FROM sides s JOIN owned o ON o.image_id = s.image_id AND o.e = s.e GROUP BY s.image_id, s.label, o.ring"""
)
_UNNUMBERED = ["image_id", "label", "is_hole", "points", "area"]
register(
    "trace_rings",
    lambda spark, sf_dir: planar.trace_rings(view(spark, sf_dir, "mosaic")).select(*_UNNUMBERED),
    oracle(_TRACED.replace(" row_number() OVER (PARTITION BY s.image_id, s.label ORDER BY min(y0 * 100000 + x0)) - 1 AS ring_no,", ""), ["mosaic"], recursive=True),
)

_ARCS = """,
kept AS (SELECT * FROM sides WHERE other IS NULL OR label < other),
ends AS (SELECT image_id, x0 AS x, y0 AS y FROM kept UNION ALL SELECT image_id, x1, y1 FROM kept),
plain AS (SELECT image_id, x, y FROM ends GROUP BY image_id, x, y HAVING count(*) = 2),
links AS (
  SELECT a.image_id, a.e, b.e AS nxt FROM kept a JOIN plain p ON p.image_id = a.image_id AND ((p.x = a.x0 AND p.y = a.y0) OR (p.x = a.x1 AND p.y = a.y1))
  JOIN kept b ON b.image_id = a.image_id AND b.e <> a.e AND ((p.x = b.x0 AND p.y = b.y0) OR (p.x = b.x1 AND p.y = b.y1))
),
walk AS (SELECT image_id, e AS root, e FROM kept UNION SELECT w.image_id, w.root, l.nxt FROM walk w JOIN links l ON l.image_id = w.image_id AND l.e = w.e AND l.nxt > w.root),
owned AS (SELECT image_id, e, min(root) AS arc FROM walk GROUP BY image_id, e)
SELECT k.image_id, k.label, k.other, count(*) AS n, sum(abs(x0 - x1) + abs(y0 - y1)) AS length, min(least(x0, x1)) AS min_x, max(greatest(y0, y1)) AS max_y FROM kept k JOIN owned o ON o.image_id = k.image_id AND o.e = k.e GROUP BY k.image_id, k.label, k.other, o.arc"""


def _arcs(found):
    return found.groupBy("image_id", "label", "other", "arc", "n").agg(
        *(planar.F.expr(e).alias(n) for e, n in (("sum(abs(x0 - x1) + abs(y0 - y1))", "length"), ("min(least(x0, x1))", "min_x"), ("max(greatest(y0, y1))", "max_y")))
    ).drop("arc")


register("boundary_arcs", lambda spark, sf_dir: _arcs(planar.shared_boundaries(view(spark, sf_dir, "mosaic"))), oracle(_SIDES.format("mosaic") + _ARCS, ["mosaic"], recursive=True))
_OWNERS = "SELECT DISTINCT image_id, label, label % 3 AS owner FROM {mosaic} WHERE label IS NOT NULL"


def _dissolved(spark, sf_dir):
    mosaic = view(spark, sf_dir, "mosaic")
    return _arcs(planar.dissolve_seams(mosaic, spark.sql(_OWNERS, mosaic=mosaic)))


register("seam_dissolve", _dissolved, oracle(_SIDES.format("mosaic").replace("SELECT image_id, x, y, label FROM", "SELECT image_id, x, y, label % 3 AS label FROM") + _ARCS, ["mosaic"], recursive=True))

# Waves from distances walked beforehand; then each wave's offers from the wave before.
_FIELD = """
WITH near AS (
  SELECT r.image_id, r.label, arg_min(p.proto_id, (r.ok_l - p.ok_l) ** 2 + (r.ok_a - p.ok_a) ** 2 + (r.ok_b - p.ok_b) ** 2) AS proto_id FROM mosaic_regions r, mosaic_prototypes p WHERE r.structural GROUP BY r.image_id, r.label
),
same AS (SELECT e.image_id, region_a AS p, region_b AS q FROM mosaic_edges e JOIN near a ON a.image_id = e.image_id AND a.label = region_a JOIN near b ON b.image_id = e.image_id AND b.label = region_b WHERE a.proto_id = b.proto_id),
both_ways AS (SELECT image_id, p, q FROM same UNION SELECT image_id, q, p FROM same),
joined AS (SELECT image_id, label, label AS root FROM near UNION SELECT j.image_id, b.q, j.root FROM joined j JOIN both_ways b ON b.image_id = j.image_id AND b.p = j.label),
parts AS (SELECT j.image_id, j.label, min(root) AS component, any_value(n.proto_id) AS proto_id FROM joined j JOIN near n ON n.image_id = j.image_id AND n.label = j.label GROUP BY j.image_id, j.label),
px AS (SELECT m.image_id, m.x, m.y, m.label, {l} AS ok_l, {a} AS ok_a, {b} AS ok_b, p.component AS own, p.proto_id FROM mosaic m LEFT JOIN parts p ON p.image_id = m.image_id AND p.label = m.label),
size AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px GROUP BY image_id),
ways(dx, dy) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)),
held AS (
  SELECT p.image_id, p.x, p.y, p.own, bool_and(p.x + dx < s.x0 OR p.x + dx > s.x1 OR p.y + dy < s.y0 OR p.y + dy > s.y1 OR coalesce(q.own = p.own, false)) AS inside
  FROM px p JOIN size s ON s.image_id = p.image_id CROSS JOIN ways LEFT JOIN px q ON q.image_id = p.image_id AND q.x = p.x + dx AND q.y = p.y + dy WHERE p.own IS NOT NULL GROUP BY p.image_id, p.x, p.y, p.own
),
seeds AS (SELECT image_id, x, y, own FROM held WHERE inside UNION SELECT image_id, x, y, own FROM held QUALIFY NOT bool_or(inside) OVER (PARTITION BY image_id, own) AND row_number() OVER (PARTITION BY image_id, own ORDER BY y, x) = 1),
reach AS (SELECT image_id, x, y, 0 AS d FROM seeds UNION SELECT r.image_id, p.x, p.y, r.d + 1 FROM reach r CROSS JOIN ways JOIN px p ON p.image_id = r.image_id AND p.x = r.x + dx AND p.y = r.y + dy WHERE r.d < 60),
waves AS (SELECT image_id, x, y, min(d) AS wave FROM reach GROUP BY image_id, x, y),
colours AS (SELECT DISTINCT p.image_id, p.component, p.proto_id, q.ok_l, q.ok_a, q.ok_b FROM parts p JOIN mosaic_prototypes q ON q.proto_id = p.proto_id),
field AS (
  SELECT image_id, x, y, 0 AS wave, own AS component, NULL::DOUBLE AS gap FROM seeds
  UNION ALL
  SELECT image_id, x, y, wave, list(component ORDER BY cost, component)[1], (list(cost ORDER BY cost, component)[2] - list(cost ORDER BY cost, component)[1]) FROM (
    SELECT w.image_id, w.x, w.y, w.wave, f.component, min(w.wave + 12 * sqrt((t.ok_l - c.ok_l) ** 2 + (t.ok_a - c.ok_a) ** 2 + (t.ok_b - c.ok_b) ** 2)
      + CASE WHEN t.label <> s.label AND t.proto_id IS DISTINCT FROM s.proto_id AND coalesce(e.avg_strength, 0) >= 0.45 THEN 1000 ELSE 0 END) AS cost
    FROM field f CROSS JOIN ways JOIN waves w ON w.image_id = f.image_id AND w.x = f.x + dx AND w.y = f.y + dy AND w.wave = f.wave + 1
    JOIN px t ON t.image_id = w.image_id AND t.x = w.x AND t.y = w.y JOIN px s ON s.image_id = f.image_id AND s.x = f.x AND s.y = f.y JOIN colours c ON c.image_id = f.image_id AND c.component = f.component
    LEFT JOIN mosaic_edges e ON e.image_id = f.image_id AND e.region_a = least(t.label, s.label) AND e.region_b = greatest(t.label, s.label)
    GROUP BY w.image_id, w.x, w.y, w.wave, f.component) q GROUP BY image_id, x, y, wave
)
SELECT p.image_id, p.x, p.y, CASE WHEN coalesce(f.gap <= 0.5, false) THEN NULL ELSE f.component END AS component, CASE WHEN coalesce(f.gap <= 0.5, false) THEN NULL ELSE c.proto_id END AS proto_id, CAST(f.wave AS BIGINT) AS wave, coalesce(f.gap <= 0.5, false) AS ambiguous
FROM px p LEFT JOIN field f ON f.image_id = p.image_id AND f.x = p.x AND f.y = p.y LEFT JOIN colours c ON c.image_id = f.image_id AND c.component = f.component"""
_OK = dict(zip("lab", fields.E.oklab("r", "g", "b"), strict=True))


def _field(spark, sf_dir):
    """The mosaic is made once for its regions, edges and prototypes too."""
    held = {"mosaic": cut(view(spark, sf_dir, "mosaic"))}
    return fields.prototype_field(*(view(spark, sf_dir, n, held) for n in ("mosaic", "mosaic_regions", "mosaic_edges", "mosaic_prototypes")))


register(
    "prototype_field",
    _field,
    oracle(_FIELD.format(**_OK), ["mosaic", "mosaic_regions", "mosaic_edges", "mosaic_prototypes"], recursive=True),
)

_BRIDGED = """
WITH cells AS (SELECT image_id, label, x, y, row_number() OVER (PARTITION BY image_id ORDER BY y, x) AS id FROM mosaic WHERE label IS NOT NULL),
links AS (SELECT a.image_id, a.id AS p, b.id AS q FROM cells a JOIN cells b ON b.image_id = a.image_id AND b.label = a.label AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
walk AS (SELECT image_id, id, id AS root FROM cells UNION SELECT w.image_id, l.q, w.root FROM walk w JOIN links l ON l.image_id = w.image_id AND l.p = w.id AND l.q > w.root),
owned AS (SELECT image_id, id, min(root) AS part FROM walk GROUP BY image_id, id),
boxes AS (SELECT c.image_id, c.label, o.part, count(*) AS area, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells c JOIN owned o ON o.image_id = c.image_id AND o.id = c.id GROUP BY c.image_id, c.label, o.part),
close AS (SELECT a.image_id, a.part AS p, b.part AS q FROM boxes a JOIN boxes b ON b.image_id = a.image_id AND b.label = a.label AND a.part <> b.part
  AND greatest(0, a.x0 - b.x1 - 1, b.x0 - a.x1 - 1) ** 2 + greatest(0, a.y0 - b.y1 - 1, b.y0 - a.y1 - 1) ** 2 <= 4),
reach AS (SELECT image_id, part, part AS root FROM boxes UNION SELECT r.image_id, c.q, r.root FROM reach r JOIN close c ON c.image_id = r.image_id AND c.p = r.part),
whole AS (SELECT image_id, part, min(root) AS root FROM reach GROUP BY image_id, part)
SELECT b.image_id, b.label, count(*) AS parts, CAST(sum(area) AS BIGINT) AS area, min(x0) AS min_x, max(x1) AS max_x, min(y0) AS min_y, max(y1) AS max_y, row_number() OVER (PARTITION BY b.image_id ORDER BY w.root) - 1 AS logical
FROM boxes b JOIN whole w ON w.image_id = b.image_id AND w.part = b.part GROUP BY b.image_id, b.label, w.root"""
register("bridged_components", lambda spark, sf_dir: fields.bridged_components(view(spark, sf_dir, "mosaic")), oracle(_BRIDGED, ["mosaic"], recursive=True))


_ISLANDS = """
WITH cells AS (SELECT image_id, label, x, y, row_number() OVER (PARTITION BY image_id ORDER BY y, x) AS id FROM mosaic WHERE label IS NOT NULL),
links AS (SELECT a.image_id, a.id AS p, b.id AS q FROM cells a JOIN cells b ON b.image_id = a.image_id AND b.label = a.label AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
walk AS (SELECT image_id, id, id AS root FROM cells UNION SELECT w.image_id, l.q, w.root FROM walk w JOIN links l ON l.image_id = w.image_id AND l.p = w.id AND l.q > w.root),
owned AS (SELECT image_id, id, min(root) AS part FROM walk GROUP BY image_id, id),
islands AS (SELECT image_id, part FROM owned GROUP BY image_id, part HAVING count(*) < 12),
sides AS (
  SELECT i.image_id, i.part, b.label, count(*) AS n FROM islands i JOIN owned o ON o.image_id = i.image_id AND o.part = i.part JOIN cells a ON a.image_id = o.image_id AND a.id = o.id
  JOIN cells b ON b.image_id = a.image_id AND b.label <> a.label AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY i.image_id, i.part, b.label
),
owners AS (SELECT image_id, part, label FROM sides QUALIFY row_number() OVER (PARTITION BY image_id, part ORDER BY n DESC, label) = 1)
SELECT c.image_id, c.x, c.y, coalesce(w.label, c.label) AS label, i.part IS NOT NULL AS island FROM cells c JOIN owned o ON o.image_id = c.image_id AND o.id = c.id
LEFT JOIN islands i ON i.image_id = o.image_id AND i.part = o.part LEFT JOIN owners w ON w.image_id = o.image_id AND w.part = o.part"""
register("island_removal", lambda spark, sf_dir: fields.remove_islands(view(spark, sf_dir, "mosaic")), oracle(_ISLANDS, ["mosaic"], recursive=True))


def _tree(name: str) -> str:
    """Common tables tree_<name> and adjacent_<name> of a relation of outlines: every probe against every side of the document."""
    return f"""
{name}_sides AS (
  SELECT doc_id, ring_id, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY doc_id, ring_id) AS n FROM {name} WINDOW w AS (PARTITION BY doc_id, ring_id ORDER BY pos)
),
{name}_areas AS (SELECT doc_id, ring_id, abs(sum(x * ny - nx * y)) / 2 AS area FROM {name}_sides WHERE n >= 3 GROUP BY doc_id, ring_id),
{name}_held AS (
  SELECT p.doc_id, p.ring_id AS inner_id, s.ring_id AS outer_id, q, count(*) AS met FROM (SELECT *, unnest([0, n // 4, n // 2, 3 * n // 4]) AS at, unnest([0, 1, 2, 3]) AS q FROM {name}_sides WHERE n >= 3) p JOIN {name}_sides s ON s.doc_id = p.doc_id AND s.ring_id <> p.ring_id AND s.n >= 3
  WHERE p.k = p.at AND (s.y > p.y) <> (s.ny > p.y) AND p.x < (s.nx - s.x) * (p.y - s.y) / (s.ny - s.y) + s.x GROUP BY ALL
),
{name}_in AS (SELECT h.doc_id, inner_id, outer_id, o.area FROM {name}_held h JOIN {name}_areas o ON o.doc_id = h.doc_id AND o.ring_id = outer_id JOIN {name}_areas i ON i.doc_id = h.doc_id AND i.ring_id = inner_id
  WHERE met % 2 = 1 AND o.area > i.area GROUP BY h.doc_id, inner_id, outer_id, o.area HAVING count(*) >= 3),
{name}_parents AS (SELECT a.doc_id, a.ring_id, a.area, (SELECT i.outer_id FROM {name}_in i WHERE i.doc_id = a.doc_id AND i.inner_id = a.ring_id ORDER BY i.area, i.outer_id LIMIT 1) AS parent FROM {name}_areas a),
{name}_depths AS (SELECT doc_id, ring_id, 0 AS depth FROM {name}_parents WHERE parent IS NULL UNION ALL SELECT p.doc_id, p.ring_id, d.depth + 1 FROM {name}_depths d JOIN {name}_parents p ON p.doc_id = d.doc_id AND p.parent = d.ring_id),
{name}_tree AS (SELECT p.doc_id, p.ring_id, round(p.area, 6) AS area, p.parent, CAST(d.depth AS BIGINT) AS depth, CASE WHEN d.depth = 0 THEN 'OUTER' WHEN d.depth % 2 = 1 THEN 'HOLE' ELSE 'ISLAND' END AS role FROM {name}_parents p JOIN {name}_depths d ON d.doc_id = p.doc_id AND d.ring_id = p.ring_id),
{name}_adjacent AS (SELECT a.doc_id, a.ring_id AS ring_a, b.ring_id AS ring_b FROM {name} a JOIN {name} b ON b.doc_id = a.doc_id AND b.ring_id > a.ring_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 6.25 GROUP BY ALL HAVING count(DISTINCT a.pos) >= 2),
{name}_signature AS (
  SELECT t.doc_id, count(*) AS components, count(*) FILTER (WHERE role = 'HOLE') AS holes, count(*) FILTER (WHERE role = 'ISLAND') AS islands, max(depth) AS max_depth, (SELECT count(*) FROM {name}_adjacent a WHERE a.doc_id = t.doc_id) AS adjacent FROM {name}_tree t GROUP BY t.doc_id
)"""


register("ring_hierarchy", lambda spark, sf_dir: hierarchy.ring_tree(view(spark, sf_dir, "art_outlines")), oracle(f"WITH {_tree('art_outlines').strip()} SELECT * FROM art_outlines_tree", ["art_outlines"], recursive=True))
register("topology_signature", lambda spark, sf_dir: hierarchy.topology_signature(view(spark, sf_dir, "art_outlines")), oracle(f"WITH {_tree('art_outlines').strip()} SELECT * FROM art_outlines_signature", ["art_outlines"], recursive=True))
_INVARIANTS = f"""WITH {_tree('art_outlines').strip()},{_tree('redrawn_outlines')},
moved AS (
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, count(*) FILTER (WHERE b.ring_id IS NULL) AS lost, count(*) FILTER (WHERE a.ring_id IS NULL) AS added
  FROM (SELECT DISTINCT doc_id, ring_id FROM art_outlines) a FULL JOIN (SELECT DISTINCT doc_id, ring_id FROM redrawn_outlines) b ON b.doc_id = a.doc_id AND b.ring_id = a.ring_id GROUP BY 1
),
told AS (
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, greatest(coalesce(a.holes, 0) - coalesce(b.holes, 0), 0) AS holes_lost,
         concat_ws(',', CASE WHEN a.components IS DISTINCT FROM b.components THEN 'COMPONENT_COUNT' END, CASE WHEN coalesce(a.holes, 0) <> coalesce(b.holes, 0) THEN 'HOLE_COUNT' END,
           CASE WHEN coalesce(a.max_depth, 0) <> coalesce(b.max_depth, 0) THEN 'NESTING_DEPTH' END, CASE WHEN abs(coalesce(a.adjacent, 0) - coalesce(b.adjacent, 0)) > 2 THEN 'ADJACENCY' END) AS violations
  FROM art_outlines_signature a FULL JOIN redrawn_outlines_signature b ON b.doc_id = a.doc_id
)
SELECT t.doc_id, lost, added, holes_lost, violations, violations = '' AS kept FROM told t JOIN moved m ON m.doc_id = t.doc_id"""
register(
    "topology_invariants",
    lambda spark, sf_dir: hierarchy.topology_invariants(view(spark, sf_dir, "art_outlines"), view(spark, sf_dir, "redrawn_outlines")),
    oracle(_INVARIANTS, ["art_outlines", "redrawn_outlines"], recursive=True),
)

# Every point of a fragment against every point of every larger ring of its document.
_LABS = {p: dict(zip("lab", fields.E.cielab(*c), strict=True)) for p, c in (("own", ("o0", "o1", "o2")), ("under", ("r", "g", "b")))}
_REASSIGNED = f"""
WITH sides AS (SELECT doc_id, ring_id, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM fragment_outlines WINDOW w AS (PARTITION BY doc_id, ring_id ORDER BY pos)),
areas AS (SELECT doc_id, ring_id, abs(sum(x * ny - nx * y)) / 2 AS area FROM sides GROUP BY doc_id, ring_id),
sized AS (SELECT a.doc_id, a.ring_id, a.area, f.fill, f.r, f.g, f.b FROM areas a JOIN ring_fills f ON f.doc_id = a.doc_id AND f.ring_id = a.ring_id),
gaps AS (
  SELECT s.doc_id, s.ring_id, l.fill AS owner, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS d FROM sized s JOIN sized l ON l.doc_id = s.doc_id AND s.area < 25 AND l.area >= 25
  JOIN fragment_outlines p ON p.doc_id = s.doc_id AND p.ring_id = s.ring_id JOIN fragment_outlines q ON q.doc_id = l.doc_id AND q.ring_id = l.ring_id
),
met AS (SELECT doc_id, ring_id, owner, count(*) FILTER (WHERE d < 1) AS shared, min(d) AS least FROM gaps WHERE d < 2.5 GROUP BY ALL),
free AS (SELECT * FROM met QUALIFY owner NOT IN ('#ffffff', '#fefefe') OR NOT bool_or(owner NOT IN ('#ffffff', '#fefefe')) OVER (PARTITION BY doc_id, ring_id)),
wide AS (SELECT f.*, s.r, s.g, s.b, CAST(('0x' || substr(owner, 2, 2)) AS INT) AS o0, CAST(('0x' || substr(owner, 4, 2)) AS INT) AS o1, CAST(('0x' || substr(owner, 6, 2)) AS INT) AS o2 FROM free f JOIN sized s ON s.doc_id = f.doc_id AND s.ring_id = f.ring_id),
scored AS (
  SELECT doc_id, ring_id, owner, round(20 * shared + greatest(0, 10 - 2 * least) + greatest(0, 50 - sqrt(({_LABS['own']['l']} - ({_LABS['under']['l']})) ** 2 + ({_LABS['own']['a']} - ({_LABS['under']['a']})) ** 2 + ({_LABS['own']['b']} - ({_LABS['under']['b']})) ** 2)), 6) AS score FROM wide
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, ring_id ORDER BY score DESC, owner) = 1),
told AS (
  SELECT s.doc_id, s.ring_id, s.area, s.fill, b.owner, b.score, CASE WHEN b.score > 10 THEN least(1.0, b.score / 100) ELSE 0.0 END AS confidence FROM sized s LEFT JOIN best b ON b.doc_id = s.doc_id AND b.ring_id = s.ring_id WHERE s.area < 25
),
moved AS (SELECT *, coalesce(confidence >= 0.5 AND owner <> fill, false) AS moves, CASE WHEN coalesce(confidence >= 0.5 AND owner <> fill, false) THEN (CAST(fill IN ('#ffffff', '#fefefe') AS INT) - CAST(owner IN ('#ffffff', '#fefefe') AS INT)) * area ELSE 0 END AS change FROM told),
done AS (SELECT *, CASE WHEN NOT moves THEN 'PRESERVED' WHEN change <> 0 AND abs(sum(change) OVER (PARTITION BY doc_id)) > 5 THEN 'ROLLED_BACK' ELSE 'REASSIGNED' END AS action FROM moved)
SELECT doc_id, ring_id, round(area, 6) AS area, fill, CASE WHEN action = 'REASSIGNED' THEN owner ELSE fill END AS owner, score, round(confidence, 6) AS confidence, action FROM done"""
register(
    "fragment_reassignment",
    lambda spark, sf_dir: reassignment.reassign_fragments(view(spark, sf_dir, "fragment_outlines"), view(spark, sf_dir, "ring_fills")),
    oracle(_REASSIGNED, ["fragment_outlines", "ring_fills"]),
)

# Pairs in order of rank, one after the other, with the numbers already used.
_MATCHED = """
WITH pairs AS (
  SELECT a.doc_id, a.node_id AS a_id, b.node_id AS b_id, (a.x1 - a.x0) * (a.y1 - a.y0) AS a_area, (b.x1 - b.x0) * (b.y1 - b.y0) AS b_area,
         greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared, sqrt(((a.x0 + a.x1 - b.x0 - b.x1) / 2) ** 2 + ((a.y0 + a.y1 - b.y0 - b.y1) / 2) ** 2) AS gap
  FROM art_boxes a JOIN redrawn_boxes b ON b.doc_id = a.doc_id AND b.fill = a.fill
),
offers AS (SELECT doc_id, a_id, b_id, round(shared / (a_area + b_area - shared), 9) AS iou, round(shared / a_area, 9) AS within, round(gap, 9) AS apart, round(b_area / greatest(1, a_area), 9) AS ratio FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY iou DESC, apart, a_id, b_id) AS k FROM offers WHERE iou > 0.05 OR within > 0.5 OR apart < 100),
taken AS (
  SELECT doc_id, 0 AS k, []::BIGINT[] AS sources, []::BIGINT[] AS targets FROM (SELECT DISTINCT doc_id FROM ranked)
  UNION ALL SELECT t.doc_id, r.k, CASE WHEN list_contains(sources, a_id) OR list_contains(targets, b_id) THEN sources ELSE list_append(sources, a_id) END, CASE WHEN list_contains(sources, a_id) OR list_contains(targets, b_id) THEN targets ELSE list_append(targets, b_id) END
  FROM taken t JOIN ranked r ON r.doc_id = t.doc_id AND r.k = t.k + 1
),
last AS (SELECT doc_id, arg_max(sources, k) AS sources, arg_max(targets, k) AS targets FROM taken GROUP BY doc_id),
won AS (SELECT doc_id, unnest(sources) AS a_id, unnest(targets) AS b_id FROM last),
told AS (
  SELECT s.doc_id, s.node_id AS a_id, o.b_id, o.iou, o.apart, o.ratio, CASE WHEN o.b_id IS NULL OR NOT (iou >= 0.35 OR within >= 0.7 OR (apart <= 30 AND ratio >= 0.4)) THEN 'LOST' WHEN ratio > 2.5 THEN 'MERGED' WHEN ratio < 0.4 THEN 'SHRUNK' ELSE 'PRESERVED' END AS status
  FROM art_boxes s LEFT JOIN won w ON w.doc_id = s.doc_id AND w.a_id = s.node_id LEFT JOIN offers o ON o.doc_id = w.doc_id AND o.a_id = w.a_id AND o.b_id = w.b_id
)
SELECT doc_id, a_id, CASE WHEN status <> 'LOST' THEN b_id END AS b_id, CASE WHEN status <> 'LOST' THEN iou END AS iou, CASE WHEN status <> 'LOST' THEN apart END AS apart, CASE WHEN status <> 'LOST' THEN ratio END AS ratio, status FROM told"""
register("component_matching", lambda spark, sf_dir: hierarchy.match_components(view(spark, sf_dir, "art_boxes"), view(spark, sf_dir, "redrawn_boxes")), oracle(_MATCHED, ["art_boxes", "redrawn_boxes"], recursive=True))

# Partial clusters one after the other by size, each a leader unless an earlier one is near.
_MASKS = """
WITH parts AS (
  SELECT image_id, cell, n, floor(({l}) * 1000000000 + 0.5) / 1000000000 AS l, floor(({a}) * 1000000000 + 0.5) / 1000000000 AS ca, floor(({b}) * 1000000000 + 0.5) / 1000000000 AS cb, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, cell) AS k
  FROM (SELECT image_id, r // 8 * 1024 + g // 8 * 32 + b // 8 AS cell, count(*) AS n, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM mosaic WHERE a > 0 GROUP BY 1, 2) q
),
walk AS (
  SELECT image_id, 1 AS k, [{{'cell': cell, 'l': l, 'ca': ca, 'cb': cb, 'k': k}}] AS heads FROM parts WHERE k = 1
  UNION ALL SELECT w.image_id, p.k, CASE WHEN len([h FOR h IN w.heads IF sqrt((h.l - p.l) ** 2 + (h.ca - p.ca) ** 2 + (h.cb - p.cb) ** 2) <= 0.025]) = 0 THEN list_append(w.heads, {{'cell': p.cell, 'l': p.l, 'ca': p.ca, 'cb': p.cb, 'k': p.k}}) ELSE w.heads END
  FROM walk w JOIN parts p ON p.image_id = w.image_id AND p.k = w.k + 1
),
heads AS (SELECT image_id, unnest(arg_max(heads, k)) AS h FROM walk GROUP BY image_id),
owned AS (
  SELECT p.image_id, p.cell, arg_min(h.cell, floor(sqrt((h.l - p.l) ** 2 + (h.ca - p.ca) ** 2 + (h.cb - p.cb) ** 2) * 1000000000 + 0.5) * 100000 + h.k) AS leader FROM parts p JOIN heads USING (image_id)
  WHERE sqrt((h.l - p.l) ** 2 + (h.ca - p.ca) ** 2 + (h.cb - p.cb) ** 2) <= 0.025 GROUP BY p.image_id, p.cell
),
sums AS (
  SELECT m.image_id, o.leader, count(*) AS pixels, avg(r) AS r, avg(g) AS g, avg(b) AS b, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y
  FROM mosaic m JOIN owned o ON o.image_id = m.image_id AND o.cell = r // 8 * 1024 + g // 8 * 32 + b // 8 WHERE a > 0 GROUP BY m.image_id, o.leader
)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY pixels DESC, leader) - 1 AS cluster, CAST(floor(r + 0.5) AS BIGINT) AS r, CAST(floor(g + 0.5) AS BIGINT) AS g, CAST(floor(b + 0.5) AS BIGINT) AS b, pixels,
       floor(pixels / sum(pixels) OVER (PARTITION BY image_id) * 1000000 + 0.5) / 1000000 AS coverage, min_x, min_y, max_x, max_y FROM sums"""
register("colour_masks", lambda spark, sf_dir: clustering.colour_masks(view(spark, sf_dir, "mosaic")), oracle(_MASKS.format(**_OK), ["mosaic"], recursive=True))


def _coupled(spark, sf_dir):
    """Circles through the round outlines of a document, with near relations made exact."""
    outlines = cut(view(spark, sf_dir, "art_outlines"))
    fits = kernels.circle_fit(outlines).where("radius IS NOT NULL")
    owned = outlines.groupBy("doc_id", "ring_id").agg(planar.F.count("*").cast("double").alias("weight"))
    circles = cut(fits.join(owned, "ring_id").selectExpr("doc_id", "ring_id AS shape_id", "cx", "cy", "radius", "weight"))
    return coupling.couple_circles(circles)


register("coupled_shapes", _coupled)
register("cubic_fit", lambda spark, sf_dir: fitting.fit_curves(view(spark, sf_dir, "rings"), 4.0, sigma=2.0))
register("outline_curves", lambda spark, sf_dir: fitting.fit_curves(view(spark, sf_dir, "round_outlines"), 0.2))
register("interval_models", lambda spark, sf_dir: selection.best_model(model_errors=fitting.interval_models(view(spark, sf_dir, "round_outlines"))))
register("fit_frontier", lambda spark, sf_dir: fitting.fit_frontier(view(spark, sf_dir, "round_outlines")))
register("ellipse_fit", lambda spark, sf_dir: fitting.ellipse_fit(view(spark, sf_dir, "rings")))
for _name in ("vw_simplify", "validated_simplify"):
    register(_name, lambda spark, sf_dir, f=getattr(kernels, _name): f(view(spark, sf_dir, "rings")))

# Segments of a ring that is split at its first point and the one farthest from it, split on while a point lies off.
_RDP = """
WITH ext AS (SELECT ring_id, pos, n, x, y FROM rings UNION ALL SELECT ring_id, n, n, x, y FROM rings WHERE pos = 0),
far AS (
  SELECT p.ring_id, p.pos AS far, p.n FROM rings p JOIN rings o ON o.ring_id = p.ring_id AND o.pos = 0 WHERE p.n >= 4
  QUALIFY row_number() OVER (PARTITION BY p.ring_id ORDER BY (p.x - o.x) ** 2 + (p.y - o.y) ** 2 DESC, p.pos) = 1
),
segs AS (
  SELECT ring_id, 0 AS a, far AS b FROM far UNION ALL SELECT ring_id, far, n FROM far
  UNION ALL
  SELECT ring_id, CASE WHEN half = 0 THEN a ELSE k END, CASE WHEN half = 0 THEN k ELSE b END FROM (
    SELECT s.ring_id, s.a, s.b, p.pos AS k, CASE WHEN size2 = 0 THEN sqrt((p.x - s.ax) ** 2 + (p.y - s.ay) ** 2) ELSE abs((s.bx - s.ax) * (p.y - s.ay) - (s.by_ - s.ay) * (p.x - s.ax)) / sqrt(size2) END AS off
    FROM (SELECT t.ring_id, t.a, t.b, u.x AS ax, u.y AS ay, v.x AS bx, v.y AS by_, (v.x - u.x) ** 2 + (v.y - u.y) ** 2 AS size2 FROM segs t JOIN ext u ON u.ring_id = t.ring_id AND u.pos = t.a JOIN ext v ON v.ring_id = t.ring_id AND v.pos = t.b) s
    JOIN ext p ON p.ring_id = s.ring_id AND p.pos > s.a AND p.pos < s.b
    QUALIFY row_number() OVER (PARTITION BY s.ring_id, s.a, s.b ORDER BY off DESC, p.pos) = 1
  ) q CROSS JOIN (VALUES (0), (1)) h(half) WHERE off > 2
),
kept AS (SELECT DISTINCT s.ring_id, p.pos FROM segs s JOIN rings p ON p.ring_id = s.ring_id AND (p.pos = s.a OR p.pos = s.b) UNION SELECT ring_id, pos FROM rings WHERE n < 4),
after AS (SELECT k.ring_id, k.pos, r.x, r.y, coalesce(lead(r.x) OVER w, first(r.x) OVER w) AS nx, coalesce(lead(r.y) OVER w, first(r.y) OVER w) AS ny FROM kept k JOIN rings r ON r.ring_id = k.ring_id AND r.pos = k.pos WINDOW w AS (PARTITION BY k.ring_id ORDER BY k.pos)),
before AS (SELECT ring_id, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM rings WINDOW w AS (PARTITION BY ring_id ORDER BY pos))
SELECT b.ring_id, b.points, a.kept, b.area AS area_before, a.area AS area_after FROM (SELECT ring_id, count(*) AS points, sum(x * ny - nx * y) / 2 AS area FROM before GROUP BY ring_id) b
JOIN (SELECT ring_id, count(*) AS kept, sum(x * ny - nx * y) / 2 AS area FROM after GROUP BY ring_id) a ON a.ring_id = b.ring_id"""
register("rdp_simplify", lambda spark, sf_dir: kernels.rdp_simplify(view(spark, sf_dir, "rings")), oracle(_RDP, ["rings"], recursive=True))



def _artboard(spark, sf_dir):
    """Subpath areas of the first path of every file, its view box laid out at twice its size."""
    # Texts are dealt to all tasks before they are read, as the table they come from may be one small file; outlines are made once for both sums.
    files = view(spark, sf_dir, "svgs").selectExpr("case_id AS svg_id", "svg").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "svg_id")
    nodes = view(spark, sf_dir, "nodes").where("type = 'vector_path'")
    placed = nodes.selectExpr("node_id AS svg_id", "x_mm", "y_mm", "2 * w_mm AS w_mm", "2 * h_mm AS h_mm", "0e0 AS vb_x", "0e0 AS vb_y", "floor(w_mm) AS vb_w", "floor(h_mm) AS vb_h")
    points = cut(contours.artboard_outlines(svg.path_commands(svg.read_paths(files)), placed).where("path_no = 0"))
    areas = arrangement.ring_areas(points.selectExpr("svg_id AS doc_id", "subpath AS ring_id", "pos", "x", "y"))
    low = points.groupBy("svg_id", "subpath").agg(planar.F.min("x").alias("min_x"), planar.F.max("y").alias("max_y"))
    return areas.selectExpr("doc_id AS svg_id", "ring_id AS subpath", "points", "area_mm2").join(low, ["svg_id", "subpath"])


_ARTBOARD = """
SELECT node_id AS svg_id, CAST(0 AS BIGINT) AS subpath, CAST(4 AS BIGINT) AS points, w_mm * h_mm * 4 AS area_mm2, x_mm AS min_x, y_mm + 2 * h_mm AS max_y FROM nodes WHERE type = 'vector_path' AND w_mm > 0
UNION ALL SELECT node_id, 1, 3, 2, x_mm + 2, y_mm + 4 FROM nodes WHERE type = 'vector_path' AND w_mm > 0 AND node_id % 4 = 0"""
register("artboard_outlines", _artboard, oracle(_ARTBOARD, ["nodes"]))

# The same circle from its normal equations, in sums about the mean.
_CIRCLE = f"""
WITH centred AS (SELECT ring_id, avg(x) OVER r AS mx, avg(y) OVER r AS my, x - avg(x) OVER r AS u, y - avg(y) OVER r AS v FROM rings WINDOW r AS (PARTITION BY ring_id)),
sums AS (SELECT ring_id, any_value(mx) AS mx, any_value(my) AS my, count(*) AS n, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * (u * u + v * v)) / 2 AS a, sum(v * (u * u + v * v)) / 2 AS b FROM centred GROUP BY ring_id),
found AS (SELECT ring_id, n, mx, my, (a * vv - b * uv) / (uu * vv - uv * uv) AS p, (b * uu - a * uv) / (uu * vv - uv * uv) AS q, (uu + vv) / n AS spread FROM sums WHERE n > 2 AND uu * vv <> uv * uv),
circles AS (SELECT ring_id, mx + p AS cx, my + q AS cy, p, q, sqrt(p * p + q * q + spread) AS radius FROM found),
offs AS (SELECT f.ring_id, sqrt(avg((sqrt((u - p) ** 2 + (v - q) ** 2) - radius) ** 2)) AS rms FROM circles f JOIN centred c ON c.ring_id = f.ring_id GROUP BY f.ring_id)
SELECT r.ring_id, {_r4('c.cx')} AS cx, {_r4('c.cy')} AS cy, {_r4('c.radius')} AS radius, {_r4('o.rms')} AS rms FROM (SELECT DISTINCT ring_id FROM rings) r LEFT JOIN circles c ON c.ring_id = r.ring_id LEFT JOIN offs o ON o.ring_id = r.ring_id"""
register("circle_fit", lambda spark, sf_dir: kernels.circle_fit(view(spark, sf_dir, "rings")).selectExpr("ring_id", *(f"{_r4(c)} AS {c}" for c in ("cx", "cy", "radius", "rms"))), oracle(_CIRCLE, ["rings"]))
