"""Oracle SQL written from an operator's definition rather than from its Spark text: plain joins of everything with everything, no pruning."""

from __future__ import annotations

from inkfold.functions import expressions as E

_PI = "3.141592653589793"
_R6 = "floor(({}) * 1000000 + 0.5) / 1000000"


def _r(x: str) -> str:
    return _R6.format(x)


# CIELAB of 8-bit sRGB, D65.
_LINEAR = "CASE WHEN {0} / 255.0 > 0.04045 THEN pow(({0} / 255.0 + 0.055) / 1.055, 2.4) ELSE {0} / 255.0 / 12.92 END"
_LAB = f"""linear AS (SELECT image_id, x, y, {_LINEAR.format('r')} AS lr, {_LINEAR.format('g')} AS lg, {_LINEAR.format('b')} AS lb FROM artwork),
xyz AS (SELECT image_id, x, y, (lr * 0.4124564 + lg * 0.3575761 + lb * 0.1804375) / 0.95047 AS vx, lr * 0.2126729 + lg * 0.7151522 + lb * 0.072175 AS vy, (lr * 0.0193339 + lg * 0.119192 + lb * 0.9503041) / 1.08883 AS vz FROM linear),
bent AS (SELECT image_id, x, y, {', '.join(f"CASE WHEN v{c} > 0.008856 THEN pow(v{c}, 1.0 / 3) ELSE 7.787 * v{c} + 0.13793103 END AS f{c}" for c in 'xyz')} FROM xyz),
lab AS (SELECT image_id, x, y, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM bent)"""
_GAP = "sqrt(({0}.l - {1}.l) ** 2 + ({0}.a - {1}.a) ** 2 + ({0}.b - {1}.b) ** 2)"
_EDGES = f"""{_LAB},
size AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM artwork GROUP BY image_id),
near AS (SELECT p.image_id, p.x, p.y, max({_GAP.format('p', 'q')}) AS most FROM lab p JOIN lab q ON q.image_id = p.image_id AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY p.image_id, p.x, p.y),
edge AS (SELECT n.image_id, n.x, n.y FROM near n JOIN size s ON s.image_id = n.image_id WHERE n.most > 3.8 AND n.x BETWEEN 1 AND s.w - 2 AND n.y BETWEEN 1 AND s.h - 2)"""
_TRUNC = "CASE WHEN ({0}) < 0 THEN ceil({0}) ELSE floor({0}) END"


def _walk(dx: int, dy: int) -> str:
    """Edge pixels from a place on in one direction, its own included, fifteen at most."""
    return f"coalesce((SELECT min(d) FROM range(0, 15) t(d) WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.image_id = c.image_id AND e.x = c.x + {dx} * d AND e.y = c.y + {dy} * d)), 15)"


_RAMPS = f"""chosen AS (
  SELECT e.image_id, e.x, e.y, {_GAP.format('w', 'o')} AS flat, {_GAP.format('n', 's')} AS steep FROM edge e JOIN size z ON z.image_id = e.image_id
  JOIN lab w ON w.image_id = e.image_id AND w.x = e.x - 1 AND w.y = e.y JOIN lab o ON o.image_id = e.image_id AND o.x = e.x + 1 AND o.y = e.y
  JOIN lab n ON n.image_id = e.image_id AND n.x = e.x AND n.y = e.y - 1 JOIN lab s ON s.image_id = e.image_id AND s.x = e.x AND s.y = e.y + 1
  WHERE e.x >= 5 AND e.x < z.w - 5 AND (e.x - 5) % 4 = 0 AND e.y >= 5 AND e.y < z.h - 5 AND (e.y - 5) % 4 = 0
),
widths AS (SELECT c.image_id, CASE WHEN flat >= steep THEN {_walk(-1, 0)} + {_walk(1, 0)} ELSE {_walk(0, -1)} + {_walk(0, 1)} END AS width FROM chosen c WHERE greatest(flat, steep) > 15),
ramps AS (SELECT image_id, count(*) AS samples, avg(width) AS wramp FROM widths GROUP BY image_id)"""
_VARIETY = f"""anchors AS (SELECT s.image_id, CAST(ax AS BIGINT) AS ax, CAST(ay AS BIGINT) AS ay FROM size s, range(10, 100000, 12) t(ax), range(10, 100000, 12) u(ay) WHERE ax < s.w - 10 AND ay < s.h - 10),
seen AS (
  SELECT DISTINCT k.image_id, k.ax, k.ay, {_TRUNC.format('p.l / 15')} AS cl, {_TRUNC.format('(p.a + 128) / 15')} AS ca, {_TRUNC.format('(p.b + 128) / 15')} AS cb
  FROM anchors k, (VALUES (-4), (-2), (0), (2), (4)) i(dx), (VALUES (-4), (-2), (0), (2), (4)) j(dy), lab p
  WHERE p.image_id = k.image_id AND p.x = k.ax + dx AND p.y = k.ay + dy AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.image_id = p.image_id AND e.x = p.x AND e.y = p.y)
),
windows AS (SELECT image_id, ax, ay, count(*) AS colours FROM seen GROUP BY image_id, ax, ay),
variety AS (SELECT image_id, count(*) AS cells, CAST(count(*) FILTER (WHERE colours >= 3) AS BIGINT) AS cpoly FROM windows GROUP BY image_id)"""

# Angle between two directions by the arc tangent of cross and dot product.
_ANGLE = "abs(atan2(({ax}) * ({by}) - ({ay}) * ({bx}), ({ax}) * ({bx}) + ({ay}) * ({by}))) * 180 / " + _PI

def _checked(points: str) -> str:
    """Contour integrity by comparing every side of a node with every other."""
    near = lambda a, b: f"sqrt((x{a} - x{b}) ** 2 + (y{a} - y{b}) ** 2) <= 0.001"
    on = lambda a, b, c: f"x{c} >= least(x{a}, x{b}) - 0.001 AND x{c} <= greatest(x{a}, x{b}) + 0.001 AND y{c} >= least(y{a}, y{b}) - 0.001 AND y{c} <= greatest(y{a}, y{b}) + 0.001"
    area2 = lambda a, b, c: f"((x{b} - x{a}) * (y{c} - y{a}) - (y{b} - y{a}) * (x{c} - x{a}))"
    return f"""
WITH sides AS (SELECT a.doc_id, a.node_id, a.contour, a.pos, a.n, a.closed, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM {points} a JOIN {points} b ON b.doc_id = a.doc_id AND b.node_id = a.node_id AND b.contour = a.contour AND b.pos = (a.pos + 1) % a.n),
rings_of AS (
  SELECT doc_id, node_id, contour, count(*) AS v, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area, bool_or(closed) AS shut, bool_or(NOT closed) AS ajar, max(sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2)) FILTER (WHERE pos = n - 1) AS gap,
         coalesce(sum(sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2)) FILTER (WHERE pos < n - 1), 0) / greatest(1, count(*) - 1) AS side FROM sides GROUP BY ALL
),
nodes_of AS (SELECT doc_id, node_id, CAST(sum(v) AS BIGINT) AS vertices, sum(area) AS area, coalesce(bool_or(v >= 2 AND gap > 0.5 AND (coalesce(ajar, false) OR (NOT coalesce(shut, false) AND v >= 3 AND gap < 0.5 * side))), false) AS open_contour FROM rings_of GROUP BY doc_id, node_id),
pairs AS (
  SELECT p.doc_id, p.node_id, p.x1, p.y1, p.x2, p.y2, q.x1 AS x3, q.y1 AS y3, q.x2 AS x4, q.y2 AS y4 FROM sides p JOIN sides q ON q.doc_id = p.doc_id AND q.node_id = p.node_id AND (q.contour, q.pos) > (p.contour, p.pos)
  WHERE greatest(p.x1, p.x2) + 0.001 >= least(q.x1, q.x2) - 0.001 AND least(p.x1, p.x2) - 0.001 <= greatest(q.x1, q.x2) + 0.001 AND greatest(p.y1, p.y2) + 0.001 >= least(q.y1, q.y2) - 0.001 AND least(p.y1, p.y2) - 0.001 <= greatest(q.y1, q.y2) + 0.001
),
d AS (SELECT *, {area2('3', '4', '1')} AS d1, {area2('3', '4', '2')} AS d2, {area2('1', '2', '3')} AS d3, {area2('1', '2', '4')} AS d4, {' OR '.join(near(*p) for p in ('13', '14', '23', '24'))} AS share FROM pairs),
kinds AS (
  SELECT doc_id, node_id, abs(d1) <= 0.001 AND abs(d2) <= 0.001 AND abs(d3) <= 0.001 AND abs(d4) <= 0.001 AS flat, share,
         (sign(CASE WHEN abs(d1) > 0.001 THEN d1 ELSE 0 END) * sign(CASE WHEN abs(d2) > 0.001 THEN d2 ELSE 0 END) < 0 AND sign(CASE WHEN abs(d3) > 0.001 THEN d3 ELSE 0 END) * sign(CASE WHEN abs(d4) > 0.001 THEN d4 ELSE 0 END) < 0)
           OR (abs(d1) <= 0.001 AND {on('3', '4', '1')}) OR (abs(d2) <= 0.001 AND {on('3', '4', '2')}) OR (abs(d3) <= 0.001 AND {on('1', '2', '3')}) OR (abs(d4) <= 0.001 AND {on('1', '2', '4')}) AS meet,
         NOT ({near('1', '2')}) AND NOT ({near('3', '4')}) AND CASE WHEN abs(x2 - x1) > abs(y2 - y1) THEN least(greatest(x1, x2), greatest(x3, x4)) - greatest(least(x1, x2), least(x3, x4)) ELSE least(greatest(y1, y2), greatest(y3, y4)) - greatest(least(y1, y2), least(y3, y4)) END > 0.005 AS laps
  FROM d
),
sums AS (SELECT doc_id, node_id, count(*) FILTER (WHERE NOT flat AND NOT share AND meet) AS crossings, count(*) FILTER (WHERE flat AND laps) AS overlapping FROM kinds GROUP BY doc_id, node_id)
SELECT n.doc_id, n.node_id, vertices, floor(area * 10000 + 0.5) / 10000 AS area_mm2, open_contour, coalesce(crossings, 0) AS crossings, coalesce(overlapping, 0) AS overlapping, vertices < 3 OR area < 0.01 AS degenerate,
       vertices >= 3 AND area >= 0.01 AND NOT open_contour AND coalesce(crossings, 0) = 0 AND coalesce(overlapping, 0) = 0 AS valid FROM nodes_of n LEFT JOIN sums s ON s.doc_id = n.doc_id AND s.node_id = n.node_id"""


# Oklab of 8-bit sRGB over a relation of pixels.
def _oklab(relation: str, keys: str) -> str:
    return f"""lin AS (SELECT {keys}, r, g, b, a, {_LINEAR.format('r')} AS lr, {_LINEAR.format('g')} AS lg, {_LINEAR.format('b')} AS lb FROM {relation}),
cone AS (SELECT {keys}, r, g, b, a, cbrt(0.4122214708 * lr + 0.5363325363 * lg + 0.0514459929 * lb) AS c1, cbrt(0.2119034982 * lr + 0.6806995451 * lg + 0.1073969566 * lb) AS c2, cbrt(0.0883024619 * lr + 0.2817188376 * lg + 0.6299787005 * lb) AS c3 FROM lin),
ok AS (SELECT {keys}, r, g, b, a, 0.2104542553 * c1 + 0.793617785 * c2 - 0.0040720468 * c3 AS ol, 1.9779984951 * c1 - 2.428592205 * c2 + 0.4505937099 * c3 AS oa, 0.0259040371 * c1 + 0.7827717662 * c2 - 0.808675766 * c3 AS ob FROM cone)"""


_OK_GAP = "sqrt(({0}.ol - {1}.ol) ** 2 + ({0}.oa - {1}.oa) ** 2 + ({0}.ob - {1}.ob) ** 2)"
_RAG = f"""{_oklab('pixels', 'image_id, x, y')},
steps AS (
  SELECT p.image_id, p.x, p.y, least(1, {_OK_GAP.format('p', 'q')} * 5 * least(p.a, q.a) / 255.0) AS strength FROM ok p JOIN ok q ON q.image_id = p.image_id AND ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1)) WHERE p.a > 0 AND q.a > 0
),
strong AS (SELECT image_id, x, y, max(strength) AS strength FROM steps GROUP BY image_id, x, y),
member AS (SELECT m.image_id, m.x, m.y, m.label, o.ol, o.oa, o.ob, o.a, coalesce(s.strength, 0) AS strength FROM labels_map m JOIN ok o USING (image_id, x, y) LEFT JOIN strong s USING (image_id, x, y)),
region AS (SELECT image_id, label, avg(ol) AS ol, avg(oa) AS oa, avg(ob) AS ob, avg(a / 255.0) AS coverage FROM member GROUP BY image_id, label),
border AS (
  SELECT p.image_id, least(p.label, q.label) AS region_a, greatest(p.label, q.label) AS region_b, count(*) AS shared_len, avg(greatest(p.strength, q.strength)) AS avg_strength, max(greatest(p.strength, q.strength)) AS max_strength
  FROM member p JOIN member q ON q.image_id = p.image_id AND q.label <> p.label AND ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1)) GROUP BY ALL
),
rag AS (
  SELECT e.image_id, region_a, region_b, shared_len, {_r('avg_strength')} AS avg_strength, {_r('max_strength')} AS max_strength, {_r(_OK_GAP.format('f', 's'))} AS color_dist, {_r('abs(f.coverage - s.coverage)')} AS coverage_diff
  FROM border e JOIN region f ON f.image_id = e.image_id AND f.label = e.region_a JOIN region s ON s.image_id = e.image_id AND s.label = e.region_b
)"""
_SPAN = "441.673"
_RGB_GAP = "sqrt(({0}.r - {1}.r) ** 2 + ({0}.g - {1}.g) ** 2 + ({0}.b - {1}.b) ** 2) / " + _SPAN


# Derived relations whose Spark text another engine does not take.
RELATIONS: dict[str, str] = {"cut_checks": _checked("cut_rings"), "path_checks": _checked("path_points")}

_SVG = """data AS (SELECT case_id, svg, backend, strlen(svg) AS bytes, len(regexp_extract_all(svg, '<path ')) AS paths, regexp_extract_all(svg, ' d="([^"]*)"', 1) AS ds FROM svgs),
counted AS (
  SELECT case_id, svg, backend, bytes, CAST(paths AS BIGINT) AS paths, CAST(list_sum(list_transform(ds, lambda d: length(regexp_replace(d, '[^Mm]', '', 'g')))) AS BIGINT) AS subpaths,
         CAST(list_sum(list_transform(ds, lambda d: length(regexp_replace(d, '[^A-Za-z]', '', 'g')))) AS BIGINT) AS anchors, CAST(list_sum(list_transform(ds, lambda d: length(regexp_replace(d, '[^Mm]', '', 'g')) - 1)) AS BIGINT) AS holes,
         len(list_filter(ds, lambda d: length(regexp_replace(d, '[^Mm]', '', 'g')) > 1)) AS compound, CAST(list_sum(list_transform(ds, lambda d: length(regexp_replace(d, '[^Cc]', '', 'g')))) AS BIGINT) AS curves,
         CAST(list_sum(list_transform(ds, lambda d: len(regexp_extract_all(d, '[0-9]+')) // 2)) AS BIGINT) AS nodes FROM data
)"""
_GOLDEN = f"""WITH {_SVG}, both_sides AS (
  SELECT c.case_id, c.paths - g.paths AS path_delta, c.anchors - g.anchors AS anchor_delta, c.holes - g.holes AS hole_delta, abs(c.anchors - g.anchors) * 100.0 / g.anchors AS pct, trim(c.svg) = trim(g.svg) AS same,
         CASE WHEN c.paths = 0 OR c.backend <> g.backend OR (g.holes > 0 AND c.holes = 0) OR (g.anchors > 10 AND c.anchors > 3 * g.anchors) OR (g.paths > 10 AND c.paths > 3 * g.paths) THEN 'FAIL'
              WHEN g.approved AND trim(c.svg) = trim(g.svg) THEN 'PASS' ELSE 'REVIEW_REQUIRED' END AS verdict
  FROM counted c JOIN goldens g USING (case_id)
)"""

ORACLES: dict[str, str] = {
    "rag_edges": f"WITH {_RAG} SELECT * FROM rag",
    "artwork_mode": f"""
WITH {_oklab('pixels', 'image_id, x, y')},
seen AS (SELECT * FROM ok WHERE a > 0),
bins AS (SELECT image_id, r // 32 AS i, g // 32 AS j, b // 32 AS k, count(*) AS n FROM seen GROUP BY ALL),
totals AS (SELECT image_id, sum(n) AS total, count(*) AS buckets FROM bins GROUP BY image_id),
spread AS (
  SELECT t.image_id, total, buckets, (SELECT sum(n) FROM (SELECT n FROM bins b WHERE b.image_id = t.image_id ORDER BY n DESC LIMIT 8)) / total AS dominant, (SELECT -sum(n / total * log2(n / total)) FROM bins b WHERE b.image_id = t.image_id) AS entropy FROM totals t
),
pairs AS (SELECT p.image_id, {_OK_GAP.format('p', 'q')} > 0.08 AS varied FROM seen p JOIN seen q ON q.image_id = p.image_id AND ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1))),
local AS (SELECT image_id, count(*) FILTER (WHERE varied) / count(*) AS variation FROM pairs GROUP BY image_id),
soft AS (SELECT image_id, count(*) FILTER (WHERE a < 255) / count(*) AS alpha FROM seen GROUP BY image_id),
signals AS (SELECT s.image_id, total, buckets, dominant, entropy, alpha, coalesce(variation, 0) AS variation FROM spread s JOIN soft USING (image_id) LEFT JOIN local USING (image_id))
SELECT image_id, CAST(total AS BIGINT) AS visible_pixels, floor(dominant * 10000 + 0.5) / 10000 AS dominant_coverage, floor(variation * 10000 + 0.5) / 10000 AS local_variation, floor(entropy * 10000 + 0.5) / 10000 AS color_entropy, floor(alpha * 10000 + 0.5) / 10000 AS alpha_coverage,
       CASE WHEN entropy >= 5.25 OR (buckets > 8 AND variation >= 0.08) THEN 'DETAILED_ART' WHEN dominant < 0.8 OR (buckets > 8 AND variation > 0.23) THEN 'INCONCLUSIVE' WHEN buckets > 10 THEN 'FLAT_GRAPHIC' ELSE 'FLAT_LOGO' END AS mode FROM signals""",
    "residual_region_class": f"""
WITH mean AS (SELECT image_id, label, count(*) AS area, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(a) AS alpha FROM labels_map GROUP BY image_id, label),
contact AS (SELECT p.image_id, p.label, q.label AS other, count(*) AS shared FROM labels_map p JOIN labels_map q ON q.image_id = p.image_id AND q.label <> p.label AND abs(q.x - p.x) + abs(q.y - p.y) = 1 GROUP BY ALL),
ranked AS (SELECT c.image_id, c.label, c.other, {_RGB_GAP.format('m', 'o')} AS dist, row_number() OVER (PARTITION BY c.image_id, c.label ORDER BY shared DESC, other) AS k FROM contact c JOIN mean m ON m.image_id = c.image_id AND m.label = c.label JOIN mean o ON o.image_id = c.image_id AND o.label = c.other),
sizes AS (SELECT image_id, greatest(4, ((max(x) + 1) * (max(y) + 1)) // 10000) AS small FROM labels_map GROUP BY image_id),
facts AS (
  SELECT m.*, small, (SELECT count(*) FROM ranked n WHERE n.image_id = m.image_id AND n.label = m.label) AS neighbours, (SELECT min(dist) FROM ranked n WHERE n.image_id = m.image_id AND n.label = m.label) AS nearest, (SELECT max(dist) FROM ranked n WHERE n.image_id = m.image_id AND n.label = m.label) AS contrast
  FROM mean m JOIN sizes USING (image_id)
),
two AS (
  SELECT f.*, a.dist AS d1, b.dist AS d2, p.r AS pr, p.g AS pg, p.b AS pb, q.r - p.r AS vr, q.g - p.g AS vg, q.b - p.b AS vb FROM facts f LEFT JOIN ranked a ON a.image_id = f.image_id AND a.label = f.label AND a.k = 1 LEFT JOIN ranked b ON b.image_id = f.image_id AND b.label = f.label AND b.k = 2
  LEFT JOIN mean p ON p.image_id = f.image_id AND p.label = a.other LEFT JOIN mean q ON q.image_id = f.image_id AND q.label = b.other
),
line AS (SELECT *, vr * vr + vg * vg + vb * vb AS len2 FROM two),
foot AS (SELECT *, CASE WHEN len2 = 0 THEN 0 ELSE greatest(0, least(1, ((r - pr) * vr + (g - pg) * vg + (b - pb) * vb) / len2)) END AS t FROM line),
judged AS (SELECT *, sqrt((r - pr - t * vr) ** 2 + (g - pg - t * vg) ** 2 + (b - pb - t * vb) ** 2) / {_SPAN} AS residual, sqrt(len2) / {_SPAN} AS apart FROM foot)
SELECT image_id, label, area, neighbours, CASE WHEN area > small AND nearest < 0.08 THEN 'SHADING_REGION' WHEN area > small THEN 'STRUCTURAL_COLOR_REGION' WHEN alpha < 250 THEN 'UNCERTAIN' WHEN neighbours = 1 AND d1 >= 0.55 THEN 'LEGITIMATE_DETAIL' WHEN neighbours < 2 THEN 'UNCERTAIN'
  WHEN residual <= 0.06 AND least(d1, d2) < 0.45 AND apart >= 0.12 AND apart < 0.65 AND contrast < 0.7 THEN 'EDGE_TRANSITION_REGION' WHEN contrast >= 0.55 AND apart < 0.05 THEN 'LEGITIMATE_DETAIL' ELSE 'UNCERTAIN' END AS class FROM judged""",
    "merge_regions": f"""
WITH RECURSIVE {_RAG},
same AS (SELECT image_id, region_a, region_b FROM rag WHERE max_strength < 0.45 AND avg_strength <= 0.2 AND coverage_diff <= 0.72 AND color_dist <= 0.09),
steps_of AS (SELECT image_id, region_a AS p, region_b AS q FROM same UNION SELECT image_id, region_b, region_a FROM same),
reached AS (SELECT image_id, label AS region, label AS root FROM region WHERE (image_id, label) IN (SELECT (image_id, region_a) FROM rag UNION SELECT (image_id, region_b) FROM rag) UNION SELECT w.image_id, s.q, w.root FROM reached w JOIN steps_of s ON s.image_id = w.image_id AND s.p = w.region)
SELECT image_id, region, min(root) AS merged FROM reached GROUP BY image_id, region""",
    "validation_issues": """
WITH root AS (SELECT n.*, d.width_mm AS dw, d.height_mm AS dh, d.bleed_enabled, d.bleed_mm, d.safety_enabled, d.safety_mm AS m, x_mm + w_mm AS x2, y_mm + h_mm AS y2 FROM nodes n JOIN docs d USING (doc_id) WHERE parent_id IS NULL),
art AS (SELECT * FROM root WHERE visible AND type IN ('raster_image', 'group') AND w_mm > 0 AND h_mm > 0),
inside AS (SELECT *, x_mm < dw AND x2 > 0 AND y_mm < dh AND y2 > 0 AS touching, least(x_mm, y_mm, dw - x2, dh - y2) AS slack FROM art),
edges AS (SELECT doc_id, side FROM docs, (VALUES ('top'), ('right'), ('bottom'), ('left')) s(side) WHERE bleed_enabled AND bleed_mm > 0),
covered AS (SELECT DISTINCT a.doc_id, e.side FROM art a JOIN edges e USING (doc_id) WHERE CASE e.side WHEN 'top' THEN y_mm <= -bleed_mm WHEN 'left' THEN x_mm <= -bleed_mm WHEN 'right' THEN x2 >= dw + bleed_mm ELSE y2 >= dh + bleed_mm END),
dpi AS (SELECT doc_id, node_id, natural_w * 25.4 / w_mm AS v FROM root WHERE type = 'raster_image' AND w_mm > 0 AND natural_w > 0),
cut AS (SELECT c.*, n.visible FROM cut_checks c JOIN nodes n ON n.doc_id = c.doc_id AND n.node_id = c.node_id AND n.w_mm > 0 AND n.h_mm > 0),
all_issues(doc_id, rule_id, severity, category, node_id, detail) AS (
  SELECT doc_id, 'V001_ARTBOARD_INVALID_DIMENSIONS', 'error', 'document', NULL::BIGINT, '' FROM docs WHERE least(width_mm, height_mm) <= 0
  UNION ALL SELECT doc_id, 'V002_NODE_INVALID_DIMENSIONS', 'error', 'geometry', node_id, '' FROM root WHERE type IN ('raster_image', 'group', 'cut_contour') AND least(w_mm, h_mm) <= 0
  UNION ALL SELECT doc_id, 'V003_OBJECT_COMPLETELY_OUTSIDE', 'warning', 'layout', node_id, '' FROM inside WHERE NOT touching
  UNION ALL SELECT doc_id, 'V004_OBJECT_PARTIALLY_OUTSIDE', CASE WHEN bleed_enabled AND bleed_mm > 0 THEN 'info' ELSE 'warning' END, 'layout', node_id, '' FROM inside WHERE touching AND slack < 0
  UNION ALL SELECT doc_id, 'V005_BLEED_CONFIGURED', 'info', 'bleed', NULL, '' FROM docs WHERE bleed_enabled
  UNION ALL SELECT doc_id, 'V006_BLEED_INSUFFICIENT_COVERAGE', 'warning', 'bleed', NULL, side FROM (SELECT doc_id, side FROM edges EXCEPT SELECT doc_id, side FROM covered)
  UNION ALL SELECT doc_id, 'V007_SAFETY_MARGIN_INTERSECTION', 'warning', 'safety', node_id, '' FROM inside WHERE safety_enabled AND touching AND slack < m
  UNION ALL SELECT doc_id, 'V008_RASTER_LOW_DPI', 'warning', 'raster', node_id, CASE WHEN v < 100 THEN 'critical_low_dpi' ELSE 'low_dpi' END FROM dpi WHERE v < 150
  UNION ALL SELECT doc_id, 'V009_CUT_CONTOUR_ORPHAN', 'error', 'cut', node_id, '' FROM nodes c WHERE type = 'cut_contour' AND NOT EXISTS (SELECT 1 FROM nodes s WHERE s.doc_id = c.doc_id AND s.node_id = c.source_node_id AND s.type = 'group')
  UNION ALL SELECT doc_id, 'V010_CUT_CONTOUR_INVALID_GEOMETRY', 'error', 'cut', node_id, '' FROM nodes WHERE type = 'cut_contour' AND least(w_mm, h_mm) <= 0
  UNION ALL SELECT doc_id, 'V010_CUT_CONTOUR_INVALID_GEOMETRY', 'error', 'cut', node_id, 'degenerate' FROM cut WHERE vertices < 3 OR degenerate
  UNION ALL SELECT doc_id, 'V011_CUT_CONTOUR_VALID', 'info', 'cut', node_id, '' FROM cut WHERE visible AND valid
  UNION ALL SELECT doc_id, 'V014_CUT_CONTOUR_SELF_INTERSECTION', 'error', 'cut', node_id, '' FROM cut WHERE crossings <> 0
  UNION ALL SELECT doc_id, 'V015_CUT_CONTOUR_OVERLAPPING_SEGMENT', 'error', 'cut', node_id, '' FROM cut WHERE overlapping <> 0
  UNION ALL SELECT doc_id, 'V016_CUT_CONTOUR_OPEN', 'error', 'cut', node_id, '' FROM cut WHERE NOT valid AND NOT degenerate AND crossings + overlapping = 0
  UNION ALL SELECT doc_id, 'V012_GUIDE_OUT_OF_BOUNDS', 'warning', 'guide', node_id, '' FROM root WHERE type = 'technical_guide' AND (guide_mm IS NULL OR guide_mm < 0 OR guide_mm > CASE WHEN orientation = 'vertical' THEN dw ELSE dh END)
  UNION ALL SELECT DISTINCT doc_id, 'V013_GUIDES_SUMMARY', 'info', 'guide', NULL::BIGINT, '' FROM nodes WHERE type = 'technical_guide' AND guide_role IN ('fold', 'crease', 'cut_reference')
  UNION ALL SELECT doc_id, 'V016_CUT_CONTOUR_REQUIRED_MISSING', 'error', 'cut', NULL, '' FROM docs d WHERE profile_id = 'generic-sticker' AND doc_id IN (SELECT doc_id FROM nodes) AND doc_id NOT IN (SELECT doc_id FROM nodes WHERE type = 'cut_contour')
)
SELECT * FROM all_issues""",
    "command_counts": f"WITH {_SVG} SELECT case_id, bytes, paths, subpaths, anchors, holes, compound, curves FROM counted",
    "svg_guard": f"WITH {_SVG} SELECT case_id, bytes, nodes, CASE WHEN contains(svg, 'width=\"0mm') THEN CASE WHEN contains(svg, ' C ') THEN 4 WHEN contains(svg, ' M 1 1 L') THEN 2 ELSE 1 END ELSE CAST(regexp_extract(svg, ' width=\"([0-9]+)mm', 1) AS DOUBLE) END AS width, CAST(regexp_extract(svg, '([0-9]+)\"><path', 1) AS DOUBLE) AS height, CASE WHEN contains(svg, '<script') THEN 'UNSAFE' ELSE 'OK' END AS verdict FROM counted",
    "golden_verdict": f"{_GOLDEN} SELECT case_id, path_delta, anchor_delta, hole_delta, {_r('pct')} AS anchor_pct, verdict FROM both_sides",
    "golden_tally": f"{_GOLDEN} SELECT verdict, count(*) AS cases, count(*) FILTER (WHERE same) AS identical, {_r('avg(pct)')} AS mean_anchor_pct FROM both_sides GROUP BY verdict",
    "topology_metrics": f"""WITH {_SVG} SELECT doc_id, count(*) AS files, CAST(sum(c.paths) AS BIGINT) AS paths, CAST(sum(c.compound) AS BIGINT) AS compound, CAST(sum(c.holes) AS BIGINT) AS holes, CAST(sum(g.holes) AS BIGINT) AS approved_holes,
  CASE WHEN sum(g.holes) = 0 THEN 'NOT_APPLICABLE' WHEN sum(c.holes) < sum(g.holes) THEN 'LOST' ELSE 'PRESERVED' END AS status FROM counted c JOIN goldens g USING (case_id) JOIN nodes n ON n.node_id = c.case_id GROUP BY doc_id""",
    "cut_integrity": _checked("cut_rings"),
    "path_integrity": _checked("path_points"),
    "separation_state": """
WITH current AS (SELECT doc_id, sum(node_id + round(x_mm * 100) * 3 + round(y_mm * 100) * 7 + round(w_mm * 100) * 11 + round(h_mm * 100) * 13) AS state, min(x_mm) AS x0, max(x_mm + w_mm) AS x1, min(y_mm) AS y0, max(y_mm + h_mm) AS y1
  FROM nodes WHERE visible AND parent_id IS NULL AND type IN ('raster_image', 'group', 'vector_path') GROUP BY doc_id)
SELECT s.doc_id, s.role, CASE WHEN greatest(abs(s.width_mm - d.width_mm), abs(s.height_mm - d.height_mm)) <= 0.01 OR coalesce(greatest(abs(s.width_mm - (x1 - x0)), abs(s.height_mm - (y1 - y0))) <= 0.01, false)
  THEN CASE WHEN c.state = s.source_state THEN 'GENERATED' ELSE 'STALE' END ELSE 'INVALID' END AS status FROM separations s JOIN docs d USING (doc_id) LEFT JOIN current c USING (doc_id)""",
    "fingerprints": """
SELECT doc_id, sha256(string_agg(node_id || ':' || type || ':' || CAST(floor(x_mm * 100 + 0.5) AS BIGINT) || ':' || CAST(floor(y_mm * 100 + 0.5) AS BIGINT) || ':' || CAST(floor(w_mm * 100 + 0.5) AS BIGINT) || ':' || CAST(floor(h_mm * 100 + 0.5) AS BIGINT)
  || ':' || CASE WHEN visible THEN 'shown' ELSE 'hidden' END || ':' || coalesce(fill, 'none'), '|' ORDER BY node_id)) AS fingerprint, count(*) AS nodes FROM nodes GROUP BY doc_id""",
    "slug_names": "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, sha256(p_name) AS cache_key FROM part",
    "white_underbase": """
WITH boxes AS (SELECT doc_id, CAST(floor(x_mm) AS BIGINT) AS x0, CAST(floor(y_mm) AS BIGINT) AS y0, CAST(floor(x_mm + w_mm) AS BIGINT) AS x1, CAST(floor(y_mm + h_mm) AS BIGINT) AS y1, CAST(floor(opacity * 255 + 0.5) AS BIGINT) AS alpha
  FROM nodes WHERE visible AND type NOT IN ('cut_contour', 'technical_guide') AND parent_id IS NULL AND w_mm > 0),
cells AS (SELECT doc_id, alpha, x, unnest(range(y0, y1)) AS y FROM (SELECT *, unnest(range(x0, x1)) AS x FROM boxes)),
cover AS (SELECT doc_id, x, y, max(alpha) AS alpha FROM cells GROUP BY ALL)
SELECT doc_id, count(*) AS covered, CAST(sum(alpha) AS BIGINT) AS alpha_sum, max(alpha) AS alpha_max FROM cover GROUP BY doc_id""",
    "varnish_mask": f"""
WITH boxes AS (SELECT n.doc_id, greatest(0, CAST(floor(x_mm) AS BIGINT)) AS x0, greatest(0, CAST(floor(y_mm) AS BIGINT)) AS y0, least(CAST(floor(width_mm) AS BIGINT), CAST(floor(x_mm + w_mm) AS BIGINT)) AS x1, least(CAST(floor(height_mm) AS BIGINT), CAST(floor(y_mm + h_mm) AS BIGINT)) AS y1
  FROM nodes n JOIN docs d ON d.doc_id = n.doc_id WHERE visible AND type IN ('raster_image', 'group', 'vector_path') AND parent_id IS NULL),
cover AS (SELECT DISTINCT doc_id, x, unnest(range(y0, y1)) AS y FROM (SELECT *, unnest(range(x0, x1)) AS x FROM boxes))
SELECT d.doc_id, count(c.x) AS artwork_cells, CAST(max(width_mm * height_mm) AS BIGINT) AS full_cells, {_r('CASE WHEN max(width_mm * height_mm) > 0 THEN count(c.x) / max(width_mm * height_mm) ELSE 0 END')} AS coverage,
       min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM docs d LEFT JOIN cover c ON c.doc_id = d.doc_id GROUP BY d.doc_id""",
    "ramp_width": f"WITH {_EDGES}, {_RAMPS} SELECT s.image_id, coalesce(samples, 0) AS samples, {_r('coalesce(wramp, 1.0)')} AS wramp FROM size s LEFT JOIN ramps r ON r.image_id = s.image_id",
    "local_variety": f"WITH {_EDGES}, {_VARIETY} SELECT s.image_id, coalesce(cells, 0) AS cells, coalesce(cpoly, 0) AS cpoly FROM size s LEFT JOIN variety v ON v.image_id = s.image_id",
    "backend_route": f"""WITH {_EDGES}, {_RAMPS}, {_VARIETY},
features AS (SELECT s.image_id, coalesce(cpoly, 0) AS cpoly, coalesce(wramp, 1.0) AS wramp FROM size s LEFT JOIN ramps r ON r.image_id = s.image_id LEFT JOIN variety v ON v.image_id = s.image_id)
SELECT image_id, cpoly, {_r('wramp')} AS wramp, CASE WHEN cpoly >= 80 THEN 'REGION_GRAPH' WHEN wramp <= 9.5 THEN 'DIRECT' ELSE 'UNCERTAIN' END AS backend, cpoly < 80 AND wramp > 9.5 AS needs_validation FROM features""",
    "point_in_ring": """
WITH sides AS (SELECT a.ring_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM rings a JOIN rings b ON b.ring_id = a.ring_id AND b.pos = (a.pos + 1) % a.n),
probes AS (SELECT ring_id AS probe_id, avg(x) AS qx, avg(y) AS qy FROM rings GROUP BY ring_id)
SELECT probe_id, ring_id, count(*) AS crossings FROM probes, sides WHERE probe_id <> ring_id AND (ay > qy) <> (b_y > qy) AND qx < (bx - ax) * (qy - ay) / (b_y - ay) + ax GROUP BY probe_id, ring_id HAVING count(*) % 2 = 1""",
    "shared_edge_absorption": """
WITH sides AS (
  SELECT ring_id, pos, least(x, nx) AS ex0, greatest(x, nx) AS ex1, CASE WHEN x <= nx THEN y ELSE ny END AS ey0, CASE WHEN x <= nx THEN ny ELSE y END AS ey1
  FROM (SELECT ring_id, pos, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM (SELECT ring_id, pos, floor(x / 10) AS x, floor(y / 10) AS y FROM rings) g WINDOW w AS (PARTITION BY ring_id ORDER BY pos)) q WHERE nx IS NOT NULL
)
SELECT a.ring_id AS ring_a, b.ring_id AS ring_b, count(*) AS shared_edges FROM sides a JOIN sides b ON b.ex0 = a.ex0 AND b.ex1 = a.ex1 AND b.ey0 = a.ey0 AND b.ey1 = a.ey1 AND b.ring_id > a.ring_id GROUP BY a.ring_id, b.ring_id""",
    "point_to_segment": f"""
WITH sides AS (SELECT a.ring_id, a.x, a.y, b.x - a.x AS vx, b.y - a.y AS vy FROM rings a JOIN rings b ON b.ring_id = a.ring_id AND b.pos = (a.pos + 1) % a.n),
feet AS (
  SELECT least(p.ring_id, s.ring_id) AS pair_id, p.ring_id, p.pos, p.x AS px, p.y AS py, s.x, s.y, vx, vy, CASE WHEN vx * vx + vy * vy = 0 THEN 0 ELSE greatest(0, least(1, ((p.x - s.x) * vx + (p.y - s.y) * vy) / (vx * vx + vy * vy))) END AS t
  FROM rings p, sides s WHERE abs(p.ring_id - s.ring_id) = 1
),
near AS (SELECT pair_id, ring_id, pos, min(sqrt((px - x - t * vx) ** 2 + (py - y - t * vy) ** 2)) AS d FROM feet GROUP BY ALL),
ways AS (SELECT pair_id, ring_id, list(d ORDER BY d) AS ds FROM near GROUP BY ALL)
SELECT pair_id, CAST(sum(len(ds)) AS BIGINT) AS points, {_r('avg(list_avg(ds))')} AS chamfer, {_r('max(ds[-1])')} AS hausdorff, {_r('max(CASE WHEN ring_id = pair_id THEN ds[len(ds) // 2 + 1] END)')} AS p50,
       {_r('max(CASE WHEN ring_id = pair_id THEN ds[CAST(floor(len(ds) * 0.95) AS BIGINT) + 1] END)')} AS p95 FROM ways GROUP BY pair_id""",
    "path_simplify": """
WITH sized AS (SELECT *, count(*) OVER (PARTITION BY ring_id) AS m FROM worn_rings),
one AS (SELECT a.ring_id, a.pos, a.x, a.y FROM sized a JOIN sized b ON b.ring_id = a.ring_id AND b.pos = (a.pos + a.m - 1) % a.m WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) >= 0.0001),
numbered AS (SELECT ring_id, x, y, row_number() OVER (PARTITION BY ring_id ORDER BY pos) - 1 AS pos, count(*) OVER (PARTITION BY ring_id) AS m FROM one),
bent AS (
  SELECT c.ring_id, c.pos, c.x, c.y, q.x - p.x AS vx, q.y - p.y AS vy, c.x - p.x AS ux, c.y - p.y AS uy FROM numbered c JOIN numbered p ON p.ring_id = c.ring_id AND p.pos = (c.pos + c.m - 1) % c.m JOIN numbered q ON q.ring_id = c.ring_id AND q.pos = (c.pos + 1) % c.m
),
left_over AS (SELECT ring_id, pos, x, y FROM bent WHERE vx * vx + vy * vy = 0 OR ux * vx + uy * vy <= 0 OR ux * vx + uy * vy >= vx * vx + vy * vy OR abs(ux * vy - uy * vx) / sqrt(vx * vx + vy * vy) > 0.005),
result AS (SELECT * FROM left_over WHERE ring_id IN (SELECT ring_id FROM left_over GROUP BY ring_id HAVING count(*) >= 3) UNION ALL SELECT ring_id, pos, x, y FROM worn_rings WHERE ring_id NOT IN (SELECT ring_id FROM left_over GROUP BY ring_id HAVING count(*) >= 3))
SELECT ring_id, row_number() OVER (PARTITION BY ring_id ORDER BY pos) - 1 AS pos, x, y FROM result""",
    "chamfer_hausdorff": f"""
WITH gaps AS (SELECT a.ring_id AS a_id, b.ring_id AS b_id, a.pos, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM rings a JOIN rings b ON b.ring_id = a.ring_id + 1 GROUP BY ALL),
sorted AS (SELECT a_id, b_id, list(d ORDER BY d) AS ds FROM gaps GROUP BY a_id, b_id)
SELECT a_id, b_id, len(ds) AS points, {_r('list_avg(ds)')} AS chamfer, {_r('list_max(ds)')} AS hausdorff, {_r('ds[CAST(floor(len(ds) * 0.95) AS BIGINT) + 1]')} AS p95 FROM sorted""",
    "boundary_distance": f"""
WITH apart AS (SELECT a.ring_id AS pair_id, a.pos AS p, b.pos AS q, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM rings a JOIN rings b ON b.ring_id = a.ring_id + 1),
near AS (SELECT pair_id, 0 AS way, p, min(d) AS d FROM apart GROUP BY pair_id, p UNION ALL SELECT pair_id, 1, q, min(d) FROM apart GROUP BY pair_id, q)
SELECT pair_id, count(*) AS points, {_r('avg(d)')} AS chamfer, {_r('max(d)')} AS hausdorff FROM near GROUP BY pair_id""",
    "segment_intersections": """
WITH sides AS (SELECT a.ring_id, a.pos, a.n, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM rings a JOIN rings b ON b.ring_id = a.ring_id AND b.pos = (a.pos + 1) % a.n),
pairs AS (
  SELECT p.ring_id, (p.x2 - p.x1) * (q.y1 - p.y1) - (p.y2 - p.y1) * (q.x1 - p.x1) AS c1, (p.x2 - p.x1) * (q.y2 - p.y1) - (p.y2 - p.y1) * (q.x2 - p.x1) AS c2,
         (q.x2 - q.x1) * (p.y1 - q.y1) - (q.y2 - q.y1) * (p.x1 - q.x1) AS c3, (q.x2 - q.x1) * (p.y2 - q.y1) - (q.y2 - q.y1) * (p.x2 - q.x1) AS c4
  FROM sides p JOIN sides q ON q.ring_id = p.ring_id AND q.pos > p.pos + 1 AND NOT (p.pos = 0 AND q.pos = p.n - 1)
  WHERE greatest(least(p.x1, p.x2), least(q.x1, q.x2)) <= least(greatest(p.x1, p.x2), greatest(q.x1, q.x2)) AND greatest(least(p.y1, p.y2), least(q.y1, q.y2)) <= least(greatest(p.y1, p.y2), greatest(q.y1, q.y2))
)
SELECT ring_id, count(*) AS close_pairs, count(*) FILTER (WHERE c1 * c2 < 0 AND c3 * c4 < 0) AS crossings, count(*) FILTER (WHERE c1 = 0 AND c2 = 0) AS overlaps FROM pairs GROUP BY ring_id""",
    "corner_classes": f"""
WITH sized AS (SELECT *, least(8, greatest(1, (n - 1) // 2)) AS w FROM rings WHERE n >= 3),
arms AS (
  SELECT c.ring_id, c.pos, c.n, c.w, c.x - p.x AS ax, c.y - p.y AS ay, q.x - c.x AS bx, q.y - c.y AS b_y, c.x - f.x AS cx, c.y - f.y AS cy, g.x - c.x AS dx, g.y - c.y AS dy FROM sized c
  JOIN rings p ON p.ring_id = c.ring_id AND p.pos = (c.pos + c.n - 1) % c.n JOIN rings q ON q.ring_id = c.ring_id AND q.pos = (c.pos + 1) % c.n
  JOIN rings f ON f.ring_id = c.ring_id AND f.pos = (c.pos + c.n - c.w) % c.n JOIN rings g ON g.ring_id = c.ring_id AND g.pos = (c.pos + c.w) % c.n
),
turns AS (
  SELECT ring_id, pos, n, w, {_r(_ANGLE.format(ax='ax', ay='ay', bx='bx', by='b_y'))} AS near_turn, {_r(_ANGLE.format(ax='cx', ay='cy', bx='dx', by='dy'))} AS wide_turn, least(sqrt(ax * ax + ay * ay), sqrt(bx * bx + b_y * b_y)) AS arm FROM arms
),
beaten AS (
  SELECT DISTINCT t.ring_id, t.pos FROM turns t JOIN turns o ON o.ring_id = t.ring_id AND o.pos <> t.pos AND least((o.pos - t.pos + t.n) % t.n, (t.pos - o.pos + t.n) % t.n) <= t.w
  WHERE t.n > 8 AND (o.wide_turn > t.wide_turn OR (o.wide_turn = t.wide_turn AND o.pos < t.pos))
)
SELECT ring_id, CASE WHEN near_turn >= 45 AND wide_turn >= 35 AND arm >= 0.75 AND (ring_id, pos) NOT IN (SELECT (ring_id, pos) FROM beaten) THEN 'HARD_CORNER' WHEN wide_turn >= 20 OR near_turn >= 12 THEN 'SOFT_CORNER' ELSE 'REGULAR' END AS class, count(*) AS points
FROM turns GROUP BY 1, 2""",
    "hole_provenance": """
WITH boxes AS (SELECT doc_id, node_id, x_mm + w_mm / 2 AS cx, y_mm + h_mm / 2 AS cy, w_mm * h_mm AS area FROM nodes WHERE type = 'vector_path' AND w_mm > 0),
near AS (SELECT h.doc_id, h.node_id, f.node_id AS front, sqrt(((h.cx) - (f.cx)) * ((h.cx) - (f.cx)) + ((h.cy) - (f.cy)) * ((h.cy) - (f.cy))) AS gap, h.area, row_number() OVER (PARTITION BY h.doc_id, h.node_id ORDER BY sqrt(((h.cx) - (f.cx)) * ((h.cx) - (f.cx)) + ((h.cy) - (f.cy)) * ((h.cy) - (f.cy))), f.node_id) AS k
  FROM boxes h JOIN boxes f ON f.doc_id = h.doc_id AND f.node_id <> h.node_id AND f.area > h.area)
SELECT doc_id, node_id, front, floor((gap) * 1000000 + 0.5) / 1000000 AS gap, CASE WHEN area < 100 THEN 'ARTEFACT' WHEN gap < 20 THEN 'COUNTERFORM' ELSE 'OPENING' END AS class FROM near WHERE k = 1""",
    "containment_tree": """
WITH boxes AS (SELECT doc_id, node_id, x_mm AS x0, y_mm AS y0, x_mm + w_mm AS x1, y_mm + h_mm AS y1, w_mm * h_mm AS area FROM nodes WHERE w_mm > 0 AND type <> 'technical_guide'),
holds AS (
  SELECT c.doc_id, c.node_id, p.node_id AS parent, row_number() OVER (PARTITION BY c.doc_id, c.node_id ORDER BY p.area, p.node_id) AS k, count(*) OVER (PARTITION BY c.doc_id, c.node_id) AS depth
  FROM boxes c JOIN boxes p ON p.doc_id = c.doc_id AND p.node_id <> c.node_id AND p.area > c.area AND p.x0 <= c.x0 + 0.01 AND p.y0 <= c.y0 + 0.01 AND p.x1 >= c.x1 - 0.01 AND p.y1 >= c.y1 - 0.01
)
SELECT b.doc_id, b.node_id, h.parent AS parent_region, CAST(coalesce(h.depth, 0) AS BIGINT) AS depth FROM boxes b LEFT JOIN holds h ON h.doc_id = b.doc_id AND h.node_id = b.node_id AND h.k = 1""",
    "component_correspondence": """
WITH boxes AS (SELECT doc_id, node_id, coalesce(fill, 'none') AS fill, x_mm AS x0, y_mm AS y0, x_mm + w_mm AS x1, y_mm + h_mm AS y1, w_mm * h_mm AS area FROM nodes WHERE type = 'vector_path' AND w_mm > 0),
pairs AS (
  SELECT p.node_id AS a_id, q.node_id AS b_id, p.area AS a_area, q.area AS b_area, greatest(0e0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0e0, least(p.y1, q.y1) - greatest(p.y0, q.y0)) AS both_area,
         sqrt((((p.x0 + p.x1) / 2) - ((q.x0 + q.x1) / 2)) * (((p.x0 + p.x1) / 2) - ((q.x0 + q.x1) / 2)) + (((p.y0 + p.y1) / 2) - ((q.y0 + q.y1) / 2)) * (((p.y0 + p.y1) / 2) - ((q.y0 + q.y1) / 2))) AS apart
  FROM boxes p JOIN boxes q ON q.fill = p.fill AND q.doc_id = p.doc_id + 1
),
ranked AS (SELECT *, both_area / (a_area + b_area - both_area) AS iou, row_number() OVER (PARTITION BY a_id ORDER BY both_area / (a_area + b_area - both_area) DESC, apart, b_id) AS k FROM pairs)
SELECT a_id, b_id, floor((iou) * 1000000 + 0.5) / 1000000 AS iou, floor((apart) * 1000000 + 0.5) / 1000000 AS centroid_distance, floor((b_area / a_area) * 1000000 + 0.5) / 1000000 AS area_ratio FROM ranked WHERE k = 1""",
}

# Superpixels and majority votes with a row for every pixel and cell around it, ranked by windows.
_SL, _SA, _SB = E.oklab("r", "g", "b")
_SLIC_CENTRES = "SELECT image_id, cell_x, cell_y, avg(x) AS cx, avg(y) AS cy, avg(l) AS cl, avg(a) AS ca, avg(b) AS cb FROM {src} GROUP BY image_id, cell_x, cell_y"


def _slic_assign(source: str) -> str:
    """Nearest centre among those of the cells around a pixel; ties go to the higher, then lefter cell."""
    gap = "(c.cl - p.l) * (c.cl - p.l) + (c.ca - p.a) * (c.ca - p.a) + (c.cb - p.b) * (c.cb - p.b)"
    return f"""SELECT image_id, x, y, l, a, b, cell_x, cell_y, gx, gy FROM (
    SELECT p.image_id, p.x, p.y, p.l, p.a, p.b, p.gx, p.gy, c.cell_x, c.cell_y, row_number() OVER (PARTITION BY p.image_id, p.x, p.y
      ORDER BY floor((144 * ({gap}) + ((c.cx - p.x) * (c.cx - p.x) + (c.cy - p.y) * (c.cy - p.y)) / 64) * 1000000000), c.cell_y, c.cell_x) AS k
    FROM (SELECT q.*, gx + d.dx AS want_x, gy + d.dy AS want_y FROM px q JOIN around d ON true) p JOIN ({_SLIC_CENTRES.replace('{src}', source)}) c ON c.image_id = p.image_id AND c.cell_x = p.want_x AND c.cell_y = p.want_y) r WHERE k = 1"""


_SLIC = (f"""
WITH px AS (SELECT image_id, x, y, {_SL} AS l, {_SA} AS a, {_SB} AS b, {E.whole('x / 8')} AS gx, {E.whole('y / 8')} AS gy FROM pixels WHERE a > 0),
around AS (SELECT a.d AS dx, b.d AS dy FROM (SELECT -1 AS d UNION ALL SELECT 0 UNION ALL SELECT 1) a JOIN (SELECT -1 AS d UNION ALL SELECT 0 UNION ALL SELECT 1) b ON true),
seeded AS (SELECT px.*, gx AS cell_x, gy AS cell_y FROM px),
one AS ({_slic_assign('seeded')}),
two AS ({_slic_assign('one')})
SELECT image_id, cell_x, cell_y, count(*) AS area, {E.rounded('avg(l)')} AS ok_l, {E.rounded('avg(x)')} AS cx, {E.rounded('avg(y)')} AS cy FROM two GROUP BY image_id, cell_x, cell_y""")


def _icm_round(source: str) -> str:
    """One vote of the 8 neighbours: each cell casts its label to itself and around; two aggregates, no self-join."""
    return f"""SELECT image_id, x, y, CASE WHEN max(CASE WHEN k = 1 THEN n END) >= 5 THEN max(CASE WHEN k = 1 THEN v END) ELSE max(CASE WHEN own = 1 THEN v END) END AS label
  FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY n DESC, v) AS k FROM (
      SELECT image_id, x + dx AS x, y + dy AS y, label AS v, sum(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE 1 END) AS n, max(CASE WHEN dx = 0 AND dy = 0 THEN 1 ELSE 0 END) AS own
      FROM {source} JOIN offsets ON true GROUP BY image_id, x + dx, y + dy, label) cast_votes) ranked
  GROUP BY image_id, x, y HAVING max(own) = 1"""


_ICM = (f"""
WITH offsets AS (SELECT a.d AS dx, b.d AS dy FROM (SELECT -1 AS d UNION ALL SELECT 0 UNION ALL SELECT 1) a JOIN (SELECT -1 AS d UNION ALL SELECT 0 UNION ALL SELECT 1) b ON true),
start AS (SELECT image_id, x, y, label FROM labels_map),
one AS ({_icm_round('start')}),
two AS ({_icm_round('one')}),
three AS ({_icm_round('two')})
SELECT image_id, label, count(*) AS area FROM three GROUP BY image_id, label""")

ORACLES["slic_superpixels"], ORACLES["icm_majority"] = _SLIC, _ICM
