"""Production checks: contour integrity, separations of transfer printing, and the list of issues with their fixes.

Outlines come as points(doc_id, node_id, contour, closed, pos, n, x, y).
"""

from __future__ import annotations

from inkfold.functions import expressions as E
from inkfold.operators.template import Operator

# Fixed values in mm and mm2: touch, overlap, closing gap, least area.
TOUCH, OVERLAP, GAP, LEAST_AREA = 0.001, 0.005, 0.5, 0.01
_STRIP = 8


# Nodes of so many sides or fewer have one strip: their sides would lie in many of them.
_FEW_SIDES = 128


def _cross(a: str, b: str, c: str) -> str:
    return f"((x{b} - x{a}) * (y{c} - y{a}) - (y{b} - y{a}) * (x{c} - x{a}))"


def _near(a: str, b: str) -> str:
    return f"{E.distance((f'x{a}', f'x{b}'), (f'y{a}', f'y{b}'))} <= {TOUCH}"


def _between(side: str, c: str) -> str:
    """Whether c lies in the box of a side, touching included."""
    return " AND ".join(f"{v}{c} BETWEEN {side}_low_{v} - {TOUCH} AND {side}_high_{v} + {TOUCH}" for v in "xy")


def _integrity(points: str) -> str:
    """Per node: vertices, area, open gap, crossings, overlapping sides. Sides meet only sides of the same strip of their node.

    What is told of one side comes before sides meet, so that the code of a pair is short.
    """
    strip = lambda v, pad: E.whole(f"({v}_y {pad} {TOUCH}) / {_STRIP}")
    apart = lambda d: f"({d[0]} > {TOUCH} AND {d[1]} < -{TOUCH}) OR ({d[0]} < -{TOUCH} AND {d[1]} > {TOUCH})"
    told = ("low_x", "high_x", "low_y", "high_y", "short")
    return f"""
WITH dealt AS (SELECT /*deal doc_id, node_id*/ * FROM {{{points}}}),
turned AS (
  SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, count(*) OVER (PARTITION BY doc_id, node_id) AS m FROM dealt WINDOW w AS (PARTITION BY doc_id, node_id, contour ORDER BY pos)
),
outlines AS (
  SELECT doc_id, node_id, contour, count(*) AS vertices, abs(sum(x * ny - nx * y)) / 2 AS area, max(CASE WHEN closed THEN 1 ELSE 0 END) AS closed, max(CASE WHEN NOT closed THEN 1 ELSE 0 END) AS opened,
         max(CASE WHEN pos = n - 1 THEN {E.distance(('x', 'nx'), ('y', 'ny'))} END) AS gap, sum(CASE WHEN pos < n - 1 THEN {E.distance(('x', 'nx'), ('y', 'ny'))} ELSE 0 END) / greatest(1, count(*) - 1) AS mean_side
  FROM turned GROUP BY doc_id, node_id, contour
),
wholes AS (
  SELECT doc_id, node_id, CAST(sum(vertices) AS BIGINT) AS vertices, sum(area) AS area,
         max(CASE WHEN vertices >= 2 AND gap > {GAP} AND (opened = 1 OR (closed = 0 AND vertices >= 3 AND gap < 0.5 * mean_side)) THEN 1 ELSE 0 END) = 1 AS open_contour
  FROM outlines GROUP BY doc_id, node_id
),
sides AS (
  SELECT doc_id, node_id, m, contour * 4294967296 + pos AS k, x AS x1, y AS y1, nx AS x2, ny AS y2 FROM turned
),
boxes AS (SELECT *, least(x1, x2) AS low_x, greatest(x1, x2) AS high_x, least(y1, y2) AS low_y, greatest(y1, y2) AS high_y, {_near('1', '2')} AS short FROM sides),
low AS (SELECT *, CASE WHEN m <= {_FEW_SIDES} THEN 0 ELSE {strip('low', '-')} END AS first_strip FROM boxes),
spread AS (SELECT *, explode(sequence(first_strip, CASE WHEN m <= {_FEW_SIDES} THEN 0 ELSE {strip('high', '+')} END)) AS strip FROM low),
cut AS (SELECT /*deal doc_id, node_id, strip*/ * FROM spread),
met AS (
  SELECT p.doc_id, p.node_id, p.x1, p.y1, p.x2, p.y2, q.x1 AS x3, q.y1 AS y3, q.x2 AS x4, q.y2 AS y4, {', '.join(f'p.{c} AS p_{c}, q.{c} AS q_{c}' for c in told)} FROM cut p
  JOIN cut q ON q.doc_id = p.doc_id AND q.node_id = p.node_id AND q.strip = p.strip AND p.strip = greatest(p.first_strip, q.first_strip) AND q.k > p.k
    AND p.low_x - {TOUCH} <= q.high_x + {TOUCH} AND q.low_x - {TOUCH} <= p.high_x + {TOUCH} AND p.low_y - {TOUCH} <= q.high_y + {TOUCH} AND q.low_y - {TOUCH} <= p.high_y + {TOUCH}
),
turns AS (
  SELECT *, {_cross('3', '4', '1')} AS d1, {_cross('3', '4', '2')} AS d2, {_cross('1', '2', '3')} AS d3, {_cross('1', '2', '4')} AS d4 FROM met
),
judged AS (
  SELECT doc_id, node_id,
         CASE WHEN greatest(abs(d1), abs(d2), abs(d3), abs(d4)) <= {TOUCH} THEN
                CASE WHEN CASE WHEN abs(x2 - x1) > abs(y2 - y1) THEN least(p_high_x, q_high_x) - greatest(p_low_x, q_low_x) ELSE least(p_high_y, q_high_y) - greatest(p_low_y, q_low_y) END > {OVERLAP} AND NOT p_short AND NOT q_short THEN 2 ELSE 0 END
              WHEN {_near('1', '3')} OR {_near('1', '4')} OR {_near('2', '3')} OR {_near('2', '4')} THEN 0
              WHEN (({apart(('d1', 'd2'))}) AND ({apart(('d3', 'd4'))})) OR (abs(d1) <= {TOUCH} AND {_between('q', '1')}) OR (abs(d2) <= {TOUCH} AND {_between('q', '2')})
                OR (abs(d3) <= {TOUCH} AND {_between('p', '3')}) OR (abs(d4) <= {TOUCH} AND {_between('p', '4')}) THEN 1 ELSE 0 END AS kind
  FROM turns
),
counts AS (
  SELECT doc_id, node_id, CAST(sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END) AS BIGINT) AS crossings, CAST(sum(CASE WHEN kind = 2 THEN 1 ELSE 0 END) AS BIGINT) AS overlapping FROM judged GROUP BY doc_id, node_id
),
report AS (
  SELECT w.doc_id, w.node_id, vertices, {E.rounded('area', 4)} AS area_mm2, open_contour, coalesce(crossings, 0) AS crossings, coalesce(overlapping, 0) AS overlapping, vertices < 3 OR area < {LEAST_AREA} AS degenerate
  FROM wholes w LEFT JOIN counts c ON c.doc_id = w.doc_id AND c.node_id = w.node_id
)
SELECT *, NOT (open_contour OR crossings > 0 OR overlapping > 0 OR degenerate) AS valid FROM report"""


cut_integrity = Operator(_integrity("cut_rings"))
path_integrity = Operator(_integrity("path_points"))

# What a path carries without need: equal neighbours, sides of no length, points on the straight line between their neighbours.
path_analysis = Operator(f"""
WITH seq AS (SELECT doc_id, node_id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM {{path_points}} WINDOW w AS (PARTITION BY doc_id, node_id, contour ORDER BY pos)),
spans AS (SELECT *, (nx - px) * (nx - px) + (ny - py) * (ny - py) AS len2, (x - px) * (nx - px) + (y - py) * (ny - py) AS dot FROM seq)
SELECT doc_id, node_id, count(*) AS points, CAST(sum(CASE WHEN x = px AND y = py THEN 1 ELSE 0 END) AS BIGINT) AS duplicates, CAST(sum(CASE WHEN {E.distance(('x', 'px'), ('y', 'py'))} < 0.0001 THEN 1 ELSE 0 END) AS BIGINT) AS zero_length,
       CAST(sum(CASE WHEN len2 > 0 AND dot > 0 AND dot < len2 AND abs((x - px) * (ny - py) - (y - py) * (nx - px)) / sqrt(len2) <= 0.005 THEN 1 ELSE 0 END) AS BIGINT) AS collinear, count(*) > 500 AS excessive
FROM spans GROUP BY doc_id, node_id""")

_STATE = "n.node_id + CAST(floor(n.x_mm * 100 + 0.5) AS BIGINT) * 3 + CAST(floor(n.y_mm * 100 + 0.5) AS BIGINT) * 7 + CAST(floor(n.w_mm * 100 + 0.5) AS BIGINT) * 11 + CAST(floor(n.h_mm * 100 + 0.5) AS BIGINT) * 13"
_SEPARATIONS = f"""now AS (
  SELECT n.doc_id, CAST(sum({_STATE}) AS BIGINT) AS state, max(n.x_mm + n.w_mm) - min(n.x_mm) AS art_w, max(n.y_mm + n.h_mm) - min(n.y_mm) AS art_h FROM {{nodes}} n
  WHERE n.visible AND n.parent_id IS NULL AND n.type IN ('raster_image', 'group', 'vector_path') GROUP BY n.doc_id
),
states AS (
  SELECT s.doc_id, s.role, CASE WHEN NOT (abs(s.width_mm - d.width_mm) <= 0.01 AND abs(s.height_mm - d.height_mm) <= 0.01) AND NOT coalesce(abs(s.width_mm - a.art_w) <= 0.01 AND abs(s.height_mm - a.art_h) <= 0.01, false) THEN 'INVALID'
         WHEN a.state IS NULL OR a.state <> s.source_state THEN 'STALE' ELSE 'GENERATED' END AS status
  FROM {{separations}} s JOIN {{docs}} d ON d.doc_id = s.doc_id LEFT JOIN now a ON a.doc_id = s.doc_id
)"""
separation_state = Operator(f"WITH {_SEPARATIONS} SELECT doc_id, role, status FROM states")

dtf_uv_issues = Operator(f"""
WITH {_SEPARATIONS},
transfer AS (SELECT * FROM {{docs}} WHERE profile_id = 'dtf-uv'),
alpha AS (SELECT image_id, CAST(sum(CASE WHEN a = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS clear_share, CAST(sum(CASE WHEN a > 0 AND a < 255 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS soft_share FROM {{pixels}} GROUP BY image_id),
rasters AS (SELECT n.doc_id, n.node_id, clear_share, soft_share FROM {{nodes}} n JOIN transfer d ON d.doc_id = n.doc_id JOIN alpha a ON a.image_id = n.node_id % 10 WHERE n.type = 'raster_image' AND n.parent_id IS NULL),
roles AS (SELECT 'WHITE' AS role UNION ALL SELECT 'CLEAR'),
wanted AS (SELECT d.doc_id, r.role, CASE r.role WHEN 'WHITE' THEN white_policy ELSE clear_policy END AS policy FROM transfer d JOIN roles r ON true)
SELECT doc_id, CASE WHEN clear_share = 0 THEN 'DTF_UV_OPAQUE_ARTWORK' ELSE 'DTF_UV_ALPHA_VALID' END AS rule_id, 'info' AS severity, node_id FROM rasters
UNION ALL SELECT doc_id, 'DTF_UV_SEMI_TRANSPARENCY', 'info', node_id FROM rasters WHERE soft_share > 0.001
UNION ALL SELECT w.doc_id, concat(w.role, '_REQUIRED_NOT_GENERATED'), 'error', CAST(NULL AS BIGINT) FROM wanted w LEFT JOIN {{separations}} s ON s.doc_id = w.doc_id AND s.role = w.role WHERE w.policy = 'REQUIRED' AND s.doc_id IS NULL
UNION ALL SELECT s.doc_id, concat(s.role, '_SEPARATION_', s.status), 'error', CAST(NULL AS BIGINT) FROM states s JOIN transfer d ON d.doc_id = s.doc_id WHERE s.status <> 'GENERATED'""")


def _found(code: str, severity: str, category: str, fix: str, source: str, node: str = "node_id") -> str:
    return f"SELECT doc_id, '{code}' AS code, {severity} AS severity, '{category}' AS category, {node} AS node_id, {fix} AS fix_class FROM {source}"


_AUTO, _ASK, _HAND, _TELL = "'AUTO_FIXABLE'", "'REQUIRES_CONFIRMATION'", "'MANUAL'", "'INFORMATIONAL'"
_ERROR, _WARN, _INFO = "'error'", "'warning'", "'info'"
_NONE = "CAST(NULL AS BIGINT)"
_OPEN = "outline_gaps WHERE open_now"


def _fanned(source: str, codes: list[tuple[str, str, str, str, str]]) -> str:
    """Several findings of one relation in one pass: code, severity, category, fix, test."""
    kinds = " UNION ALL ".join(f"SELECT '{code}|{k}' AS kind, '{code}' AS code, {severity} AS severity, '{category}' AS category, {fix} AS fix_class" for k, (code, severity, category, fix, _) in enumerate(codes))
    tests = " OR ".join(f"(k.kind = '{code}|{k}' AND {test})" for k, (code, _, _, _, test) in enumerate(codes))
    return f"SELECT f.doc_id, k.code, k.severity, k.category, f.node_id, k.fix_class FROM {source} f JOIN ({kinds}) k ON {tests}"


# Rules of the validation report that have a code of their own; the rest is generic.
# Rule, condition, code, severity, category and whether it can be mended.
_MAPPED = [
    ("V008_RASTER_LOW_DPI", "f.detail = 'critical_low_dpi'", "CRITICAL_LOW_DPI", _ERROR, "resolution", _HAND),
    ("V008_RASTER_LOW_DPI", "f.detail <> 'critical_low_dpi'", "LOW_DPI", _WARN, "resolution", _HAND),
    ("V009_CUT_CONTOUR_ORPHAN", "true", "CUT_CONTOUR_ORPHAN", _ERROR, "cut", _HAND),
    ("V010_CUT_CONTOUR_INVALID_GEOMETRY", "true", "CUT_CONTOUR_INVALID_GEOMETRY", _ERROR, "cut", _HAND),
    ("V003_OBJECT_COMPLETELY_OUTSIDE", "true", "OUT_OF_BOUNDS", _WARN, "safety", _ASK),
    ("V004_OBJECT_PARTIALLY_OUTSIDE", "true", "OUT_OF_BOUNDS", _WARN, "safety", _ASK),
    ("V006_BLEED_INSUFFICIENT_COVERAGE", "true", "BLEED_INSUFFICIENT", _WARN, "bleed", _HAND),
    ("V007_SAFETY_MARGIN_INTERSECTION", "true", "SAFETY_MARGIN_VIOLATION", _WARN, "safety", _ASK),
    ("V001_ARTBOARD_INVALID_DIMENSIONS", "true", "INVALID_DIMENSIONS", _ERROR, "document", _HAND),
    ("V002_NODE_INVALID_DIMENSIONS", "true", "INVALID_DIMENSIONS", _ERROR, "document", _HAND),
]
# Told elsewhere in the list, or no problem.
_SILENT = ["V005_BLEED_CONFIGURED", "V011_CUT_CONTOUR_VALID", "V013_GUIDES_SUMMARY", "V014_CUT_CONTOUR_SELF_INTERSECTION", "V015_CUT_CONTOUR_OVERLAPPING_SEGMENT", "V016_CUT_CONTOUR_OPEN", "V016_CUT_CONTOUR_REQUIRED_MISSING"]
_KNOWN = ", ".join(f"'{r}'" for r in dict.fromkeys([m[0] for m in _MAPPED] + _SILENT))
_CODES = [
    _found("MISSING_CUT_CONTOUR", _ERROR, "cut", _AUTO, "(SELECT n.doc_id, min(CASE WHEN n.type = 'group' THEN n.node_id END) AS node_id FROM {nodes} n JOIN {docs} d ON d.doc_id = n.doc_id WHERE d.profile_id <> 'dtf-uv' GROUP BY n.doc_id HAVING sum(CASE WHEN n.type = 'cut_contour' THEN 1 ELSE 0 END) = 0 AND sum(CASE WHEN n.type = 'group' THEN 1 ELSE 0 END) > 0) q"),
    _found("CUT_CONTOUR_MISALIGNED", _WARN, "cut", _AUTO, "(SELECT c.doc_id, c.node_id FROM {nodes} c JOIN {nodes} s ON s.doc_id = c.doc_id AND s.node_id = c.source_node_id AND s.type = 'group' WHERE c.type = 'cut_contour' AND (abs(s.x_mm - c.x_mm) > 0.1 OR abs(s.y_mm - c.y_mm) > 0.1)) q"),
    _found("CUT_CONTOUR_OPEN", _ERROR, "cut", f"CASE WHEN gap <= {GAP} THEN {_AUTO} ELSE {_ASK} END", _OPEN),
    _found("CUT_CONTOUR_OUTSIDE_ARTBOARD", _WARN, "cut", _ASK, "(SELECT c.doc_id, c.node_id FROM {nodes} c JOIN {docs} d ON d.doc_id = c.doc_id WHERE c.type = 'cut_contour' AND (c.x_mm < 0 OR c.y_mm < 0 OR c.x_mm + c.w_mm > d.width_mm OR c.y_mm + c.h_mm > d.height_mm)) q"),
    _fanned("{cut_checks}", [("CUT_CONTOUR_SELF_INTERSECTION", _ERROR, "cut", _HAND, "f.crossings > 0"), ("OVERLAPPING_CUT_SEGMENT", _ERROR, "cut", _HAND, "f.overlapping > 0"), ("INVALID_CUT_CONTOUR", _ERROR, "cut", _HAND, "f.degenerate")]),
    _found("INVISIBLE_VECTOR_OBJECT", _WARN, "geometry", _AUTO, "paths WHERE hidden"),
    _found("STROKE_TOO_THIN", _WARN, "geometry", _ASK, "paths WHERE NOT hidden AND stroke IS NOT NULL AND effective_mm < 0.199"),
    _found("OPEN_VECTOR_PATH", _INFO, "geometry", _TELL, "(SELECT DISTINCT o.doc_id, o.node_id FROM {path_points} o JOIN paths p ON p.doc_id = o.doc_id AND p.node_id = o.node_id WHERE NOT p.hidden AND NOT o.closed) q"),
    _fanned(
        "(SELECT a.* FROM {path_parts} a JOIN paths p ON p.doc_id = a.doc_id AND p.node_id = a.node_id WHERE NOT p.hidden)",
        [
            ("DUPLICATE_VECTOR_POINT", _WARN, "geometry", _AUTO, "f.duplicates > 0"),
            ("ZERO_LENGTH_SEGMENT", _WARN, "geometry", _AUTO, "f.zero_length > 0"),
            ("REDUNDANT_COLLINEAR_POINT", _INFO, "geometry", _AUTO, "f.collinear > 0"),
            ("EXCESSIVE_PATH_COMPLEXITY", _WARN, "geometry", _ASK, "f.excessive"),
        ],
    ),
    _fanned(
        "(SELECT c.* FROM {path_checks} c JOIN paths p ON p.doc_id = c.doc_id AND p.node_id = c.node_id WHERE NOT p.hidden)",
        [("SELF_INTERSECTING_PATH", _WARN, "geometry", _HAND, "f.crossings > 0"), ("DEGENERATE_VECTOR_PATH", _WARN, "geometry", _AUTO, "f.degenerate")],
    ),
    _found("RGB_RASTER", _INFO, "color", _TELL, "{nodes} WHERE type = 'raster_image'"),
    _found("NO_GRAPHIC_ELEMENTS", _ERROR, "document", _HAND, "(SELECT d.doc_id FROM {docs} d LEFT JOIN {nodes} n ON n.doc_id = d.doc_id AND n.type <> 'technical_guide' GROUP BY d.doc_id HAVING count(n.node_id) = 0) q", _NONE),
    # Generic ones keep the rule's own severity and category, so they are told apart by kind.
    f"SELECT doc_id, code, CASE code WHEN 'GENERIC_PREPRESS_ISSUE' THEN own_severity ELSE severity END, CASE code WHEN 'GENERIC_PREPRESS_ISSUE' THEN own_category ELSE category END, node_id, fix_class FROM ("
    + _fanned(
        "{issues}",
        [(code, severity, category, fix, f"f.rule_id = '{rule}' AND {test}") for rule, test, code, severity, category, fix in _MAPPED]
        + [("GENERIC_PREPRESS_ISSUE", _WARN, "document", _HAND, f"f.rule_id NOT IN ({_KNOWN}) AND f.severity <> 'info'")],
    ).replace("f.node_id, k.fix_class", "f.node_id, k.fix_class, f.severity AS own_severity, f.category AS own_category")
    + ") q",
]
prepress_issues = Operator(f"""
WITH paths AS (
  SELECT c.doc_id, c.node_id, c.stroke, NOT c.visible OR c.opacity <= 0 OR (c.fill IS NULL AND c.stroke IS NULL) AS hidden, c.stroke_mm * coalesce(p.w_mm / 100, 1) AS effective_mm
  FROM {{nodes}} c LEFT JOIN {{nodes}} p ON p.doc_id = c.doc_id AND p.node_id = c.parent_id AND p.type = 'group' WHERE c.type = 'vector_path'
),
ends AS (
  SELECT doc_id, node_id, contour, max(CASE WHEN NOT closed THEN 1 ELSE 0 END) AS opened, max(CASE WHEN pos = 0 THEN x END) AS x0, max(CASE WHEN pos = 0 THEN y END) AS y0, max(CASE WHEN pos = n - 1 THEN x END) AS x1, max(CASE WHEN pos = n - 1 THEN y END) AS y1
  FROM {{cut_rings}} GROUP BY doc_id, node_id, contour
),
outline_gaps AS (SELECT doc_id, node_id, {E.distance(('x0', 'x1'), ('y0', 'y1'))} AS gap, opened = 1 AND {E.distance(('x0', 'x1'), ('y0', 'y1'))} > 0 AS open_now FROM ends),
found AS (""" + "\nUNION ALL ".join(_CODES) + """)
SELECT doc_id, code, severity, category, node_id, fix_class,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE fix_class WHEN 'AUTO_FIXABLE' THEN 0 WHEN 'REQUIRES_CONFIRMATION' THEN 1 WHEN 'MANUAL' THEN 2 ELSE 3 END, code, coalesce(node_id, -1), severity, category) AS BIGINT) AS position FROM found""")
