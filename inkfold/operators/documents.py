"""Scene-graph operators and production rules over docs and nodes; each rule is one SELECT of issues."""

from __future__ import annotations

from inkfold.functions import expressions as E
from inkfold.operators.template import Operator

doc_summary = Operator("""
SELECT doc_id, type, count(*) AS nodes, CAST(sum(CASE WHEN visible THEN 1 ELSE 0 END) AS BIGINT) AS visible, count(parent_id) AS grouped, min(z_index) AS lowest, max(z_index) AS highest
FROM {nodes} GROUP BY doc_id, type""")

fill_distribution = Operator("""
SELECT doc_id, coalesce(upper(fill), 'NONE') AS fill, count(*) AS n, CAST(sum(CASE WHEN stroke IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS stroked FROM {nodes} WHERE type = 'vector_path'
GROUP BY doc_id, coalesce(upper(fill), 'NONE')""")

invisible_objects = Operator("""
SELECT doc_id, node_id FROM {nodes} WHERE type = 'vector_path' AND (NOT visible OR opacity <= 0 OR (fill IS NULL AND stroke IS NULL))""")

replace_fill = Operator("""
SELECT doc_id, node_id, CASE WHEN lower(trim(fill)) = '#aaaaa1' THEN '#00ff00' ELSE fill END AS fill, coalesce(lower(trim(fill)) = '#aaaaa1', false) AS changed FROM {nodes} WHERE type = 'vector_path'""")

orphan_nodes = Operator("""
SELECT c.doc_id, c.node_id, c.source_node_id FROM {nodes} c LEFT JOIN {nodes} s ON s.doc_id = c.doc_id AND s.node_id = c.source_node_id AND s.type = 'group'
WHERE c.type = 'cut_contour' AND s.node_id IS NULL""")

stroke_effective = Operator(f"""
SELECT c.doc_id, c.node_id, p.node_id AS group_id, {E.rounded('c.stroke_mm * coalesce(p.w_mm / 100, 1)')} AS effective_mm, coalesce(c.stroke_mm * coalesce(p.w_mm / 100, 1) < 0.25, false) AS too_thin
FROM {{nodes}} c LEFT JOIN {{nodes}} p ON p.node_id = c.parent_id WHERE c.type = 'vector_path' AND c.stroke IS NOT NULL""")

_ROOTS = """boxes AS (
  SELECT n.*, d.width_mm, d.height_mm, d.bleed_enabled AND d.bleed_mm > 0 AS bleeding, d.bleed_mm, d.safety_enabled, d.safety_mm,
         n.x_mm < d.width_mm AND n.x_mm + n.w_mm > 0 AND n.y_mm < d.height_mm AND n.y_mm + n.h_mm > 0 AS touches,
         n.x_mm >= 0 AND n.y_mm >= 0 AND n.x_mm + n.w_mm <= d.width_mm AND n.y_mm + n.h_mm <= d.height_mm AS within_trim,
         n.x_mm >= d.safety_mm AND n.y_mm >= d.safety_mm AND n.x_mm + n.w_mm <= d.width_mm - d.safety_mm AND n.y_mm + n.h_mm <= d.height_mm - d.safety_mm AS within_safety
  FROM {nodes} n JOIN {docs} d ON d.doc_id = n.doc_id WHERE n.parent_id IS NULL
),
art AS (SELECT * FROM boxes WHERE visible AND type IN ('raster_image', 'group') AND w_mm > 0 AND h_mm > 0)"""
_SIDES = """sides AS (
  SELECT d.doc_id, s.side, max(CASE s.side WHEN 'top' THEN CASE WHEN a.y_mm <= -d.bleed_mm THEN 1 ELSE 0 END WHEN 'left' THEN CASE WHEN a.x_mm <= -d.bleed_mm THEN 1 ELSE 0 END
         WHEN 'right' THEN CASE WHEN a.x_mm + a.w_mm >= d.width_mm + d.bleed_mm THEN 1 ELSE 0 END ELSE CASE WHEN a.y_mm + a.h_mm >= d.height_mm + d.bleed_mm THEN 1 ELSE 0 END END) AS covered
  FROM {docs} d JOIN (SELECT 'top' AS side UNION ALL SELECT 'right' UNION ALL SELECT 'bottom' UNION ALL SELECT 'left') s ON true LEFT JOIN art a ON a.doc_id = d.doc_id
  WHERE d.bleed_enabled AND d.bleed_mm > 0 GROUP BY d.doc_id, s.side
)"""
bleed_coverage = Operator(f"WITH {_ROOTS}, {_SIDES} SELECT doc_id, side, coalesce(covered, 0) = 1 AS covered FROM sides")

_DPI = E.effective_dpi("natural_w", "w_mm")


def _issue(rule: str, severity: str, category: str, source: str, node: str = "node_id", key: str = "''") -> str:
    return f"SELECT doc_id, '{rule}' AS rule_id, {severity} AS severity, '{category}' AS category, {node} AS node_id, {key} AS detail FROM {source}"


_NONE = "CAST(NULL AS BIGINT)"
_RULES = [
    _issue("V001_ARTBOARD_INVALID_DIMENSIONS", "'error'", "document", "{docs} WHERE NOT (width_mm > 0 AND height_mm > 0)", _NONE),
    _issue("V002_NODE_INVALID_DIMENSIONS", "'error'", "geometry", "boxes WHERE type IN ('raster_image', 'group', 'cut_contour') AND NOT (w_mm > 0 AND h_mm > 0)"),
    _issue("V003_OBJECT_COMPLETELY_OUTSIDE", "'warning'", "layout", "art WHERE NOT touches"),
    _issue("V004_OBJECT_PARTIALLY_OUTSIDE", "CASE WHEN bleeding THEN 'info' ELSE 'warning' END", "layout", "art WHERE touches AND NOT within_trim"),
    _issue("V005_BLEED_CONFIGURED", "'info'", "bleed", "{docs} WHERE bleed_enabled", _NONE),
    _issue("V006_BLEED_INSUFFICIENT_COVERAGE", "'warning'", "bleed", "sides WHERE coalesce(covered, 0) = 0", _NONE, "side"),
    _issue("V007_SAFETY_MARGIN_INTERSECTION", "'warning'", "safety", "art WHERE safety_enabled AND touches AND NOT within_safety"),
    _issue("V008_RASTER_LOW_DPI", "'warning'", "raster", f"boxes WHERE type = 'raster_image' AND w_mm > 0 AND natural_w > 0 AND {_DPI} < 150", "node_id", f"CASE WHEN {_DPI} < 100 THEN 'critical_low_dpi' ELSE 'low_dpi' END"),
    _issue("V009_CUT_CONTOUR_ORPHAN", "'error'", "cut", "(SELECT c.doc_id, c.node_id FROM {nodes} c LEFT JOIN {nodes} s ON s.doc_id = c.doc_id AND s.node_id = c.source_node_id AND s.type = 'group' WHERE c.type = 'cut_contour' AND s.node_id IS NULL) q"),
    _issue("V010_CUT_CONTOUR_INVALID_GEOMETRY", "'error'", "cut", "{nodes} WHERE type = 'cut_contour' AND NOT (w_mm > 0 AND h_mm > 0)"),
    # The findings of a cut outline in one pass over its checks.
    "SELECT c.doc_id, k.rule_id, k.severity, 'cut' AS category, c.node_id, k.detail FROM cuts c JOIN (SELECT 'V010_CUT_CONTOUR_INVALID_GEOMETRY' AS rule_id, 'error' AS severity, 'degenerate' AS detail"
    " UNION ALL SELECT 'V011_CUT_CONTOUR_VALID', 'info', '' UNION ALL SELECT 'V014_CUT_CONTOUR_SELF_INTERSECTION', 'error', '' UNION ALL SELECT 'V015_CUT_CONTOUR_OVERLAPPING_SEGMENT', 'error', '' UNION ALL SELECT 'V016_CUT_CONTOUR_OPEN', 'error', '') k"
    " ON CASE substr(k.rule_id, 1, 4) WHEN 'V010' THEN degenerate WHEN 'V011' THEN c.visible AND valid WHEN 'V014' THEN crossings > 0 WHEN 'V015' THEN overlapping > 0 ELSE open_contour AND NOT degenerate AND crossings = 0 AND overlapping = 0 END",
    _issue("V012_GUIDE_OUT_OF_BOUNDS", "'warning'", "guide", "boxes WHERE type = 'technical_guide' AND NOT coalesce(guide_mm >= 0 AND guide_mm <= CASE orientation WHEN 'vertical' THEN width_mm ELSE height_mm END, false)"),
    _issue("V013_GUIDES_SUMMARY", "'info'", "guide", "(SELECT doc_id FROM {nodes} WHERE type = 'technical_guide' AND guide_role IN ('fold', 'crease', 'cut_reference') GROUP BY doc_id) q", _NONE),
    _issue(
        "V016_CUT_CONTOUR_REQUIRED_MISSING", "'error'", "cut",
        "(SELECT d.doc_id FROM {docs} d JOIN {nodes} n ON n.doc_id = d.doc_id WHERE d.profile_id = 'generic-sticker' GROUP BY d.doc_id HAVING sum(CASE WHEN n.type = 'cut_contour' THEN 1 ELSE 0 END) = 0) q", _NONE,
    ),
]
_CUTS = "cuts AS (SELECT k.*, n.visible FROM {cut_checks} k JOIN {nodes} n ON n.doc_id = k.doc_id AND n.node_id = k.node_id WHERE n.w_mm > 0 AND n.h_mm > 0)"
_ISSUES = f"{_ROOTS}, {_SIDES}, {_CUTS}, issues AS (" + "\nUNION ALL ".join(_RULES) + ")"

validation_issues = Operator(f"WITH {_ISSUES} SELECT doc_id, rule_id, severity, category, node_id, detail FROM issues")

doc_status = Operator(f"""
WITH {_ISSUES},
counts AS (
  SELECT doc_id, sum(CASE WHEN severity = 'error' THEN 1 ELSE 0 END) AS errors, sum(CASE WHEN severity = 'warning' THEN 1 ELSE 0 END) AS warnings, sum(CASE WHEN severity = 'info' THEN 1 ELSE 0 END) AS infos FROM issues GROUP BY doc_id
),
graphic AS (SELECT doc_id, count(*) AS n FROM {{nodes}} WHERE type <> 'technical_guide' GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(errors, 0) AS BIGINT) AS errors, CAST(coalesce(warnings, 0) AS BIGINT) AS warnings, CAST(coalesce(infos, 0) AS BIGINT) AS infos,
       CASE WHEN coalesce(errors, 0) > 0 THEN 'blocked' WHEN coalesce(warnings, 0) > 0 THEN 'attention' WHEN coalesce(g.n, 0) = 0 THEN 'waiting_for_file' ELSE 'ready' END AS status
FROM {{docs}} d LEFT JOIN counts c ON c.doc_id = d.doc_id LEFT JOIN graphic g ON g.doc_id = d.doc_id""")

issue_dedup = Operator(f"""
WITH {_ISSUES},
keyed AS (SELECT *, CASE WHEN rule_id = 'V008_RASTER_LOW_DPI' THEN 'dpi' ELSE rule_id END AS code, coalesce(node_id, -1) AS node_key FROM issues),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, code, node_key ORDER BY CASE WHEN detail = 'critical_low_dpi' THEN 0 ELSE 1 END, detail) AS k FROM keyed)
SELECT doc_id, rule_id, severity, node_id, detail FROM ranked WHERE k = 1""")

deliverable_filter = Operator(f"""
WITH {_ISSUES},
banned AS (SELECT 'PRINT_PNG' AS deliverable, 'V009' AS prefix UNION ALL SELECT 'PRINT_PNG', 'V010' UNION ALL SELECT 'PRINT_PNG', 'V014' UNION ALL SELECT 'PRINT_PNG', 'V015' UNION ALL SELECT 'PRINT_PNG', 'V016' UNION ALL SELECT 'DTF_UV_PACKAGE', 'V016'),
kinds AS (SELECT 'PRINT_PNG' AS deliverable UNION ALL SELECT 'CUT_SVG' UNION ALL SELECT 'STICKER_PACKAGE' UNION ALL SELECT 'DTF_UV_PACKAGE')
SELECT k.deliverable, i.doc_id, count(*) AS issues, CAST(sum(CASE WHEN i.severity = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors
FROM issues i JOIN kinds k ON k.deliverable <> 'CUT_SVG' OR i.category IN ('cut', 'geometry') OR i.rule_id LIKE 'V001%'
LEFT JOIN banned b ON b.deliverable = k.deliverable AND b.prefix = substr(i.rule_id, 1, 4)
WHERE b.prefix IS NULL GROUP BY k.deliverable, i.doc_id""")

doc_diff = Operator("""
WITH before AS (SELECT doc_id, node_id, x_mm, y_mm, fill, visible FROM {nodes} WHERE node_id % 7 <> 0),
after AS (SELECT doc_id, node_id, CASE WHEN node_id % 9 = 0 THEN x_mm + 1 ELSE x_mm END AS x_mm, y_mm, CASE WHEN node_id % 8 = 0 THEN '#123456' ELSE fill END AS fill, visible FROM {nodes} WHERE node_id % 6 <> 0)
SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, coalesce(b.node_id, a.node_id) AS node_id,
       CASE WHEN b.node_id IS NULL THEN 'ADDED' WHEN a.node_id IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS change
FROM before b FULL OUTER JOIN after a ON a.doc_id = b.doc_id AND a.node_id = b.node_id
WHERE b.node_id IS NULL OR a.node_id IS NULL OR a.x_mm <> b.x_mm OR a.y_mm <> b.y_mm OR a.fill IS DISTINCT FROM b.fill OR a.visible <> b.visible""")

# Equal boxes of a fill are compared once; of equal answers the smallest number is kept.
component_correspondence = Operator(f"""
WITH boxes AS (SELECT doc_id, node_id, coalesce(fill, 'none') AS fill, x_mm AS x0, y_mm AS y0, x_mm + w_mm AS x1, y_mm + h_mm AS y1, w_mm * h_mm AS area FROM {{nodes}} WHERE type = 'vector_path' AND w_mm > 0),
kinds AS (SELECT doc_id, fill, x0, y0, x1, y1, area, min(node_id) AS node_id FROM boxes GROUP BY doc_id, fill, x0, y0, x1, y1, area),
pairs AS (
  SELECT p.doc_id, p.fill, p.x0, p.y0, p.x1, p.y1, q.node_id AS b_id, p.area AS a_area, q.area AS b_area, greatest(0e0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0e0, least(p.y1, q.y1) - greatest(p.y0, q.y0)) AS both_area,
         {E.distance(('(p.x0 + p.x1) / 2', '(q.x0 + q.x1) / 2'), ('(p.y0 + p.y1) / 2', '(q.y0 + q.y1) / 2'))} AS apart
  FROM kinds p JOIN kinds q ON q.fill = p.fill AND q.doc_id = p.doc_id + 1
),
best AS (
  SELECT doc_id, fill, x0, y0, x1, y1, a_area, min(named_struct('unlike', -(both_area / (a_area + b_area - both_area)), 'apart', apart, 'b_id', b_id, 'b_area', b_area)) AS b FROM pairs GROUP BY doc_id, fill, x0, y0, x1, y1, a_area
)
SELECT a.node_id AS a_id, k.b.b_id AS b_id, {E.rounded('-k.b.unlike')} AS iou, {E.rounded('k.b.apart')} AS centroid_distance, {E.rounded('k.b.b_area / k.a_area')} AS area_ratio
FROM boxes a JOIN best k ON k.doc_id = a.doc_id AND k.fill = a.fill AND k.x0 = a.x0 AND k.y0 = a.y0 AND k.x1 = a.x1 AND k.y1 = a.y1 AND k.a_area = a.area""")

document_complexity = Operator(f"""
WITH counts AS (SELECT doc_id, CAST(sum(CASE WHEN type = 'vector_path' THEN 1 ELSE 0 END) AS BIGINT) AS paths FROM {{nodes}} GROUP BY doc_id)
SELECT doc_id, paths, {E.complexity('paths')} AS complexity FROM counts""")

readiness = Operator(f"""
WITH {_ISSUES},
worst AS (SELECT doc_id, min(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS level, count(DISTINCT rule_id) AS rules FROM issues GROUP BY doc_id),
dpi AS (SELECT doc_id, min({_DPI}) AS lowest FROM boxes WHERE type = 'raster_image' AND w_mm > 0 GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(w.rules, 0) AS BIGINT) AS rules, {E.rounded('p.lowest')} AS lowest_dpi, CASE WHEN p.lowest IS NULL THEN 'NO_RASTER' WHEN p.lowest < 150 THEN 'LOW' WHEN p.lowest < 300 THEN 'ACCEPTABLE' ELSE 'GOOD' END AS dpi_state,
       CASE coalesce(w.level, 3) WHEN 0 THEN 'BLOCKED' WHEN 1 THEN 'NEEDS_REVIEW' ELSE 'READY' END AS state
FROM {{docs}} d LEFT JOIN worst w ON w.doc_id = d.doc_id LEFT JOIN dpi p ON p.doc_id = d.doc_id""")
