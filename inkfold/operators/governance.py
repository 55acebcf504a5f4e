"""Gates, proposals, command history and ablation over documents and plans."""

from __future__ import annotations

from inkfold.functions import expressions as E
from inkfold.operators.template import Operator

proposals = Operator(f"""
WITH outside AS (SELECT n.doc_id, n.node_id, n.x_mm, n.y_mm, n.w_mm, n.h_mm, d.width_mm, d.height_mm FROM {{nodes}} n JOIN {{docs}} d ON d.doc_id = n.doc_id WHERE n.parent_id IS NULL AND n.type <> 'technical_guide' AND d.height_mm > 0)
SELECT doc_id, node_id, CASE WHEN w_mm > width_mm OR h_mm > height_mm THEN 'RESIZE' ELSE 'MOVE' END AS action,
       {E.rounded(E.clamp('x_mm', '0e0', 'greatest(0e0, width_mm - w_mm)'))} AS to_x, {E.rounded(E.clamp('y_mm', '0e0', 'greatest(0e0, height_mm - h_mm)'))} AS to_y,
       {E.rounded('least(1e0, width_mm / greatest(w_mm, 0.001), height_mm / greatest(h_mm, 0.001))')} AS scale
FROM outside WHERE x_mm < 0 OR y_mm < 0 OR x_mm + w_mm > width_mm OR y_mm + h_mm > height_mm""")

policy_gate = Operator("""
WITH matrix AS (
  SELECT 'generic-sticker' AS profile_id, 'cut_contour' AS type, 'REQUIRED' AS rule UNION ALL SELECT 'dtf-uv', 'cut_contour', 'FORBIDDEN' UNION ALL SELECT 'dtf-uv', 'raster_image', 'REQUIRED' UNION ALL SELECT 'print', 'technical_guide', 'ALLOWED'
),
present AS (SELECT doc_id, type, count(*) AS n FROM {nodes} GROUP BY doc_id, type)
SELECT d.doc_id, m.type, m.rule, CAST(coalesce(p.n, 0) AS BIGINT) AS found, NOT (m.rule = 'REQUIRED' AND p.n IS NULL) AND NOT (m.rule = 'FORBIDDEN' AND p.n IS NOT NULL) AS passed
FROM {docs} d JOIN matrix m ON m.profile_id = d.profile_id LEFT JOIN present p ON p.doc_id = d.doc_id AND p.type = m.type""")

package_gate = Operator("""
WITH facts AS (
  SELECT d.doc_id, d.profile_id, max(CASE WHEN n.type = 'cut_contour' AND n.w_mm > 0 THEN 1 ELSE 0 END) AS cut, max(CASE WHEN n.type = 'raster_image' THEN 1 ELSE 0 END) AS raster, min(CASE WHEN d.width_mm > 0 AND d.height_mm > 0 THEN 1 ELSE 0 END) AS sized
  FROM {docs} d LEFT JOIN {nodes} n ON n.doc_id = d.doc_id GROUP BY d.doc_id, d.profile_id
)
SELECT doc_id, profile_id, CASE WHEN sized = 0 THEN 'INVALID_ARTBOARD' WHEN profile_id = 'generic-sticker' AND cut = 0 THEN 'CUT_MISSING' WHEN profile_id = 'dtf-uv' AND raster = 0 THEN 'ARTWORK_MISSING' ELSE 'OK' END AS gate FROM facts""")

command_log_state = Operator("""
WITH log AS (SELECT user_id AS doc_id, event_id, ts, CASE event_type WHEN 'view' THEN 'UNDO' ELSE 'SET' END AS cmd, CAST(floor(value * 10) AS BIGINT) AS v FROM {events}),
depth AS (SELECT *, sum(CASE cmd WHEN 'SET' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS height FROM log),
last_height AS (SELECT doc_id, height AS final_height FROM (SELECT doc_id, height, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) AS k FROM depth) q WHERE k = 1),
live AS (SELECT d.doc_id, d.v, row_number() OVER (PARTITION BY d.doc_id ORDER BY d.ts DESC, d.event_id DESC) AS k, l.final_height FROM depth d JOIN last_height l ON l.doc_id = d.doc_id WHERE d.cmd = 'SET' AND d.height = l.final_height)
SELECT doc_id, CAST(final_height AS BIGINT) AS height, v AS current_value FROM live WHERE k = 1""")

ablation_matrix = Operator("""
WITH flags AS (SELECT a.f AS absorb, b.f AS merge, c.f AS smooth FROM (SELECT 0 AS f UNION ALL SELECT 1) a JOIN (SELECT 0 AS f UNION ALL SELECT 1) b ON true JOIN (SELECT 0 AS f UNION ALL SELECT 1) c ON true),
sizes AS (SELECT image_id, label, count(*) AS area FROM {labels_map} GROUP BY image_id, label)
SELECT image_id, absorb, merge, smooth, count(DISTINCT CASE WHEN merge = 1 THEN CAST(floor(label / 4) AS BIGINT) ELSE label END) AS regions, CAST(sum(CASE WHEN absorb = 1 AND area < 8 THEN 0 WHEN smooth = 1 AND area < 16 THEN area - 1 ELSE area END) AS BIGINT) AS area
FROM sizes JOIN flags ON true GROUP BY image_id, absorb, merge, smooth""")

component_identities = Operator(f"""
SELECT doc_id, node_id, {E.rounded('w_mm * h_mm')} AS area, {E.rounded('2 * (w_mm + h_mm)')} AS perimeter, {E.rounded('x_mm + w_mm / 2')} AS cx, {E.rounded('y_mm + h_mm / 2')} AS cy,
       CASE WHEN y_mm < 30 THEN 'HEADER' WHEN y_mm > 120 THEN 'FOOTER' WHEN w_mm * h_mm < 200 THEN 'DETAIL' ELSE 'BODY' END AS role FROM {{nodes}} WHERE type = 'vector_path'""")

# Boxes of one place and size are compared once, by the smallest number among them; a front is larger, so never one of them.
hole_provenance = Operator(f"""
WITH boxes AS (SELECT doc_id, node_id, x_mm + w_mm / 2 AS cx, y_mm + h_mm / 2 AS cy, w_mm * h_mm AS area FROM {{nodes}} WHERE type = 'vector_path' AND w_mm > 0),
kinds AS (SELECT doc_id, cx, cy, area, min(node_id) AS node_id FROM boxes GROUP BY doc_id, cx, cy, area),
gaps AS (SELECT h.doc_id, h.cx, h.cy, h.area, f.node_id AS front, {E.distance(('h.cx', 'f.cx'), ('h.cy', 'f.cy'))} AS gap FROM kinds h JOIN kinds f ON f.doc_id = h.doc_id AND f.area > h.area),
near AS (SELECT doc_id, cx, cy, area, min(named_struct('gap', gap, 'front', front)) AS best FROM gaps GROUP BY doc_id, cx, cy, area)
SELECT b.doc_id, b.node_id, n.best.front AS front, {E.rounded('n.best.gap')} AS gap, CASE WHEN b.area < 100 THEN 'ARTEFACT' WHEN n.best.gap < 20 THEN 'COUNTERFORM' ELSE 'OPENING' END AS class
FROM boxes b JOIN near n ON n.doc_id = b.doc_id AND n.cx = b.cx AND n.cy = b.cy AND n.area = b.area""")

offset_texts = Operator("""
WITH said AS (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'move ' || CAST(p_size AS VARCHAR(10)) || 'mm right' WHEN 1 THEN 'offset of ' || CAST(p_size AS VARCHAR(10)) || ' mm inside' WHEN 2 THEN 'resize to ' || CAST(p_size AS VARCHAR(10)) || ' x ' || CAST(p_size + 3 AS VARCHAR(10)) || ' cm' ELSE 'shift up ' || CAST(p_size AS VARCHAR(10)) || ' cm' END AS said FROM {part}
)
SELECT p_partkey, CASE WHEN said LIKE 'resize%' THEN 'SIZE' WHEN said LIKE '%offset%' THEN 'OFFSET' ELSE 'MOVE' END AS intent, CAST(regexp_extract(said, '([0-9]+)', 1) AS BIGINT) * CASE WHEN said LIKE '%cm%' THEN 10 ELSE 1 END AS first_mm,
       said LIKE '%inside%' AS inward, CASE WHEN said LIKE '%right%' THEN 'RIGHT' WHEN said LIKE '%up%' THEN 'UP' END AS direction FROM said""")
