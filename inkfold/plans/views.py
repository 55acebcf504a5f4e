"""Domain relations derived from the star-schema tables: pixels, shapes, rings, nodes, documents, steps, telemetry.

The tables hold no images, so a deterministic integer mapping stands in for them. The
same text builds a view in Spark and a common table expression for another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkfold.functions import expressions as E
from inkfold.operators import documents, prepress
from inkfold.operators.template import Operator
from inkfold.plans.oracles import RELATIONS

_OK_L, _OK_A, _OK_B = E.oklab("r", "g", "b")
_ROUND = "n.{c}_mm + n.{size}_mm / 2 + n.{size}_mm / 2 * (0.5e0 + y / 200) * {turn}(0.1234e0 + 6.283185307179586e0 * r.pos * (CASE WHEN n.node_id % 7 = 0 THEN 2 ELSE 1 END) / r.n)"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"

VIEWS = {
    "pixels": Operator(f"""
        SELECT image_id, n AS idx, n % 64 AS x, CAST(floor(n / 64) AS BIGINT) AS y,
               CAST(floor(5 * l_quantity + 0.5) AS BIGINT) % 256 AS r, CAST(floor(l_discount * 2500 + 0.5) AS BIGINT) % 256 AS g,
               CAST(floor(l_tax * 3000 + 0.5) AS BIGINT) % 256 AS b,
               CAST(CASE l_returnflag WHEN 'N' THEN 255 WHEN 'A' THEN 128 ELSE 0 END AS BIGINT) AS a
        FROM (SELECT l_suppkey % 10 AS image_id, CAST(row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY {_ORDER}) AS BIGINT) - 1 AS n,
                     l_quantity, l_discount, l_tax, l_returnflag FROM {{lineitem}})"""),
    "shapes": Operator("""
        SELECT image_id, idx, x, y, CAST(CASE
                 WHEN (x - 16) * (x - 16) + (y - 16) * (y - 16) BETWEEN 25 AND 100 THEN 1
                 WHEN (x - 44) * (x - 44) + (y - 20) * (y - 20) <= 64 + image_id THEN 2
                 WHEN (x - 30) * (x - 30) + (y - 60) * (y - 60) <= 81 THEN 1
                 WHEN x BETWEEN 50 AND 58 AND y BETWEEN 50 AND 70 THEN 3 END AS BIGINT) AS label
        FROM {pixels}"""),
    # The shapes in flat colours, one of them striped, on a plain ground with a shaded band.
    "artwork": Operator("""
        SELECT image_id, idx, x, y,
               CAST(CASE WHEN label = 1 THEN 30 WHEN label = 2 THEN 20 WHEN label = 3 THEN CASE WHEN floor(y / 4) % 3 = 0 THEN 250 ELSE 30 END WHEN y BETWEEN 30 AND 37 THEN 255 - (y - 29) * 20 ELSE 255 END AS BIGINT) AS r,
               CAST(CASE WHEN label = 1 THEN 200 WHEN label = 2 THEN 60 WHEN label = 3 THEN CASE WHEN floor(y / 4) % 3 = 1 THEN 180 ELSE 90 END WHEN y BETWEEN 30 AND 37 THEN 255 - (y - 29) * 20 ELSE 255 END AS BIGINT) AS g,
               CAST(CASE WHEN label = 1 THEN 40 WHEN label = 2 THEN 180 WHEN label = 3 THEN 60 WHEN y BETWEEN 30 AND 37 THEN 255 - (y - 29) * 20 ELSE 255 END AS BIGINT) AS b, CAST(255 AS BIGINT) AS a
        FROM {shapes}"""),
    # One image of 32 by 32 for every 1024 orders, a pixel per order with lines; labels and colours come from the lines, orders without lines are holes.
    "mosaic": Operator("""
        SELECT CAST(floor(l_orderkey / 1024) AS BIGINT) AS image_id, l_orderkey % 1024 AS idx, l_orderkey % 32 AS x, CAST(floor(l_orderkey % 1024 / 32) AS BIGINT) AS y, label,
               CAST(label * 28 + s % 24 AS BIGINT) AS r, CAST(220 - label * 20 + p % 16 AS BIGINT) AS g, CAST(label % 3 * 90 + p % 12 AS BIGINT) AS b, CAST(255 AS BIGINT) AS a
        FROM (SELECT l_orderkey, CAST(floor((max(l_quantity) + floor(l_orderkey % 1024 / 128) * 12) / 18) AS BIGINT) AS label, max(l_suppkey) AS s, max(l_partkey) AS p FROM {lineitem} GROUP BY l_orderkey) q"""),
    # The mosaic in one flat colour a label, a sixth of its pixels mixed from two of them.
    "blended": Operator("""
        SELECT image_id, idx, x, y, CAST(floor((label % 5 * 60 * (9 - m) + (label + 1) % 5 * 60 * m) / 9) AS BIGINT) AS r, CAST(floor(((220 - label % 5 * 50) * (9 - m) + (220 - (label + 1) % 5 * 50) * m) / 9) AS BIGINT) AS g,
               CAST(floor((label % 2 * 150 * (9 - m) + (label + 1) % 2 * 150 * m) / 9) AS BIGINT) AS b, a
        FROM (SELECT *, CASE WHEN idx % 6 = 5 THEN b % 10 ELSE 0 END AS m FROM {mosaic}) q"""),
    "mosaic_regions": Operator(f"""
        SELECT image_id, label, avg({_OK_L}) AS ok_l, avg({_OK_A}) AS ok_a, avg({_OK_B}) AS ok_b, count(*) >= 120 AS structural FROM {{mosaic}} GROUP BY image_id, label"""),
    "mosaic_prototypes": Operator(f"""
        SELECT label % 3 AS proto_id, avg({_OK_L}) AS ok_l, avg({_OK_A}) AS ok_a, avg({_OK_B}) AS ok_b FROM {{mosaic}} GROUP BY label % 3"""),
    "mosaic_edges": Operator(f"""
        SELECT image_id, least(p, q) AS region_a, greatest(p, q) AS region_b, avg(strength) AS avg_strength FROM (
          SELECT image_id, label AS p, other AS q, sqrt((l - l2) * (l - l2) + (la - a2) * (la - a2) + (lb - b2) * (lb - b2)) AS strength FROM (
            SELECT image_id, x AS place, label, l, la, lb, lag(x) OVER w AS was, lag(label) OVER w AS other, lag(l) OVER w AS l2, lag(la) OVER w AS a2, lag(lb) OVER w AS b2 FROM (SELECT *, {_OK_L} AS l, {_OK_A} AS la, {_OK_B} AS lb FROM {{mosaic}}) m WINDOW w AS (PARTITION BY image_id, y ORDER BY x)
            UNION ALL SELECT image_id, y AS place, label, l, la, lb, lag(y) OVER w AS was, lag(label) OVER w AS other, lag(l) OVER w AS l2, lag(la) OVER w AS a2, lag(lb) OVER w AS b2 FROM (SELECT *, {_OK_L} AS l, {_OK_A} AS la, {_OK_B} AS lb FROM {{mosaic}}) m WINDOW w AS (PARTITION BY image_id, x ORDER BY y)) n
          WHERE was = place - 1 AND other <> label) e GROUP BY image_id, least(p, q), greatest(p, q)"""),
    # Outlines of visible art: round ones through every sixth point of a ring of the same number, every seventh twice round, boxes elsewhere.
    "art_outlines": Operator(f"""
        SELECT n.doc_id, n.node_id AS ring_id, r.pos, {_ROUND.format(c='x', size='w', turn='cos')} AS x, {_ROUND.format(c='y', size='h', turn='sin')} AS y
        FROM {{nodes}} n JOIN {{rings}} r ON r.ring_id = n.node_id AND r.pos % 6 = 0 WHERE n.visible AND n.type IN ('vector_path', 'group') AND n.w_mm > 0
        UNION ALL
        SELECT n.doc_id, n.node_id, CAST(k.pos AS BIGINT), n.x_mm + CASE WHEN k.pos IN (1, 2) THEN n.w_mm ELSE 0 END, n.y_mm + CASE WHEN k.pos IN (2, 3) THEN n.h_mm ELSE 0 END
        FROM {{nodes}} n JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k ON true LEFT JOIN (SELECT DISTINCT ring_id FROM {{rings}}) r ON r.ring_id = n.node_id
        WHERE n.visible AND n.w_mm > 0 AND (n.type = 'raster_image' OR (n.type IN ('vector_path', 'group') AND r.ring_id IS NULL))"""),
    # The same art drawn again: some rings gone, some moved.
    "redrawn_outlines": Operator("SELECT doc_id, ring_id, pos, CASE WHEN ring_id % 5 = 0 THEN x + 40 ELSE x END AS x, y FROM {art_outlines} WHERE ring_id % 11 <> 3 AND NOT (doc_id % 3 = 0 AND ring_id % 4 = 1)"),
    # Every second ring has a speck of nine square millimetres at its first point.
    "fragment_outlines": Operator("""
        SELECT doc_id, ring_id, pos, x, y FROM {art_outlines}
        UNION ALL SELECT o.doc_id, o.ring_id + 1000001, CAST(k.pos AS BIGINT), o.x + CASE WHEN k.pos IN (1, 2) THEN 3 ELSE 0 END, o.y + CASE WHEN k.pos IN (2, 3) THEN 3 ELSE 0 END
        FROM {art_outlines} o JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k ON true WHERE o.pos = 0 AND o.ring_id % 2 = 0"""),
    "ring_fills": Operator("""
        SELECT DISTINCT doc_id, ring_id, CASE ring_id % 5 WHEN 0 THEN '#ffffff' WHEN 1 THEN '#c81e1e' WHEN 2 THEN '#1e50dc' ELSE '#1eb446' END AS fill,
               CAST(CASE ring_id % 3 WHEN 0 THEN 200 ELSE 40 + ring_id % 20 END AS BIGINT) AS r, CAST(CASE ring_id % 3 WHEN 1 THEN 170 ELSE 40 END AS BIGINT) AS g, CAST(CASE ring_id % 3 WHEN 2 THEN 210 ELSE 50 END AS BIGINT) AS b
        FROM {fragment_outlines}"""),
    "round_outlines": Operator("SELECT ring_id, pos, x, y FROM {art_outlines}"),
    "art_boxes": Operator("SELECT doc_id, node_id, coalesce(fill, 'none') AS fill, x_mm AS x0, y_mm AS y0, x_mm + w_mm AS x1, y_mm + h_mm AS y1 FROM {nodes} WHERE type IN ('vector_path', 'group') AND w_mm > 0"),
    "redrawn_boxes": Operator("""
        SELECT doc_id, node_id + CASE WHEN node_id % 3 = 0 THEN 100000 ELSE 0 END AS node_id, fill, x0 + node_id % 13 - 6 AS x0, y0 + node_id % 5 AS y0, x1 + node_id % 13 - 6 + CASE WHEN node_id % 17 = 0 THEN 3 * (x1 - x0) ELSE 0 END AS x1,
               y1 + node_id % 5 - CASE WHEN node_id % 19 = 0 THEN 0.8 * (y1 - y0) ELSE 0 END AS y1
        FROM {art_boxes} WHERE node_id % 9 <> 4"""),
    # Errors of models as a fitter reports them, and trials of a case; interval_models and fit_trials compute real ones.
    "model_errors": Operator("""
        SELECT p_partkey % 50 AS ring_id, p_partkey AS interval_id, m.model, m.params, CAST((p_partkey * m.k) % 101 AS DOUBLE) / 40 + CAST(p_size AS DOUBLE) / 50 AS rms, CAST((p_partkey * m.k) % 89 AS DOUBLE) / 30 AS worst
        FROM {part} JOIN (SELECT 'LINE' AS model, 2 AS params, 7 AS k UNION ALL SELECT 'ARC', 3, 13 UNION ALL SELECT 'ELLIPSE', 5, 29 UNION ALL SELECT 'BEZIER', 8, 31) m ON true"""),
    "trials": Operator("""
        SELECT p_size AS case_id, p_partkey AS trial, CAST((p_partkey * 17) % 101 AS BIGINT) AS error, CAST((p_partkey * 31) % 97 AS BIGINT) AS nodes, CAST((p_partkey * 7) % 89 AS BIGINT) AS editability FROM {part}"""),
    "accents": Operator("SELECT image_id, idx, x, y, CASE WHEN a > 0 AND g > r + 20 AND g > b + 20 THEN CAST(1 AS BIGINT) END AS label FROM {artwork}"),
    # Outlines with every third side halved and some points doubled.
    "worn_rings": Operator("""
        SELECT ring_id, CAST(row_number() OVER (PARTITION BY ring_id ORDER BY pos, k) AS BIGINT) - 1 AS pos, count(*) OVER (PARTITION BY ring_id) AS n, x, y FROM (
          SELECT ring_id, pos, 0 AS k, x, y FROM {rings}
          UNION ALL SELECT ring_id, pos, 1, (x + nx) / 2, (y + ny) / 2 FROM (SELECT *, lead(x) OVER (PARTITION BY ring_id ORDER BY pos) AS nx, lead(y) OVER (PARTITION BY ring_id ORDER BY pos) AS ny FROM {rings}) s WHERE pos % 3 = 0 AND nx IS NOT NULL
          UNION ALL SELECT ring_id, pos, -1, x, y FROM {rings} WHERE pos % 5 = 0) q"""),
    "labels_map": Operator("""
        SELECT image_id, idx, x, y, r, g, b, a,
               CAST(floor(r / 64) AS BIGINT) * 16 + CAST(floor(g / 64) AS BIGINT) * 4 + CAST(floor(b / 64) AS BIGINT) AS label
        FROM {pixels} WHERE a > 0"""),
    "colours": Operator("SELECT r, g, b, count(*) AS n FROM {pixels} WHERE a > 0 GROUP BY r, g, b"),
    "rings": Operator("""
        SELECT ring_id, pos, n, CAST((pos * 37) % 101 AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y
        FROM (SELECT user_id AS ring_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) - 1 AS pos,
                     CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n, CAST(floor(value * 100 + 0.5) AS BIGINT) % 97 AS y FROM {events})"""),
    "nodes": Operator("""
        SELECT p_partkey % 50 AS doc_id, p_partkey AS node_id,
               CASE p_partkey % 10 WHEN 0 THEN 'group' WHEN 1 THEN 'raster_image' WHEN 2 THEN 'raster_image' WHEN 8 THEN 'cut_contour' WHEN 9 THEN 'technical_guide' ELSE 'vector_path' END AS type,
               p_name AS name, p_partkey % 11 <> 0 AS visible,
               CAST((p_partkey * 13) % 300 - 20 AS DOUBLE) AS x_mm, CAST((p_partkey * 29) % 200 - 15 AS DOUBLE) AS y_mm,
               CAST(CASE WHEN p_partkey % 97 = 0 THEN 0 ELSE p_size * 2 END AS DOUBLE) AS w_mm, CAST(p_size + 5 AS DOUBLE) AS h_mm,
               CAST(floor(p_retailprice) AS BIGINT) % 400 + 1 AS natural_w,
               CASE WHEN p_partkey % 10 IN (3, 4) THEN p_partkey - p_partkey % 10 END AS parent_id,
               CASE WHEN p_partkey % 10 = 8 THEN p_partkey - p_partkey % 3 * 4 - 8 END AS source_node_id,
               CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE '#' || lpad(CAST((p_partkey * 7919) % 3 AS VARCHAR(10)), 6, 'a') END AS fill,
               CASE WHEN p_partkey % 4 = 0 THEN '#000000' END AS stroke, CAST(p_size % 7 AS DOUBLE) / 10 AS stroke_mm, CAST(p_partkey % 13 AS DOUBLE) / 12 AS opacity,
               CASE WHEN p_partkey % 20 = 9 THEN 'fold' WHEN p_partkey % 10 = 9 THEN 'none' END AS guide_role, p_partkey AS z_index,
               CASE WHEN p_partkey % 10 = 9 THEN CASE WHEN p_partkey % 3 = 0 THEN 'vertical' ELSE 'horizontal' END END AS orientation, CASE WHEN p_partkey % 10 = 9 THEN CAST((p_partkey * 17) % 260 - 10 AS DOUBLE) END AS guide_mm
        FROM {part}"""),
    "docs": Operator("""
        SELECT doc_id, CAST(200 + doc_id % 5 * 10 AS DOUBLE) AS width_mm, CAST(CASE WHEN doc_id = 49 THEN 0 ELSE 140 + doc_id % 3 * 10 END AS DOUBLE) AS height_mm,
               doc_id % 2 = 0 AS bleed_enabled, CAST(CASE WHEN doc_id % 4 = 0 THEN 3 ELSE 2 END AS DOUBLE) AS bleed_mm,
               doc_id % 3 = 0 AS safety_enabled, CAST(5 AS DOUBLE) AS safety_mm,
               CASE doc_id % 4 WHEN 0 THEN 'generic-sticker' WHEN 1 THEN 'dtf-uv' WHEN 2 THEN 'print' ELSE 'generic' END AS profile_id,
               CASE WHEN doc_id % 8 = 5 THEN 'REQUIRED' ELSE 'OPTIONAL' END AS white_policy, CASE WHEN doc_id % 8 = 1 THEN 'REQUIRED' ELSE 'OPTIONAL' END AS clear_policy
        FROM (SELECT DISTINCT p_partkey % 50 AS doc_id FROM {part})"""),
    # Cut outlines: a ring where one has the node's number, else a rectangle, some of them left open.
    "cut_rings": Operator("""
        SELECT n.doc_id, n.node_id, CAST(0 AS BIGINT) AS contour, CAST(NULL AS BOOLEAN) AS closed, r.pos, r.n, r.x, r.y FROM {nodes} n JOIN {rings} r ON r.ring_id = n.node_id WHERE n.type = 'cut_contour'
        UNION ALL
        SELECT n.doc_id, n.node_id, CAST(0 AS BIGINT), n.node_id % 30 <> 8, CAST(k.pos AS BIGINT), CAST(CASE WHEN n.node_id % 30 = 8 THEN 5 ELSE 4 END AS BIGINT),
               n.x_mm + CASE WHEN k.pos IN (1, 2) THEN n.w_mm ELSE 0 END, n.y_mm + CASE WHEN k.pos IN (2, 3) THEN n.h_mm WHEN k.pos = 4 THEN 0.2 + n.node_id % 4 * 0.2 ELSE 0 END
        FROM {nodes} n JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) k ON k.pos < CASE WHEN n.node_id % 30 = 8 THEN 5 ELSE 4 END
        LEFT JOIN (SELECT DISTINCT ring_id FROM {rings}) r ON r.ring_id = n.node_id WHERE n.type = 'cut_contour' AND r.ring_id IS NULL"""),
    "path_points": Operator("""
        SELECT n.doc_id, n.node_id, CAST(0 AS BIGINT) AS contour, n.node_id % 4 <> 1 AS closed, r.pos, r.n, r.x, r.y FROM {nodes} n JOIN {rings} r ON r.ring_id = n.node_id WHERE n.type = 'vector_path'"""),
    # Saved separations of transfer prints; every third was made before its artwork changed, every fifth at another size.
    "separations": Operator("""
        SELECT d.doc_id, k.role, d.width_mm + CASE WHEN d.doc_id % 5 = 0 THEN 1 ELSE 0 END AS width_mm, d.height_mm, coalesce(s.state, 0) + CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS source_state
        FROM {docs} d JOIN (SELECT 'WHITE' AS role UNION ALL SELECT 'CLEAR') k ON true LEFT JOIN (
          SELECT doc_id, CAST(sum(node_id + CAST(floor(x_mm * 100 + 0.5) AS BIGINT) * 3 + CAST(floor(y_mm * 100 + 0.5) AS BIGINT) * 7 + CAST(floor(w_mm * 100 + 0.5) AS BIGINT) * 11 + CAST(floor(h_mm * 100 + 0.5) AS BIGINT) * 13) AS BIGINT) AS state
          FROM {nodes} WHERE visible AND parent_id IS NULL AND type IN ('raster_image', 'group', 'vector_path') GROUP BY doc_id) s ON s.doc_id = d.doc_id
        WHERE d.doc_id % 4 = 1 AND d.doc_id % (CASE k.role WHEN 'WHITE' THEN 13 ELSE 9 END) <> 0"""),
    "cut_checks": prepress.cut_integrity,
    "path_checks": prepress.path_integrity,
    "path_parts": prepress.path_analysis,
    "issues": documents.validation_issues,
    "telemetry": Operator("""
        SELECT event_id, ts, user_id % 7 AS organization_id, user_id % 3 AS provider_id,
               CASE WHEN event_id % 10 < 7 THEN 'SUCCESS' WHEN event_id % 10 < 9 THEN 'CACHED' ELSE 'FAILED' END AS status,
               CAST(floor(value * 100 + 0.5) AS BIGINT) AS duration_ms, CAST(event_id % 5 AS BIGINT) AS credits_calculated,
               CAST(CASE WHEN event_id % 10 < 7 THEN event_id % 5 ELSE 0 END AS BIGINT) AS credits_charged, md5(CAST(event_id % 997 AS VARCHAR(20))) AS sha
        FROM {events}"""),
    # One file per vector path: an outline of its box, some with a hole, a second curved path, or something unsafe.
    "svgs": Operator("""
        SELECT node_id AS case_id, CASE WHEN node_id % 5 = 0 THEN 'REGION_GRAPH' ELSE 'DIRECT' END AS backend,
               '<svg xmlns="http://www.w3.org/2000/svg" width="' || w || 'mm" viewBox="0 0 ' || w || ' ' || h || '"><path d="M 0 0 L ' || w || ' 0 L ' || w || ' ' || h || ' L 0 ' || h || ' Z' || CASE WHEN node_id % 4 = 0 THEN ' M 1 1 L 2 1 L 2 2 Z' ELSE '' END
               || '" fill="' || coalesce(fill, 'none') || '"/>' || CASE WHEN node_id % 3 = 0 THEN '<path d="M 1 1 C 2 2 3 3 4 4 Z" fill="none"/>' ELSE '' END || CASE WHEN node_id % 17 = 0 THEN '<script>x</script>' ELSE '' END || '</svg>' AS svg
        FROM (SELECT node_id, fill, CAST(CAST(w_mm AS BIGINT) AS VARCHAR(20)) AS w, CAST(CAST(h_mm AS BIGINT) AS VARCHAR(20)) AS h FROM {nodes} WHERE type = 'vector_path') q"""),
    # Approved results of the same files, some of an earlier form.
    "goldens": Operator("""
        SELECT case_id, backend, case_id % 6 <> 0 AS approved, CASE WHEN case_id % 13 = 0 THEN svg || '<g/>' ELSE svg || ' ' END AS svg,
               1 + CASE WHEN case_id % 3 = 0 THEN 1 ELSE 0 END AS paths, CASE WHEN case_id % 4 = 0 OR case_id % 11 = 0 THEN 1 ELSE 0 END AS holes,
               5 + CASE WHEN case_id % 3 = 0 THEN 3 ELSE 0 END + CASE WHEN case_id % 4 = 0 THEN 4 ELSE 0 END + CASE WHEN case_id % 19 = 0 THEN 1 ELSE 0 END AS anchors
        FROM (SELECT case_id, svg, CASE WHEN case_id % 23 = 0 THEN 'REGION_GRAPH' ELSE backend END AS backend FROM {svgs}) q"""),
    "palette": Operator("""
        SELECT label AS proto_id, dim, avg(v) AS v FROM {dims} GROUP BY label, dim"""),
    "steps": Operator("""
        SELECT o_custkey AS plan_id, k AS step_id, CASE WHEN k > 1 THEN CAST(floor(k / 2) AS BIGINT) END AS depends_on,
               CASE o_orderkey % 4 WHEN 0 THEN 'AUTO_FIX' WHEN 1 THEN 'CONFIRM' WHEN 2 THEN 'MANUAL' ELSE 'INFORMATIONAL' END AS classification,
               CASE WHEN o_orderkey % 5 = 0 THEN 'error' WHEN o_orderkey % 5 < 3 THEN 'warning' ELSE 'info' END AS severity,
               CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderkey % 6 = 0 THEN 'FAILED' WHEN o_orderkey % 6 = 1 THEN 'WAITING_CONFIRMATION'
                    WHEN o_orderkey % 6 = 2 THEN 'BLOCKED' WHEN o_orderkey % 6 = 3 THEN 'SKIPPED' ELSE 'PENDING' END AS status
        FROM (SELECT o_custkey, o_orderkey, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS k FROM {orders})"""),
}
# Three views have a text of their own for Spark: vector components as rows, worn rings (below), and pixels, numbered within parts of the order
# keys (the first column of the order) upon the counts of the parts before, so that no image is sorted in one task. Rows without an image count as
# image 10, which no remainder is, so that parts meet their counts by plain keys where they lie.
_PART = 8192
_SPARK_PIXELS = Operator(f"""
    WITH lines AS (
      SELECT coalesce(l_suppkey % 10, 10) AS image, coalesce(CAST(floor(l_orderkey / {_PART}) AS BIGINT), -9223372036854775808) AS part, {_ORDER} FROM {{lineitem}}
    ),
    counts AS (SELECT image, part, count(*) AS n FROM lines GROUP BY image, part),
    starts AS (SELECT image, part, sum(n) OVER (PARTITION BY image ORDER BY part ROWS UNBOUNDED PRECEDING) - n AS start FROM counts),
    numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY image, part ORDER BY {_ORDER}) AS BIGINT) - 1 AS k FROM lines)
    SELECT image_id, n AS idx, n % 64 AS x, CAST(floor(n / 64) AS BIGINT) AS y,
           CAST(floor(5 * l_quantity + 0.5) AS BIGINT) % 256 AS r, CAST(floor(l_discount * 2500 + 0.5) AS BIGINT) % 256 AS g,
           CAST(floor(l_tax * 3000 + 0.5) AS BIGINT) % 256 AS b,
           CAST(CASE l_returnflag WHEN 'N' THEN 255 WHEN 'A' THEN 128 ELSE 0 END AS BIGINT) AS a
    FROM (SELECT nullif(l.image, 10) AS image_id, l.k + s.start AS n, l.l_quantity, l.l_discount, l.l_tax, l.l_returnflag FROM numbered l JOIN starts s ON s.image = l.image AND s.part = l.part) q""")
# Worn rings in one order of the events: a ring's points are counted on as they are doubled and halved, not sorted again.
_SPARK_WORN = Operator("""
    WITH points AS (
      SELECT user_id, ts, event_id, CAST(row_number() OVER w AS BIGINT) - 1 AS pos, CAST(CAST(floor(value * 100 + 0.5) AS BIGINT) % 97 AS DOUBLE) AS y, lead(event_id) OVER w AS follower,
             CAST(CAST(floor(lead(value) OVER w * 100 + 0.5) AS BIGINT) % 97 AS DOUBLE) AS ny FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    ),
    ends AS (SELECT *, CAST((pos * 37) % 101 AS DOUBLE) AS x, CASE WHEN follower IS NOT NULL THEN CAST(((pos + 1) * 37) % 101 AS DOUBLE) END AS nx FROM points),
    worn AS (
      SELECT *, filter(array(CASE WHEN pos % 5 = 0 THEN named_struct('x', x, 'y', y) END, named_struct('x', x, 'y', y), CASE WHEN pos % 3 = 0 AND nx IS NOT NULL THEN named_struct('x', (x + nx) / 2, 'y', (y + ny) / 2) END), p -> p IS NOT NULL) AS made FROM ends
    ),
    sized AS (SELECT *, sum(size(made)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - size(made) AS start, sum(size(made)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM worn)
    SELECT user_id AS ring_id, CAST(start + k AS BIGINT) AS pos, CAST(n AS BIGINT) AS n, p.x AS x, p.y AS y FROM sized LATERAL VIEW posexplode(made) t AS k, p""")
_DIMS_SPARK = Operator("SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(dim AS BIGINT) AS dim, CAST(v AS DOUBLE) AS v FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS dim, v")
_DIMS_ANSI = "SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(i - 1 AS BIGINT) AS dim, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)"


def view(spark: SparkSession, sf_dir: str, name: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table or a derived relation as a DataFrame; relations already held are taken as they are."""
    if held and name in held:
        return held[name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    operator = {"dims": _DIMS_SPARK, "pixels": _SPARK_PIXELS, "worn_rings": _SPARK_WORN}.get(name) or VIEWS[name]
    return operator(**{n: view(spark, sf_dir, n, held) for n in operator.inputs})


def _needed(names: list[str], seen: dict[str, str]) -> None:
    for name in names:
        if name in TABLES or name in seen:
            continue
        if name == "dims":
            seen[name] = _DIMS_ANSI
            continue
        _needed(VIEWS[name].inputs, seen)
        seen[name] = RELATIONS.get(name) or VIEWS[name].ansi()


def oracle(text: str, names: list[str], recursive: bool = False) -> str:
    """text with the derived relations it names as common table expressions; text may begin with its own WITH list."""
    seen: dict[str, str] = {}
    _needed(names, seen)
    ctes = [f"{n} AS ({t.strip()})" for n, t in seen.items()]
    body = text.strip()
    if not ctes:
        return ("WITH RECURSIVE " + body[5:].strip()) if recursive and body.upper().startswith("WITH ") else body
    word = "WITH RECURSIVE " if recursive else "WITH "
    if body.upper().startswith("WITH "):
        return word + ",\n".join(ctes) + ",\n" + body[5:].strip()
    return word + ",\n".join(ctes) + "\n" + body
