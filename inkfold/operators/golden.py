"""SVG documents as rows: counts of their path language, safety of foreign files, comparison with approved results.

svgs(case_id, svg, backend); goldens(case_id, paths, anchors, holes, backend, approved, svg).
"""

from __future__ import annotations

from inkfold.functions import expressions as E
from inkfold.operators.template import Operator
from inkfold.sources.svg import NUMBER, UNSAFE

_D = """regexp_extract_all(svg, '(?is)<path\\\\b[^>]*?\\\\bd\\\\s*=\\\\s*["\\']([^"\\']*)["\\']', 1)"""
_COUNTS = f"""parts AS (SELECT case_id, svg, backend, octet_length(svg) AS bytes, regexp_count(svg, '(?i)<path\\\\b') AS paths, {_D} AS d FROM {{svgs}}),
stats AS (
  SELECT case_id, svg, backend, bytes, paths, CAST(aggregate(d, 0, (n, x) -> n + regexp_count(x, '[Mm]')) AS BIGINT) AS subpaths, CAST(aggregate(d, 0, (n, x) -> n + regexp_count(x, '[MmLlHhVvCcSsQqTtAaZz]')) AS BIGINT) AS anchors,
         CAST(aggregate(d, 0, (n, x) -> n + greatest(regexp_count(x, '[Mm]') - 1, 0)) AS BIGINT) AS holes, CAST(size(filter(d, x -> regexp_count(x, '[Mm]') > 1)) AS BIGINT) AS compound,
         CAST(aggregate(d, 0, (n, x) -> n + regexp_count(x, '[Cc]')) AS BIGINT) AS curves
  FROM parts
)"""

command_counts = Operator(f"WITH {_COUNTS} SELECT case_id, bytes, CAST(paths AS BIGINT) AS paths, subpaths, anchors, holes, compound, curves FROM stats")

tag_attributes = Operator("""
SELECT case_id, regexp_extract(svg, 'viewBox="([^"]*)"', 1) AS view_box, regexp_extract(svg, 'width="([^"]*)"', 1) AS width, regexp_extract(svg, 'fill="([^"]*)"', 1) AS first_fill FROM {svgs}""")

# Pairs of numbers in path data are nodes. The size is the view box's, else the width and height given, else what the nodes reach.
_LIST = f"flatten(transform(d, p -> transform(regexp_extract_all(p, '{NUMBER}', 0), v -> CAST(v AS DOUBLE))))"
_GIVEN = "try_cast(regexp_extract(svg, '(?i)\\\\b{0}\\\\s*=\\\\s*[\"\\']\\\\s*([0-9]*[.]?[0-9]+)', 1) AS DOUBLE)"
svg_guard = Operator(f"""
WITH {_COUNTS},
told AS (
  SELECT case_id, svg, bytes, paths, CAST(aggregate(d, 0, (n, x) -> n + CAST(floor(regexp_count(x, '{NUMBER}') / 2) AS INT)) AS BIGINT) AS nodes, {UNSAFE} AS unsafe, {_LIST} AS numbers,
         transform(split(trim(regexp_extract(svg, '(?i)viewBox\\\\s*=\\\\s*["\\']([^"\\']*)', 1)), '[ ,]+'), v -> try_cast(v AS DOUBLE)) AS box, {_GIVEN.format('width')} AS given_w, {_GIVEN.format('height')} AS given_h
  FROM (SELECT s.*, p.d FROM stats s JOIN parts p ON p.case_id = s.case_id) q
),
sized AS (
  SELECT *, size(box) >= 4 AND get(box, 2) > 0 AND get(box, 3) > 0 AS boxed, array_max(filter(numbers, (v, i) -> i % 2 = 0)) AS reach_x, array_max(filter(numbers, (v, i) -> i % 2 = 1)) AS reach_y FROM told
)
SELECT case_id, bytes, nodes, CASE WHEN coalesce(boxed, false) THEN get(box, 2) WHEN given_w > 0 AND given_h > 0 THEN given_w WHEN nodes > 0 THEN greatest(1e0, ceil(reach_x)) END AS width,
       CASE WHEN coalesce(boxed, false) THEN get(box, 3) WHEN given_w > 0 AND given_h > 0 THEN given_h WHEN nodes > 0 THEN greatest(1e0, ceil(reach_y)) END AS height,
       CASE WHEN bytes = 0 THEN 'EMPTY' WHEN unsafe THEN 'UNSAFE' WHEN paths = 0 THEN 'NO_PATHS' WHEN nodes = 0 THEN 'NO_GEOMETRY' WHEN bytes > 20000000 OR nodes > 2000000 THEN 'TOO_LARGE' ELSE 'OK' END AS verdict FROM sized""")

# A candidate fails on structural loss or a growth above three times, needs eyes on any other change. Limits are fixed values.
_VERDICTS = f"""{_COUNTS},
compared AS (
  SELECT c.case_id, c.paths - g.paths AS path_delta, c.anchors - g.anchors AS anchor_delta, c.holes - g.holes AS hole_delta, trim(c.svg) = trim(g.svg) AS same,
         c.paths = 0 OR length(trim(c.svg)) < 10 OR c.backend <> g.backend OR (g.holes > 0 AND c.holes = 0) OR (g.anchors > 10 AND c.anchors > g.anchors * 3) OR (g.paths > 10 AND c.paths > g.paths * 3) AS broken,
         g.approved, CASE WHEN g.anchors > 0 THEN abs(c.anchors - g.anchors) * 100e0 / g.anchors ELSE 0e0 END AS anchor_pct
  FROM stats c JOIN {{goldens}} g ON g.case_id = c.case_id
),
verdicts AS (SELECT *, CASE WHEN broken THEN 'FAIL' WHEN NOT approved OR NOT same THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS verdict FROM compared)"""
golden_verdict = Operator(f"WITH {_VERDICTS} SELECT case_id, CAST(path_delta AS BIGINT) AS path_delta, CAST(anchor_delta AS BIGINT) AS anchor_delta, CAST(hole_delta AS BIGINT) AS hole_delta, {E.rounded('anchor_pct')} AS anchor_pct, verdict FROM verdicts")
golden_tally = Operator(f"WITH {_VERDICTS} SELECT verdict, count(*) AS cases, CAST(sum(CASE WHEN same THEN 1 ELSE 0 END) AS BIGINT) AS identical, {E.rounded('avg(anchor_pct)')} AS mean_anchor_pct FROM verdicts GROUP BY verdict")

# Holes are further subpaths of a compound path; a document keeps its topology if candidate and approved result hold as many.
topology_metrics = Operator(f"""
WITH {_COUNTS}
SELECT n.doc_id, count(*) AS files, CAST(sum(s.paths) AS BIGINT) AS paths, CAST(sum(s.compound) AS BIGINT) AS compound, CAST(sum(s.holes) AS BIGINT) AS holes, CAST(sum(g.holes) AS BIGINT) AS approved_holes,
       CASE WHEN sum(g.holes) = 0 THEN 'NOT_APPLICABLE' WHEN sum(s.holes) >= sum(g.holes) THEN 'PRESERVED' ELSE 'LOST' END AS status
FROM stats s JOIN {{nodes}} n ON n.node_id = s.case_id JOIN {{goldens}} g ON g.case_id = s.case_id GROUP BY n.doc_id""")
