"""Pixel neighbourhood operators: blur, bilinear samples, superpixels, masks, composition, sub-pixel edges."""

from __future__ import annotations

from inkfold.functions import expressions as E
from inkfold.operators.template import Operator

_GREY = E.luminance("r", "g", "b")
# 3x3 binomial weights by absolute offset: centre 4, side 2, corner 1.
_KERNEL = "(SELECT a.d AS dx, b.d AS dy, CAST(4 / power(2, abs(a.d) + abs(b.d)) AS DOUBLE) AS w FROM (SELECT -1 AS d UNION ALL SELECT 0 UNION ALL SELECT 1) a JOIN (SELECT -1 AS d UNION ALL SELECT 0 UNION ALL SELECT 1) b ON true)"

gaussian_blur = Operator(f"""
WITH cast_out AS (
  SELECT image_id, x + dx AS x, y + dy AS y, sum(w * r) AS r, sum(w * g) AS g, sum(w * b) AS b, sum(w) AS w, max(CASE WHEN dx = 0 AND dy = 0 THEN 1 ELSE 0 END) AS own
  FROM {{pixels}} JOIN {_KERNEL} k ON true GROUP BY image_id, x + dx, y + dy
)
SELECT image_id, x, y, {E.whole('r / w + 0.5')} AS r, {E.whole('g / w + 0.5')} AS g, {E.whole('b / w + 0.5')} AS b FROM cast_out WHERE own = 1""")

half_scale = Operator(f"""
SELECT image_id, {E.whole('x / 2')} AS x, {E.whole('y / 2')} AS y, {E.whole('avg(r) + 0.5')} AS r, {E.whole('avg(g) + 0.5')} AS g, {E.whole('avg(b) + 0.5')} AS b, {E.whole('avg(a) + 0.5')} AS a
FROM {{pixels}} GROUP BY image_id, {E.whole('x / 2')}, {E.whole('y / 2')}""")

bilinear_samples = Operator(f"""
WITH probes AS (SELECT image_id, idx AS probe, x + 0.25e0 AS u, y + 0.75e0 AS v, x AS x0, y AS y0 FROM {{pixels}}),
corners AS (SELECT 0 AS i, 0 AS j UNION ALL SELECT 1, 0 UNION ALL SELECT 0, 1 UNION ALL SELECT 1, 1),
wanted AS (SELECT image_id, probe, x0 + i AS x, y0 + j AS y, CASE WHEN i = 1 THEN u - x0 ELSE 1 - (u - x0) END * CASE WHEN j = 1 THEN v - y0 ELSE 1 - (v - y0) END AS w FROM probes JOIN corners ON true)
SELECT w.image_id, w.probe, {E.rounded('sum(w.w * (2126 * r + 7152 * g + 722 * b)) / sum(w.w) / 10000')} AS value, count(*) AS corners
FROM wanted w JOIN {{pixels}} p ON p.image_id = w.image_id AND p.x = w.x AND p.y = w.y GROUP BY w.image_id, w.probe""")

subpixel_edges = Operator(f"""
WITH grey AS (SELECT image_id, x, y, {_GREY} AS v FROM {{pixels}}),
near AS (SELECT image_id, x, y, v, lag(v) OVER w AS p, lead(v) OVER w AS n FROM grey WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
slopes AS (SELECT image_id, x, y, (n - p) / 2 AS slope FROM near WHERE p IS NOT NULL AND n IS NOT NULL),
peaks AS (SELECT image_id, x, y, abs(slope) AS m, abs(lag(slope) OVER w) AS pm, abs(lead(slope) OVER w) AS nm FROM slopes WINDOW w AS (PARTITION BY image_id, y ORDER BY x))
SELECT image_id, x, y, {E.rounded('m')} AS strength, {E.rounded('x + CASE WHEN pm - 2 * m + nm = 0 THEN 0e0 ELSE (pm - nm) / (2 * (pm - 2 * m + nm)) END')} AS edge_x FROM peaks WHERE m > 20 AND m > pm AND m >= nm""")

_L, _A, _B = E.oklab("r", "g", "b")


def _centres(source: str) -> str:
    """The centres that a cell of eight by eight pixels can see, its own and those around, as one array; a row a cell, whatever its pixels."""
    return f"""SELECT image_id, cell_x + dx AS gx, cell_y + dy AS gy, collect_list(struct(cell_x, cell_y, cx, cy, cl, ca, cb)) AS seen
    FROM (SELECT image_id, cell_x, cell_y, avg(x) AS cx, avg(y) AS cy, avg(l) AS cl, avg(a) AS ca, avg(b) AS cb FROM {source} GROUP BY image_id, cell_x, cell_y) c JOIN around ON true GROUP BY image_id, cell_x + dx, cell_y + dy"""


def _assign(source: str) -> str:
    """Nearest centre among those of the cells around a pixel; ties go to the higher, then lefter cell. Pixels are not multiplied: each looks through its cell's array."""
    gap = "(c.cl - p.l) * (c.cl - p.l) + (c.ca - p.a) * (c.ca - p.a) + (c.cb - p.b) * (c.cb - p.b)"
    cost = f"floor((144 * ({gap}) + ((c.cx - p.x) * (c.cx - p.x) + (c.cy - p.y) * (c.cy - p.y)) / 64) * 1000000000)"
    return f"""SELECT image_id, x, y, l, a, b, best.cell_x AS cell_x, best.cell_y AS cell_y FROM (
    SELECT p.image_id, p.x, p.y, p.l, p.a, p.b, array_min(transform(seen, c -> struct({cost} AS cost, c.cell_y AS cell_y, c.cell_x AS cell_x))) AS best
    FROM px p JOIN ({_centres(source)}) n ON n.image_id = p.image_id AND n.gx = p.gx AND n.gy = p.gy) r"""


slic_superpixels = Operator(f"""
WITH px AS (SELECT image_id, x, y, {_L} AS l, {_A} AS a, {_B} AS b, {E.whole('x / 8')} AS gx, {E.whole('y / 8')} AS gy FROM {{pixels}} WHERE a > 0),
around AS (SELECT a.d AS dx, b.d AS dy FROM (SELECT -1 AS d UNION ALL SELECT 0 UNION ALL SELECT 1) a JOIN (SELECT -1 AS d UNION ALL SELECT 0 UNION ALL SELECT 1) b ON true),
seeded AS (SELECT px.*, gx AS cell_x, gy AS cell_y FROM px),
one AS ({_assign('seeded')}),
two AS ({_assign('one')})
SELECT image_id, cell_x, cell_y, count(*) AS area, {E.rounded('avg(l)')} AS ok_l, {E.rounded('avg(x)')} AS cx, {E.rounded('avg(y)')} AS cy FROM two GROUP BY image_id, cell_x, cell_y""")

varnish_mask = Operator(f"""
WITH boxes AS (
  SELECT n.doc_id, greatest(0, {E.whole('x_mm')}) AS x0, greatest(0, {E.whole('y_mm')}) AS y0, least({E.whole('width_mm')}, {E.whole('x_mm + w_mm')}) AS x1, least({E.whole('height_mm')}, {E.whole('y_mm + h_mm')}) AS y1
  FROM {{nodes}} n JOIN {{docs}} d ON d.doc_id = n.doc_id WHERE visible AND type IN ('raster_image', 'group', 'vector_path') AND parent_id IS NULL
),
lines AS (SELECT doc_id, x0, x1, explode(sequence(y0, y1 - 1)) AS y FROM boxes WHERE x1 > x0 AND y1 > y0),
cover AS (SELECT DISTINCT doc_id, explode(sequence(x0, x1 - 1)) AS x, y FROM lines),
sums AS (SELECT doc_id, count(*) AS cells, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM cover GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(cells, 0) AS BIGINT) AS artwork_cells, CAST(width_mm * height_mm AS BIGINT) AS full_cells, {E.rounded('CASE WHEN width_mm * height_mm > 0 THEN coalesce(cells, 0) / (width_mm * height_mm) ELSE 0 END')} AS coverage, min_x, max_x, min_y, max_y
FROM {{docs}} d LEFT JOIN sums s ON s.doc_id = d.doc_id""")

composition_route = Operator(f"""
WITH sizes AS (SELECT n.doc_id, max(n.w_mm * n.h_mm) AS largest, max(d.width_mm * d.height_mm) AS canvas, sum(CASE WHEN opacity < 1 THEN 1 ELSE 0 END) AS soft, count(*) AS parts FROM {{nodes}} n JOIN {{docs}} d ON d.doc_id = n.doc_id WHERE n.type <> 'technical_guide' GROUP BY n.doc_id)
SELECT doc_id, {E.rounded('CASE WHEN canvas > 0 THEN largest / canvas ELSE 0 END')} AS underlay_share, CAST(soft AS BIGINT) AS translucent, parts,
       CASE WHEN canvas > 0 AND largest / canvas >= 0.85 THEN 'LAYERED' WHEN soft * 2 > parts THEN 'BLENDED' ELSE 'PLANAR' END AS model FROM sizes""")

typographic_palette = Operator(f"""
WITH size AS (SELECT image_id, max(x) AS w, max(y) AS h FROM {{pixels}} GROUP BY image_id),
border AS (SELECT p.image_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM {{pixels}} p JOIN size s ON s.image_id = p.image_id WHERE x = 0 OR y = 0 OR x = w OR y = h GROUP BY p.image_id),
dark AS (SELECT p.image_id, count(*) AS n, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM {{pixels}} p WHERE a > 0 AND {_GREY} < 100 GROUP BY p.image_id)
SELECT b.image_id, {E.whole('b.r + 0.5')} AS bg_r, {E.whole('b.g + 0.5')} AS bg_g, {E.whole('b.b + 0.5')} AS bg_b, {E.whole('d.r + 0.5')} AS fg_r, {E.whole('d.g + 0.5')} AS fg_g, {E.whole('d.b + 0.5')} AS fg_b, d.n AS dark_samples
FROM border b JOIN dark d ON d.image_id = b.image_id""")

# An image's palette are its colours of a share or more; every colour goes to the nearest of them in CIELAB, ties to the more frequent.
_SHARE = 0.02
_PL, _PA, _PB = E.cielab("r", "g", "b")
palette_snap = Operator(f"""
WITH counted AS (SELECT image_id, r, g, b, count(*) AS n FROM {{pixels}} WHERE a > 0 GROUP BY image_id, r, g, b),
shades AS (SELECT image_id, r, g, b, n, sum(n) OVER (PARTITION BY image_id) AS total, {_PL} AS l, {_PA} AS la, {_PB} AS lb FROM counted),
palette AS (SELECT image_id, l, la, lb, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS k FROM shades WHERE n >= {_SHARE} * total),
gaps AS (SELECT c.image_id, c.r, c.g, c.b, c.n, p.k, {E.rounded(E.distance(('c.l', 'p.l'), ('c.la', 'p.la'), ('c.lb', 'p.lb')))} AS gap FROM shades c JOIN palette p ON p.image_id = c.image_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, r, g, b ORDER BY gap, k) AS near FROM gaps)
SELECT image_id, CAST(k AS BIGINT) AS palette_id, count(*) AS colours, CAST(sum(n) AS BIGINT) AS pixels, CAST(sum(CASE WHEN gap > 0 THEN n ELSE 0 END) AS BIGINT) AS reassigned, max(gap) AS farthest FROM ranked WHERE near = 1 GROUP BY image_id, k""")

fragmented_colours = Operator("""
WITH parts AS (SELECT image_id, label, count(*) AS cells, count(DISTINCT y) AS lines, min(x) AS min_x, max(x) AS max_x FROM {labels_map} GROUP BY image_id, label)
SELECT p.image_id, p.label AS small_label, q.label AS into_label, p.cells FROM parts p JOIN parts q ON q.image_id = p.image_id AND q.cells > p.cells AND abs(q.label - p.label) = 1
WHERE p.cells < 40 AND p.max_x >= q.min_x - 3 AND q.max_x >= p.min_x - 3""")
