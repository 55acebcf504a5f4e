"""Region operators over label maps: statistics, adjacency, boundaries, classification."""

from __future__ import annotations

from inkfold.functions import expressions as E
from inkfold.operators.raster import strength
from inkfold.operators.template import Operator

_L, _A, _B = E.oklab("r", "g", "b")
_STATS = f"""stats AS (
  SELECT image_id, label, count(*) AS area, avg({_L}) AS l, avg({_A}) AS a, avg({_B}) AS b, avg(a / 255e0) AS coverage, avg(r) AS r, avg(g) AS g, avg(bb) AS blue, avg(a) AS alpha,
         min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y
  FROM (SELECT *, b AS bb FROM {{labels_map}}) m GROUP BY image_id, label
)"""

region_stats = Operator(f"""
WITH {_STATS}
SELECT image_id, label, area, {E.rounded('l')} AS ok_l, {E.rounded('a')} AS ok_a, {E.rounded('b')} AS ok_b, {E.rounded('coverage')} AS coverage, min_x, max_x, min_y, max_y FROM stats""")

# Pairs of different labels on neighbouring pixels, from two windows.
_TOUCH = """sides AS (
  SELECT image_id, x, y, label, lead(label) OVER w_row AS right_label, lead(x) OVER w_row AS right_x, lead(label) OVER w_col AS down_label, lead(y) OVER w_col AS down_y
  FROM {labels_map} WINDOW w_row AS (PARTITION BY image_id, y ORDER BY x), w_col AS (PARTITION BY image_id, x ORDER BY y)
),
touch AS (
  SELECT image_id, x, y, x + 1 AS ox, y AS oy, label, right_label AS other FROM sides WHERE right_x = x + 1 AND right_label <> label
  UNION ALL SELECT image_id, x, y, x AS ox, y + 1 AS oy, label, down_label AS other FROM sides WHERE down_y = y + 1 AND down_label <> label
)"""

# Rows of a band.
_BAND = 64

# Pixels and labels are dealt to bands of rows once, the two rows below a band also to it; they are laid on one another, and strengths
# and touching labels come from windows, inside their bands without a shuffle.
_STEP = E.distance(("ll", "next_ll"), ("la", "next_la"), ("lb", "next_lb"))
_NEXT = "lead(ll) OVER w AS next_ll, lead(la) OVER w AS next_la, lead(lb) OVER w AS next_lb, lead(a) OVER w AS next_a"
rag_edges = Operator(f"""
WITH {_STATS},
dealt AS (
  SELECT * FROM (
    SELECT *, explode(sequence({E.whole(f'(y - 2) / {_BAND}')}, {E.whole(f'y / {_BAND}')})) AS band
    FROM (SELECT image_id, x, y, r, g, b, a, NULL AS label FROM {{pixels}} UNION ALL SELECT image_id, x, y, NULL, NULL, NULL, NULL, label FROM {{labels_map}}) u) d DISTRIBUTE BY image_id, band
),
laid AS (
  SELECT image_id, band, x, y, max(r) AS r, max(g) AS g, max(b) AS b, max(a) AS a, max(label) AS label FROM dealt GROUP BY image_id, band, x, y HAVING max(a) IS NOT NULL
),
lab AS (SELECT image_id, band, x, y, a, label, {_L} AS ll, {_A} AS la, {_B} AS lb FROM laid),
across AS (
  SELECT image_id, band, x, y, a, label, ll, la, lb, CASE WHEN next_x = x + 1 THEN {strength('next', _STEP)} ELSE 0e0 END AS rightward
  FROM (SELECT *, lead(x) OVER w AS next_x, {_NEXT} FROM lab WINDOW w AS (PARTITION BY image_id, band, y ORDER BY x)) n
),
edges AS (
  SELECT image_id, band, x, y, label, CASE WHEN a = 0 THEN 0e0 WHEN next_y = y + 1 THEN greatest(rightward, {strength('next', _STEP)}) ELSE rightward END AS strength
  FROM (SELECT *, lead(y) OVER w AS next_y, {_NEXT} FROM across WINDOW w AS (PARTITION BY image_id, band, x ORDER BY y)) n
),
below AS (SELECT *, CASE WHEN lead(y) OVER w = y + 1 THEN lead(label) OVER w END AS down_label, lead(strength) OVER w AS down_strength FROM edges WINDOW w AS (PARTITION BY image_id, band, x ORDER BY y)),
beside AS (SELECT *, CASE WHEN lead(x) OVER w = x + 1 THEN lead(label) OVER w END AS right_label, lead(strength) OVER w AS right_strength FROM below WINDOW w AS (PARTITION BY image_id, band, y ORDER BY x)),
walls AS (
  SELECT image_id, least(label, other) AS region_a, greatest(label, other) AS region_b, greatest(strength, other_strength) AS strength FROM (
    SELECT image_id, label, strength, inline(array(named_struct('other', down_label, 'other_strength', down_strength), named_struct('other', right_label, 'other_strength', right_strength)))
    FROM beside WHERE {E.whole(f'y / {_BAND}')} = band) t WHERE other <> label
),
sums AS (SELECT image_id, region_a, region_b, count(*) AS shared_len, avg(strength) AS avg_strength, max(strength) AS max_strength FROM walls GROUP BY image_id, region_a, region_b)
SELECT e.image_id, region_a, region_b, shared_len, {E.rounded('avg_strength')} AS avg_strength, {E.rounded('max_strength')} AS max_strength,
       {E.rounded(E.distance(('f.l', 's.l'), ('f.a', 's.a'), ('f.b', 's.b')))} AS color_dist, {E.rounded('abs(f.coverage - s.coverage)')} AS coverage_diff
FROM sums e JOIN stats f ON f.image_id = e.image_id AND f.label = e.region_a JOIN stats s ON s.image_id = e.image_id AND s.label = e.region_b""")

_RGB = lambda p, q: f"({E.distance((f'{p}.r', f'{q}.r'), (f'{p}.g', f'{q}.g'), (f'{p}.blue', f'{q}.blue'))} / 441.673e0)"

residual_region_class = Operator(f"""
WITH {_STATS}, {_TOUCH},
both_ways AS (SELECT image_id, label, other FROM touch UNION ALL SELECT image_id, other AS label, label AS other FROM touch),
beside AS (SELECT image_id, label, other, count(*) AS shared FROM both_ways GROUP BY image_id, label, other),
sizes AS (SELECT image_id, greatest(4, {E.whole('(max(max_x) + 1) * (max(max_y) + 1) / 10000')}) AS small FROM stats GROUP BY image_id),
near AS (
  SELECT b.image_id, b.label, b.other, b.shared, {_RGB('s', 'o')} AS dist, o.r, o.g, o.blue,
         row_number() OVER (PARTITION BY b.image_id, b.label ORDER BY b.shared DESC, b.other) AS k
  FROM beside b JOIN stats s ON s.image_id = b.image_id AND s.label = b.label JOIN stats o ON o.image_id = b.image_id AND o.label = b.other
),
summed AS (
  SELECT image_id, label, count(*) AS neighbours, min(dist) AS nearest, max(dist) AS contrast, max(CASE WHEN k = 1 THEN dist END) AS d1, max(CASE WHEN k = 2 THEN dist END) AS d2,
         max(CASE WHEN k = 1 THEN r END) AS r1, max(CASE WHEN k = 1 THEN g END) AS g1, max(CASE WHEN k = 1 THEN blue END) AS b1,
         max(CASE WHEN k = 2 THEN r END) AS r2, max(CASE WHEN k = 2 THEN g END) AS g2, max(CASE WHEN k = 2 THEN blue END) AS b2
  FROM near GROUP BY image_id, label
),
lines AS (
  SELECT s.image_id, s.label, s.area, s.alpha, z.small, coalesce(n.neighbours, 0) AS neighbours, n.nearest, n.contrast, n.d1, n.d2, s.r, s.g, s.blue, r1, g1, b1, r2 - r1 AS vr, g2 - g1 AS vg, b2 - b1 AS vb
  FROM stats s JOIN sizes z ON z.image_id = s.image_id LEFT JOIN summed n ON n.image_id = s.image_id AND n.label = s.label
),
placed AS (
  SELECT *, sqrt(vr * vr + vg * vg + vb * vb) / 441.673e0 AS between,
         CASE WHEN vr * vr + vg * vg + vb * vb = 0 THEN 0e0 ELSE {E.clamp('((r - r1) * vr + (g - g1) * vg + (blue - b1) * vb) / (vr * vr + vg * vg + vb * vb)', '0e0', '1e0')} END AS t FROM lines
),
offs AS (SELECT *, {E.distance(('r', 'r1 + vr * t'), ('g', 'g1 + vg * t'), ('blue', 'b1 + vb * t'))} / 441.673e0 AS off FROM placed)
SELECT image_id, label, area, CAST(neighbours AS BIGINT) AS neighbours,
       CASE WHEN area > small THEN CASE WHEN nearest < 0.08 THEN 'SHADING_REGION' ELSE 'STRUCTURAL_COLOR_REGION' END
            WHEN alpha < 250 THEN 'UNCERTAIN'
            WHEN neighbours < 2 THEN CASE WHEN neighbours = 1 AND d1 >= 0.55 THEN 'LEGITIMATE_DETAIL' ELSE 'UNCERTAIN' END
            WHEN off <= 0.06 AND least(d1, d2) < 0.45 AND between >= 0.12 AND between < 0.65 AND contrast < 0.7 THEN 'EDGE_TRANSITION_REGION'
            WHEN contrast >= 0.55 AND between < 0.05 THEN 'LEGITIMATE_DETAIL' ELSE 'UNCERTAIN' END AS class
FROM offs""")

# Owners are an image's colours of a share or more; another colour is a mixture of the two owners whose line in CIELAB runs nearest, if within the residual bound.
_OWNER_SHARE, _MOST_RESIDUAL = 0.05, 12
_ML, _MA, _MB = E.cielab("r", "g", "b")
mixture_endpoint = Operator(f"""
WITH counted AS (SELECT image_id, r, g, b, count(*) AS n FROM {{pixels}} WHERE a > 0 GROUP BY image_id, r, g, b),
shades AS (SELECT image_id, r, g, b, n, sum(n) OVER (PARTITION BY image_id) AS total, {_ML} AS l, {_MA} AS la, {_MB} AS lb FROM counted),
owners AS (SELECT image_id, l, la, lb, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS k FROM shades WHERE n >= {_OWNER_SHARE} * total),
pairs AS (SELECT p.image_id, p.k AS i, q.k AS j, p.l AS l1, p.la AS a1, p.lb AS b1, q.l - p.l AS vl, q.la - p.la AS va, q.lb - p.lb AS vb FROM owners p JOIN owners q ON q.image_id = p.image_id AND p.k < q.k),
shares AS (
  SELECT c.image_id, c.r, c.g, c.b, c.l, c.la, c.lb, i, j, l1, a1, b1, vl, va, vb, ((c.l - l1) * vl + (c.la - a1) * va + (c.lb - b1) * vb) / (vl * vl + va * va + vb * vb) AS t
  FROM shades c JOIN pairs p ON p.image_id = c.image_id AND c.n < {_OWNER_SHARE} * c.total AND vl * vl + va * va + vb * vb > 0
),
fits AS (SELECT image_id, r, g, b, i, j, {E.rounded('t')} AS t, {E.rounded(E.distance(('l', 'l1 + vl * t'), ('la', 'a1 + va * t'), ('lb', 'b1 + vb * t')))} AS off FROM shares),
best AS (SELECT *, row_number() OVER (PARTITION BY image_id, r, g, b ORDER BY off, i, j) AS k FROM fits WHERE t > 0.02 AND t < 0.98 AND off <= {_MOST_RESIDUAL})
SELECT image_id, r, g, b, CAST(i AS BIGINT) AS first_owner, CAST(j AS BIGINT) AS second_owner, t AS share, off AS residual, CAST(CASE WHEN t < 0.5 THEN i ELSE j END AS BIGINT) AS endpoint
FROM best WHERE k = 1""")

nearest_prototype = Operator(f"""
WITH gaps AS (SELECT d.vec_id, d.label, p.proto_id, sum((d.v - p.v) * (d.v - p.v)) AS gap FROM {{dims}} d JOIN {{palette}} p ON p.dim = d.dim GROUP BY d.vec_id, d.label, p.proto_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY gap, proto_id) AS k FROM gaps)
SELECT vec_id, label, proto_id, {E.rounded('sqrt(gap)')} AS distance, label <> proto_id AS reassigned FROM ranked WHERE k = 1""")

boundary_edges = Operator("""
WITH cells AS (SELECT image_id, x, y, label FROM {shapes} WHERE label IS NOT NULL),
sides AS (
  SELECT c.image_id, c.x, c.y, c.label, d.side, n.label AS other
  FROM cells c JOIN (SELECT 'R' AS side, 1 AS dx, 0 AS dy UNION ALL SELECT 'L', -1, 0 UNION ALL SELECT 'D', 0, 1 UNION ALL SELECT 'U', 0, -1) d ON true
  LEFT JOIN cells n ON n.image_id = c.image_id AND n.x = c.x + d.dx AND n.y = c.y + d.dy
)
SELECT image_id, label, side, count(*) AS edges FROM sides WHERE other IS NULL OR other <> label GROUP BY image_id, label, side""")

shared_boundaries = Operator(f"""
WITH {_TOUCH}
SELECT image_id, least(label, other) AS region_a, greatest(label, other) AS region_b, count(*) AS shared_len, min(x) AS min_x, min(y) AS min_y
FROM touch GROUP BY image_id, least(label, other), greatest(label, other)""")

# Three more rows on either side of a band are enough for three rounds.
_ROUNDS = 3


def _round(source: str) -> str:
    """One vote of the 8 neighbours inside bands: a cell takes a label that five or more of them have, which lies in the middle of all nine in order."""
    votes = "array_sort(array_compact(array(own, p, n, own_p, p_p, n_p, own_n, p_n, n_n)))"
    take = lambda fn, row: ", ".join(f"CASE WHEN {fn}(y) OVER w_col = y {row} 1 THEN {fn}({c}) OVER w_col END AS {c}_{'p' if fn == 'lag' else 'n'}" for c in ("own", "p", "n"))
    return f"""SELECT image_id, band, x, y, CASE WHEN size(filter(votes, v -> v = likely)) - CASE WHEN likely = own THEN 1 ELSE 0 END >= 5 THEN likely ELSE own END AS label FROM (
    SELECT image_id, band, x, y, own, votes, votes[CAST(floor(size(votes) / 2) AS INT)] AS likely FROM (
      SELECT image_id, band, x, y, own, {votes} AS votes FROM (
        SELECT *, {take('lag', '-')}, {take('lead', '+')} FROM (
          SELECT image_id, band, x + dx AS x, y, max(CASE WHEN dx = 0 THEN label END) AS own, max(CASE WHEN dx = 1 THEN label END) AS p, max(CASE WHEN dx = -1 THEN label END) AS n
          FROM {source} JOIN (SELECT -1 AS dx UNION ALL SELECT 0 UNION ALL SELECT 1) d ON true GROUP BY image_id, band, x + dx, y) across
        WINDOW w_col AS (PARTITION BY image_id, band, x ORDER BY y)) around WHERE own IS NOT NULL) counted) judged"""


# Pixels are dealt to bands of rows once, those near a seam to both; the rounds then stay inside their bands, without a shuffle. A pixel's place is its own (image_id, x, y).
icm_majority = Operator(f"""
WITH start AS (SELECT * FROM (SELECT image_id, x, y, label, explode(sequence({E.whole(f'(y - {_ROUNDS}) / {_BAND}')}, {E.whole(f'(y + {_ROUNDS}) / {_BAND}')})) AS band FROM {{labels_map}}) s DISTRIBUTE BY image_id, band),
one AS ({_round('start')}),
two AS ({_round('one')}),
three AS ({_round('two')})
SELECT image_id, label, count(*) AS area FROM three WHERE {E.whole(f'y / {_BAND}')} = band GROUP BY image_id, label""")

reconstruction_error = Operator(f"""
WITH {_STATS}
SELECT m.image_id, {E.rounded('(sum(abs(m.r - s.r)) + sum(abs(m.g - s.g)) + sum(abs(m.b - s.blue))) / (3 * count(*)) / 255e0')} AS mae
FROM {{labels_map}} m JOIN stats s ON s.image_id = m.image_id AND s.label = m.label GROUP BY m.image_id""")
