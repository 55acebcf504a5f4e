"""Raster operators over pixels(image_id, idx, x, y, r, g, b, a)."""

from __future__ import annotations

from inkfold.functions import expressions as E
from inkfold.operators.template import Operator

_L, _A, _B = E.oklab("r", "g", "b")
_LAB = f"SELECT image_id, x, y, r, g, b, a, {_L} AS ll, {_A} AS la, {_B} AS lb FROM {{pixels}}"


def _neighbours(columns: str, source: str) -> str:
    """Each pixel with its right and its lower neighbour, by two windows instead of a self-join."""
    pick = lambda way, part: ", ".join(f"lead({c}) OVER {way} AS {part}_{c}" for c in columns.split())
    return (
        f"SELECT *, {pick('w_row', 'right')}, {pick('w_col', 'down')} FROM {source} "
        "WINDOW w_row AS (PARTITION BY image_id, y ORDER BY x), w_col AS (PARTITION BY image_id, x ORDER BY y)"
    )


_PAIRS = f"""lab AS ({_LAB}), near AS ({_neighbours('ll la lb a', 'lab')})"""
_RIGHT = E.distance(("ll", "right_ll"), ("la", "right_la"), ("lb", "right_lb"))
_DOWN = E.distance(("ll", "down_ll"), ("la", "down_la"), ("lb", "down_lb"))

artwork_mode = Operator(f"""
WITH {_PAIRS},
buckets AS (
  SELECT image_id, count(*) AS n FROM {{pixels}} WHERE a > 0
  GROUP BY image_id, {E.whole('r / 32')}, {E.whole('g / 32')}, {E.whole('b / 32')}
),
ranked AS (SELECT image_id, n, row_number() OVER (PARTITION BY image_id ORDER BY n DESC) AS k, sum(n) OVER (PARTITION BY image_id) AS total FROM buckets),
spread AS (
  SELECT image_id, count(*) AS buckets, CAST(max(total) AS BIGINT) AS visible, CAST(sum(CASE WHEN k <= 8 THEN n ELSE 0 END) AS DOUBLE) / max(total) AS dominant,
         -sum(CAST(n AS DOUBLE) / total * log2(CAST(n AS DOUBLE) / total)) AS entropy
  FROM ranked GROUP BY image_id
),
local AS (
  SELECT image_id, CAST(sum(CASE WHEN right_a > 0 THEN 1 ELSE 0 END + CASE WHEN down_a > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS pairs,
         sum(CASE WHEN right_a > 0 AND {_RIGHT} > 0.08 THEN 1 ELSE 0 END + CASE WHEN down_a > 0 AND {_DOWN} > 0.08 THEN 1 ELSE 0 END) AS varied,
         CAST(sum(CASE WHEN a < 255 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS alpha
  FROM near WHERE a > 0 GROUP BY image_id
),
signals AS (
  SELECT image_id, visible, buckets, dominant, entropy, alpha, CASE WHEN pairs = 0 THEN 0e0 ELSE varied / pairs END AS variation FROM spread JOIN local USING (image_id)
)
SELECT image_id, visible AS visible_pixels, {E.rounded('dominant', 4)} AS dominant_coverage, {E.rounded('variation', 4)} AS local_variation,
       {E.rounded('entropy', 4)} AS color_entropy, {E.rounded('alpha', 4)} AS alpha_coverage,
       CASE WHEN (variation >= 0.08 AND buckets > 8) OR entropy >= 5.25 THEN 'DETAILED_ART'
            WHEN dominant >= 0.80 AND (variation <= 0.23 OR buckets <= 8) THEN CASE WHEN buckets <= 10 THEN 'FLAT_LOGO' ELSE 'FLAT_GRAPHIC' END
            ELSE 'INCONCLUSIVE' END AS mode
FROM signals""")

color_histogram = Operator("SELECT image_id, r, g, b, a, count(*) AS n FROM {pixels} GROUP BY image_id, r, g, b, a")

quantized_palette_top8 = Operator(f"""
WITH bins AS (
  SELECT image_id, {E.whole('r / 8')} * 1024 + {E.whole('g / 8')} * 32 + {E.whole('b / 8')} AS bin, count(*) AS n,
         CAST(sum(r) AS DOUBLE) / count(*) AS mr, CAST(sum(g) AS DOUBLE) / count(*) AS mg, CAST(sum(b) AS DOUBLE) / count(*) AS mb
  FROM {{pixels}} GROUP BY image_id, {E.whole('r / 8')} * 1024 + {E.whole('g / 8')} * 32 + {E.whole('b / 8')}
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY n DESC, bin) AS BIGINT) AS k FROM bins)
SELECT image_id, k AS rank, bin, n, {E.whole('mr + 0.5')} AS r, {E.whole('mg + 0.5')} AS g, {E.whole('mb + 0.5')} AS b FROM ranked WHERE k <= 8""")


def _projection(parts: tuple[str, str, str], names: str) -> Operator:
    shown = ", ".join(f"{E.rounded(p)} AS {n}" for p, n in zip(parts, names.split(), strict=True))
    return Operator(f"SELECT r, g, b, {shown} FROM {{colours}}")


oklab_projection = _projection(E.oklab("r", "g", "b"), "ok_l ok_a ok_b")
cielab_projection = _projection(E.cielab("r", "g", "b"), "lab_l lab_a lab_b")
_H, _S, _V = E.hsl("r", "g", "b")
hsl_family = Operator(
    f"SELECT r, g, b, {E.rounded('h')} AS hue, {E.rounded('s')} AS saturation, {E.rounded('l')} AS lightness, {E.rounded(E.luminance('r', 'g', 'b'))} AS luminance, "
    f"{E.colour_family('h', 's', 'l')} AS family FROM (SELECT r, g, b, {_H} AS h, {_S} AS s, {_V} AS l FROM {{colours}})"
)

_FEATURES = f"""
WITH left_of AS (
  SELECT *, lag(r) OVER w AS pr, lag(g) OVER w AS pg, lag(b) OVER w AS pb FROM {{pixels}} WINDOW w AS (PARTITION BY image_id, y ORDER BY x)
),
steps AS (SELECT *, abs(r - pr) + abs(g - pg) + abs(b - pb) AS step FROM left_of),
features AS (
  SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height, count(*) AS pixels, max(CASE WHEN a > 0 AND a < 255 THEN 1 ELSE 0 END) = 1 AS alpha,
         count(DISTINCT CASE WHEN a > 0 THEN {E.whole('r / 16')} * 256 + {E.whole('g / 16')} * 16 + {E.whole('b / 16')} END) AS colours,
         CAST(sum(CASE WHEN a > 0 AND step > 60 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS edges,
         CAST(sum(CASE WHEN a > 0 AND step > 15 AND step <= 60 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS noise
  FROM steps GROUP BY image_id
)"""
raster_features = Operator(
    _FEATURES + f" SELECT image_id, width, height, pixels, alpha AS alpha_presence, colours AS color_pressure, {E.rounded('edges')} AS edge_density, {E.rounded('noise')} AS noise_indicator FROM features"
)
strategy_selector = Operator(
    _FEATURES
    + """
SELECT image_id, CASE WHEN NOT alpha AND noise >= 0.01 AND noise * pixels >= greatest(32, least(width, height)) AND colours >= 8 AND edges >= 0.06 THEN 'NOISY_LOGO' ELSE 'BASELINE_LOGO' END AS strategy,
       CASE WHEN alpha THEN 'ALPHA_PRESERVATION' WHEN noise >= 0.01 AND noise * pixels >= greatest(32, least(width, height)) AND colours >= 8 AND edges >= 0.06 THEN 'SUFFICIENT_RASTER_NOISE'
            ELSE 'INSUFFICIENT_COMBINED_EVIDENCE' END AS reason
FROM features"""
)


def strength(way: str, step: str) -> str:
    """Strength of the boundary to a neighbour at a colour distance."""
    return f"CASE WHEN {way}_a > 0 THEN least(1e0, {step} * 5 * least(a, {way}_a) / 255e0) ELSE 0e0 END"


EDGES = f"{_PAIRS}, edges AS (SELECT image_id, x, y, CASE WHEN a = 0 THEN 0e0 ELSE greatest({strength('right', _RIGHT)}, {strength('down', _DOWN)}) END AS strength FROM near)"
edge_map = Operator(f"WITH {EDGES} SELECT image_id, x, y, {E.rounded('strength')} AS strength FROM edges")

alpha_classes = Operator(f"""
SELECT image_id, step, count(*) AS sampled, CAST(sum(CASE WHEN a = 0 THEN 1 ELSE 0 END) AS BIGINT) AS transparent,
       CAST(sum(CASE WHEN a > 0 AND a < 255 THEN 1 ELSE 0 END) AS BIGINT) AS semi, CAST(sum(CASE WHEN a = 255 THEN 1 ELSE 0 END) AS BIGINT) AS opaque,
       {E.rounded('CAST(sum(CASE WHEN a = 255 THEN 1 ELSE 0 END) AS DOUBLE) / count(*)')} AS opaque_ratio
FROM {{pixels}} JOIN (SELECT CAST(1 AS BIGINT) AS step UNION ALL SELECT CAST(2 AS BIGINT)) s ON idx % step = 0
GROUP BY image_id, step""")

# An inner pixel is an edge if one of the nine around it differs by more than this in Lab.
_EDGE_STEP = 3.8
_CL, _CA, _CB = E.cielab("r", "g", "b")


def _steps_to(names: str) -> str:
    gaps = [E.distance(("ll", f"{n}_l"), ("la", f"{n}_a"), ("lb", f"{n}_b")) for n in names.split()]
    return "greatest(" + ", ".join(f"coalesce({g}, 0e0)" for g in gaps) + ")"


def _moved(way: str, names: dict[str, str]) -> str:
    """Lab columns of neighbours as lag (-) and lead (+) over a window."""
    out = []
    for new, old in names.items():
        fn, source = ("lag" if new.startswith(("w", "n")) else "lead"), old
        out += [f"{fn}({source}{c}) OVER {way} AS {new}_{c}" for c in "lab"]
    return ", ".join(out)


# Whole rasters, row by row: two windows bring the eight neighbours, no join.
_EDGE_PIXELS = f"""
lab AS (SELECT image_id, x, y, {_CL} AS ll, {_CA} AS la, {_CB} AS lb FROM {{artwork}}),
sized AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM {{artwork}} GROUP BY image_id),
across AS (SELECT *, {_moved('w_row', {'w': 'l', 'e': 'l'})} FROM lab WINDOW w_row AS (PARTITION BY image_id, y ORDER BY x)),
around AS (SELECT *, {_moved('w_col', {'n': 'l', 's': 'l', 'nw': 'w_', 'ne': 'e_', 'sw': 'w_', 'se': 'e_'})} FROM across WINDOW w_col AS (PARTITION BY image_id, x ORDER BY y)),
marked AS (
  SELECT q.*, width, height, CASE WHEN x BETWEEN 1 AND width - 2 AND y BETWEEN 1 AND height - 2 AND {_steps_to('w e n s nw ne sw se')} > {_EDGE_STEP} THEN 1 ELSE 0 END AS edge
  FROM around q JOIN sized z ON z.image_id = q.image_id
)"""


def _runs(way: str, axis: str) -> str:
    """Start and end of the run of edge pixels that a pixel lies in, along an axis."""
    return f"min({axis}) OVER (PARTITION BY image_id, {way}, {axis}_run) AS {axis}_first, max({axis}) OVER (PARTITION BY image_id, {way}, {axis}_run) AS {axis}_last"


_BREAKS = """
numbered AS (
  SELECT *, sum(1 - edge) OVER (PARTITION BY image_id, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS x_run, sum(1 - edge) OVER (PARTITION BY image_id, x ORDER BY y ROWS UNBOUNDED PRECEDING) AS y_run FROM marked
)"""
_FEATURE_CTES = f"""{_EDGE_PIXELS}, {_BREAKS.strip()},
spans AS (SELECT *, {_runs('y', 'x')}, {_runs('x', 'y')} FROM numbered WHERE edge = 1),
samples AS (
  SELECT *, {E.distance(('w_l', 'e_l'), ('w_a', 'e_a'), ('w_b', 'e_b'))} AS flat, {E.distance(('n_l', 's_l'), ('n_a', 's_a'), ('n_b', 's_b'))} AS steep
  FROM spans WHERE x >= 5 AND x < width - 5 AND y >= 5 AND y < height - 5 AND (x - 5) % 4 = 0 AND (y - 5) % 4 = 0
),
ramps AS (
  SELECT image_id, count(*) AS samples, CAST(sum(CASE WHEN flat >= steep THEN least(15, x - x_first + 1) + least(15, x_last - x + 1) ELSE least(15, y - y_first + 1) + least(15, y_last - y + 1) END) AS DOUBLE) / count(*) AS wramp
  FROM samples WHERE greatest(flat, steep) > 15 GROUP BY image_id
),
windows AS (
  SELECT image_id, {E.whole('(x - 6) / 12')} AS ax, {E.whole('(y - 6) / 12')} AS ay, count(DISTINCT {E.toward_zero('ll / 15')} * 65536 + {E.toward_zero('(la + 128) / 15')} * 256 + {E.toward_zero('(lb + 128) / 15')}) AS colours
  FROM marked WHERE edge = 0 AND x >= 6 AND y >= 6 AND (x - 6) % 12 <= 8 AND (y - 6) % 12 <= 8 AND x % 2 = 0 AND y % 2 = 0
    AND 10 + 12 * {E.whole('(x - 6) / 12')} < width - 10 AND 10 + 12 * {E.whole('(y - 6) / 12')} < height - 10
  GROUP BY image_id, {E.whole('(x - 6) / 12')}, {E.whole('(y - 6) / 12')}
),
variety AS (SELECT image_id, count(*) AS cells, CAST(sum(CASE WHEN colours >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS cpoly FROM windows GROUP BY image_id)"""

ramp_width = Operator(f"WITH {_FEATURE_CTES} SELECT z.image_id, coalesce(samples, 0) AS samples, {E.rounded('coalesce(wramp, 1e0)')} AS wramp FROM sized z LEFT JOIN ramps r ON r.image_id = z.image_id")

local_variety = Operator(f"WITH {_FEATURE_CTES} SELECT z.image_id, coalesce(cells, 0) AS cells, coalesce(cpoly, 0) AS cpoly FROM sized z LEFT JOIN variety v ON v.image_id = z.image_id")

backend_route = Operator(f"""
WITH {_FEATURE_CTES},
features AS (SELECT z.image_id, coalesce(v.cpoly, 0) AS cpoly, coalesce(r.wramp, 1e0) AS wramp FROM sized z LEFT JOIN variety v ON v.image_id = z.image_id LEFT JOIN ramps r ON r.image_id = z.image_id)
SELECT image_id, cpoly, {E.rounded('wramp')} AS wramp, {E.route('cpoly', 'wramp')} AS backend, {E.route('cpoly', 'wramp')} = 'UNCERTAIN' AS needs_validation FROM features""")

# Equal boxes are laid out once, with the strongest of them.
white_underbase = Operator(f"""
WITH boxes AS (
  SELECT doc_id, {E.whole('x_mm')} AS x0, {E.whole('y_mm')} AS y0, {E.whole('x_mm + w_mm')} AS x1, {E.whole('y_mm + h_mm')} AS y1, {E.whole('opacity * 255 + 0.5')} AS alpha
  FROM {{nodes}} WHERE visible AND type NOT IN ('cut_contour', 'technical_guide') AND parent_id IS NULL AND w_mm > 0
),
kinds AS (SELECT doc_id, x0, y0, x1, y1, max(alpha) AS alpha FROM boxes WHERE x1 > x0 AND y1 > y0 GROUP BY doc_id, x0, y0, x1, y1),
lines AS (SELECT doc_id, x0, x1, alpha, explode(sequence(y0, y1 - 1)) AS y FROM kinds),
cells AS (SELECT doc_id, alpha, y, explode(sequence(x0, x1 - 1)) AS x FROM lines),
cover AS (SELECT doc_id, x, y, max(alpha) AS alpha FROM cells GROUP BY doc_id, x, y)
SELECT doc_id, count(*) AS covered, CAST(sum(alpha) AS BIGINT) AS alpha_sum, CAST(max(alpha) AS BIGINT) AS alpha_max FROM cover GROUP BY doc_id""")
