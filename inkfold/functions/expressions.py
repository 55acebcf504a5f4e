"""Scalar expressions as SQL text, for F.expr, spark.sql templates and any ANSI engine alike."""

from __future__ import annotations

# sRGB transfer curve, Oklab matrices, D65 Lab matrix and white point.
OKLAB_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OKLAB_LAB = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
MM_PER_INCH = 25.4
SCREEN_DPI = 96.0


def rounded(x: str, digits: int = 6) -> str:
    """Half up towards plus infinity."""
    return f"floor(({x}) * {10**digits} + 0.5) / {10**digits}"


def whole(x: str) -> str:
    return f"CAST(floor({x}) AS BIGINT)"


def toward_zero(x: str) -> str:
    return f"CAST(CASE WHEN ({x}) < 0 THEN ceil({x}) ELSE floor({x}) END AS BIGINT)"


def clamp(x: str, low: str, high: str) -> str:
    return f"greatest({low}, least({high}, {x}))"


def linear(v: str) -> str:
    """sRGB channel 0-255 to linear light 0-1."""
    return f"(CASE WHEN ({v}) / 255.0e0 <= 0.04045e0 THEN ({v}) / 255.0e0 / 12.92e0 ELSE power((({v}) / 255.0e0 + 0.055e0) / 1.055e0, 2.4e0) END)"


def _dot(row: tuple, parts: list[str]) -> str:
    return "(" + " + ".join(f"({k!r}e0) * {p}" for k, p in zip(row, parts, strict=True)) + ")"


def oklab(r: str, g: str, b: str) -> tuple[str, str, str]:
    light = [linear(v) for v in (r, g, b)]
    lms = [f"cbrt({_dot(row, light)})" for row in OKLAB_LMS]
    return tuple(_dot(row, lms) for row in OKLAB_LAB)


def cielab(r: str, g: str, b: str) -> tuple[str, str, str]:
    light = [linear(v) for v in (r, g, b)]
    xyz = [f"({_dot(row, light)} / {w!r}e0)" for row, w in zip(XYZ, WHITE, strict=True)]
    f = [f"(CASE WHEN {v} > 0.008856e0 THEN cbrt({v}) ELSE 7.787e0 * {v} + 0.13793103e0 END)" for v in xyz]
    return f"(116e0 * {f[1]} - 16e0)", f"(500e0 * ({f[0]} - {f[1]}))", f"(200e0 * ({f[1]} - {f[2]}))"


def distance(*pairs: tuple[str, str]) -> str:
    return "sqrt(" + " + ".join(f"(({a}) - ({b})) * (({a}) - ({b}))" for a, b in pairs) + ")"


def hsl(r: str, g: str, b: str) -> tuple[str, str, str]:
    """Hue in degrees, saturation and lightness of channels 0-255."""
    high, low = f"(greatest({r}, {g}, {b}) / 255.0e0)", f"(least({r}, {g}, {b}) / 255.0e0)"
    span, light = f"({high} - {low})", f"(({high} + {low}) / 2e0)"
    raw = (
        f"CASE WHEN {span} = 0 THEN 0e0 WHEN {r} >= {g} AND {r} >= {b} THEN 60e0 * (({g} - {b}) / 255.0e0 / {span}) "
        f"WHEN {g} >= {b} THEN 60e0 * (({b} - {r}) / 255.0e0 / {span} + 2e0) ELSE 60e0 * (({r} - {g}) / 255.0e0 / {span} + 4e0) END"
    )
    hue = f"(CASE WHEN ({raw}) < 0 THEN ({raw}) + 360e0 ELSE ({raw}) END)"
    saturation = f"(CASE WHEN {span} = 0 THEN 0e0 ELSE {span} / (1e0 - abs(2e0 * {light} - 1e0)) END)"
    return hue, saturation, light


def colour_family(h: str, s: str, l: str) -> str:  # noqa: E741
    """Eleven colour families of HSL columns. Limits are fixed values."""
    return (
        f"CASE WHEN {l} >= 0.92 OR ({l} >= 0.82 AND {s} <= 0.12) THEN 'white' WHEN {l} <= 0.10 THEN 'black' WHEN {s} <= 0.18 THEN 'grey' "
        f"WHEN {h} >= 345 OR {h} <= 18 THEN 'red' WHEN {h} <= 45 THEN 'orange' WHEN {h} <= 70 THEN 'yellow' WHEN {h} <= 165 THEN 'green' "
        f"WHEN {h} <= 195 THEN 'cyan' WHEN {h} <= 260 THEN 'blue' WHEN {h} < 345 THEN 'purple' ELSE 'unknown' END"
    )


def luminance(r: str, g: str, b: str) -> str:
    return f"(0.2126e0 * {r} + 0.7152e0 * {g} + 0.0722e0 * {b})"


def mm_to_px(mm: str, dpi: float = SCREEN_DPI) -> str:
    return f"(({mm}) / {MM_PER_INCH}e0 * {dpi}e0)"


def effective_dpi(pixels: str, mm: str) -> str:
    return f"(({pixels}) / (({mm}) / {MM_PER_INCH}e0))"


def turn_degrees(ax: str, ay: str, bx: str, by: str) -> str:
    """Angle between two arms; 0 if one has no length."""
    norm = f"(sqrt(({ax}) * ({ax}) + ({ay}) * ({ay})) * sqrt(({bx}) * ({bx}) + ({by}) * ({by})))"
    cosine = f"(CASE WHEN {norm} = 0 THEN 1e0 ELSE {clamp(f'(({ax}) * ({bx}) + ({ay}) * ({by})) / {norm}', '-1e0', '1e0')} END)"
    return f"(acos({cosine}) * 180e0 / 3.141592653589793e0)"


def route(cpoly: str, wramp: str) -> str:
    """Backend by local variety and ramp width. Limits are fixed values."""
    return f"CASE WHEN {cpoly} >= 80 THEN 'REGION_GRAPH' WHEN {wramp} <= 9.5 THEN 'DIRECT' ELSE 'UNCERTAIN' END"


def complexity(paths: str) -> str:
    """Class by number of paths. Limits are fixed values."""
    return f"CASE WHEN {paths} > 800 THEN 'complex' WHEN {paths} > 150 THEN 'moderate' ELSE 'simple' END"


def editability(nodes: str, smooth_share: str) -> str:
    """0-100: fewer nodes and smoother joins are easier to edit."""
    return clamp(f"100e0 - 20e0 * log10(1e0 + {nodes}) + 10e0 * ({smooth_share})", "0e0", "100e0")
