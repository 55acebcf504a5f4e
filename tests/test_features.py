"""Ramp width, colour variety and routing on small rasters worked out by hand, against a per-pixel loop."""

import math

import pytest

from inkfold.operators import raster

SCHEMA = "image_id long, idx long, x long, y long, r long, g long, b long, a long"


def lab(r, g, b):
    lin = [v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4 for v in (r, g, b)]
    m = ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.072175, 1.0), (0.0193339, 0.119192, 0.9503041, 1.08883))
    f = [t ** (1 / 3) if t > 0.008856 else 7.787 * t + 0.13793103 for t in (sum(k * v for k, v in zip(row, lin)) / row[3] for row in m)]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def slow(img):
    h, w = len(img), len(img[0])
    labs = [[lab(*p) for p in row] for row in img]
    edge = [[0] * w for _ in range(h)]
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            edge[y][x] = int(max(math.dist(labs[y][x], labs[y + j][x + i]) for j in (-1, 0, 1) for i in (-1, 0, 1)) > 3.8)
    total = samples = 0
    for y in range(5, h - 5, 4):
        for x in range(5, w - 5, 4):
            flat, steep = math.dist(labs[y][x - 1], labs[y][x + 1]), math.dist(labs[y - 1][x], labs[y + 1][x])
            if edge[y][x] and max(flat, steep) > 15:
                line, at = (edge[y], x) if flat >= steep else ([edge[k][x] for k in range(h)], y)
                back = next((k for k in range(15) if at - k <= 0 or not line[at - k]), 15)
                on = next((k for k in range(15) if at + k >= len(line) - 1 or not line[at + k]), 15)
                total, samples = total + back + on, samples + 1
    varied = 0
    for y in range(10, h - 10, 12):
        for x in range(10, w - 10, 12):
            seen = {tuple(math.trunc(v / 15) for v in (c[0], c[1] + 128, c[2] + 128)) for j in range(-4, 5, 2) for i in range(-4, 5, 2) if not edge[y + j][x + i] for c in [labs[y + j][x + i]]}
            varied += len(seen) >= 3
    return samples, round(total / samples, 6) if samples else 1.0, varied


def images():
    flat = [[(255, 255, 255)] * 40 for _ in range(32)]
    sharp = [[(255, 255, 255) if x < 17 else (0, 0, 0) for x in range(40)] for _ in range(32)]
    soft = [[(max(0, min(255, 255 - 14 * (x - 8))),) * 3 for x in range(40)] for _ in range(32)]
    tiles = [[[(250, 20, 20), (20, 250, 20), (20, 20, 250), (250, 250, 20)][(x // 4 + 2 * (y // 4)) % 4] for x in range(120)] for y in range(120)]
    return [flat, sharp, soft, tiles]


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(k, y * len(img[0]) + x, x, y, *p, 255) for k, img in enumerate(images()) for y, row in enumerate(img) for x, p in enumerate(row)]
    return spark.createDataFrame(rows, SCHEMA)


def test_features_and_routes(frames):
    got = {r["image_id"]: r for r in raster.backend_route(artwork=frames).collect()}
    widths = {r["image_id"]: r for r in raster.ramp_width(artwork=frames).collect()}
    for k, img in enumerate(images()):
        samples, wramp, cpoly = slow(img)
        assert (widths[k]["samples"], got[k]["wramp"], got[k]["cpoly"]) == (samples, pytest.approx(wramp, abs=1e-6), cpoly)
    assert got[0]["backend"] == "DIRECT" and widths[0]["samples"] == 0 and got[0]["wramp"] == 1.0
    assert widths[1]["samples"] == 6 and got[1]["wramp"] == 3.0  # two edge columns, seen from the right one: 2 left with itself, 1 right
    for k in range(4):
        cpoly, wramp = got[k]["cpoly"], got[k]["wramp"]
        assert got[k]["backend"] == ("REGION_GRAPH" if cpoly >= 80 else "DIRECT" if wramp <= 9.5 else "UNCERTAIN") and got[k]["needs_validation"] == (cpoly < 80 and wramp > 9.5)
