"""All rings against all in blocks: the same pairs as from the definition, none of them shuffled."""

import numpy as np
import pytest

from inkfold.operators import curves, pairs, rings
from tests.test_copies import RINGS


def some_rings(rng, many=60):
    """Rings of one to eleven points, every fifth a copy of one before."""
    made = []
    for k in range(many):
        p = rng.integers(0, 40, (int(rng.integers(1, 12)), 2)).astype(float)
        made.append(made[int(rng.integers(len(made)))] if k % 5 == 4 else p)
    rows = [(k * 7, pos, len(p), float(x), float(y)) for k, p in enumerate(made) for pos, (x, y) in enumerate(p)]
    return made, rows


def above_python(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("MapInArrow")]


@pytest.mark.parametrize("small", [False, True])
def test_points_in_rings_by_definition(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(pairs, "MOST_SIDES", 40)
        monkeypatch.setattr(pairs, "MOST_PROBES", 9)
        monkeypatch.setattr(pairs, "_TOLD", 20)
    made, rows = some_rings(np.random.default_rng(3))
    want = set()
    for p, probe in enumerate(made):
        qx, qy = probe.mean(axis=0)
        for r, ring in enumerate(made):
            n = sum((y > qy) != (ny > qy) and qx < (nx - x) * (qy - y) / (ny - y) + x for (x, y), (nx, ny) in zip(ring, np.roll(ring, -1, axis=0), strict=True))
            if p != r and n % 2:
                want.add((7 * p, 7 * r, n))
    df = rings.point_in_ring(rings=spark.createDataFrame(rows, RINGS))
    got = [tuple(r) for r in df.collect()]
    assert len(want) > 300 and len(got) == len(want) and set(got) == want
    assert "Exchange" not in above_python(df)


@pytest.mark.parametrize("small", [False, True])
def test_shared_sides_by_definition(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(pairs, "MOST_KINDS", 30)
        monkeypatch.setattr(pairs, "_TOLD", 20)
    made, rows = some_rings(np.random.default_rng(5))
    sides = []
    for ring in made:
        cells = [tuple(c) for c in np.floor(ring / 10).astype(int).tolist()]
        # as in SQL: ends in order of x alone
        sides.append([(a[0], b[0], a[1], b[1]) if a[0] <= b[0] else (b[0], a[0], b[1], a[1]) for a, b in zip(cells, cells[1:], strict=False)])
    want = {(7 * a, 7 * b, n) for a in range(len(made)) for b in range(a + 1, len(made)) if (n := sum(s == t for s in sides[a] for t in sides[b]))}
    df = curves.shared_edge_absorption(rings=spark.createDataFrame(rows, RINGS))
    got = [tuple(r) for r in df.collect()]
    assert len(want) > 100 and max(w[2] for w in want) > 3 and len(got) == len(want) and set(got) == want
    assert "Exchange" not in above_python(df)


def test_points_without_a_place_and_a_crowd_of_copies(spark):
    """A ring without coordinates lies nowhere; copies are told of one another, in every block."""
    box = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]
    rows = [(k, pos, 4, x, y) for k in range(200) for pos, (x, y) in enumerate(box)] + [(500, 0, 1, None, 5.0)]
    df = spark.createDataFrame(rows, RINGS)
    assert {tuple(r) for r in rings.point_in_ring(rings=df).collect()} == {(p, r, 1) for p in range(200) for r in range(200) if p != r}
    assert {tuple(r) for r in curves.shared_edge_absorption(rings=df).collect()} == {(a, b, 9) for a in range(200) for b in range(a + 1, 200)}


def test_ranges_of_points_and_arithmetic_agree(monkeypatch):
    """Sides of all slopes and sizes, points on them and beside them."""
    rng = np.random.default_rng(1)
    for trial in range(40):
        monkeypatch.setattr(pairs, "_PART", int(rng.integers(2, 60)))
        monkeypatch.setattr(pairs, "_PARTS", int(rng.integers(1, 6)))
        monkeypatch.setattr(pairs, "_TOLD", int(rng.integers(5, 200)))
        scale = (1, 1, 1e-6, 1e7)[trial % 4]
        qx, qy = rng.integers(0, 12, (2, int(rng.integers(1, 300)))) / (1 + trial % 2) * scale
        lx, ly, nx, ny = rng.integers(0, 6, (4, 40)) * 1.0 * scale
        if trial % 5 == 4:
            nx = lx + rng.normal(0, 1e-12, 40) * scale  # hardly steep
        lx, ly, nx, ny = (c[ly != ny] for c in (lx, ly, nx, ny))
        want = sum(((ly[k] > qy) != (ny[k] > qy)) & (qx < (nx[k] - lx[k]) * (qy - ly[k]) / (ny[k] - ly[k]) + lx[k]) for k in range(len(lx)))
        laid = pairs._Points(qx, qy, (lx, ly, nx, ny))
        assert (laid.crossings(slice(0, len(lx))) == (want + np.zeros(len(qx), int))[laid.order]).all()
