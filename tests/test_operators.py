import math

import numpy as np
import pytest

from inkfold.functions import expressions as E
from inkfold.operators import graph, kernels, planar, raster
from inkfold.operators.template import Operator
from pyspark.sql import functions as F


def grid(spark, *images):
    """Rows of letters as label maps; '.' is empty."""
    rows = []
    for k, text in enumerate(images):
        for y, line in enumerate(text.split("/")):
            for x, c in enumerate(line.strip()):
                rows.append((k, y * 100 + x, x, y, None if c == "." else ord(c)))
    return spark.createDataFrame(rows, "image_id long, idx long, x long, y long, label long")


def holes(spark, cells):
    outside = graph.border_flood_fill(cells)
    return {r["image_id"]: r["n"] for r in outside.where("NOT outside").groupBy("image_id").count().withColumnRenamed("count", "n").collect()}


def test_literal_rasters(spark):
    cells = grid(spark, ".###. / .###. / .###.", "##### / #...# / #...# / #####", ".###. / ##### / #...# / ##### / #...# / #...#", "##..## / ##..##", "aabb / aabb", "....... / ...#... / .......")
    found = {}
    for r in graph.connected_components(cells).collect():
        found.setdefault(r["image_id"], []).append(r["area"])
    assert {k: len(v) for k, v in found.items()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 1}
    assert found[5] == [1]
    assert holes(spark, cells) == {1: 1, 2: 1}


def test_components_settle_on_long_paths(spark):
    edges = spark.range(500).select(F.lit(1).alias("g"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.components(edges, ["g"], "a", "b")
    assert got.count() == 501 and got.where("component <> 0").count() == 0


def test_scratch_tables_go_back_to_a_mark(spark):
    kept = graph.cut(spark.range(3))
    mark = graph.scratch_mark()
    gone = graph.cut(spark.range(4))
    graph.discard(spark, mark)
    assert kept.count() == 3 and graph.scratch_mark() == mark
    with pytest.raises(Exception):
        gone.count()


def test_levels_skip_cycles(spark):
    steps = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 5), (1, 5, 4), (1, 6, 99)], "plan_id long, step_id long, depends_on long")
    assert sorted(tuple(r)[1:] for r in graph.step_levels(steps).collect()) == [(1, 0), (2, 1), (3, 2)]


def test_blocked_through_several_steps(spark):
    rows = [(1, 1, None, "FAILED"), (1, 2, 1, "PENDING"), (1, 3, 2, "PENDING"), (1, 4, 2, "COMPLETED"), (2, 1, None, "PENDING"), (2, 2, 1, "PENDING")]
    steps = spark.createDataFrame(rows, "plan_id long, step_id long, depends_on long, status string")
    assert sorted(tuple(r) for r in graph.blocked_steps(steps).collect()) == [(1, 2), (1, 3)]


def test_long_chains_and_blocked_cycles(spark):
    rows = [(1, k, k - 1 if k > 1 else None, "FAILED" if k == 1 else "PENDING") for k in range(1, 91)] + [(2, 1, 2, "FAILED"), (2, 2, 1, "PENDING")]
    steps = spark.createDataFrame(rows, "plan_id long, step_id long, depends_on long, status string")
    assert graph.step_levels(steps).agg(F.max("level")).first()[0] == 89
    assert graph.blocked_steps(steps).groupBy("plan_id").count().orderBy("plan_id").collect() == [(1, 89), (2, 2)]


def value(spark, sql):
    return spark.sql(f"SELECT {sql} AS v").first()["v"]


@pytest.mark.parametrize(
    ("rgb", "family"),
    [((255, 0, 0), "red"), ((0, 0, 255), "blue"), ((0, 255, 0), "green"), ((255, 255, 255), "white"), ((0, 0, 0), "black"), ((128, 128, 128), "grey"), ((255, 165, 0), "orange"), ((255, 255, 0), "yellow"), ((0, 255, 255), "cyan"), ((128, 0, 128), "purple")],
)
def test_colour_families(spark, rgb, family):
    h, s, v = E.hsl(*map(str, rgb))
    row = spark.sql(f"SELECT {E.colour_family('h', 's', 'l')} AS f FROM (SELECT {h} AS h, {s} AS s, {v} AS l)").first()
    assert row["f"] == family


def test_colour_spaces(spark):
    lab = spark.sql("SELECT " + ", ".join(E.cielab("255", "255", "255"))).first()
    assert abs(lab[0] - 100) < 1e-2 and abs(lab[1]) < 1e-2 and abs(lab[2]) < 2e-2
    ok = spark.sql("SELECT " + ", ".join(E.oklab("255", "255", "255"))).first()
    assert abs(ok[0] - 1) < 1e-3 and abs(ok[1]) < 1e-3


def test_scalars(spark):
    assert value(spark, E.rounded("-0.5", 0)) == 0 and value(spark, E.rounded("2.5", 0)) == 3
    assert abs(value(spark, E.effective_dpi("300", "25.4")) - 300) < 1e-9 and abs(value(spark, E.mm_to_px("25.4")) - 96) < 1e-9
    assert abs(value(spark, E.turn_degrees("1", "0", "0", "1")) - 90) < 1e-9 and value(spark, E.turn_degrees("0", "0", "1", "0")) == 0
    assert [value(spark, E.route(*a)) for a in (("80", "1"), ("79", "9.5"), ("79", "9.6"))] == ["REGION_GRAPH", "DIRECT", "UNCERTAIN"]
    assert [value(spark, E.complexity(n)) for n in ("150", "151", "801")] == ["simple", "moderate", "complex"]


def test_edges_ignore_transparent_pixels(spark):
    rows = [(0, 0, 0, 0, 220, 40, 50, 255), (0, 1, 1, 0, 20, 40, 250, 0), (0, 2, 2, 0, 20, 40, 250, 255)]
    px = spark.createDataFrame(rows, "image_id long, idx long, x long, y long, r long, g long, b long, a long")
    assert {r["strength"] for r in raster.edge_map(pixels=px).collect()} == {0.0}


def test_operator_names_its_inputs(spark):
    op = Operator("SELECT count(*) AS n FROM {left_side} JOIN {right_side} USING (id)")
    assert op.inputs == ["left_side", "right_side"]
    assert op(left_side=spark.range(3), right_side=spark.range(5)).first()["n"] == 3
    with pytest.raises(TypeError):
        op(left_side=spark.range(3))


def test_simplifiers_stay_within_tolerance():
    t = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    ring = np.stack([np.cos(t) * 50, np.sin(t) * 30], axis=1)
    keep = kernels.closed_rdp(ring, 0.5)
    assert 8 < keep.sum() < 80 and abs(kernels._area(ring[keep]) / kernels._area(ring) - 1) < 0.05
    assert kernels.visvalingam(ring, 5.0).sum() < 200
    line = np.stack([np.arange(50.0), np.zeros(50)], axis=1)
    assert kernels.rdp(line, 0.1).sum() == 2 and kernels.visvalingam(line, 0.1).sum() == 2


def test_circle_fit_and_resampling():
    a = np.linspace(0, 5, 30)
    cx, cy, r, rms = kernels.fit_circle(np.stack([3 + 7 * np.cos(a), -2 + 7 * np.sin(a)], axis=1))
    assert max(abs(cx - 3), abs(cy + 2), abs(r - 7), rms) < 1e-6
    assert math.isclose(len(kernels.resample(np.array([[0, 0], [4, 0], [4, 4], [0, 4.0]]), 16)), 16)


def test_tracing_finds_outlines_and_holes(spark):
    cells = grid(spark, "##### / #...# / #...# / #####")
    rows = sorted((r["is_hole"], r["area"], r["points"]) for r in planar.trace_rings(cells).collect())
    assert rows == [(False, 20.0, 18), (True, 6.0, 10)]


def _simplified(ring):
    """The rule of path_simplify, point by point."""
    far = lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5
    one = [p for k, p in enumerate(ring) if far(p, ring[k - 1]) >= 0.0001]
    kept = []
    for k, c in enumerate(one):
        p, q = one[k - 1], one[(k + 1) % len(one)]
        v, u = (q[0] - p[0], q[1] - p[1]), (c[0] - p[0], c[1] - p[1])
        size, dot = v[0] * v[0] + v[1] * v[1], u[0] * v[0] + u[1] * v[1]
        if not (size > 0 and 0 < dot < size and abs(u[0] * v[1] - u[1] * v[0]) / size**0.5 <= 0.005):
            kept.append(c)
    return kept if len(kept) >= 3 else ring


def test_paths_are_simplified_in_one_order(spark):
    import random

    from inkfold.operators import rings
    from inkfold.plans.views import view

    rng = random.Random(2)
    shapes = [[(float(rng.randrange(4)), float(rng.randrange(3))) for _ in range(rng.choice([1, 2, 3, 6, 15]))] for _ in range(60)] + [[(2.0, 2.0)] * 4, [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]]
    df = spark.createDataFrame([(k, pos, len(s), *p) for k, s in enumerate(shapes) for pos, p in enumerate(s)], "ring_id long, pos long, n long, x double, y double")
    got = {}
    for r in rings.path_simplify(rings=df).orderBy("ring_id", "pos").collect():
        got.setdefault(r["ring_id"], []).append((r["pos"], r["x"], r["y"]))
    assert got == {k: [(i, *p) for i, p in enumerate(_simplified(s))] for k, s in enumerate(shapes)}
    # A task holds one sort of the events and one of the points, whatever windows there are.
    plan = rings.path_simplify(rings=view(spark, "/root/testdata/sf0.001", "worn_rings"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2 and plan.count("Exchange hashpartitioning") == 1
