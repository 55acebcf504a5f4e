"""Equal outlines are computed once and told for all of them."""

import threading

import numpy as np
import pytest

from inkfold.operators import copies, curves, fitting, hierarchy, kernels, raster, rings, selection

RINGS = "ring_id long, pos long, n long, x double, y double"


def outline(k: int, n: int = 12) -> np.ndarray:
    t = 2 * np.pi * np.arange(n) / n
    return np.round(np.stack([20 + (5 + k) * np.cos(t), 20 + (5 + k) * np.sin(t)], axis=1), 3)


def repeated(spark, shapes: list[np.ndarray], times: int):
    """All shapes again and again, numbered on."""
    return spark.createDataFrame([(t * len(shapes) + k, pos, len(p), float(x), float(y)) for t in range(times) for k, p in enumerate(shapes) for pos, (x, y) in enumerate(p)], RINGS)


def test_classes_tell_rings_apart(spark):
    rows = [(0, 0, 1, 5.0, None), (1, 0, 1, None, 5.0), (2, 0, 1, 5.0, None), (3, 0, 2, 5.0, None), (3, 1, 2, 1.0, 1.0), (4, 0, 2, 1.0, 1.0), (4, 1, 2, 5.0, None)]
    assert {r["ring_id"]: r["first"] for r in copies.classes(spark.createDataFrame(rows, RINGS)).collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}


@pytest.mark.parametrize("measure", [curves.point_to_segment, curves.boundary_distance, rings.chamfer_hausdorff])
def test_equal_pairs_are_measured_once(spark, measure, monkeypatch):
    df = repeated(spark, [outline(0), outline(3), outline(3)], 20)
    seen = []
    plain = copies.next_rings
    watched = lambda r, f: plain(r, lambda first, ways: (seen.append(ways.count()), f(first, ways))[1])
    monkeypatch.setattr("inkfold.operators.curves.next_rings", watched)
    monkeypatch.setattr("inkfold.operators.rings.next_rings", watched)
    got = {r[0]: tuple(r)[-3:] for r in measure(rings=df).collect()}
    assert seen == [6] and sorted(got) == list(range(59))  # three pairs of shapes, both ways
    alone = {r[0]: tuple(r)[-3:] for r in measure(rings=df.where("ring_id < 4")).collect()}
    assert all(got[k] == alone[k % 3] for k in got) and alone[1] != alone[0]


def box(x: float, y: float, size: float) -> np.ndarray:
    return np.array([[x, y], [x + size, y], [x + size, y + size], [x, y + size]], float)


@pytest.mark.parametrize(("measure", "inner"), [(rings.point_in_ring, "inkfold.operators.rings._point_in_ring"), (curves.shared_edge_absorption, "inkfold.operators.curves._shared_edges")])
def test_pairs_of_equal_rings_are_compared_once(spark, measure, inner, monkeypatch):
    shapes = [box(0, 0, 40), box(10, 10, 10), box(0, 0, 10)]
    few, many = repeated(spark, shapes, 2), repeated(spark, shapes, 12)
    want = {}
    for a, b, n in measure(rings=few).collect():
        want.setdefault((a % 3, b % 3), set()).add(n)
    module, name = inner.rsplit(".", 1)
    plain, seen = getattr(__import__(module, fromlist=[name]), name), []
    monkeypatch.setattr(inner, lambda rings: (seen.append(rings.select("ring_id").distinct().count()), plain(rings=rings))[1])
    got = measure(rings=many).collect()
    assert seen == [3] and len({r[:2] for r in map(tuple, got)}) == len(got)
    ordered = measure is curves.shared_edge_absorption
    numbers = range(36)
    pairs = {(a, b) for a in numbers for b in numbers if (a < b if ordered else a != b) and ((a % 3, b % 3) in want or (ordered and (b % 3, a % 3) in want))}
    assert {(r[0], r[1]) for r in got} == pairs and all({r[2]} in (want.get((r[0] % 3, r[1] % 3)), want.get((r[1] % 3, r[0] % 3))) for r in got)


OUTLINES = "doc_id long, ring_id long, pos long, x double, y double"


def test_trees_of_copies(spark):
    times = 4000
    shapes = spark.createDataFrame([(k, pos, float(x), float(y)) for k, p in enumerate((box(0, 0, 90), box(20, 20, 40), box(30, 30, 10))) for pos, (x, y) in enumerate(p)], "k long, pos long, x double, y double")
    df = spark.range(times).crossJoin(shapes).selectExpr("CAST(1 AS BIGINT) AS doc_id", "3 * id + k AS ring_id", "pos", "x", "y")
    timer = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    timer.start()
    tree = hierarchy.ring_tree(df).selectExpr("ring_id % 3 AS kind", "parent", "depth", "role").groupBy("kind", "parent", "depth", "role").count().collect()
    told = hierarchy.topology_signature(df).first()
    timer.cancel()
    assert sorted(tuple(r) for r in tree) == [(0, None, 0, "OUTER", times), (1, 0, 1, "HOLE", times), (2, 1, 2, "ISLAND", times)]
    assert told["components"] == 3 * times and told["adjacent"] == 3 * times * (times - 1) // 2


def test_adjacent_copies_are_counted_as_pairs(spark):
    long = np.array([[0, 0], [30, 0], [30, 1], [0, 1]], float)
    spot = np.array([[0, 0], [0.5, 0], [0.5, 0.5], [0, 9]], float)  # three of its points are near one of the long ring's, which has one near it or two
    shapes = [long, spot, long + [40, 0], box(31, 0, 5)]
    order = np.random.default_rng(4).permutation(40)
    rows = [(1 + k % 2, int(n), pos, float(x), float(y)) for k, n in enumerate(order) for pos, (x, y) in enumerate(shapes[k % 4 if k % 2 else k // 2 % 4])]
    df = spark.createDataFrame(rows, OUTLINES)
    want = {r["doc_id"]: r["count"] for r in hierarchy.ring_adjacency(df).groupBy("doc_id").count().collect()}
    assert {r["doc_id"]: r["adjacent"] for r in hierarchy.topology_signature(df).collect()} == want


def test_frontier_fits_equal_rings_once(spark, monkeypatch):
    df = repeated(spark, [outline(0, 24), outline(4, 7)], 10)
    plain, seen = fitting.fit_trials, []
    monkeypatch.setattr(fitting, "fit_trials", lambda r: (seen.append(r.select("ring_id").distinct().count()), plain(r))[1])
    got = {}
    for r in fitting.fit_frontier(df).collect():
        got.setdefault(r["case_id"], set()).add(tuple(r)[1:])
    assert seen == [2] and sorted(got) == list(range(20)) and all(got[k] == got[k % 2] for k in got)
    want = selection.pareto_frontier(trials=plain(df.where("ring_id < 2"))).collect()
    assert {(r[0], *tuple(r)[1:]) for r in want} == {(k, *rest) for k in (0, 1) for rest in got[k]}


def test_fits_share_rounds_between_tolerances():
    rng = np.random.default_rng(2)
    ring = outline(6, 40) + rng.normal(0, 0.4, (40, 2))
    kept: dict = {}
    for tolerance in (0.25, 4.0, 1.0):
        mine, alone = fitting.fit_ring(ring, tolerance, kept=kept), fitting.fit_ring(ring, tolerance)
        assert [(a, b, c.tolist(), e, s) for a, b, c, e, s in mine] == [(a, b, c.tolist(), e, s) for a, b, c, e, s in alone]
    assert kept


def test_rings_are_dealt_to_all_tasks(spark):
    assert kernels.circle_fit(repeated(spark, [outline(0)], 8)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


BOXES = "doc_id long, node_id long, fill string, x0 double, y0 double, x1 double, y1 double"


def test_matching_of_copies(spark):
    copied = lambda start: spark.range(2000).selectExpr("CAST(1 AS BIGINT) AS doc_id", f"{start} + id AS node_id", "'r' AS fill", "0e0 AS x0", "0e0 AS y0", "10e0 AS x1", "10e0 AS y1")
    timer = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    timer.start()
    got = hierarchy.match_components(copied(0), copied(5000)).collect()
    timer.cancel()
    assert {(r["a_id"], r["b_id"], r["status"]) for r in got} == {(k, 5000 + k, "PRESERVED") for k in range(2000)}


def test_matching_takes_pairs_in_order_of_rank(spark):
    rng = np.random.default_rng(6)
    made = lambda start: [(int(rng.integers(1, 3)), start + int(k), "rg"[int(rng.integers(2))], x, y, x + w, y + 10) for k in rng.permutation(60) for x, y, w in [map(float, (10 * rng.integers(0, 3), 10 * rng.integers(0, 2), 10 * rng.integers(1, 3)))]]
    a, b = made(0), made(100)
    offers = []
    for p in a:
        for q in b:
            if p[0] == q[0] and p[2] == q[2]:
                shared = max(0, min(p[5], q[5]) - max(p[3], q[3])) * max(0, min(p[6], q[6]) - max(p[4], q[4]))
                iou = shared / ((p[5] - p[3]) * 10 + (q[5] - q[3]) * 10 - shared)
                offers.append((-round(iou, 9), round(float(np.hypot(p[3] + p[5] - q[3] - q[5], p[4] + p[6] - q[4] - q[6]) / 2), 9), p[1], q[1]))
    want, used = {}, set()
    for _, _, m, n in sorted(offers):
        if m not in want and n not in used:
            want[m] = n
            used.add(n)
    got = hierarchy.match_components(spark.createDataFrame(a, BOXES), spark.createDataFrame(b, BOXES)).where("b_id IS NOT NULL").collect()
    assert got and all(want[r["a_id"]] == r["b_id"] for r in got)


def test_underbase_of_copies(spark):
    nodes = spark.range(60_000).selectExpr("id % 2 AS doc_id", "id AS node_id", "'vector_path' AS type", "true AS visible", "CAST(NULL AS BIGINT) AS parent_id", "0e0 AS x_mm", "0e0 AS y_mm", "200e0 AS w_mm", "200e0 AS h_mm", "(id % 4) / 4 AS opacity")
    timer = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    timer.start()
    got = sorted(map(tuple, raster.white_underbase(nodes=nodes).collect()))
    timer.cancel()
    assert got == [(0, 40_000, 40_000 * 128, 128), (1, 40_000, 40_000 * 191, 191)]
