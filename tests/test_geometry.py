"""Free outlines, label maps and fits on literal rows, against rasters and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.operators import arrangement, chains, clustering, coupling, fields, fitting, hierarchy, kernels, planar, reassignment, selection
from inkfold.sources import svg
from tests.test_operators import grid

OUTLINES = "doc_id long, ring_id long, pos long, x double, y double"


def frame(spark, docs):
    return spark.createDataFrame([(d, k, i, float(x), float(y)) for d, rings in docs.items() for k, r in enumerate(rings) for i, (x, y) in enumerate(r)], OUTLINES)


def rings_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["doc_id"], r["ring_id"], r["pos"])):
        out.setdefault(r["doc_id"], {}).setdefault(r["ring_id"], []).append((r["x"], r["y"]))
    return {d: [np.array(v) for v in rings.values()] for d, rings in out.items()}


def winding(spots, rings):
    """One side of one ring at a time."""
    out = np.zeros(len(spots), int)
    for ring in rings:
        for (x, y), (nx, ny) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            if y != ny:
                hit = (min(y, ny) <= spots[:, 1]) & (spots[:, 1] < max(y, ny)) & (x + (nx - x) * ((spots[:, 1] - y) / (ny - y)) < spots[:, 0])
                out -= np.where(hit, int(np.sign(ny - y)), 0)
    return out


def gap(spots, rings):
    best = np.full(len(spots), np.inf)
    for ring in rings:
        for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            v = b - a
            t = np.clip(((spots - a) @ v) / max(v @ v, 1e-30), 0, 1)
            best = np.minimum(best, np.hypot(*(spots - a - t[:, None] * v).T))
    return best


def made():
    rng = np.random.default_rng(1)
    box = np.array([[0, 0], [10, 0], [10, 10], [0, 10.0]])
    turn = np.linspace(0, 2 * np.pi, 20, endpoint=False)
    docs = {d: [rng.uniform(0, 50, (7, 2)).round(3), rng.uniform(0, 50, (5, 2)).round(3), box + d, (box + 5)[::-1], np.stack([25 + 8 * np.cos(turn), 25 + 5 * np.sin(turn)], axis=1)] for d in range(3)}
    docs[3] = [box, box + [10, 10], box + [10, 0]]  # touching in a corner and along a side
    docs[4] = [box * 3, (box * 2 + 5)[::-1], box + 10]  # a hole with an island
    docs[5] = [np.array([[0, 0], [30, 0], [0, 0], [30, 0.0]])]  # no area
    docs[6] = [np.array([[0, 0], [20, 20], [20, 0], [0, 20.0]])]  # crosses itself
    docs[7] = [box, box]  # the same ring twice
    return docs


SPOTS = np.stack(np.meshgrid(np.arange(-6, 58, 0.517) + 0.0137, np.arange(-6, 58, 0.517) + 0.0291), axis=-1).reshape(-1, 2)


def test_union_equals_a_raster(spark):
    docs = made()
    found = arrangement.union(frame(spark, docs))
    got = rings_of(found)
    for d, rings in docs.items():
        inside = winding(SPOTS, got.get(d, []))
        assert ((winding(SPOTS, rings) != 0) == (inside == 1)).all() and set(inside.tolist()) <= {0, 1}
    assert [len(got.get(d, [])) for d in (3, 4, 5, 6, 7)] == [1, 3, 0, 2, 1] and len(got[7][0]) == 4
    cells = {}
    for r in arrangement.covered_cells(found, pitch_mm=1.5).collect():
        cells[r["doc_id"]] = cells.get(r["doc_id"], 0) + r["cells"]
    spots = np.stack(np.meshgrid(np.arange(-8, 60) * 1.5 + 0.3137, np.arange(-8, 60) * 1.5 + 0.3137), axis=-1).reshape(-1, 2)
    assert cells == {d: int(n) for d, rings in docs.items() if (n := (winding(spots, rings) != 0).sum())}


@pytest.mark.parametrize("join", ["round", "miter", "bevel"])
def test_offset_equals_a_raster(spark, join):
    docs = {d: r for d, r in made().items() if d in (0, 4, 6)}
    got = rings_of(arrangement.offset(frame(spark, docs), 2.0, join=join))
    for d, rings in docs.items():
        art, far, inside = winding(SPOTS, rings) != 0, gap(SPOTS, rings), winding(SPOTS, got[d])
        assert set(inside.tolist()) <= {0, 1}
        if join == "round":
            assert (inside[art | (far < 1.97)] == 1).all()
        assert (inside[art] == 1).all() and (inside[~art & (far > (4.01 if join == "miter" else 2.001))] == 0).all()


def test_cut_contours_drop_holes_and_specks(spark):
    box = np.array([[0, 0], [10, 0], [10, 10], [0, 10.0]])
    docs = {1: [box * 3, (box * 2 + 5)[::-1]], 2: [box * 0.01]}
    found = arrangement.cut_contours(frame(spark, docs), offset_mm=0.2)
    areas = sorted(tuple(r)[:1] + tuple(r)[2:3] for r in arrangement.ring_areas(found).collect())
    assert areas == [(1, False), (2, False)]  # a document keeps its only ring, however small
    with_holes = arrangement.ring_areas(arrangement.cut_contours(frame(spark, docs), offset_mm=0.2, inner=True)).where("is_hole").collect()
    assert len(with_holes) == 1 and abs(with_holes[0]["area_mm2"] - 19.6**2) < 0.01
    with pytest.raises(ValueError):
        arrangement.offset(frame(spark, docs), 0.0)
    assert arrangement.union(frame(spark, docs).limit(0)).count() == 0


def test_chains_and_rings_over_many_tiles(spark):
    rows = [(1, k, (k + 1) % 50, k // 7) for k in range(50)]  # a ring over eight tiles
    rows += [(1, 100 + k, 101 + k if k < 29 else None, k % 3) for k in range(30)]  # an open chain that jumps between tiles
    rows += [(1, 200, 200, 0), (2, 5, None, 0), (2, 9, 7, 1), (2, 7, 9, 1)]
    links = spark.createDataFrame([(g, e, n, t, 10 * e) for g, e, n, t in rows], "g long, e long, nxt long, t int, more long")
    got = {(r["g"], r["e"]): (r["ring"], r["pos"], r["n"], r["closed"]) for r in chains.follow(links, ["g"], ["t"], ("more",)).collect()}
    first = got[(1, 0)][1]
    assert all(got[(1, k)][1:] == ((first + k) % 50, 50, True) and got[(1, k)][0] == got[(1, 0)][0] for k in range(50))
    assert all(got[(1, 100 + k)] == (100, k, 30, False) for k in range(30))
    assert got[(1, 200)] == (200, 0, 1, True) and got[(2, 5)] == (5, 0, 1, False) and {got[(2, 7)][1], got[(2, 9)][1]} == {0, 1}
    assert chains.follow(links.limit(0), ["g"], ["t"]).count() == 0


def test_rings_of_label_maps(spark, monkeypatch):
    cells = grid(spark, "#####/#...#/#.#.#/#...#/#####", "a.a/.a./a.a")
    want = sorted([(0, False, 20, 25.0), (0, True, 12, 9.0), (0, False, 4, 1.0)] + [(1, False, 4, 1.0)] * 5)
    for tile in (256, 2):
        monkeypatch.setattr(planar, "_TILE", tile)
        assert sorted((r["image_id"], r["is_hole"], r["points"], r["area"]) for r in planar.trace_rings(cells).collect()) == want
    assert planar.trace_rings(cells.limit(0)).count() == 0


def test_neighbours_share_their_boundary_and_seams_go(spark):
    cells = grid(spark, "aabb/aabb/ccbb/ccbb")
    arcs = planar.shared_boundaries(cells).collect()
    lengths = {}
    for r in arcs:
        lengths[(r["label"], r["other"])] = lengths.get((r["label"], r["other"]), 0) + 1
    a, b, c = ord("a"), ord("b"), ord("c")
    assert lengths == {(a, b): 2, (a, c): 2, (b, c): 2, (a, None): 4, (b, None): 8, (c, None): 4}
    assert len({r["arc"] for r in arcs}) == 6 and not any(r["closed"] for r in arcs)
    owners = spark.createDataFrame([(0, a, 1), (0, c, 1)], "image_id long, label long, owner long")
    merged = planar.dissolve_seams(cells, owners).collect()
    assert {(r["label"], r["other"]) for r in merged} == {(1, b), (1, None), (b, None)} and len({r["arc"] for r in merged}) == 3
    whole = planar.dissolve_seams(cells, owners.union(spark.createDataFrame([(0, b, 1)], owners.schema))).collect()
    assert len(whole) == 16 and {r["closed"] for r in whole} == {True} and len({r["arc"] for r in whole}) == 1


def test_components_joined_over_gaps(spark):
    far = "a" + "." * 70 + "a" * 100 + "../" + "." * 171 + "a."
    cells = grid(spark, "aa..aa/....../......./aa.b.b", far)
    got = sorted((r["image_id"], chr(r["label"]), r["parts"], r["area"]) for r in fields.bridged_components(cells, gap=2.0).collect())
    assert got == [(0, "a", 3, 6), (0, "b", 2, 2), (1, "a", 1, 1), (1, "a", 2, 101)]
    assert sorted(r["parts"] for r in fields.bridged_components(cells, gap=1.0).where("image_id = 0").collect()) == [1, 1, 1, 2]
    assert sorted(r["parts"] for r in fields.bridged_components(cells, gap=70.0, cell=16).where("image_id = 1").collect()) == [3]


def test_islands_go_to_the_label_they_border_most(spark):
    cells = grid(spark, "aaaaaa/aabbaa/aaccaa/aaccaa/......", "aab/..b")
    got = {(r["image_id"], r["x"], r["y"]): (None if r["label"] is None else chr(r["label"]), r["island"]) for r in fields.remove_islands(cells, 4).collect()}
    assert got[(0, 2, 1)] == got[(0, 3, 1)] == ("a", True) and got[(0, 2, 2)] == ("c", False) and got[(0, 0, 4)] == (None, False)
    assert [got[(1, x, 0)][0] for x in range(3)] == ["b", "b", "a"] and len(got) == 36


def test_field_equals_a_breadth_first_walk(spark):
    rng = np.random.default_rng(6)
    size = 14
    label = np.where(np.arange(size)[None, :] < 5, 1, np.where(np.arange(size)[None, :] > 9, 2, 0)) * np.ones((size, 1), int)
    label[9:, :] = np.where(rng.random((5, size)) < 0.4, 3, label[9:, :])
    colour = {0: (128, 128, 128), 1: (250, 20, 20), 2: (20, 20, 250), 3: (60, 200, 60)}
    pixels = [(0, x, y, *colour[int(label[y, x])], int(label[y, x])) for y in range(size) for x in range(size) if (x, y) != (7, 3)]
    df = spark.createDataFrame(pixels, "image_id long, x long, y long, r long, g long, b long, label long")
    regions = spark.createDataFrame([(0, 1, 0.6, 0.2, 0.1, True), (0, 2, 0.4, 0.0, -0.3, True), (0, 0, 0.5, 0.0, 0.0, False), (0, 3, 0.7, -0.2, 0.1, False)], "image_id long, label long, ok_l double, ok_a double, ok_b double, structural boolean")
    edges = spark.createDataFrame([(0, 0, 1, 0.9), (0, 0, 2, 0.2)], "image_id long, region_a long, region_b long, avg_strength double")
    prototypes = spark.createDataFrame([(7, 0.6, 0.2, 0.1), (8, 0.4, 0.0, -0.3)], "proto_id long, ok_l double, ok_a double, ok_b double")
    got = {(r["x"], r["y"]): (r["component"], r["wave"], r["ambiguous"]) for r in fields.prototype_field(df, regions, edges, prototypes).collect()}

    def oklab(r, g, b):
        lin = [v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4 for v in (r, g, b)]
        lms = np.cbrt(np.array([[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188376, 0.6299787005]]) @ lin)
        return np.array([[0.2104542553, 0.793617785, -0.0040720468], [1.9779984951, -2.428592205, 0.4505937099], [0.0259040371, 0.7827717662, -0.808675766]]) @ lms

    at = {(x, y): (lab, oklab(r, g, b)) for _, x, y, r, g, b, lab in pixels}
    proto = {1: np.array([0.6, 0.2, 0.1]), 2: np.array([0.4, 0.0, -0.3])}
    beside = lambda x, y: [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
    edge = lambda x, y: not (0 <= x < size and 0 <= y < size)
    wave, owner, unsure = {}, {}, set()
    for p, (lab, _) in at.items():
        if lab in proto and all(edge(*q) or (q in at and at[q][0] == lab) for q in beside(*p)):
            wave[p], owner[p] = 0, lab
    step = 0
    while True:
        offers = {}
        for p in [p for p, w in wave.items() if w == step]:
            for q in beside(*p):
                if q in at and q not in wave:
                    strong = {at[p][0], at[q][0]} == {0, 1}
                    cost = step + 1 + 12 * float(np.sqrt(((at[q][1] - proto[owner[p]]) ** 2).sum())) + (1000 if strong else 0)
                    offers.setdefault(q, {}).setdefault(owner[p], []).append(cost)
        if not offers:
            break
        step += 1
        for q, by in offers.items():
            ranked = sorted((min(c), k) for k, c in by.items())
            wave[q], owner[q] = step, ranked[0][1]
            if len(ranked) > 1 and ranked[1][0] - ranked[0][0] <= 0.5:
                unsure.add(q)
    assert got == {p: (None if p in unsure else owner.get(p), wave.get(p), p in unsure) for p in at}


def test_rings_in_rings_and_what_a_redrawing_keeps(spark):
    box = np.array([[0, 0], [10, 0], [10, 10], [0, 10.0]])
    cross = np.array([[0, 12], [30, 12], [30, 18], [0, 18.0]])  # reaches out of the outer box
    docs = {1: [box * 4, box * 3 + 2, box * 2 + 4, box + 100], 2: [box * 2, cross, np.array([[1, 1], [4, 1], [2, 4.0]])]}
    got = {(r["doc_id"], r["ring_id"]): (r["parent"], r["depth"], r["role"]) for r in hierarchy.ring_tree(frame(spark, docs)).collect()}
    assert got == {(1, 0): (None, 0, "OUTER"), (1, 1): (0, 1, "HOLE"), (1, 2): (1, 2, "ISLAND"), (1, 3): (None, 0, "OUTER"), (2, 0): (None, 0, "OUTER"), (2, 1): (None, 0, "OUTER"), (2, 2): (0, 1, "HOLE")}
    redrawn = frame(spark, docs).where("NOT (doc_id = 1 AND ring_id = 1)")
    told = {r["doc_id"]: r for r in hierarchy.topology_invariants(frame(spark, docs), redrawn).collect()}
    assert told[2]["kept"] and told[2]["violations"] == "" and (told[1]["lost"], told[1]["added"], told[1]["kept"]) == (1, 0, False)
    assert told[1]["violations"] == "COMPONENT_COUNT,NESTING_DEPTH"


def test_colour_masks_do_not_depend_on_order(spark):
    rng = np.random.default_rng(8)
    shades = [(200, 30, 30), (204, 34, 28), (30, 30, 200), (250, 250, 250)]
    rows = [(k % 2, x, y, *(int(c + rng.integers(-2, 3)) if c < 250 else c for c in shades[(x // 6 + k) % 4]), 255 if (x, y) != (0, 0) else 0) for k in range(2) for x in range(24) for y in range(8)]
    schema = "image_id long, x long, y long, r long, g long, b long, a long"
    once = sorted(map(tuple, clustering.colour_masks(spark.createDataFrame(rows, schema)).collect()))
    again = sorted(map(tuple, clustering.colour_masks(spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], schema).repartition(7)).collect()))
    assert once == again and [r[1] for r in once] == [0, 1, 2, 0, 1, 2]
    assert [r[5] for r in once[:3]] == [95, 48, 48] and sum(r[6] for r in once[:3]) == pytest.approx(1, abs=1e-5)
    assert (once[0][2:5], once[0][7:]) == ((202, 32, 29), (0, 0, 11, 7))
    assert clustering.colour_masks(spark.createDataFrame(rows, schema).where("a = 0")).count() == 0


def test_near_relations_become_exact_and_others_stay(spark):
    circles = [(1, 1, 10.0, 10.0, 5.0, 30.0), (1, 2, 10.4, 9.8, 9.0, 10.0), (1, 3, 40.0, 10.0, 5.3, 10.0), (1, 4, 80.0, 80.0, 30.0, 1.0), (2, 1, 10.0, 10.0, 5.0, 1.0), (1, 9, None, 1.0, 5.0, 1.0)]
    circles += [(3, k, 0.9 * k, 0.0, 10.0 * k, 1.0) for k in range(8)]  # a chain: each near the next only
    lines = [(1, 11, 179.5, 1.0), (1, 12, 0.7, 3.0), (1, 13, 45.0, 1.0), (1, 14, 90.0, 1.0), (1, 15, 91.5, 1.0), (1, 16, None, 1.0)]
    rounds, straight = coupling.couple(spark.createDataFrame(circles, "doc_id long, shape_id long, cx double, cy double, radius double, weight double"), spark.createDataFrame(lines, "doc_id long, shape_id long, degrees double, weight double"))
    got = {(r["doc_id"], r["shape_id"]): r for r in rounds.collect()}
    assert got[(1, 1)]["cx"] == got[(1, 2)]["cx"] == pytest.approx(10.1) and got[(1, 1)]["cy"] == got[(1, 2)]["cy"] == pytest.approx(9.95)
    assert got[(1, 1)]["radius"] == got[(1, 3)]["radius"] == pytest.approx(5.075) and got[(1, 2)]["radius"] == 9.0
    assert got[(1, 1)]["concentric"] == 1 and got[(1, 3)]["concentric"] is None and got[(1, 3)]["equal_size"] == 1
    for key in ((1, 4), (2, 1), (1, 9), *((3, k) for k in range(8))):
        want = next(c for c in circles if c[:2] == key)
        assert tuple(got[key])[:6] == want and tuple(got[key])[6:] == (None, None)
    turn = {r["shape_id"]: (r["degrees"], r["parallel"]) for r in straight.collect()}
    assert turn[11][0] == turn[12][0] == pytest.approx(0.4, abs=1e-3) and turn[14][0] == turn[15][0] == pytest.approx(90.75, abs=1e-3)
    assert turn[13] == (45.0, None) and turn[16] == (None, None)


def test_shapes_are_made_once_and_crowds_need_no_rounds(spark, monkeypatch):
    """What makes the circles runs once, and of shapes that hang on one of them only links between different centres are followed."""
    seen, followed = spark.sparkContext.accumulator(0), []
    made = F.udf(lambda v: seen.add(1) or v, "double").asNondeterministic()
    circles = spark.range(300).selectExpr("1L AS doc_id", "(id * 7) % 300 AS shape_id", "0.4e0 * (id % 2) AS cx", "0e0 AS cy", "10 + id / 4 AS r", "1e0 AS weight").repartition(4)
    plain = coupling.components
    monkeypatch.setattr(coupling, "components", lambda edges, keys, a, b: (followed.append(edges.count()), plain(edges, keys, a, b))[1])
    lines = spark.createDataFrame([], "doc_id long, shape_id long, degrees double, weight double")
    rounds, _ = coupling.couple(circles.select("doc_id", "shape_id", "cx", "cy", made("r").alias("radius"), "weight"), lines)
    got = rounds.collect()
    assert len(got) == 300 and {(round(r["cx"], 9), r["cy"], r["concentric"], r["equal_size"]) for r in got} == {(0.2, 0.0, 0, None)}
    assert seen.value == 300 and followed[0] == 1 and sum(followed) <= 2


def test_fragments_change_colour_but_not_the_covered_area(spark):
    box = np.array([[0, 0], [30, 0], [30, 30], [0, 30.0]])
    speck = np.array([[0, 0], [3, 0], [3, 3], [0, 3.0]])
    docs = {
        1: [box, speck + [30, 0], speck + [60, 60]],  # a speck at a corner of the red box, another far from all
        2: [box, speck + [30, 0]],  # white to red: nine units more are covered
        3: [box, speck[:, ::-1] * [0.5, 1] + [30, 0]],  # white to red, but small enough
        4: [box, box + [31, 0], speck + [29.5, 0]],  # red or white: red, as a colour goes before white
    }
    fills = {1: ["#c81e1e", "#1e50dc", "#1e50dc"], 2: ["#c81e1e", "#ffffff"], 3: ["#c81e1e", "#fefefe"], 4: ["#c81e1e", "#ffffff", "#1e50dc"]}
    rows = [(d, k, f, 200, 30, 30) for d, some in fills.items() for k, f in enumerate(some)]
    got = reassignment.reassign_fragments(frame(spark, docs), spark.createDataFrame(rows, "doc_id long, ring_id long, fill string, r long, g long, b long"))
    told = {(r["doc_id"], r["ring_id"]): (r["owner"], r["action"]) for r in got.collect()}
    assert told == {(1, 1): ("#c81e1e", "REASSIGNED"), (1, 2): ("#1e50dc", "PRESERVED"), (2, 1): ("#ffffff", "ROLLED_BACK"), (3, 1): ("#c81e1e", "REASSIGNED"), (4, 2): ("#c81e1e", "REASSIGNED")}


def test_matching_uses_no_target_twice(spark):
    boxes = "doc_id long, node_id long, fill string, x0 double, y0 double, x1 double, y1 double"
    a = [(1, 1, "r", 0, 0, 10, 10), (1, 2, "r", 1, 0, 11, 10), (1, 3, "r", 500, 0, 510, 10), (1, 4, "b", 0, 0, 10, 10), (1, 5, "g", 0, 0, 10, 10), (1, 6, "y", 0, 0, 10, 10)]
    b = [(1, 11, "r", 1, 0, 11, 10), (1, 12, "r", 3, 0, 13, 10), (1, 14, "r", 0, 0, 10, 10), (1, 15, "g", -5, -5, 15, 15), (1, 16, "y", 0, 0, 3, 3)]
    f = lambda rows: spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], boxes)
    got = {r["a_id"]: (r["b_id"], r["status"]) for r in hierarchy.match_components(f(a), f(b)).collect()}
    assert got == {1: (14, "PRESERVED"), 2: (11, "PRESERVED"), 3: (None, "LOST"), 4: (None, "LOST"), 5: (15, "MERGED"), 6: (None, "LOST")}
    again = {r["a_id"]: (r["b_id"], r["status"]) for r in hierarchy.match_components(f(a[::-1]), f(b[::-1]).repartition(3)).collect()}
    assert again == got and hierarchy.match_components(f(a), f(b).limit(0)).where("status <> 'LOST'").count() == 0


def test_ellipses_are_recovered(spark):
    rng = np.random.default_rng(0)
    rows, truth = [], {}
    for k in range(30):
        cx, cy, a, th = rng.uniform(-500, 500), rng.uniform(-500, 500), rng.uniform(5, 50), rng.uniform(0, np.pi)
        b = a * rng.uniform(0.2, 0.95)
        t = np.linspace(0, 2 * np.pi if k % 2 else 2.0, int(rng.integers(6, 60)), endpoint=False)  # whole ones and arcs
        x, y = cx + a * np.cos(t) * np.cos(th) - b * np.sin(t) * np.sin(th), cy + a * np.cos(t) * np.sin(th) + b * np.sin(t) * np.cos(th)
        truth[k] = cx, cy, a, b, math.degrees(th)
        rows += [(k, i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, y, strict=True))]
    rows += [(100, i, float(i), 2.0 * i) for i in range(9)] + [(101, i, float(i), 1.0 + i * i) for i in range(3)] + [(102, 0, 5.0, None)] + [(103, i, 4.0, 4.0) for i in range(8)]
    got = {r["ring_id"]: tuple(r)[2:] for r in fitting.ellipse_fit(spark.createDataFrame(rows, "ring_id long, pos long, x double, y double")).collect()}
    for k, want in truth.items():
        assert np.allclose(got[k][:4], want[:4], atol=1e-6) and abs((got[k][4] - want[4] + 90) % 180 - 90) < 1e-4
    assert all(got[k] == (None,) * 5 for k in (100, 101, 103)) and 102 not in got


def test_curves_keep_corners_and_join_smoothly():
    t = np.linspace(0, 2 * np.pi, 80, endpoint=False)
    circle = np.stack([50 + 30 * np.cos(t), 20 + 30 * np.sin(t)], axis=1)
    curves = fitting.fit_ring(circle, 0.05)
    assert len(curves) <= 6 and all(e <= 0.05 and s for *_, e, s in curves)
    for (_, _, p, _, _), (_, _, q, _, _) in zip(curves, curves[1:] + curves[:1], strict=True):
        out, into = p[3] - p[2], q[1] - q[0]
        assert abs(out[0] * into[1] - out[1] * into[0]) <= 1e-9 * np.hypot(*out) * np.hypot(*into) and (out * into).sum() > 0
    far = np.concatenate([fitting.bezier(c, np.linspace(0, 1, 50)) for _, _, c, _, _ in curves]) - [50, 20]
    assert np.abs(np.hypot(*far.T) - 30).max() < 0.1
    side = np.linspace(0, 10, 11)[:-1]
    square = np.concatenate([np.stack([side, 0 * side], 1), np.stack([10 + 0 * side, side], 1), np.stack([10 - side, 10 + 0 * side], 1), np.stack([0 * side, 10 - side], 1)])
    assert [(a, b, s) for a, b, _, _, s in fitting.fit_ring(square, 0.05)] == [(0, 10, False), (10, 20, False), (20, 30, False), (30, 0, False)]
    planted = fitting.bezier(np.array([[0, 0], [10, 30], [40, 30], [50, 0.0]]), np.linspace(0, 1, 60))
    drop = np.stack([np.linspace(50, 0, 20)[1:-1], np.zeros(18)], axis=1)
    curves = fitting.fit_ring(np.concatenate([planted, drop]), 0.05)
    assert len(curves) == 2 and np.allclose(curves[0][2], [[0, 0], [10, 30], [40, 30], [50, 0]], atol=0.5)
    assert fitting.fit_ring(np.array([[1.0, 1.0]] * 4), 0.1) == []


def test_models_of_intervals_and_trials(spark):
    t = np.linspace(0, np.pi, 30)
    half = np.concatenate([np.stack([20 * np.cos(t), 20 * np.sin(t)], axis=1), np.stack([np.linspace(-20, 20, 15)[1:-1], np.zeros(13)], axis=1)])  # a half circle and its chord
    s = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    oval = np.stack([30 * np.cos(s), 12 * np.sin(s)], axis=1)
    rings = spark.createDataFrame([(k, i, float(x), float(y)) for k, r in ((1, half), (2, oval), (3, half[:1])) for i, (x, y) in enumerate(r)], "ring_id long, pos long, x double, y double")
    best = {(r["ring_id"], r["interval_id"]): (r["model"], r["max_error"]) for r in selection.best_model(model_errors=fitting.interval_models(rings)).collect()}
    assert sorted(m for (k, _), (m, _) in best.items() if k == 1) == ["ARC", "LINE"] and {m for (k, _), (m, _) in best.items() if k == 2} == {"ELLIPSE"} and all(e < 1e-6 for _, e in best.values())
    trials = fitting.fit_trials(rings)
    front = selection.pareto_frontier(trials=trials).collect()
    every = [r for r in trials.collect() if r["case_id"] == 1]
    beats = lambda a, b: a["error"] <= b["error"] and a["nodes"] <= b["nodes"] and a["editability"] >= b["editability"] and (a["error"], a["nodes"], a["editability"]) != (b["error"], b["nodes"], b["editability"])
    assert len(every) == 18 and sorted(r["trial"] for r in front if r["case_id"] == 1) == sorted(b["trial"] for b in every if not any(beats(a, b) for a in every))


def test_simplification_under_gates(spark):
    t = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    round_ring = np.stack([40 * np.cos(t), 40 * np.sin(t)], axis=1)
    keep, used, outcome = kernels.checked_simplify(round_ring, 8.0)
    assert outcome == "SIMPLIFIED" and used < 8.0 and abs(abs(kernels._area(round_ring[keep])) / abs(kernels._area(round_ring)) - 1) <= 0.05
    assert kernels.checked_simplify(np.array([[0, 0], [4, 4], [4, 0], [0, 3.0]]), 1.0)[2] == "CROSSING"
    assert kernels.checked_simplify(np.array([[0, 0], [1, 0], [0, 1.0]]), 1.0)[2] == "UNCHANGED"
    rows = [(1, i, *map(float, p)) for i, p in enumerate(round_ring)] + [(2, 0, 0.0, 0.0)]
    got = {r["ring_id"]: r for r in kernels.validated_simplify(spark.createDataFrame(rows, "ring_id long, pos long, x double, y double")).collect()}
    assert got[1]["outcome"] == "SIMPLIFIED" and got[2]["outcome"] == "UNCHANGED" and got[2]["kept"] == 1


def test_rings_stream_through_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, i, float(i), float(k)) for k in range(20) for i in range(k + 1)]
        found = kernels.per_ring(spark.createDataFrame(rows, "ring_id long, pos long, x double, y double"), lambda ring, p: [(ring, len(p), float(p[:, 0].sum()))], "ring_id long, n long, s double")
        assert sorted(tuple(r) for r in found.collect()) == [(k, k + 1, k * (k + 1) / 2) for k in range(20)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_commands_are_read_whole(spark):
    many = " ".join(["7"] * 800_000)
    df = spark.createDataFrame([(1, f'<path d="M0 0L{many}"/>')], "svg_id long, svg string")
    assert svg.path_commands(svg.read_paths(df)).where("cmd = 'L'").selectExpr("size(args)").first()[0] == 800_000


def test_union_of_a_pile(spark):
    """Most sides of 200 squares of one pile lie inside of it, where they are not cut: 200 squares cross 30,000 times or more, which makes 60,000 pieces."""
    rng = np.random.default_rng(5)
    box = np.array([[0, 0], [20, 0], [20, 20], [0, 20.0]])
    rings = [box + rng.uniform(0, 10, 2).round(4) + rng.uniform(0, 0.5, (4, 2)).round(4) for _ in range(200)]
    docs = frame(spark, {0: rings, 1: [r[::-1] for r in rings] + [box + [60, 0]]})
    assert arrangement.arrange(arrangement.segments(docs.where("doc_id = 0")))[0].count() < 30_000
    for d, found in rings_of(arrangement.union(docs)).items():
        spots = np.stack(np.meshgrid(np.arange(-2, 84, 0.371) + 0.0137, np.arange(-2, 34, 0.371) + 0.0291), axis=-1).reshape(-1, 2)
        assert ((winding(spots, found) != 0) == (winding(spots, rings + [box + [60, 0]] * d) != 0)).all()


def test_relations_span_the_same_groups(spark):
    """A crowd of equal circles gives links in proportion to it, and scattered ones the groups of all their pairs."""
    rng = np.random.default_rng(8)
    some = [(0, i, *(float(v) for v in rng.uniform(0, 12, 2)), float(r), 1.0) for i, r in enumerate(rng.uniform(0, 60, 80))]
    crowd = [(1, 1000 + i, 3.0, 4.0, 5.0, 1.0) for i in range(2000)]
    circles = spark.createDataFrame(some + crowd, "doc_id long, shape_id long, cx double, cy double, radius double, weight double")
    turns = [(0, i, float(t), 1.0) for i, t in enumerate(rng.uniform(0, 180, 60))]
    lines = spark.createDataFrame(turns, "doc_id long, shape_id long, degrees double, weight double")

    def groups(edges):
        root = {}
        find = lambda v: v if root.setdefault(v, v) == v else find(root[v])
        for kind, a, b in edges:
            root[find((kind, a))] = find((kind, b))
        found = {}
        for v in list(root):
            found.setdefault(find(v), set()).add(v)
        return {frozenset(g) for g in found.values() if len(g) > 1}

    links = [tuple(r) for r in coupling.spanning_relations(circles, lines).select("kind", "a", "b", "doc_id").collect()]
    assert sum(r[3] == 1 for r in links) < 3 * len(crowd)
    pairs = coupling.relations(circles.where("doc_id = 0"), lines).select("kind", "a", "b").collect()
    assert groups(r[:3] for r in links if r[3] == 0) == groups(tuple(r) for r in pairs)


def _field_of(spark, label):
    """The field over a map of labels 0 to 3, 1 and 2 seeds of two prototypes, 0 beside 1 strongly."""
    colour = {0: (128, 128, 128), 1: (250, 20, 20), 2: (20, 20, 250), 3: (60, 200, 60)}
    pixels = [(0, x, y, *colour[int(v)], int(v)) for (y, x), v in np.ndenumerate(label) if v >= 0]
    df = spark.createDataFrame(pixels, "image_id long, x long, y long, r long, g long, b long, label long")
    regions = spark.createDataFrame([(0, 1, 0.6, 0.2, 0.1, True), (0, 2, 0.4, 0.0, -0.3, True), (0, 0, 0.5, 0.0, 0.0, False), (0, 3, 0.7, -0.2, 0.1, False)], "image_id long, label long, ok_l double, ok_a double, ok_b double, structural boolean")
    edges = spark.createDataFrame([(0, 0, 1, 0.9), (0, 0, 2, 0.2)], "image_id long, region_a long, region_b long, avg_strength double")
    prototypes = spark.createDataFrame([(7, 0.6, 0.2, 0.1), (8, 0.4, 0.0, -0.3)], "proto_id long, ok_l double, ok_a double, ok_b double")
    return sorted(map(str, fields.prototype_field(df, regions, edges, prototypes).collect()))


@pytest.mark.parametrize("inside", [True, False])
def test_field_of_many_tiles_is_that_of_one(spark, inside, monkeypatch):
    rng = np.random.default_rng(5)
    label = np.where(rng.random((11, 17)) < 0.2, 3, 0)
    label[rng.random(label.shape) < 0.1] = -1  # no pixel there
    label[2:5, 3:6], label[6:10, 12:16] = 1, 2
    if not inside:  # components of no pixel with four neighbours: their first one seeds
        label[2:10, 3:16:2] = 0
    whole = _field_of(spark, label)
    monkeypatch.setattr(fields, "_TILE", 6)
    assert _field_of(spark, label) == whole and len({r.split("wave=")[1] for r in whole}) > 8


def test_field_writes_no_table_a_wave(spark, monkeypatch):
    label = np.zeros((2, 40), int)
    label[:, :3] = 1
    written, plain = [], fields.cut
    monkeypatch.setattr(fields, "cut", lambda df: (written.append(df), plain(df))[1])
    assert any("wave=37" in r for r in _field_of(spark, label)) and len(written) < 10
