"""Contour integrity, separations, transfer-print rules and issue codes on literal documents."""

import pytest

from inkfold.operators import documents, prepress

POINTS = "doc_id long, node_id long, contour long, closed boolean, pos long, n long, x double, y double"
NODES = (
    "doc_id long, node_id long, type string, name string, visible boolean, x_mm double, y_mm double, w_mm double, h_mm double, natural_w long, parent_id long, source_node_id long, fill string, stroke string, "
    "stroke_mm double, opacity double, guide_role string, z_index long, orientation string, guide_mm double"
)
DOCS = "doc_id long, width_mm double, height_mm double, bleed_enabled boolean, bleed_mm double, safety_enabled boolean, safety_mm double, profile_id string, white_policy string, clear_policy string"


def outline(node, points, closed=None, contour=0):
    return [(1, node, contour, closed, k, len(points), float(x), float(y)) for k, (x, y) in enumerate(points)]


SQUARE = [(0, 0), (20, 0), (20, 20), (0, 20)]
CASES = {
    1: (outline(1, SQUARE, True), dict(valid=True, area_mm2=400.0, crossings=0, overlapping=0)),
    2: (outline(2, [(0, 0), (20, 20), (20, 0), (0, 20)], True), dict(valid=False, crossings=1, overlapping=0)),
    3: (outline(3, [(0, 0), (10, 0), (4, 0), (4, 8)], True), dict(valid=False, overlapping=1, crossings=1)),
    4: (outline(4, [*SQUARE, (0, 0.6)], False), dict(valid=False, open_contour=True, crossings=0)),
    5: (outline(5, [*SQUARE, (0, 0.6)], None), dict(valid=False, open_contour=True)),
    6: (outline(6, [(0, 0), (30, 0)], True), dict(valid=False, degenerate=True, vertices=2)),
    7: (outline(7, SQUARE, True) + outline(7, [(5, 5), (5, 15), (15, 15), (15, 5)], True, 1), dict(valid=True, vertices=8, area_mm2=500.0)),
    8: (outline(8, SQUARE, True) + outline(8, [(10, 10), (30, 10), (30, 15), (10, 15)], True, 1), dict(valid=False, crossings=2)),
    9: (outline(9, [(0, 0), (0.05, 0), (0.05, 0.05)], True), dict(valid=False, degenerate=True)),
}


@pytest.fixture(scope="module")
def checks(spark):
    return prepress.cut_integrity(cut_rings=spark.createDataFrame([r for rows, _ in CASES.values() for r in rows], POINTS))


def test_contour_integrity(checks):
    got = {r["node_id"]: r for r in checks.collect()}
    for node, (_, want) in CASES.items():
        assert {k: got[node][k] for k in want} == want, node


def node(i, kind, **more):
    base = dict.fromkeys((c.split()[0] for c in NODES.split(", ")), None)
    base |= dict(doc_id=1, node_id=i, type=kind, name=f"n{i}", visible=True, x_mm=10.0, y_mm=10.0, w_mm=50.0, h_mm=40.0, natural_w=1000, opacity=1.0, z_index=i)
    return tuple((base | more).values())


def doc(**more):
    base = dict(doc_id=1, width_mm=100.0, height_mm=80.0, bleed_enabled=False, bleed_mm=0.0, safety_enabled=False, safety_mm=0.0, profile_id="generic", white_policy="OPTIONAL", clear_policy="OPTIONAL")
    return tuple((base | more).values())


def test_rules_of_cut_outlines_and_guides(spark, checks):
    nodes = [node(k, "cut_contour", source_node_id=90) for k in CASES] + [node(90, "group")]
    nodes += [node(60, "technical_guide", orientation="vertical", guide_mm=90.0), node(61, "technical_guide", orientation="horizontal", guide_mm=90.0), node(62, "technical_guide", orientation="vertical")]
    got = documents.validation_issues(nodes=spark.createDataFrame(nodes, NODES), docs=spark.createDataFrame([doc()], DOCS), cut_checks=checks).collect()
    by = lambda rule: sorted(r["node_id"] for r in got if r["rule_id"].startswith(rule))
    assert by("V011") == [1, 7] and by("V014") == [2, 3, 8] and by("V015") == [3, 6] and by("V016_CUT_CONTOUR_OPEN") == [4, 5] and by("V010") == [2, 6, 9]
    assert by("V012") == [61, 62]  # 90 mm is inside the width, outside the height; no position is outside too


def test_transfer_print_rules(spark):
    docs = [doc(profile_id="dtf-uv", white_policy="REQUIRED"), doc(doc_id=2, profile_id="dtf-uv"), doc(doc_id=3, profile_id="generic", white_policy="REQUIRED")]
    nodes = [node(10, "raster_image"), node(11, "raster_image"), node(20, "group", doc_id=2), node(30, "raster_image", doc_id=3)]
    pixels = [(0, k, k, 0, 0, 0, 0, a) for k, a in enumerate([0, 255, 255, 128])] + [(1, k, k, 0, 0, 0, 0, 255) for k in range(4)]
    state = 20 + 1000 * 3 + 1000 * 7 + 5000 * 11 + 4000 * 13
    separations = [(2, "WHITE", 100.0, 80.0, state), (2, "CLEAR", 50.0, 40.0, state + 1), (1, "CLEAR", 99.0, 80.0, 0)]
    got = prepress.dtf_uv_issues(
        nodes=spark.createDataFrame(nodes, NODES),
        docs=spark.createDataFrame(docs, DOCS),
        pixels=spark.createDataFrame(pixels, "image_id long, idx long, x long, y long, r long, g long, b long, a long"),
        separations=spark.createDataFrame(separations, "doc_id long, role string, width_mm double, height_mm double, source_state long"),
    ).collect()
    assert sorted((r["doc_id"], r["rule_id"], r["node_id"] or 0) for r in got) == [
        (1, "CLEAR_SEPARATION_INVALID", 0),
        (1, "DTF_UV_ALPHA_VALID", 10),
        (1, "DTF_UV_OPAQUE_ARTWORK", 11),
        (1, "DTF_UV_SEMI_TRANSPARENCY", 10),
        (1, "WHITE_REQUIRED_NOT_GENERATED", 0),
        (2, "CLEAR_SEPARATION_STALE", 0),
    ]


def test_issue_codes_and_their_order(spark):
    rows = outline(5, [*SQUARE, (0, 0.4)], False) + outline(6, [*SQUARE, (0, 0.9)], False)
    path = outline(20, [(0, 0), (10, 0), (10, 0), (20, 0), (20, 20)], False) + outline(21, [(0, 0), (20, 20), (20, 0), (0, 20)], True)
    nodes = [
        node(5, "cut_contour", source_node_id=90, x_mm=10.5), node(6, "cut_contour", source_node_id=90), node(90, "group"), node(20, "vector_path", fill="#ff0000", parent_id=90),
        node(21, "vector_path", fill="#ff0000", stroke="#000000", stroke_mm=0.1), node(22, "vector_path"), node(30, "raster_image", natural_w=100), node(31, "raster_image", natural_w=250, x_mm=80.0),
    ]
    frames = dict(nodes=spark.createDataFrame(nodes, NODES), docs=spark.createDataFrame([doc()], DOCS), cut_rings=spark.createDataFrame(rows, POINTS), path_points=spark.createDataFrame(path, POINTS))
    frames["cut_checks"] = prepress.cut_integrity(cut_rings=frames["cut_rings"])
    frames["path_checks"] = prepress.path_integrity(path_points=frames["path_points"])
    frames["path_parts"] = prepress.path_analysis(path_points=frames["path_points"])
    frames["issues"] = documents.validation_issues(nodes=frames["nodes"], docs=frames["docs"], cut_checks=frames["cut_checks"])
    got = sorted(prepress.prepress_issues(**frames).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(1, len(got) + 1))
    found = {(r["code"], r["node_id"]): r["fix_class"] for r in got}
    assert found[("CUT_CONTOUR_OPEN", 5)] == "AUTO_FIXABLE" and found[("CUT_CONTOUR_OPEN", 6)] == "REQUIRES_CONFIRMATION" and ("CUT_CONTOUR_MISALIGNED", 5) in found and ("CUT_CONTOUR_MISALIGNED", 6) not in found
    assert {("DUPLICATE_VECTOR_POINT", 20), ("ZERO_LENGTH_SEGMENT", 20), ("OPEN_VECTOR_PATH", 20), ("SELF_INTERSECTING_PATH", 21), ("STROKE_TOO_THIN", 21), ("INVISIBLE_VECTOR_OBJECT", 22)} <= set(found)
    assert {("CRITICAL_LOW_DPI", 30), ("LOW_DPI", 31), ("OUT_OF_BOUNDS", 31), ("RGB_RASTER", 30)} <= set(found)
    order = ["AUTO_FIXABLE", "REQUIRES_CONFIRMATION", "MANUAL", "INFORMATIONAL"]
    assert [order.index(r["fix_class"]) for r in got] == sorted(order.index(r["fix_class"]) for r in got)


def test_sides_meet_once_with_and_without_strips(spark, monkeypatch):
    """Tall zigzags with missing points: in one strip, in many, and as one side after another."""
    rows = [r for k in (1, 2) for r in outline(k, [((i * 37) % 101, (i * i * 29) % 97) for i in range(40 * k)], True)]
    rows[5] = (*rows[5][:7], None)
    frame = spark.createDataFrame(rows, POINTS)
    whole = sorted(map(str, prepress.cut_integrity(cut_rings=frame).collect()))
    monkeypatch.setattr(prepress, "_FEW_SIDES", 50)
    assert sorted(map(str, prepress.Operator(prepress._integrity("cut_rings"))(cut_rings=frame).collect())) == whole and "crossings=0" not in " ".join(whole)


def test_contour_checks_are_dealt_to_all_tasks(spark):
    frame = spark.createDataFrame(CASES[1][0] + CASES[2][0], POINTS)
    assert prepress.Operator("SELECT /*deal doc_id, node_id*/ * FROM {cut_rings}")(cut_rings=frame).rdd.getNumPartitions() == 4
    plan = prepress.cut_integrity(cut_rings=frame)._jdf.queryExecution().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2  # small tables are not put into one task, whatever pairs they make


def test_issue_list_holds_what_it_reads_more_than_once(spark, monkeypatch):
    from inkfold.operators import graph
    from inkfold.plans import registry

    written, plain = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (written.append(df.columns), plain(df))[1])
    rows = registry.queries()["prepress_issues"](spark, "/root/testdata/sf0.001").count()
    assert rows > 0 and len(written) == 3 and "crossings" in written[2]
