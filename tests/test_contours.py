import math

from inkfold.operators import contours, kernels
from inkfold.sources import svg


def test_flattening(spark):
    df = spark.createDataFrame([(1, '<path d="m 10 10 h 20 v 20 h -20 z M 0 0 C 0 10 10 10 10 0 S 20 -10 20 0"/><path d="M0 0Q10 20 20 0T40 0"/>')], "svg_id long, svg string")
    rows = {(r["path_no"], r["subpath"]): r for r in contours.flatten_paths(svg.path_commands(svg.read_paths(df))).collect()}
    assert rows[(0, 0)]["points"] == 5 and rows[(0, 0)]["area"] == 400.0 and rows[(0, 0)]["length"] == 80.0
    assert abs(rows[(0, 1)]["length"] - 2 * 20.0) < 0.5 and rows[(0, 1)]["points"] > 10
    s = contours.flatten([("M", [0, 0]), ("Q", [10, 20, 20, 0]), ("T", [40, 0])], 0.01)[0]
    assert abs(s[:, 1].max() - 10) < 0.05 and abs(s[:, 1].min() + 10) < 0.05


def test_arcs_are_drawn():
    half = contours.flatten([("M", [0, 0]), ("A", [5, 5, 0, 0, 1, 10, 0])], 0.01)[0]
    assert max(abs(math.hypot(x - 5, y) - 5) for x, y in half) < 1e-9 and half[:, 1].min() < -4.98 and tuple(half[-1]) == (10.0, 0.0)
    other = contours.flatten([("M", [0, 0]), ("A", [5, 5, 0, 0, 0, 10, 0])], 0.01)[0]
    assert other[:, 1].max() > 4.98
    large = contours.flatten([("m", [1, 1]), ("a", [10, 10, 0, 1, 1, 10, 0])], 0.01)[0]
    assert large[:, 1].min() < 1 - 17 and len(large) > 40
    turned = contours.flatten([("M", [0, 0]), ("A", [20, 5, 90, 0, 1, 10, 0])], 0.01)[0]
    assert abs(turned[:, 1].min() + 20) < 0.05
    assert len(contours.flatten([("M", [0, 0]), ("A", [0, 5, 0, 0, 1, 10, 0])], 0.01)[0]) == 2  # no radius: a line
    small = contours.flatten([("M", [0, 0]), ("A", [1, 1, 0, 0, 1, 10, 0])], 0.01)[0]  # too small a radius grows
    assert abs(small[:, 1].min() + 5) < 0.05


def test_paths_on_the_artboard(spark):
    files = spark.createDataFrame([(1, '<path d="M10 10 h20 v20 h-20 z M0 0 L1 1"/><path d="M20 20 A10 10 0 0 1 40 20 A10 10 0 0 1 20 20 Z"/>'), (2, '<path d="M0 0L1 0L1 1"/>'), (3, '<path d="M0 0L1 0L1 1"/>')], "svg_id long, svg string")
    placed = spark.createDataFrame([(1, 5.0, 7.0, 100.0, 50.0, 10.0, 10.0, 50.0, 50.0), (3, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0)], "svg_id long, x_mm double, y_mm double, w_mm double, h_mm double, vb_x double, vb_y double, vb_w double, vb_h double")
    got = {}
    for r in sorted(contours.artboard_outlines(svg.path_commands(svg.read_paths(files)), placed).collect()):
        got.setdefault((r["svg_id"], r["path_no"], r["subpath"]), []).append((r["x"], r["y"]))
    assert set(got) == {(1, 0, 0), (1, 1, 0)}  # a line is no polygon; files without a placement or a view box have none
    assert got[(1, 0, 0)] == [(5.0, 7.0), (45.0, 7.0), (45.0, 27.0), (5.0, 27.0)]
    round_one = got[(1, 1, 0)]
    assert all(abs(((x - 45) / 20) ** 2 + ((y - 17) / 10) ** 2 - 1) < 1e-9 for x, y in round_one) and len(round_one) > 20
    area = abs(contours._area(contours.np.array(round_one)))
    assert abs(area - math.pi * 200) < 2


def test_palette_reaches_colours_below_thousands_of_shades(spark):
    shades = [(r, g, b, 100) for r in range(17) for g in range(17) for b in range(17)]
    far = [(255, 0, 0, 3), (0, 255, 0, 2), (0, 0, 255, 1)]
    got = kernels.diverse_palette(spark.createDataFrame(shades + far, "r int, g int, b int, n long")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(k, *c) for k, c in enumerate([shades[0], *far])]


def test_paths_stream_and_are_dealt_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(contours, "_MOST", 3)  # rows are passed on in many batches
    files = spark.range(300).selectExpr("id AS svg_id", "'<path d=\"M0 0H4V3L0 3Z M1 1Q2 5 3 1Z\"/>' AS svg")
    placed = files.selectExpr("svg_id", "0e0 AS x_mm", "0e0 AS y_mm", "2e0 AS w_mm", "2e0 AS h_mm", "0e0 AS vb_x", "0e0 AS vb_y", "1e0 AS vb_w", "1e0 AS vb_h")
    made = contours.artboard_outlines(svg.path_commands(svg.read_paths(files)), placed)
    assert made.rdd.getNumPartitions() == 4  # a small table is not put into one task
    found = {}
    for r in made.collect():
        found.setdefault((r["svg_id"], r["subpath"]), []).append((r["pos"], r["x"], r["y"]))
    assert len(found) == 600 and all(sorted(found[(k, s)]) == sorted(found[(0, s)]) for k in range(300) for s in (0, 1))
    assert [p[1:] for p in sorted(found[(7, 0)])] == [(0.0, 0.0), (8.0, 0.0), (8.0, 6.0), (0.0, 6.0)] and len(found[(7, 1)]) > 5
    flat = contours.flatten_paths(svg.path_commands(svg.read_paths(files)))
    assert flat.rdd.getNumPartitions() == 4 and {tuple(r)[2:4] for r in flat.where("subpath = 0").collect()} == {(0, 5)}
