"""Pixel queries on plans and seams: no image is one task's, no pixel is multiplied before a shuffle."""

import duckdb
import numpy as np
import pytest

from inkfold.operators import fields, graph, masks, regions
from inkfold.plans import views
from inkfold.plans.oracles import ORACLES
from inkfold.sources import png


@pytest.fixture(scope="module")
def noisy(spark):
    """Two images of 20 by 200 with holes and, but for noise, labels in wide stripes; seams of bands lie at rows 64, 128 and 192."""
    df = spark.range(8000).selectExpr("id % 2 AS image_id", "floor(id / 2) % 20 AS x", "floor(id / 40) AS y", "CAST(pmod(xxhash64(id), 256) AS BIGINT) AS h")
    kept = df.where("h % 16 <> 0").selectExpr("*", "CASE WHEN h % 3 = 0 THEN h % 5 ELSE floor(y / 7) % 3 END AS label", "h AS r", "(h * 7) % 256 AS g", "(h * 13) % 256 AS b", "CASE WHEN h % 11 = 0 THEN 0 ELSE 255 END AS a")
    return kept.localCheckpoint()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def votes(cells):
    out = {}
    for (i, x, y), own in cells.items():
        near = [cells.get((i, x + dx, y + dy)) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
        best = max(set(near) - {None}, key=near.count, default=None)
        out[i, x, y] = best if best is not None and near.count(best) >= 5 else own
    return out


def test_pixels_are_numbered_in_parts(spark):
    """one window over all lines of an image sorted each image in one task."""
    text = plan(views.view(spark, "/root/testdata/sf0.001", "pixels"))
    ranked = [line for line in text.splitlines() if "row_number()" in line and "Window" in line]
    assert ranked and all("part#" in line.split("windowspecdefinition(")[1].split("ASC")[0] for line in ranked)


def test_superpixels_rank_no_rows(spark, noisy):
    """a row for each pixel and cell around it was ranked by a window."""
    assert "Window" not in plan(masks.slic_superpixels(pixels=noisy))


def test_majority_over_seams(noisy):
    """three rounds shuffled nine rows a pixel each; bands are dealt once, and agree with plain votes on both sides of their seams."""
    cells = {(r["image_id"], r["x"], r["y"]): r["label"] for r in noisy.collect()}
    for _ in range(3):
        cells = votes(cells)
    want = {}
    for (i, _, _), v in cells.items():
        want[i, v] = want.get((i, v), 0) + 1
    got = regions.icm_majority(labels_map=noisy)
    assert plan(got).count("Exchange hashpartitioning(image_id") <= 2
    assert {(r["image_id"], r["label"]): r["area"] for r in got.collect()} == want


def test_region_edges_without_pixel_joins(noisy):
    """both ends of every touching pair were looked up by joins of pixels; only the sums of regions are joined now."""
    got = regions.rag_edges(pixels=noisy, labels_map=noisy.where("a > 0"))
    cells = {(r["image_id"], r["x"], r["y"]): r["label"] for r in noisy.where("a > 0").collect()}
    want = {}
    for (i, x, y), v in cells.items():
        for other in (cells.get((i, x + 1, y)), cells.get((i, x, y + 1))):
            if other is not None and other != v:
                want[i, min(v, other), max(v, other)] = want.get((i, min(v, other), max(v, other)), 0) + 1
    assert {(r["image_id"], r["region_a"], r["region_b"]): r["shared_len"] for r in got.collect()} == want
    joins = [line for line in plan(got).splitlines() if "Join" in line]
    assert joins and not any(" x#" in line or "[x#" in line for line in joins)


def test_region_edges_stay_in_bands(spark):
    """pixels were shuffled for every window; they are dealt to bands once, and pixels beside a gap are no neighbours."""
    pixels = spark.range(3000).where("id % 23 <> 5 AND (id < 600 OR id > 640)").selectExpr("id % 2 AS image_id", "id % 14 AS x", "floor(id / 14) - 3 AS y", "(id * 31) % 60 * 4 AS r", "(id * 17) % 256 AS g", "id % 7 * 30 AS b", "CASE WHEN id % 9 = 0 THEN 0 ELSE 255 - id % 2 * 60 END AS a")
    labels_map = pixels.where("a > 0").selectExpr("*", "floor(r / 60) * 4 + floor(g / 64) AS label")
    got = regions.rag_edges(pixels=pixels, labels_map=labels_map)
    con = duckdb.connect()
    for name, df in (("p", pixels), ("m", labels_map)):
        con.register(name, df.toArrow())
    con.execute("CREATE TABLE pixels AS SELECT * FROM p; CREATE TABLE labels_map AS SELECT * FROM m")
    want = con.execute(ORACLES["rag_edges"])
    columns = [c[0] for c in want.description]
    rounded = lambda row: tuple(round(float(v), 6) for v in row)
    assert sorted(rounded(r[c] for c in columns) for r in got.collect()) == sorted(map(rounded, want.fetchall()))
    sent = [line for line in plan(got).splitlines() if "Exchange hashpartitioning(" in line]
    assert any("band#" in line for line in sent) and not any(" x#" in line or " y#" in line for line in sent)


def test_regions_are_merged_from_edges_made_once(noisy):
    """all that makes the edges ran again for every use of them."""
    merged = graph.merge_regions(regions.rag_edges(pixels=noisy, labels_map=noisy.where("a > 0")))
    assert merged.collect() and "Window" not in plan(merged)


def test_images_are_written_line_by_line(spark):
    """an image's pixels were one group of a task's Python; lines stream now, to the same bytes."""
    pixels = spark.range(30_000).where("id % 7 <> 3").selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 3 END AS image_id", "id % 90 AS x", "floor(id / 90) AS y", "(id * 31) % 256 AS r", "(id * 17) % 256 AS g", "id % 256 AS b", "255 - id % 2 AS a")
    images = png.write_images(pixels)
    assert "FlatMapGroupsInPandas" not in plan(images)
    seen = {}
    for r in pixels.collect():
        seen.setdefault(r["image_id"], []).append((r["y"], r["x"], r["r"], r["g"], r["b"], r["a"]))
    got = {r["image_id"]: r for r in images.collect()}
    assert got.keys() == seen.keys()
    for k, rows in seen.items():
        at = np.array(rows)
        want = np.zeros((at[:, 0].max() + 1, at[:, 1].max() + 1, 4), np.uint8)
        want[at[:, 0], at[:, 1]] = at[:, 2:]
        assert (got[k]["height"], got[k]["width"]) == want.shape[:2]
        assert got[k]["png"] == png.encode(want) and (png.decode(got[k]["png"]) == want).all()


def test_many_runs_are_not_sent_to_the_driver(noisy, monkeypatch):
    """tables small as files were broadcast whatever their rows; beyond a bound they meet by a shuffle, with equal results."""
    queries = (lambda: fields.bridged_components(noisy), lambda: fields.remove_islands(noisy))
    few = [sorted(map(tuple, q().collect())) for q in queries]
    monkeypatch.setattr(graph, "MOST_SENT", 10)
    for query, want in zip(queries, few, strict=True):
        df = query()
        assert "BroadcastHashJoin" not in plan(df)
        assert sorted(map(tuple, df.collect())) == want
