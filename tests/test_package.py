"""Archives that other readers open, cut lines, packages held back by their status; SVG counts, guards and verdicts."""

import io
import zipfile
import zlib

import pytest
from inkfold.operators import golden
from inkfold.sources import package
from pyspark.sql import functions as F


def test_zip_round_trip(spark):
    rows = [(1, "b é.txt", bytes(range(256)) * 50), (1, "a.txt", b"hello"), (1, "none", None), (2, "x", b""), (1, "a.txt", b"again")]
    got = {r["package_id"]: r for r in package.zip_archives(spark.createDataFrame(rows, "package_id long, name string, data binary")).collect()}
    for p in (1, 2):
        z = zipfile.ZipFile(io.BytesIO(bytes(got[p]["zip"])))
        assert z.testzip() is None and got[p]["files"] == len(z.infolist())
        want = sorted((n, d or b"") for k, n, d in rows if k == p)
        assert sorted((i.filename, z.open(i).read()) for i in z.infolist()) == want
        assert all(i.CRC == zlib.crc32(z.open(i).read()) for i in z.infolist())


def test_cut_lines_and_packages(spark):
    points = [(1, 8, 0, True, k, 3, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (10.5, 0.0), (10.0, 7.125)])] + [(1, 9, 0, False, k, 2, float(k), 1.0) for k in range(2)]
    cuts = spark.createDataFrame(points, "doc_id long, node_id long, contour long, closed boolean, pos long, n long, x double, y double")
    docs = spark.createDataFrame([(1, 100.0, 80.0), (2, 50.0, 50.0), (3, 1.0, 1.0)], "doc_id long, width_mm double, height_mm double")
    lines = package.cut_lines(cuts, docs)
    svg = lines.collect()
    assert [r["doc_id"] for r in svg] == [1] and 'viewBox="0 0 100 80"' in svg[0]["svg"]
    assert 'd="M 0 0 L 10.5 0 L 10 7.125 Z"' in svg[0]["svg"] and 'd="M 0 1 L 1 1"' in svg[0]["svg"]
    status = spark.createDataFrame([(1, "ready"), (2, "blocked")], "doc_id long, status string")
    art = spark.createDataFrame([(1, b"png"), (2, b"png")], "doc_id long, png binary")
    manifests = spark.createDataFrame([(1, "{}"), (2, "{}"), (3, "{}")], "doc_id long, manifest string")
    got = {r["doc_id"]: r for r in package.production_packages(docs, status, art, lines, manifests).collect()}
    assert (got[2]["files"], got[2]["zip"], got[2]["status"]) == (0, None, "blocked") and got[3]["files"] == 1
    names = zipfile.ZipFile(io.BytesIO(bytes(got[1]["zip"]))).namelist()
    assert names == ["document-1-cut.svg", "document-1-manifest.json", "document-1-print.png"]


def test_numbers_beyond_a_field_are_refused(spark):
    one = spark.range(1)
    assert bytes(one.select(package._le(F.lit(65_535), 2)).first()[0]) == b"\xff\xff"
    with pytest.raises(Exception, match="beyond 2 bytes"):
        one.select(package._le(F.lit(65_536), 2)).collect()


def test_svg_counts_guard_and_verdicts(spark):
    ok = '<svg><path d="M0 0L5 0L5 5Z M1 1L2 1L2 2Z" fill="#f00"/><PATH fill="none" d=\'m1,1c2-2 3,3 4.5,4z\'/></svg>'
    rows = [(1, ok), (2, ""), (3, "<svg><path d='M0 0L1 1'/><a onclick = 'x'/></svg>"), (4, "<svg/>"), (5, "<svg><path d=''/></svg>"), (6, ok.replace("#f00", "#0f0")), (7, "<svg><path d='M0 0L1 1Z'/></svg>")]
    svgs = spark.createDataFrame([(k, s, "DIRECT") for k, s in rows], "case_id long, svg string, backend string")
    got = {r["case_id"]: r for r in golden.command_counts(svgs=svgs).collect()}
    assert {c: got[1][c] for c in ("paths", "subpaths", "anchors", "holes", "compound", "curves")} == dict(paths=2, subpaths=3, anchors=11, holes=1, compound=1, curves=1)
    sizes = {r["case_id"]: (r["width"], r["height"]) for r in golden.svg_guard(svgs=spark.createDataFrame([
        (1, '<svg viewBox="0 0 30 20.5" width="9mm"><path d="M0 0L1 1"/></svg>', "X"), (2, '<svg width="9mm" HEIGHT=\'8\'><path d="M0 0L1 1"/></svg>', "X"), (3, '<svg viewBox="0 0 0 5"><path d="M0 0L7.2-1.5"/></svg>', "X"), (4, "<svg/>", "X"),
    ], "case_id long, svg string, backend string")).collect()}
    assert sizes == {1: (30.0, 20.5), 2: (9.0, 8.0), 3: (8.0, 1.0), 4: (None, None)}
    guard = {r["case_id"]: r["verdict"] for r in golden.svg_guard(svgs=svgs).collect()}
    assert guard == {1: "OK", 2: "EMPTY", 3: "UNSAFE", 4: "NO_PATHS", 5: "NO_GEOMETRY", 6: "OK", 7: "OK"}
    base = [(1, 2, 11, 1, "DIRECT", True, ok), (6, 2, 11, 1, "DIRECT", True, ok), (7, 1, 3, 1, "DIRECT", True, rows[6][1]), (4, 1, 1, 0, "DIRECT", True, "<svg/>")]
    goldens = spark.createDataFrame(base, "case_id long, paths long, anchors long, holes long, backend string, approved boolean, svg string")
    verdict = {r["case_id"]: r["verdict"] for r in golden.golden_verdict(svgs=svgs, goldens=goldens).collect()}
    assert verdict == {1: "PASS", 6: "REVIEW_REQUIRED", 7: "FAIL", 4: "FAIL"}
