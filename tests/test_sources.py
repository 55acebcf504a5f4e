import datetime
import json
import zlib
import struct

import numpy as np
import pytest

from inkfold.sources import documents, png, svg
from inkfold.streaming import telemetry


def test_png_round_trip_and_filters(spark, tmp_path):
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (9, 7, 4)).astype(np.uint8)
    assert (png.decode(png.encode(img)) == img).all()
    rows, above = b"", np.zeros(28, np.int64)
    for y in range(9):  # every scanline filter once
        line, kind = img[y].reshape(-1).astype(np.int64), y % 5
        left, corner = np.concatenate([np.zeros(4, np.int64), line[:-4]]), np.concatenate([np.zeros(4, np.int64), above[:-4]])
        p = left + above - corner
        near = np.stack([abs(p - left), abs(p - above), abs(p - corner)]).argmin(axis=0)
        guess = [0, left, above, (left + above) // 2, np.choose(near, [left, above, corner])][kind]
        rows += bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (png.decode(data) == img).all()
    (tmp_path / "a.png").write_bytes(data)
    px = png.read_pixels(spark, str(tmp_path))
    assert px.count() == 63
    back = png.write_images(px).first()
    assert (png.decode(bytes(back["png"])) == img).all() and (back["width"], back["height"]) == (7, 9)
    with pytest.raises(ValueError):
        png.decode(b"GIF89a")


SVG = """<svg><path d="M 10 10 L 90 10 L 90 90 Z M 30 30 L 60 30 L 60 60 Z" fill-rule="evenodd" stroke="NONE"/>
<path fill='#FF0000' stroke-width="2.5" stroke='#00f' d='M0,0 C1-2 3.5.5 1e1 -7z'/><rect/></svg>"""


def test_svg(spark):
    df = spark.createDataFrame([(1, SVG), (2, None), (3, "<svg></svg>")], "svg_id long, svg string")
    paths = svg.read_paths(df).cache()
    got = [tuple(r) for r in paths.orderBy("path_no").collect()]
    assert [g[3:] for g in got] == [("#000000", None, None, "evenodd"), ("#ff0000", "#00f", 2.5, "nonzero")]
    commands = [(r["cmd"], list(r["args"])) for r in svg.path_commands(paths.where("path_no = 1")).orderBy("pos").collect()]
    assert commands == [("M", [0.0, 0.0]), ("C", [1.0, -2.0, 3.5, 0.5, 10.0, -7.0]), ("z", [])]
    assert tuple(svg.stats(paths).first()) == (1, 2, 3, 11, 1)
    out = svg.write(paths, 100, 100)
    again = svg.read_paths(out)
    assert [r["d"] for r in again.orderBy("path_no").collect()] == [g[2] for g in got]
    bad = spark.createDataFrame([("<svg onload='x()'/>",), ("<svg/>",), (None,)], "s string")
    assert [r[0] for r in bad.select(svg.unsafe(bad["s"])).collect()] == [True, False, False]
    texts = {
        "<svg><SCRIPT>x</SCRIPT></svg>": True, "<svg><iframe src='x'/></svg>": True, "<svg><foreignObject/></svg>": True, "<!DOCTYPE svg [<!ENTITY a 'b'>]><svg/>": True, "<svg><a/></svg>": True,
        "<svg><use href='#a'/><image xlink:href='data:image/png;base64,AA'/></svg>": False, "<svg><use href='http://a/b.svg#c'/></svg>": True, "<svg><image href=\"data:text/html,x\"/></svg>": True, "<svg><use href=' javascript:x'/></svg>": True,
        "<svg><rect style='fill:url(#g)'/></svg>": False, "<svg><rect style='fill:url(http://x)'/></svg>": True, "<svg><rect/ONCLICK=x></svg>": True, "<svg><!-- a note --><path d='M0 0'/></svg>": False, "<svg><path d='M0 0' stroke-width='1' font='on'/></svg>": False,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "svg string")
    assert {r[0]: r[1] for r in rows.select("svg", svg.unsafe(rows["svg"])).collect()} == texts
    assert {r[0]: r[1] for r in rows.selectExpr("svg", svg.UNSAFE).collect()} == texts


def test_json_documents(spark, tmp_path):
    doc = {"id": "d1", "dimensions": {"width_mm": 100, "height_mm": 50}, "rootNodeIds": ["n1"], "nodes": {"n1": {"id": "n1", "type": "group"}, "n2": {"id": "n2", "type": "vector_path", "parentId": "n1", "visible": True}}}
    df = spark.createDataFrame([(json.dumps(doc),), ("not json",), (None,)], "json string")
    rows = {r["id"]: r for r in documents.nodes(documents.parse(df)).collect()}
    assert rows["n1"]["is_root"] and not rows["n2"]["is_root"] and rows["n2"]["parentId"] == "n1"
    case = lambda k, ok: {"case_id": k, "route": "DIRECT", "backend": "DIRECT", "humanApproved": ok, "stats": {"paths": 1}}
    (tmp_path / "g.json").write_text(json.dumps([case("a", True), case("b", False)]))
    golden = documents.read_golden(spark, str(tmp_path / "g.json"))
    fresh = golden.withColumn("stats", golden["stats"].withField("paths", golden["stats"]["paths"] + 1))
    assert sorted((r["case_id"], r["stats"]["paths"]) for r in documents.update_golden(golden, fresh).collect()) == [("a", 1), ("b", 2)]
    assert {r["stats"]["paths"] for r in documents.update_golden(golden, fresh, force=True).collect()} == {2}


def test_snapshot_digest_sees_every_cell(spark):
    a = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 0, None)], "image_id long, x long, y long, label long")
    b = spark.createDataFrame([(1, 1, 0, None), (1, 0, 0, 6)], "image_id long, x long, y long, label long")
    d = lambda f: documents.snapshot_digest(f).first()["digest"]
    assert d(a) == d(a.orderBy("x", ascending=False)) and d(a) != d(b)


def test_streaming_equals_batch(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(k % 90, at + datetime.timedelta(minutes=7 * (k % 90)), k % 3, k % 2, k % 5) for k in range(120)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, organization_id long, provider_id long, credits_charged long").dropDuplicates(["event_id"])
    df.unionByName(df.limit(10)).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = telemetry.hourly(stream).writeStream.outputMode("update").format("memory").queryName("hourly_out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("hourly_out").collect())
    assert got == sorted(tuple(r) for r in telemetry.hourly(df).collect())
