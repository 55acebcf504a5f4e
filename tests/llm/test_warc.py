import gzip
import hashlib

import pytest

from inkfold.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string, payload_bytes int"


def made():
    big, other = "é" * 600, "x" * 1000
    return [
        (1, "http://a/ b", big), (5, "http://a/5", big), (3, None, big), (2, "http://a/2", other), (7, "http://a/7", other[:-1]), (8, "http://a/8", other[:-1]),
        (9, "", None), (10, "http://a/10", ""), (11, "http://a/11", "a\r\n\r\nWARC/1.0\r\n\r\nHTTP/1.1 200\n\nfiledesc://x y z t 3\n"), (12, "http://a/12", "z\n" * 200000), (4, "u", other), (4, "u", other),
    ]


def want(rows):
    out = []
    for i, _, t in rows:
        b = (t or "").encode()
        same = [j for j, _, u in rows if (u or "") == (t or "")]
        kind = "revisit" if len(b) >= 1000 and i < max(same) else "response"
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), kind, max(same) if kind == "revisit" else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 4])
def test_round_trip(spark, partitions):
    rows = made()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(partitions)
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == want(rows)


@pytest.mark.parametrize("turned", [False, True])
def test_repeated_page_ids_with_different_payloads(spark, turned):
    a, b = "a" * 1200, "b" * 1500
    rows = [(1, "u", a), (2, "u", b), (7, "u", a), (7, "u", b)]
    df = spark.createDataFrame([(*r, "x", 1) for r in (rows[::-1] if turned else rows)], SCHEMA).repartition(1)
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    assert got == [(1, 1200, "revisit", 7), (2, 1500, "revisit", 7), (7, 1200, "response", None), (7, 1500, "response", None)]


def test_dates_of_any_precision():
    made = "20010203040506"
    assert [warc.full_date(d, made) for d in ("19990203040506", "199902030405", "1999", "199913", "-", "99")] == ["19990203040506", "19990203040500", "19990101000000", made, made, made]


def test_empty_table_and_null_id(spark):
    df = spark.createDataFrame([(None, "u", "text", "x", 1)], SCHEMA)
    assert [tuple(r) for r in warc.round_trip(df).collect()] == [(None, 4, hashlib.sha1(b"text").hexdigest(), "response", None)]
    assert warc.round_trip(df.limit(0)).count() == 0


def test_versions_by_declared_length():
    body = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"
    one = b"filedesc://a.arc 0.0.0.0 20000101000000 text/plain %d\n" % len(body) + body + b"\nhttp://q/ 1.2.3.4 19990203040506 text/plain 13\nline\n\nfiledes\n\n"
    assert [(r["url"], r["date"], r["payload"]) for r in warc.arc_records(one, "a") if r["kind"] == "record"] == [("http://q/", "19990203040506", b"line\n\nfiledes")]
    body = b"2 0 x\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    two = b"filedesc://a.arc 0.0.0.0 20000101000000 text/plain 200 - - 0 a.arc %d\n" % len(body) + body + b"\nhttp://q/ 1.2.3.4 19990203040506 image/png 200 - - 77 a.arc 5\n\n\n\n\n\n\nhttp://r/ 1.2.3.4 19990203040506 text/html 404 - - 99 a.arc 0\n\n"
    got = [(r["url"], r["mime"], r["payload"]) for r in warc.arc_records(gzip.compress(two), "a") if r["kind"] == "record"]
    assert got == [("http://q/", "image/png", b"\n" * 5), ("http://r/", "text/html", b"")]
    with pytest.raises(ValueError, match="declared length"):
        list(warc.arc_records(two[:-40].replace(b"a.arc 5\n", b"a.arc 500\n"), "a"))


def test_records_are_equivalent(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x", 1) for r in made()], SCHEMA).repartition(2)
    warc.write_arc(df, f"{tmp_path}/arc")
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    fields, infos = [], 0
    for f in sorted((tmp_path / "warc").glob("part-*")):
        for head, block in warc.warc_records(f.read_bytes(), f.name):
            assert head["warc-date"] == "2000-01-01T00:00:00Z" and head["warc-block-digest"] == "sha1:" + hashlib.sha1(block).hexdigest()
            if head["warc-type"] == "warcinfo":
                infos += 1
                continue
            fields.append(head)
            assert head["warc-record-id"].startswith("<urn:uuid:") and head["warc-type"] in ("response", "revisit")
            assert (head["warc-type"] == "revisit") == ("warc-refers-to" in head)
    assert len(fields) == len(made()) and infos == 2 and len({h["warc-record-id"] for h in fields}) == len(fields)
    ids = {h["warc-record-id"] for h in fields if h["warc-type"] == "response"}
    assert all(h["warc-refers-to"] in ids for h in fields if "warc-refers-to" in h)
