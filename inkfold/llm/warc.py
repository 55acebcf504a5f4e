"""Legacy archive converter: ARC 1 and 2 in, WARC 1.0 out, both as files on any store Spark can write.

Archives are written by Spark's text writer (records are whole strings of bytes, the
separator between records is the format's own), so the commit protocol covers lost tasks.
They are read as binary files and parsed by declared lengths only. The converter turns
version-specific ARC header lines into WARC identifiers, timestamps, types and digests; an
archive's own description becomes a warcinfo record. A record is known by its archive and
its place there, so no two share an identifier whatever their page ids. Of records with
equal payloads of at least ``least`` bytes the one with the largest page id stays a
response, the others become revisits of it without a payload.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm._common import cut, scratch_path, small_enough

CRLF = "\r\n"
ARC_FIELDS = {1: 5, 2: 10}  # words of a record's header line
_FIRST = "19700101000000"
_BATCH_BYTES = 8 << 20
_GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def _utf8(text: Column) -> Column:
    return text.cast("binary")


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20000101000000", ip: str = "0.0.0.0") -> None:
    """One archive per partition, versions 1 and 2 in turn; a record holds an HTTP response head and the UTF-8 page (null: empty).

    Spaces and control characters in a URL become %20, an absent URL ``unknown:``.
    """
    part, version = F.spark_partition_id(), F.pmod(F.spark_partition_id(), F.lit(2)) + 1
    url = F.regexp_replace(F.when(F.length(url_col) > 0, F.col(url_col)).otherwise(F.lit("unknown:")), r"[\x00-\x20\x7f]", "%20")
    page = F.when(F.col(id_col).isNotNull(), F.concat(F.lit("X-Page-Id: "), F.col(id_col).cast("string"), F.lit(CRLF))).otherwise(F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), page, F.lit(CRLF))
    rows = pages.select(
        url.alias("url"), head.alias("head"), F.coalesce(html_col, F.lit("")).alias("html"), version.alias("version"), F.concat(F.lit("part-"), part.cast("string"), F.lit(".arc")).alias("file"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")
    )
    length = (F.octet_length("head") + F.octet_length("html")).cast("string")
    line = F.when(F.col("version") == 1, F.concat_ws(" ", "url", F.lit(ip), F.lit(date), F.lit("text/html"), length)).otherwise(
        F.concat_ws(" ", "url", F.lit(ip), F.lit(date), F.lit("text/html"), F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), "file", length)
    )
    first = "1 0 inkfold\nURL IP-address Archive-date Content-type Archive-length\n"
    second = "2 0 inkfold\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    top = F.when(
        F.col("version") == 1, F.concat(F.lit("filedesc://"), F.col("file"), F.lit(f" {ip} {date} text/plain {len(first)}\n{first}\n"))
    ).otherwise(F.concat(F.lit("filedesc://"), F.col("file"), F.lit(f" {ip} {date} text/plain 200 - - 0 "), F.col("file"), F.lit(f" {len(second)}\n{second}\n")))
    record = F.concat(F.when(F.col("at") == 0, top).otherwise(F.lit("")), line, F.lit("\n"), F.col("head"), F.col("html"))
    rows.select(record.alias("value")).write.options(lineSep="\n", **_GZIP).text(path)


def _opened(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


def full_date(date: str, otherwise: str) -> str:
    """14 digits (year to second) of an ARC date; short ones are filled up from the start of their span, unreadable ones replaced."""
    digits = date if date.isascii() and date.isdigit() and len(date) >= 4 else otherwise
    digits = (digits + _FIRST[len(digits) :])[:14]
    try:
        datetime.strptime(digits, "%Y%m%d%H%M%S")
    except ValueError:
        return otherwise
    return digits


def arc_records(content: bytes, name: str) -> Iterator[dict]:
    """Records of one ARC file, read by declared lengths, its description (kind ``filedesc``) among them; a broken file raises ValueError."""
    stream, version, made = _opened(content), 1, _FIRST
    while line := stream.readline():
        if line == b"\n" or line == b"\r\n":
            continue
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        words = text.rsplit(" ", ARC_FIELDS[version] - 1)
        if text.startswith("filedesc://"):
            words = text.split(" ")
        if not words[-1].isdigit() or len(words) < 5:
            raise ValueError(f"{name}: no ARC header line: {text[:80]!r}")
        body = stream.read(int(words[-1]))
        if len(body) != int(words[-1]):
            raise ValueError(f"{name}: a record ends before its declared length")
        if text.startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"{name}: ARC version {version} is unknown")
            made = full_date(words[2], _FIRST)
            yield {"kind": "filedesc", "url": words[0], "ip": words[1], "date": made, "mime": words[3], "head": b"", "payload": body}
            continue
        head, gap, payload = body.partition(b"\r\n\r\n") if body.startswith(b"HTTP/") else (b"", b"", body)
        yield {"kind": "record", "url": words[0], "ip": words[1], "date": full_date(words[2], made), "mime": words[3], "head": head + gap, "payload": payload}


def warc_records(content: bytes, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of one WARC file; a broken file raises ValueError."""
    stream = _opened(content)
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC version line: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"{name}: a record ends before its declared length")
        yield fields, block


def _page_id(head: bytes) -> int | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == b"x-page-id":
            return int(value)
    return None


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """kind (record or filedesc), page_id, key (archive and place), url, ip, date (14 digits), mime, head, payload (null unless asked for), payload_bytes, payload_digest of every ARC record."""
    schema = "kind string, page_id long, key string, url string, ip string, date string, mime string, head binary, payload binary, payload_bytes long, payload_digest string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for k, r in enumerate(arc_records(content.as_py(), name)):
                    page, payload = _page_id(r["head"]), r["payload"]
                    key = f"{name.rsplit('/', 1)[-1]}#{k}"
                    rows.append((r["kind"], page, key, r["url"], r["ip"], r["date"], r["mime"], r["head"], payload if payloads else None, len(payload), hashlib.sha1(payload).hexdigest()))
                    held += len(payload) if payloads else 100
                    if held >= _BATCH_BYTES:
                        yield _batch(rows, schema, names)
                        rows, held = [], 0
                yield _batch(rows, schema, names)

    return _files(spark, path).mapInArrow(run, schema)


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str, names: list[str]) -> pa.RecordBatch:
    kinds = [_TYPES[c.split()[1]] for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _record_id(key: Column) -> Column:
    h = F.md5(F.concat(F.lit("inkfold|"), key))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = 1000, most_broadcast: int = 1_000_000) -> None:
    """Write the WARC equivalent of every ARC record.

    Records without a page id, and all rows that share the largest page id of their payload,
    stay responses; revisits name the first of these by its record id. The table of revisits
    is broadcast only if it has at most most_broadcast rows.
    """
    index = cut(read_arc(spark, arc_path, payloads=False).where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least)).select("key", "page_id", "payload_digest"))
    last = index.groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "last")
    known = index.join(last, "payload_digest")
    of = known.where("page_id = last").groupBy("payload_digest").agg(F.min("key").alias("of"))
    revisits = cut(known.where("page_id < last").join(of, "payload_digest").select("key", "of"))
    if small_enough(revisits, most_broadcast):
        revisits = F.broadcast(revisits)
    rows = read_arc(spark, arc_path).join(revisits, "key", "left")

    again = F.col("of").isNotNull()
    about = F.col("kind") == "filedesc"
    info = F.concat(F.lit(f"software: inkfold{CRLF}format: WARC File Format 1.0{CRLF}converted-from: "), F.col("url"), F.lit(CRLF)).cast("binary")
    block = F.when(about, info).when(again, F.col("head")).otherwise(F.concat("head", "payload"))
    rows = rows.select("*", block.alias("block"))
    stamp = F.regexp_replace("date", r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3T$4:$5:$6Z")
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}"),
        field("WARC-Type", F.when(about, F.lit("warcinfo")).when(again, F.lit("revisit")).when(F.length("head") > 0, F.lit("response")).otherwise(F.lit("resource"))),
        field("WARC-Record-ID", _record_id(F.col("key"))),
        field("WARC-Date", stamp),
        F.when(about, F.lit("")).otherwise(F.concat(field("WARC-Target-URI", F.col("url")), field("WARC-IP-Address", F.col("ip")))),
        F.when(
            again,
            F.concat(
                field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), field("WARC-Refers-To", _record_id(F.col("of")))
            ),
        ).otherwise(F.lit("")),
        F.when(about, F.lit("")).otherwise(field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))),
        field("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))),
        field("Content-Type", F.when(about, F.lit("application/warc-fields")).when(F.length("head") > 0, F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))),
        field("Content-Length", F.octet_length("block").cast("string")),
        F.lit(CRLF),
    )
    rows.select(F.concat(_utf8(head), F.col("block")).cast("string").alias("value")).write.options(lineSep=CRLF + CRLF, **_GZIP).text(warc_path)


def read_warc(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """page_id, record_id, record_type, refers_to_id, payload_bytes, payload_digest of every record but warcinfo.

    Digests of responses are computed anew (and, with check, must equal the declared ones); a revisit
    carries the declared digest and no payload size.
    """
    schema = "page_id long, record_id string, record_type string, refers_to_id string, payload_bytes long, payload_digest string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for fields, block in warc_records(content.as_py(), name):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    head, gap, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                    declared = fields["warc-payload-digest"].removeprefix("sha1:")
                    kind = fields["warc-type"]
                    if kind != "revisit" and (found := hashlib.sha1(payload).hexdigest()) != declared and check:
                        raise ValueError(f"{name}: {fields['warc-record-id']} holds {found}, not {declared}")
                    rows.append((_page_id(head), fields["warc-record-id"], kind, fields.get("warc-refers-to"), None if kind == "revisit" else len(payload), declared))
                    if len(rows) >= 10_000:
                        yield _batch(rows, schema, names)
                        rows = []
                yield _batch(rows, schema, names)

    return _files(spark, path).mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to per page, as read back from the converted archives.

    A revisit's size and target come from the response that its WARC-Refers-To names. Null
    html is an empty page; null ids and repeated ids or rows each give a record of their own
    (equal rows with the largest id are all responses); a page of any length is one record.
    Other columns of the input are ignored.
    """
    spark = pages.sparkSession
    arc, out = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, id_col, url_col, html_col)
    convert(spark, arc, out, least)
    records = cut(read_warc(spark, out))
    direct = records.where("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    target = records.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"))
    again = records.where("record_type = 'revisit'").join(target, "refers_to_id").select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return direct.unionByName(again)
