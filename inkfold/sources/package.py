"""Production packages: cut-line SVG, stored ZIP archives with CRC-32, packages gated by their documents' status. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DOS_TIME, _DOS_DATE = 0, 33  # midnight, 1980-01-01: equal files make equal archives


def _le(value: Column, size: int) -> Column:
    """A whole number as little-endian bytes; one that does not fit is an error, as the archive would be wrong."""
    whole = value.cast("long")
    fits = F.when(whole.between(0, 256**size - 1), whole).otherwise(F.raise_error(F.concat(whole.cast("string"), F.lit(f" is beyond {size} bytes of a ZIP field"))))
    text = F.lpad(F.hex(fits), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(text, 2 * k + 1, 2) for k in reversed(range(size))]))


def _bytes(text: str) -> Column:
    return F.unhex(F.lit(text.encode("latin-1").hex()))


def zip_archives(files: DataFrame, key: str = "package_id") -> DataFrame:
    """package, files, zip per package from files(package, name, data binary): entries stored in order of name.

    Names are UTF-8, null data is an empty file; equal names of a package stay separate entries.
    A package is one row, so its files together must fit in a task; 65,536 files, or sizes
    beyond 4 GB, are an error.
    """
    rows = files.select(F.col(key).alias("package"), F.encode("name", "UTF-8").alias("name"), F.coalesce("data", F.lit(b"")).alias("data"))
    rows = rows.withColumn("common", F.concat(_le(F.lit(2048), 2), _le(F.lit(0), 2), _le(F.lit(_DOS_TIME), 2), _le(F.lit(_DOS_DATE), 2), _le(F.crc32("data"), 4), _le(F.octet_length("data"), 4), _le(F.octet_length("data"), 4), _le(F.octet_length("name"), 2), _le(F.lit(0), 2)))
    entry = F.struct("name", "data", "common", F.concat(_bytes("PK\x03\x04"), _le(F.lit(20), 2), F.col("common"), F.col("name"), F.col("data")).alias("local"))
    held = rows.groupBy("package").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    sizes = F.transform("e", lambda x: F.octet_length(x["local"]).cast("long"))
    held = held.withColumn("at", F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))))
    central = F.transform(
        "e",
        lambda x, k: F.concat(_bytes("PK\x01\x02"), _le(F.lit(20), 2), _le(F.lit(20), 2), x["common"], _le(F.lit(0), 2), _le(F.lit(0), 2), _le(F.lit(0), 2), _le(F.lit(0), 4), _le(F.get("at", k), 4), x["name"]),
    )
    join = lambda parts: F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x))
    held = held.select("package", F.size("e").alias("files"), join(F.transform("e", lambda x: x["local"])).alias("body"), join(central).alias("central"))
    end = F.concat(_bytes("PK\x05\x06"), _le(F.lit(0), 2), _le(F.lit(0), 2), _le(F.col("files"), 2), _le(F.col("files"), 2), _le(F.octet_length("central"), 4), _le(F.octet_length("body"), 4), _le(F.lit(0), 2))
    return held.select(F.col("package").alias(key), F.col("files").cast("long").alias("files"), F.concat("body", "central", end).alias("zip"))


def _number(value: Column) -> Column:
    """At most three decimals, no trailing zeros."""
    return F.regexp_replace(F.format_string("%.3f", value), r"\.?0+$", "")


def cut_lines(points: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, svg: the cut outlines of a document as one SVG in mm, in order of node and contour; documents without any have no row."""
    ring = points.groupBy("doc_id", "node_id", "contour").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"), F.coalesce(F.bool_and("closed"), F.lit(True)).alias("closed"))
    step = F.transform("p", lambda q, k: F.concat(F.when(k == 0, F.lit("M ")).otherwise(F.lit("L ")), _number(q["x"]), F.lit(" "), _number(q["y"])))
    ring = ring.select("doc_id", "node_id", "contour", F.concat(F.array_join(step, " "), F.when(F.col("closed"), F.lit(" Z")).otherwise(F.lit(""))).alias("d"))
    path = ring.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "contour", "d"))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: F.concat(F.lit('<path d="'), x["d"], F.lit('" fill="none" stroke="#ff00ff" stroke-width="0.1"/>'))), "")
    sized = path.join(docs.select("doc_id", "width_mm", "height_mm"), "doc_id")
    w, h = _number(F.col("width_mm")), _number(F.col("height_mm"))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), w, F.lit('mm" height="'), h, F.lit('mm" viewBox="0 0 '), w, F.lit(" "), h, F.lit('">'))
    return sized.select("doc_id", F.concat(head, body, F.lit("</svg>")).alias("svg"))


def production_packages(docs: DataFrame, status: DataFrame, art: DataFrame, cuts: DataFrame, manifests: DataFrame) -> DataFrame:
    """doc_id, status, files, zip: print image, cut lines and manifest of every document; a blocked one has no files and a null archive.

    status: doc_id, status; art: doc_id, png; cuts: doc_id, svg; manifests: doc_id, manifest.
    """
    name = lambda tail: F.concat(F.lit("document-"), F.col("doc_id").cast("string"), F.lit(tail))
    files = (
        art.select("doc_id", name("-print.png").alias("name"), F.col("png").alias("data"))
        .unionByName(cuts.select("doc_id", name("-cut.svg").alias("name"), F.encode("svg", "UTF-8").alias("data")))
        .unionByName(manifests.select("doc_id", name("-manifest.json").alias("name"), F.encode("manifest", "UTF-8").alias("data")))
    )
    open_docs = docs.select("doc_id").join(status.select("doc_id", "status"), "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("ready")))
    made = zip_archives(files.join(open_docs.where("status <> 'blocked'").select("doc_id"), "doc_id", "left_semi"), "doc_id")
    return open_docs.join(made, "doc_id", "left").select("doc_id", "status", F.coalesce("files", F.lit(0).cast("long")).alias("files"), "zip")
