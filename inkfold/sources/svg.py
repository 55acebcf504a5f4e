"""SVG text: path rows in, path commands, safety checks, document text out; all in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# A number of the path grammar: sign, digits with or without a point, exponent.
NUMBER = "[-+]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][-+]?[0-9]+)?"

# What a drawing is made of, in lower case; a file with any other element is not taken as a drawing.
DRAWING = (
    "svg", "g", "defs", "title", "desc", "metadata", "path", "rect", "circle", "ellipse", "line", "polyline", "polygon", "text", "tspan", "use", "symbol", "marker", "image",
    "clippath", "mask", "pattern", "lineargradient", "radialgradient", "stop", "style",
)
_ELEMENT, _ATTRIBUTE, _DECLARED = "<[/ ]*([A-Za-z][A-Za-z0-9:_-]*)", "[ \\t\\r\\n/\"']([A-Za-z_:][A-Za-z0-9_:.-]*)[ \\t\\r\\n]*=", "<!(?!--)"
# Links may lead to places in the file itself or hold a picture; anything else leads out of it.
_LINK, _URL, _INSIDE = "(?i)(?:href|src)[ \\t\\r\\n]*=[ \\t\\r\\n]*[\"']([^\"']*)", "(?i)url[(][ \"']*([^)\"']*)", "^(#|data:image/|$)"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: The same rule as SQL text over a column svg.
UNSAFE = (
    f"(exists(regexp_extract_all(svg, {_literal(_ELEMENT)}, 1), e -> lower(e) NOT IN ({', '.join(map(repr, DRAWING))}))"
    f" OR exists(regexp_extract_all(svg, {_literal(_ATTRIBUTE)}, 1), a -> startswith(lower(a), 'on'))"
    f" OR exists(concat(regexp_extract_all(svg, {_literal(_LINK)}, 1), regexp_extract_all(svg, {_literal(_URL)}, 1)), u -> NOT lower(trim(u)) RLIKE {_literal(_INSIDE)}) OR svg RLIKE {_literal(_DECLARED)})"
)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a tag; null if absent."""
    value = F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""", 1)
    return F.when(value != "", value)


def read_paths(svgs: DataFrame, id_col: str = "svg_id", text_col: str = "svg", default_fill: str | None = "#000000") -> DataFrame:
    """svg_id, path_no, d, fill, stroke, stroke_width, fill_rule: a row per path element.

    A missing fill is default_fill (null: unknown), ``none`` is null; null text has no rows.
    """
    tags = svgs.select(F.col(id_col).alias("svg_id"), F.posexplode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(r"(?is)<path\b[^>]*>"), F.lit(0))).alias("path_no", "tag"))
    fill = F.lower(attribute(F.col("tag"), "fill"))
    fill = F.coalesce(fill, F.lit(default_fill)) if default_fill is not None else fill
    return tags.select(
        "svg_id", "path_no", attribute(F.col("tag"), "d").alias("d"), F.nullif(fill, F.lit("none")).alias("fill"), F.nullif(F.lower(attribute(F.col("tag"), "stroke")), F.lit("none")).alias("stroke"),
        F.expr("try_cast(regexp_extract(tag, '(?i)stroke-width\\\\s*=\\\\s*[\"\\']([0-9.]+)', 1) AS DOUBLE)").alias("stroke_width"),
        F.coalesce(attribute(F.col("tag"), "fill-rule"), F.lit("nonzero")).alias("fill_rule"),
    )


def path_commands(paths: DataFrame) -> DataFrame:
    """svg_id, path_no, pos, cmd, args array<double>: the path language as rows."""
    found = F.regexp_extract_all(F.coalesce("d", F.lit("")), F.lit(r"([MmLlHhVvCcSsQqTtAaZz])([^MmLlHhVvCcSsQqTtAaZz]*)"), F.lit(0))
    rows = paths.select("svg_id", "path_no", F.posexplode(found).alias("pos", "c"))
    numbers = F.regexp_extract_all(F.expr("substr(c, 2)"), F.lit(NUMBER), F.lit(0))
    return rows.select("svg_id", "path_no", "pos", F.substring("c", 1, 1).alias("cmd"), F.transform(numbers, lambda v: v.cast("double")).alias("args"))


def stats(paths: DataFrame) -> DataFrame:
    """svg_id, paths, subpaths, anchors, holes: counts by command letters."""
    d = F.coalesce("d", F.lit(""))
    moves = F.regexp_count(d, F.lit("[Mm]"))
    return paths.groupBy("svg_id").agg(
        F.count("*").alias("paths"), F.sum(moves).alias("subpaths"), F.sum(F.regexp_count(d, F.lit("[MmLlHhVvCcSsQqTtAaZz]"))).alias("anchors"), F.sum(F.greatest(moves - 1, F.lit(0))).alias("holes")
    )


def unsafe(svg: Column) -> Column:
    """Whether SVG text holds anything but plain drawing (UNSAFE, for any column); null text holds nothing."""
    names = F.regexp_extract_all(svg, F.lit(_ELEMENT), F.lit(1))
    links = F.concat(F.regexp_extract_all(svg, F.lit(_LINK), F.lit(1)), F.regexp_extract_all(svg, F.lit(_URL), F.lit(1)))
    strange = F.exists(names, lambda e: ~F.lower(e).isin(*DRAWING)) | F.exists(F.regexp_extract_all(svg, F.lit(_ATTRIBUTE), F.lit(1)), lambda a: F.lower(a).startswith("on"))
    return F.coalesce(strange | F.exists(links, lambda u: ~F.lower(F.trim(u)).rlike(_INSIDE)) | svg.rlike(_DECLARED), F.lit(False))


def write(paths: DataFrame, width: float, height: float) -> DataFrame:
    """svg_id, svg: one document per svg_id with its paths in order of path_no."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    tag = F.concat(F.lit('<path d="'), esc(F.col("d")), F.lit('" fill="'), F.coalesce("fill", F.lit("none")), F.lit('" fill-rule="'), F.col("fill_rule"), F.lit('"/>'))
    ordered = F.array_sort(F.collect_list(F.struct("path_no", tag.alias("tag"))))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}mm" height="{height}mm" viewBox="0 0 {width} {height}">'
    return paths.groupBy("svg_id").agg(F.concat(F.lit(head), F.array_join(F.transform(ordered, lambda p: p["tag"]), ""), F.lit("</svg>")).alias("svg"))
