"""Relations between fitted shapes of a document, and shapes moved so that near relations hold exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.operators.graph import components, cut


def _near(shapes: DataFrame, cells: list[str], reach: float, test: str) -> DataFrame:
    """doc_id, a, b: pairs of shapes that pass a test; they meet in grid cells of the size of its reach."""
    placed = shapes.selectExpr("*", *(f"CAST(floor(({c}) / {reach}) AS BIGINT) AS g{k}" for k, c in enumerate(cells)))
    keys = ["doc_id", *(f"g{k}" for k in range(len(cells)))]
    around = placed
    for k in range(len(cells)):
        around = around.withColumn(f"g{k}", F.explode(F.expr(f"array(g{k} - 1, g{k}, g{k} + 1)")))
    other = placed.select(*keys, *(F.col(c).alias(f"o_{c}") for c in shapes.columns if c != "doc_id"))
    return around.join(other, keys).where(f"shape_id < o_shape_id AND ({test})").select("doc_id", F.col("shape_id").alias("a"), F.col("o_shape_id").alias("b")).distinct()


def relations(circles: DataFrame, lines: DataFrame, centre: float = 1.0, size: float = 0.5, degrees: float = 2.0) -> DataFrame:
    """doc_id, kind, a, b: CONCENTRIC and EQUAL_SIZE pairs of circles, PARALLEL pairs of lines, each within its tolerance.

    circles(doc_id, shape_id, cx, cy, radius, weight); lines(doc_id, shape_id, degrees, weight), directions modulo 180.
    """
    round_ones = circles.where("cx IS NOT NULL AND cy IS NOT NULL AND radius IS NOT NULL").select("doc_id", "shape_id", "cx", "cy", "radius")
    same_centre = _near(round_ones, ["cx", "cy"], centre, f"(cx - o_cx) * (cx - o_cx) + (cy - o_cy) * (cy - o_cy) <= {centre * centre}")
    same_size = _near(round_ones.select("doc_id", "shape_id", "radius"), ["radius"], size, f"abs(radius - o_radius) <= {size}")
    # A direction near 180 is also one near 0, so it stands on both ends of the scale.
    turned = lines.where("degrees IS NOT NULL").selectExpr("doc_id", "shape_id", "pmod(degrees, 180e0) AS turn")
    wrapped = turned.unionByName(turned.where(f"turn < {degrees}").withColumn("turn", F.col("turn") + 180))
    parallel = _near(wrapped, ["turn"], degrees, f"abs(turn - o_turn) <= {degrees}")
    return same_centre.withColumn("kind", F.lit("CONCENTRIC")).unionByName(same_size.withColumn("kind", F.lit("EQUAL_SIZE"))).unionByName(parallel.withColumn("kind", F.lit("PARALLEL"))).select("doc_id", "kind", "a", "b")


def _chained(shapes: DataFrame, value: str, reach: float) -> DataFrame:
    """doc_id, a, b: the smallest shape of every run of values, in which neighbours lie within reach, with the others of the run: they hang together as all such pairs do, and settle at once."""
    order = Window.partitionBy("doc_id").orderBy(value, "shape_id")
    apart = F.coalesce((F.abs(F.col(value) - F.lag(value).over(order)) > reach).cast("int"), F.lit(0))
    runs = shapes.withColumn("apart", apart).withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stars = runs.select("doc_id", F.min("shape_id").over(Window.partitionBy("doc_id", "run")).alias("a"), F.col("shape_id").alias("b"))
    return stars.where("a <> b")


def _bound_to_equals(shapes: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct values with the smallest shape that has them, and doc_id, a, b: that shape with every other one."""
    firsts = shapes.groupBy("doc_id", *values).agg(F.min("shape_id").alias("first"))
    same = shapes.join(firsts, ["doc_id", *values]).where("shape_id <> first").select("doc_id", F.col("first").alias("a"), F.col("shape_id").alias("b"))
    return firsts.withColumnRenamed("first", "shape_id"), same


def _round_ones(circles: DataFrame) -> DataFrame:
    return circles.where("cx IS NOT NULL AND cy IS NOT NULL AND radius IS NOT NULL").select("doc_id", "shape_id", "cx", "cy", "radius")


def _concentric(circles: DataFrame, centre: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, a, b twice: the smallest circle of every centre with the others there, and links between such circles of different centres.

    Of the different centres in a cell whose corners are within the tolerance the first is joined
    to the others; different centres of neighbouring cells are compared.
    """
    firsts, same = _bound_to_equals(_round_ones(circles).select("doc_id", "shape_id", "cx", "cy"), ["cx", "cy"])
    cell = centre / 2
    placed = cut(firsts.selectExpr("*", f"CAST(floor(cx / {cell}) AS BIGINT) AS gx", f"CAST(floor(cy / {cell}) AS BIGINT) AS gy"))
    heads = placed.groupBy("doc_id", "gx", "gy").agg(F.min("shape_id").alias("head"))
    inside = placed.join(heads, ["doc_id", "gx", "gy"]).where("shape_id <> head").select("doc_id", F.col("head").alias("a"), F.col("shape_id").alias("b"))
    # Centres of cells two apart may be within reach; each pair of cells is looked at from its smaller one.
    ways = F.expr("filter(flatten(transform(sequence(-2, 2), dx -> transform(sequence(-2, 2), dy -> named_struct('dx', dx, 'dy', dy)))), w -> w.dx > 0 OR (w.dx = 0 AND w.dy > 0))")
    asked = placed.withColumn("w", F.explode(ways)).selectExpr("doc_id", "shape_id", "cx", "cy", "gx + w.dx AS gx", "gy + w.dy AS gy")
    other = placed.selectExpr("doc_id", "gx", "gy", "shape_id AS b", "cx AS o_cx", "cy AS o_cy")
    across = asked.join(other, ["doc_id", "gx", "gy"]).where(f"(cx - o_cx) * (cx - o_cx) + (cy - o_cy) * (cy - o_cy) <= {centre * centre}").select("doc_id", F.col("shape_id").alias("a"), "b")
    return same, inside.unionByName(across)


def _equal_size(circles: DataFrame, size: float) -> DataFrame:
    return _chained(_round_ones(circles).select("doc_id", "shape_id", "radius"), "radius", size)


def _parallel(lines: DataFrame, degrees: float) -> DataFrame:
    turned = lines.where("degrees IS NOT NULL").selectExpr("doc_id", "shape_id", "pmod(degrees, 180e0) AS turn")
    return _chained(turned.unionByName(turned.where(f"turn < {degrees}").withColumn("turn", F.col("turn") + 180)), "turn", degrees)


def spanning_relations(circles: DataFrame, lines: DataFrame, centre: float = 1.0, size: float = 0.5, degrees: float = 2.0) -> DataFrame:
    """doc_id, kind, a, b: relations that join the same groups as those of relations(), without the square of a crowd.

    Sizes and directions hang on the first shape of their run, equal centres on their first shape;
    different centres are linked as _concentric() tells.
    """
    same, linked = _concentric(circles, centre)
    kinds = {"CONCENTRIC": same.unionByName(linked), "EQUAL_SIZE": _equal_size(circles, size), "PARALLEL": _parallel(lines, degrees)}
    told = [edges.withColumn("kind", F.lit(kind)) for kind, edges in kinds.items()]
    return told[0].unionByName(told[1]).unionByName(told[2]).select("doc_id", "kind", "a", "b")


def _hung(stars: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """doc_id, shape_id, group of stars, each from its smallest shape a to the others b, that hang together where components of their a are found."""
    if found is None:
        nodes = stars.selectExpr("doc_id", "a", "inline(array(named_struct('shape_id', a), named_struct('shape_id', b)))")
        return nodes.distinct().select("doc_id", "shape_id", F.col("a").alias("group"))
    tops = found.select("doc_id", F.col("node").alias("a"), "component")
    met = stars.join(tops, ["doc_id", "a"], "left").withColumn("group", F.coalesce("component", "a"))
    nodes = met.selectExpr("doc_id", "group", "inline(array(named_struct('shape_id', a), named_struct('shape_id', b)))")
    return nodes.unionByName(tops.select("doc_id", F.col("component").alias("group"), F.col("a").alias("shape_id"))).distinct().select("doc_id", "shape_id", "group")


def _bound(df: DataFrame, settled: DataFrame, values: list[str], reach: float, name: str) -> DataFrame:
    """values replaced by their group's mean where every member is within reach of it; a group is summed up in parts, so a crowd is not one task."""
    settled, weight = cut(settled), F.coalesce("weight", F.lit(1.0))
    group = df.join(settled, ["doc_id", "shape_id"])
    means = cut(group.groupBy("doc_id", "group").agg(*((F.sum(F.col(v) * weight) / F.sum(weight)).alias(f"mean_{v}") for v in values)))
    off = F.sqrt(sum((F.col(v) - F.col(f"mean_{v}")) ** 2 for v in values))
    holds = group.join(means, ["doc_id", "group"]).groupBy("doc_id", "group").agg(F.max(off).alias("off")).where(F.col("off") <= reach).select("doc_id", "group")
    told = settled.join(means.join(holds, ["doc_id", "group"], "left_semi"), ["doc_id", "group"]).withColumnRenamed("group", name)
    moved = df.join(told, ["doc_id", "shape_id"], "left").withColumns({v: F.when(F.col(name).isNotNull(), F.col(f"mean_{v}")).otherwise(F.col(v)) for v in values})
    return moved.select(*df.columns, name)


def couple_circles(circles: DataFrame, centre: float = 1.0, size: float = 0.5) -> DataFrame:
    """The circles of couple(), from a table that cut() wrote, as it is read several times.

    Only links between different centres are followed round by round; what hangs on one shape is settled by it.
    """
    same, linked = _concentric(circles, centre)
    moved = cut(_bound(circles, _hung(same, components(cut(linked), ["doc_id"], "a", "b")), ["cx", "cy"], centre, "concentric"))
    return _bound(moved, _hung(_equal_size(circles, size)), ["radius"], size, "equal_size")


def couple_lines(lines: DataFrame, degrees: float = 2.0) -> DataFrame:
    """The lines of couple(), from a table that cut() wrote."""
    # Directions as doubled angles, so that 179 and 1 lie together.
    spread = lines.withColumns({"dx": F.cos(F.radians(F.col("degrees") * 2)), "dy": F.sin(F.radians(F.col("degrees") * 2))})
    found = components(cut(_parallel(lines, degrees)), ["doc_id"], "a", "b").select("doc_id", F.col("node").alias("shape_id"), F.col("component").alias("group"))
    aligned = _bound(spread, found, ["dx", "dy"], 2 * degrees * 0.0174532925199433, "parallel")
    turn = F.pmod(F.degrees(F.atan2("dy", "dx")) / 2 + F.lit(360.0), F.lit(180.0))
    return aligned.withColumn("degrees", F.when(F.col("parallel").isNotNull(), turn).otherwise(F.col("degrees"))).drop("dx", "dy")


def couple(circles: DataFrame, lines: DataFrame, centre: float = 1.0, size: float = 0.5, degrees: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """The circles and lines with near relations made exact: columns as given, and which relations hold (concentric, equal_size, parallel: the group, else null).

    Related shapes form groups; with all of a group's centres (radii, directions) bound to be
    equal, the least-squares solution is their mean weighted by the points behind them. A
    group that only hangs together by a chain, with members further from that mean than the
    tolerance, stays as it was. Shapes without a relation and with nulls stay as they were.
    """
    return couple_circles(cut(circles), centre, size), couple_lines(cut(lines), degrees)
