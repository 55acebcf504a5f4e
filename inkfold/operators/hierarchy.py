"""Rings inside rings, topology signatures and their invariants, and one-to-one matching of components."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.operators.copies import classes, firsts, for_all
from inkfold.operators.graph import cut, step_levels

_STRIP = 8
_DOC = ("doc_id",)


def _sides(outlines: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id", "ring_id").orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = [F.coalesce(F.lead(c).over(order), F.first(c).over(whole)).alias(f"n{c}") for c in ("x", "y")]
    return outlines.select("doc_id", "ring_id", "x", "y", *near, (F.row_number().over(order) - 1).alias("k"), F.count("*").over(whole).alias("n"))


def ring_tree(outlines: DataFrame) -> DataFrame:
    """doc_id, ring_id, area, parent, depth, role: which ring lies in which, by rings and not by boxes.

    A ring lies in a larger one that holds three or more of its points at none, a quarter, half
    and three quarters of its length; of several the smallest is its parent, ties by number.
    depth counts parents; role is OUTER at depth 0, then HOLE and ISLAND in turn. Rings of
    fewer than three points are left out. A probe meets only sides of its document in its
    strip of y whose span it lies in. Equal rings have no area more than each other, so they are
    placed once.
    """
    of = classes(outlines, _DOC)
    return for_all(_tree(firsts(outlines, of, _DOC)), of, _DOC)


def _tree(outlines: DataFrame) -> DataFrame:
    """ring_tree of outlines that all differ."""
    sides = cut(_sides(outlines).where("n >= 3"))
    areas = sides.groupBy("doc_id", "ring_id").agg(F.abs(F.sum(F.expr("x * ny - nx * y")) / 2).alias("area"))
    quarter = F.expr("k IN (0, CAST(floor(n / 4) AS BIGINT), CAST(floor(n / 2) AS BIGINT), CAST(floor(3 * n / 4) AS BIGINT))")
    # A point that stands for two quarters of a triangle counts twice.
    times = F.expr("1 + IF(k = 0 AND floor(n / 4) = 0, 1, 0)")
    probes = sides.where(quarter).select("doc_id", F.col("ring_id").alias("inner"), "k", times.alias("times"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.floor(F.col("y") / _STRIP).alias("strip"))
    walls = sides.where("y <> ny").selectExpr("doc_id", "ring_id", "x", "y", "nx", "ny", f"explode(sequence(CAST(floor(least(y, ny) / {_STRIP}) AS BIGINT), CAST(floor(greatest(y, ny) / {_STRIP}) AS BIGINT))) AS strip")
    met = probes.join(walls, ["doc_id", "strip"]).where("inner <> ring_id AND (y > qy) <> (ny > qy) AND qx < (nx - x) * (qy - y) / (ny - y) + x")
    held = met.groupBy("doc_id", "inner", "ring_id", "k", "times").count().where("count % 2 = 1").groupBy("doc_id", "inner", "ring_id").agg(F.sum("times").alias("held")).where("held >= 3")
    outer = held.join(areas.withColumnRenamed("area", "outer_area"), ["doc_id", "ring_id"]).join(areas.withColumnsRenamed({"ring_id": "inner", "area": "inner_area"}), ["doc_id", "inner"]).where("outer_area > inner_area")
    parents = outer.groupBy("doc_id", "inner").agg(F.min(F.struct("outer_area", "ring_id"))["ring_id"].alias("parent")).withColumnRenamed("inner", "ring_id")
    tree = cut(areas.join(parents, ["doc_id", "ring_id"], "left"))
    depths = step_levels(tree.select(F.col("doc_id").alias("plan_id"), F.col("ring_id").alias("step_id"), F.col("parent").alias("depends_on")))
    role = F.when(F.col("depth") == 0, "OUTER").when(F.col("depth") % 2 == 1, "HOLE").otherwise("ISLAND")
    return tree.join(depths.select(F.col("plan_id").alias("doc_id"), F.col("step_id").alias("ring_id"), F.col("level").alias("depth")), ["doc_id", "ring_id"]).select("doc_id", "ring_id", F.round("area", 6).alias("area"), "parent", "depth", role.alias("role"))


def _near(outlines: DataFrame, reach: float, least_points: int, which: str) -> DataFrame:
    """doc_id, ring_a, ring_b, shared of the pairs that a condition on ring_a and ring_b lets meet; by grid cells."""
    spots = outlines.selectExpr("doc_id", "ring_id", "pos", "x", "y", f"CAST(floor(x / {reach}) AS BIGINT) AS cx", f"CAST(floor(y / {reach}) AS BIGINT) AS cy")
    around = spots.withColumnsRenamed({"ring_id": "ring_a", "x": "ax", "y": "ay"}).selectExpr("doc_id", "ring_a", "pos", "ax", "ay", "cx", "explode(array(cy - 1, cy, cy + 1)) AS cy").selectExpr("doc_id", "ring_a", "pos", "ax", "ay", "explode(array(cx - 1, cx, cx + 1)) AS cx", "cy")
    other = spots.select("doc_id", F.col("ring_id").alias("ring_b"), "cx", "cy", "x", "y")
    near = around.join(other, ["doc_id", "cx", "cy"]).where(f"{which} AND (ax - x) * (ax - x) + (ay - y) * (ay - y) < {reach * reach}")
    return near.select("doc_id", "ring_a", "ring_b", "pos").distinct().groupBy("doc_id", "ring_a", "ring_b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least_points)


def ring_adjacency(outlines: DataFrame, reach: float = 2.5, least_points: int = 2) -> DataFrame:
    """doc_id, ring_a, ring_b, shared: rings of a document of which the first has least_points or more points within reach of the second's; by grid cells."""
    return _near(outlines, reach, least_points, "ring_a < ring_b")


def _adjacent(outlines: DataFrame, of: DataFrame, reach: float = 2.5, least_points: int = 2) -> DataFrame:
    """doc_id, adjacent: how many pairs ring_adjacency has, from outlines that all differ and the rings of each.

    Where only one of two has its points near the other, the pairs in which it has the smaller number are counted along the numbers of both.
    """
    found = cut(_near(outlines, reach, least_points, "true").select("doc_id", "ring_a", "ring_b"))
    sizes = of.groupBy("doc_id", "first").agg(F.count("*").alias("m"))
    one, two = (sizes.withColumnsRenamed({"first": f"ring_{c}", "m": f"m{c}"}) for c in "ab")
    alone = found.where("ring_a = ring_b").join(one, ["doc_id", "ring_a"]).selectExpr("doc_id", "ma * (ma - 1) / 2 AS pairs")
    back = found.selectExpr("doc_id", "ring_b AS ring_a", "ring_a AS ring_b")
    mutual = found.join(back, ["doc_id", "ring_a", "ring_b"], "left_semi").where("ring_a < ring_b").join(one, ["doc_id", "ring_a"]).join(two, ["doc_id", "ring_b"]).selectExpr("doc_id", "ma * mb AS pairs")
    single = found.where("ring_a <> ring_b").join(back, ["doc_id", "ring_a", "ring_b"], "left_anti")
    ends = single.selectExpr("doc_id", "ring_a", "ring_b", "inline(array(named_struct('first', ring_a, 'from_a', 1L), named_struct('first', ring_b, 'from_a', 0L)))")
    along = Window.partitionBy("doc_id", "ring_a", "ring_b").orderBy("ring_id").rowsBetween(Window.unboundedPreceding, 0)
    passed = ends.join(of, ["doc_id", "first"]).select("doc_id", "from_a", F.sum("from_a").over(along).alias("pairs")).where("from_a = 0").select("doc_id", "pairs")
    counts = alone.unionByName(mutual).unionByName(passed)
    return counts.groupBy("doc_id").agg(F.sum("pairs").cast("long").alias("adjacent")).where("adjacent > 0")


def topology_signature(outlines: DataFrame) -> DataFrame:
    """doc_id, components, holes, islands, max_depth, adjacent: counts that a redrawn document must keep."""
    of = classes(outlines, _DOC)
    shapes = cut(firsts(outlines, of, _DOC))
    tree = for_all(_tree(shapes), of, _DOC)
    kind = lambda r: F.count(F.when(F.col("role") == r, 1))
    counts = tree.groupBy("doc_id").agg(F.count("*").alias("components"), kind("HOLE").alias("holes"), kind("ISLAND").alias("islands"), F.max("depth").alias("max_depth"))
    return counts.join(_adjacent(shapes, of), "doc_id", "left").withColumn("adjacent", F.coalesce("adjacent", F.lit(0).cast("long")))


def topology_invariants(approved: DataFrame, candidate: DataFrame) -> DataFrame:
    """doc_id, lost, added, holes_lost, violations, kept: signature and rings of a candidate's outlines against the approved ones'.

    Counts of components, holes and depth must be equal, adjacent pairs may differ by two; rings
    are lost or added by their numbers. A document on one side only has all its rings lost or added.
    """
    a, b = topology_signature(approved), topology_signature(candidate)
    rings = lambda df, c: df.select("doc_id", "ring_id").distinct().withColumn(c, F.lit(1))
    moved = rings(approved, "a").join(rings(candidate, "b"), ["doc_id", "ring_id"], "full").groupBy("doc_id").agg(F.count(F.when(F.col("b").isNull(), 1)).alias("lost"), F.count(F.when(F.col("a").isNull(), 1)).alias("added"))
    names = ["components", "holes", "max_depth", "adjacent"]
    zero = lambda df, p: df.select("doc_id", *(F.col(c).alias(f"{p}_{c}") for c in names))
    both = zero(a, "a").join(zero(b, "b"), "doc_id", "full")
    of = lambda p, c: F.coalesce(f"{p}_{c}", F.lit(0))
    rules = [F.when(of("a", c) != of("b", c), F.lit(n)) for c, n in (("components", "COMPONENT_COUNT"), ("holes", "HOLE_COUNT"), ("max_depth", "NESTING_DEPTH"))]
    rules.append(F.when(F.abs(of("a", "adjacent") - of("b", "adjacent")) > 2, F.lit("ADJACENCY")))
    told = both.select("doc_id", F.greatest(of("a", "holes") - of("b", "holes"), F.lit(0)).alias("holes_lost"), F.concat_ws(",", *rules).alias("violations"))
    return told.join(moved, "doc_id").select("doc_id", "lost", "added", "holes_lost", "violations", (F.col("violations") == "").alias("kept"))


def _offers(sources: DataFrame, targets: DataFrame, far: float) -> DataFrame:
    """doc_id, fill, a_id, b_id, iou, within, apart, ratio: compatible pairs near each other; they meet in the first cell that both reach."""
    cell = 128
    span = lambda low, high: f"explode(sequence(CAST(floor(({low}) / {cell}) AS BIGINT), CAST(floor(({high}) / {cell}) AS BIGINT)))"

    def spread(df: DataFrame, p: str, grow: float) -> DataFrame:
        box = df.selectExpr("doc_id", "fill", f"node_id AS {p}_id", f"x0 AS {p}_x0", f"y0 AS {p}_y0", f"x1 AS {p}_x1", f"y1 AS {p}_y1")
        cells = box.selectExpr("*", span(f"{p}_x0 - {grow}", f"{p}_x1 + {grow}") + " AS cx").selectExpr("*", span(f"{p}_y0 - {grow}", f"{p}_y1 + {grow}") + " AS cy")
        return cells.selectExpr("*", f"CAST(floor(({p}_x0 - {grow}) / {cell}) AS BIGINT) AS {p}_fx", f"CAST(floor(({p}_y0 - {grow}) / {cell}) AS BIGINT) AS {p}_fy")

    pairs = spread(sources, "a", far).join(spread(targets, "b", 0.0), ["doc_id", "fill", "cx", "cy"]).where("cx = greatest(a_fx, b_fx) AND cy = greatest(a_fy, b_fy)")
    shared = "greatest(0e0, least(a_x1, b_x1) - greatest(a_x0, b_x0)) * greatest(0e0, least(a_y1, b_y1) - greatest(a_y0, b_y0))"
    sized = pairs.selectExpr(
        "doc_id", "fill", "a_id", "b_id", "(a_x1 - a_x0) * (a_y1 - a_y0) AS a_area", "(b_x1 - b_x0) * (b_y1 - b_y0) AS b_area", f"{shared} AS shared",
        "sqrt(power((a_x0 + a_x1 - b_x0 - b_x1) / 2, 2) + power((a_y0 + a_y1 - b_y0 - b_y1) / 2, 2)) AS gap",
    ).where("a_area > 0 AND b_area > 0")
    told = sized.selectExpr("doc_id", "fill", "a_id", "b_id", "round(shared / (a_area + b_area - shared), 9) AS iou", "round(shared / a_area, 9) AS within", "round(gap, 9) AS apart", "round(b_area / greatest(1e0, a_area), 9) AS ratio")
    return told.where(f"iou > 0.05 OR within > 0.5 OR apart < {far}")


def _equal_boxes(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct boxes with the smallest node of each, and doc_id, fill, first, node_id of all nodes."""
    same = ["doc_id", "fill", "x0", "y0", "x1", "y1"]
    kinds = cut(boxes.groupBy(*same).agg(F.min("node_id").alias("node_id")))
    return kinds, boxes.select(*same, "node_id").join(kinds.withColumnRenamed("node_id", "first"), same).select("doc_id", "fill", "first", "node_id")


def _take(level: list[tuple], left: tuple[dict, dict]) -> Iterator[tuple[int, int, tuple]]:
    """Pairs of one rank: offers (a, b, ...) between boxes with nodes left; the smaller source goes first and takes the smallest target of all its boxes."""
    ties: dict[int, list[tuple]] = {}
    for offer in level:
        ties.setdefault(offer[0], []).append(offer)
    queue = [(left[0][a][-1], a) for a in ties if left[0][a]]
    heapq.heapify(queue)
    while queue:
        node, a = heapq.heappop(queue)
        open_ones = [(left[1][o[1]][-1], o) for o in ties[a] if left[1][o[1]]]
        if open_ones:
            target, offer = min(open_ones, key=lambda p: p[0])
            left[0][a].pop()
            left[1][offer[1]].pop()
            yield node, target, offer
            if left[0][a]:
                heapq.heappush(queue, (left[0][a][-1], a))


_MATCHES = "doc_id long, a_id long, b_id long, iou double, within double, apart double, ratio double"


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of documents and fills one after the other: the nodes of their boxes first, then offers by rank. The nodes are held, offers pass by."""
    group, left, level, rank = None, ({}, {}), [], None
    for batch in batches:
        rows: list[tuple] = []
        doc, fill, kind, a, b = (batch.column(k).to_pylist() for k in range(5))
        iou, within, apart, ratio = (batch.column(k) for k in range(5, 9))
        for k in range(batch.num_rows):
            if group != (doc[k], fill[k]):
                rows += [(group[0], m, n, *o[2:]) for m, n, o in _take(level, left)] if level else []
                group, left, level, rank = (doc[k], fill[k]), ({}, {}), [], None
            if kind[k] < 2:
                left[kind[k]].setdefault(a[k], []).append(b[k])  # largest first
            elif left[0][a[k]] and left[1][b[k]]:
                offer = (a[k], b[k], iou[k].as_py(), within[k].as_py(), apart[k].as_py(), ratio[k].as_py())
                if rank != (offer[2], offer[4]):
                    rows += [(doc[k], m, n, *o[2:]) for m, n, o in _take(level, left)]
                    level, rank = [], (offer[2], offer[4])
                level.append(offer)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [c.split()[0] for c in _MATCHES.split(", ")])
    if level and (rows := [(group[0], m, n, *o[2:]) for m, n, o in _take(level, left)]):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [c.split()[0] for c in _MATCHES.split(", ")])


def match_components(sources: DataFrame, targets: DataFrame, far: float = 100.0, least_iou: float = 0.35, most_drift: float = 30.0, least_ratio: float = 0.4, most_ratio: float = 2.5) -> DataFrame:
    """doc_id, a_id, b_id, iou, apart, ratio, status: every source with at most one target, no target used twice.

    sources and targets(doc_id, node_id, fill, x0, y0, x1, y1) of one fill may match. Pairs rank by
    overlap, then distance, then numbers, alike for both sides, and are taken in that order where
    both are left. That matching is the only stable one, whatever the order of rows. Equal boxes
    are compared once; a task takes the offers of a document and fill by rank and holds its nodes. Status: PRESERVED, MERGED (far larger target),
    SHRUNK (far smaller) or LOST (no target near or alike enough, then b_id is null).
    """
    (kinds_a, nodes_a), (kinds_b, nodes_b) = _equal_boxes(sources), _equal_boxes(targets)
    nothing = ["CAST(NULL AS DOUBLE) AS iou", "CAST(NULL AS DOUBLE) AS within", "CAST(NULL AS DOUBLE) AS apart", "CAST(NULL AS DOUBLE) AS ratio"]
    stream = _offers(kinds_a, kinds_b, far).selectExpr("doc_id", "fill", "2 AS kind", "a_id AS a", "b_id AS b", "iou", "within", "apart", "ratio")
    for kind, nodes in enumerate((nodes_a, nodes_b)):
        stream = stream.unionByName(nodes.selectExpr("doc_id", "fill", f"{kind} AS kind", "first AS a", "node_id AS b", *nothing))
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = stream.repartition(tasks, "doc_id", "fill").sortWithinPartitions("doc_id", "fill", "kind", F.desc("iou"), "apart", "a", F.desc("b")).mapInArrow(_match, _MATCHES)
    alike = f"(iou >= {least_iou} OR within >= 0.7 OR (apart <= {most_drift} AND ratio >= {least_ratio}))"
    told = sources.selectExpr("doc_id", "node_id AS a_id").join(taken, ["doc_id", "a_id"], "left")
    status = f"CASE WHEN b_id IS NULL OR NOT {alike} THEN 'LOST' WHEN ratio > {most_ratio} THEN 'MERGED' WHEN ratio < {least_ratio} THEN 'SHRUNK' ELSE 'PRESERVED' END"
    return told.selectExpr("doc_id", "a_id", "b_id", "iou", "apart", "ratio", f"{status} AS status").selectExpr(
        "doc_id", "a_id", "IF(status = 'LOST', NULL, b_id) AS b_id", "IF(status = 'LOST', NULL, iou) AS iou", "IF(status = 'LOST', NULL, apart) AS apart", "IF(status = 'LOST', NULL, ratio) AS ratio", "status"
    )
