"""Planar map of a label image: every boundary stored once between its two owners, rings by next-links.

Pixels meet at corners. The four labels around a corner say how each owner's outline goes
on there, so one aggregate over corners gives all links; no image is held in one task.
A side of a pixel has the number y * 2**34 + x * 4 + side (top, right, bottom, left, walked
with the pixel on the right in a picture whose y grows downwards).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.operators.chains import follow

_TILE = 256


def corners(labels: DataFrame) -> DataFrame:
    """image_id, vx, vy, nw, ne, sw, se: the labels around every corner where they differ; outside and unlabelled is null."""
    at = F.array(*[F.struct((F.col("x") + dx).alias("vx"), (F.col("y") + dy).alias("vy"), F.lit(s).alias("slot")) for dx, dy, s in ((1, 1, "nw"), (0, 1, "ne"), (1, 0, "sw"), (0, 0, "se"))])
    spread = labels.where("label IS NOT NULL").select("image_id", F.col("label").cast("long").alias("label"), F.explode(at).alias("c")).select("image_id", "label", "c.vx", "c.vy", "c.slot")
    around = spread.groupBy("image_id", "vx", "vy").agg(*[F.max(F.when(F.col("slot") == s, F.col("label"))).alias(s) for s in ("nw", "ne", "sw", "se")])
    return around.where("NOT (nw <=> ne AND nw <=> sw AND nw <=> se)")


def half_edges(labels: DataFrame) -> DataFrame:
    """image_id, e, nxt, label, other, x0, y0, x1, y1, junction: sides of pixels between two owners, with the side that follows in the owner's outline.

    The outline keeps to its owner: where a corner touches two of its pixels diagonally it
    turns towards the pixel it runs along. junction: more than two boundaries meet at its end.
    """
    number = lambda x, y, side: f"CAST(({y}) * 17179869184 + ({x}) * 4 + {side} AS BIGINT)"
    # Slot, its side that ends at the corner, the pixel across, ahead on the own side, ahead across.
    turns = [
        ("sw", 0, "nw", "se", "ne", ("vx - 1", "vy"), ("vx", "vy"), ("vx", "vy - 1")),
        ("nw", 1, "ne", "sw", "se", ("vx - 1", "vy - 1"), ("vx - 1", "vy"), ("vx", "vy")),
        ("ne", 2, "se", "nw", "sw", ("vx", "vy - 1"), ("vx - 1", "vy - 1"), ("vx - 1", "vy")),
        ("se", 3, "sw", "ne", "nw", ("vx", "vy"), ("vx", "vy - 1"), ("vx - 1", "vy - 1")),
    ]
    back = {0: ("vx - 1", "vy"), 1: ("vx", "vy - 1"), 2: ("vx + 1", "vy"), 3: ("vx", "vy + 1")}
    rows = []
    for own, side, across, ahead, beyond, mine, theirs, diagonal in turns:
        nxt = f"CASE WHEN NOT ({ahead} <=> {own}) THEN {number(*mine, (side + 1) % 4)} WHEN NOT ({beyond} <=> {own}) THEN {number(*theirs, side)} ELSE {number(*diagonal, (side + 3) % 4)} END"
        exists = f"{own} IS NOT NULL AND NOT ({own} <=> {across})"
        rows.append(f"CASE WHEN {exists} THEN named_struct('e', {number(*mine, side)}, 'nxt', {nxt}, 'label', {own}, 'other', {across}, 'x0', {back[side][0]}, 'y0', {back[side][1]}, 'x1', vx, 'y1', vy) END")
    meeting = "CAST(NOT (nw <=> ne) AS INT) + CAST(NOT (ne <=> se) AS INT) + CAST(NOT (se <=> sw) AS INT) + CAST(NOT (sw <=> nw) AS INT) > 2 AS junction"
    return corners(labels).selectExpr("image_id", meeting, f"inline(filter(array({', '.join(rows)}), s -> s IS NOT NULL))").select("image_id", "e", "nxt", "label", "other", "x0", "y0", "x1", "y1", "junction")


def _tiled(edges: DataFrame) -> DataFrame:
    return edges.withColumn("tx", F.floor(F.col("x0") / _TILE)).withColumn("ty", F.floor(F.col("y0") / _TILE))


def outlines(labels: DataFrame) -> DataFrame:
    """image_id, label, ring, pos, n, x, y: closed outlines of every label, corner by corner."""
    placed = follow(_tiled(half_edges(labels)), ["image_id"], ["tx", "ty"], ("label", "x0", "y0"))
    return placed.select("image_id", "label", "ring", "pos", "n", F.col("x0").alias("x"), F.col("y0").alias("y"))


def trace_rings(labels: DataFrame) -> DataFrame:
    """image_id, label, ring_no, is_hole, points, area: closed outlines of every label, holes turn the other way; rings are numbered by their first side."""
    placed = follow(_tiled(half_edges(labels)), ["image_id"], ["tx", "ty"], ("label", "x0", "y0", "x1", "y1"))
    sums = placed.groupBy("image_id", "label", "ring").agg(F.min("e").alias("first"), F.count("*").alias("points"), (F.sum(F.expr("x0 * y1 - x1 * y0")) / 2).alias("area"))
    number = F.row_number().over(Window.partitionBy("image_id", "label").orderBy("first")) - 1
    return sums.select("image_id", "label", number.cast("long").alias("ring_no"), (F.col("area") < 0).alias("is_hole"), "points", F.abs("area").alias("area"))


def shared_boundaries(labels: DataFrame) -> DataFrame:
    """image_id, arc, label, other, pos, n, closed, x0, y0, x1, y1: each boundary once, side by side from junction to junction.

    It is held by the owner with the smaller label (the only one, where the other side is
    null) and runs with that owner on its right; the other owner's outline is the same
    points backwards, so that neighbours share their geometry whatever is done to an arc.
    """
    edges = half_edges(labels).where("other IS NULL OR label < other")
    open_ended = edges.withColumn("nxt", F.when(~F.col("junction"), F.col("nxt")))
    arcs = follow(_tiled(open_ended), ["image_id"], ["tx", "ty"], ("label", "other", "x0", "y0", "x1", "y1"))
    return arcs.select("image_id", F.col("ring").alias("arc"), "label", "other", "pos", "n", "closed", "x0", "y0", "x1", "y1")


def dissolve_seams(labels: DataFrame, owners: DataFrame) -> DataFrame:
    """image_id, arc, label, other, pos, n, closed, x0, y0, x1, y1 of the map in which labels of one owner are one face.

    owners(image_id, label, owner); a label without an owner is its own. Seams between labels
    of an owner go, and with them the junctions that only seams made.
    """
    named = labels.join(owners.select("image_id", "label", "owner"), ["image_id", "label"], "left")
    return shared_boundaries(named.select("image_id", "x", "y", F.coalesce("owner", "label").alias("label")))
