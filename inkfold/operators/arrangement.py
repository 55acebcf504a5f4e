"""Union and offset of free outlines: arrangement of segments on an integer grid, winding numbers, rings by next-links.

outlines(doc_id, ring_id, pos, x, y), closed without a repeated last point, of any shape:
holes, touching and self-crossing rings, in any direction; a point belongs to the union if
its winding number is not zero. Coordinates are rounded to units of 1e-5 mm. Segments are
cut where they meet, the meeting points rounded too, until no cut is left; segments that
meet are found by grid cells, winding numbers from the corner of a cell on, so that a document
is spread over tasks by its cells.

Between two points of a cell the winding number changes by no more than the segments that pass
the cell. A cell whose corner winds more often than that lies inside the union: no edge of it is
there, and neither meetings nor sides are looked at. The pile of a document's art so costs
what its rim costs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.operators.chains import follow
from inkfold.operators.graph import cut

UNIT = 100_000  # of a millimetre
_CELL, _TILE = 2 * UNIT, 512 * UNIT
_SHIFT = UNIT // 2  # of the cells' corners, since art often lies on whole millimetres
_SLACK = 16  # units by which a piece may lie beside its segment after all rounds
_BESIDE = 0.3819660112501051  # winding numbers are known at this much to the left of and below a cell, in line with no end


def segments(outlines: DataFrame) -> DataFrame:
    """doc_id, x1, y1, x2, y2, w: sides of rings in units, from the smaller end to the larger one, with how often they are walked that way."""
    order = Window.partitionBy("doc_id", "ring_id").orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    unit = lambda c: F.round(F.col(c) * UNIT).cast("long")
    points = outlines.where("x IS NOT NULL AND y IS NOT NULL").select("doc_id", "ring_id", "pos", unit("x").alias("x1"), unit("y").alias("y1"))
    sides = points.select("doc_id", "x1", "y1", *(F.coalesce(F.lead(c).over(order), F.first(c).over(whole)).alias(n) for c, n in (("x1", "x2"), ("y1", "y2"))))
    return _netted(sides.withColumn("w", F.lit(1).cast("long")))


def _netted(sides: DataFrame, *more: Column) -> DataFrame:
    """Equal segments as one, with aggregates asked for; those walked as often both ways are left out: they bound nothing and change no winding number."""
    forth = "(x1 < x2 OR (x1 = x2 AND y1 < y2))"
    ends = [f"IF({forth}, {a}, {b}) AS {n}" for a, b, n in (("x1", "x2", "x1"), ("y1", "y2", "y1"), ("x2", "x1", "x2"), ("y2", "y1", "y2"))]
    rest = [c for c in sides.columns if c not in ("doc_id", "x1", "y1", "x2", "y2", "w")]
    canon = sides.where("x1 <> x2 OR y1 <> y2").selectExpr("doc_id", *ends, f"IF({forth}, w, -w) AS w", *rest)
    return canon.groupBy("doc_id", "x1", "y1", "x2", "y2").agg(F.sum("w").alias("w"), *more).where("w <> 0")


def _by_cells(segs: DataFrame) -> DataFrame:
    """Every segment under the grid cells that it passes, or passes by within the slack."""
    rows = segs.withColumn("cy", F.explode(F.expr(f"sequence({_cell(f'least(y1, y2) - {_SLACK}')}, {_cell(f'greatest(y1, y2) + {_SLACK}')})")))
    at = lambda y: f"IF(y1 = y2, x1, x1 + (x2 - x1) * ((least(greatest({y}, least(y1, y2)), greatest(y1, y2)) - y1) / (y2 - y1)))"
    low, high = at(f"cy * {_CELL} - {_SHIFT + _SLACK}"), at(f"(cy + 1) * {_CELL} - {_SHIFT - _SLACK}")
    flat = "IF(y1 = y2, least(x1, x2), least({0}, {1}) - 1)", "IF(y1 = y2, greatest(x1, x2), greatest({0}, {1}) + 1)"
    span = [_cell(f"{f.format(low, high)} {slack}") for f, slack in zip(flat, (f"- {_SLACK}", f"+ {_SLACK}"), strict=True)]
    return rows.withColumn("cx", F.explode(F.expr(f"sequence({span[0]}, {span[1]})")))


def _cell(v: str) -> str:
    return f"CAST(floor(({v} + {_SHIFT}) / {_CELL}) AS BIGINT)"


def _windings(segs: DataFrame, cells: DataFrame) -> DataFrame:
    """cells(doc_id, cx, cy, touch) with winding, the number beside their lower left corner: turns of segments along the line of corners, summed from the left."""
    beside = _SHIFT + _BESIDE
    level = f"(cy * {_CELL} - {beside})"
    rows = segs.where("y1 <> y2").selectExpr("*", f"explode(sequence({_cell('least(y1, y2)')}, {_cell('greatest(y1, y2)')} + 1)) AS cy").where(f"least(y1, y2) < {level} AND {level} < greatest(y1, y2)")
    met = rows.selectExpr("doc_id", f"CAST(floor((x1 + (x2 - x1) * (({level} - y1) / (y2 - y1)) + {beside}) / {_CELL}) AS BIGINT) + 1 AS cx", "cy", "CAST(-w * sign(y2 - y1) AS BIGINT) AS turn", "CAST(NULL AS BIGINT) AS touch")
    marks = met.unionByName(cells.selectExpr("doc_id", "cx", "cy", "CAST(0 AS BIGINT) AS turn", "touch")).groupBy("doc_id", "cx", "cy").agg(F.sum("turn").alias("turn"), F.max("touch").alias("touch"))
    line = Window.partitionBy("doc_id", "cy").orderBy("cx")
    return marks.select("doc_id", "cx", "cy", "touch", F.sum("turn").over(line).alias("winding")).where("touch IS NOT NULL")


def _open_cells(segs: DataFrame) -> DataFrame:
    """doc_id, cx, cy, touch: cells in which the winding number may be zero."""
    touched = _by_cells(segs).groupBy("doc_id", "cx", "cy").agg(F.sum(F.abs("w")).alias("touch"))
    return _windings(segs, touched).where("abs(winding) <= touch").select("doc_id", "cx", "cy", "touch")


def _cuts(cells: DataFrame) -> DataFrame:
    """sid, px, py: points inside a segment at which another one meets it; pairs without a fresh segment are known to be apart."""
    cells = cells.select("doc_id", "cx", "cy", "sid", "fresh", "x1", "y1", "x2", "y2")
    other = cells.select("doc_id", "cx", "cy", *(F.col(c).alias(f"o_{c}") for c in ("sid", "fresh", "x1", "y1", "x2", "y2")))
    near = cells.where("fresh").join(other, ["doc_id", "cx", "cy"]).where(
        "sid <> o_sid AND (NOT o_fresh OR sid < o_sid) AND least(x1, x2) <= greatest(o_x1, o_x2) AND least(o_x1, o_x2) <= greatest(x1, x2) AND least(y1, y2) <= greatest(o_y1, o_y2) AND least(o_y1, o_y2) <= greatest(y1, y2)"
    )
    return near.select("sid", "o_sid", *_ENDS).mapInArrow(_meetings, "sid long, px long, py long").distinct()


_ENDS = ("x1", "y1", "x2", "y2", "o_x1", "o_y1", "o_x2", "o_y2")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sid, px, py for pairs of segments: where they cross, at units; segments along one another are cut at each other's ends."""
    for batch in batches:
        sid, o_sid, x1, y1, x2, y2, ox1, oy1, ox2, oy2 = (c.to_numpy() for c in batch.columns)
        det = (x2 - x1) * (oy2 - oy1) - (y2 - y1) * (ox2 - ox1)
        t = (ox1 - x1) * (oy2 - oy1) - (oy1 - y1) * (ox2 - ox1)
        u = (ox1 - x1) * (y2 - y1) - (oy1 - y1) * (x2 - x1)
        sign, size = np.sign(det), np.abs(det)
        crosses = (det != 0) & (t * sign >= 0) & (t * sign <= size) & (u * sign >= 0) & (u * sign <= size)
        share = t / np.where(det == 0, 1, det)

        def at(a: np.ndarray, b: np.ndarray, oa: np.ndarray, ob: np.ndarray) -> np.ndarray:
            v = a + (b - a) * share
            near = (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int64)
            return np.select([t == 0, t == det, u == 0, u == det], [a, b, oa, ob], near)

        px, py = at(x1, x2, ox1, ox2), at(y1, y2, oy1, oy2)
        found = [(sid, px, py, crosses & ~((px == x1) & (py == y1)) & ~((px == x2) & (py == y2))), (o_sid, px, py, crosses & ~((px == ox1) & (py == oy1)) & ~((px == ox2) & (py == oy2)))]
        along = (det == 0) & (u == 0)
        for whose, x, y, a, b, c, d in (
            (sid, ox1, oy1, x1, y1, x2, y2), (sid, ox2, oy2, x1, y1, x2, y2), (o_sid, x1, y1, ox1, oy1, ox2, oy2), (o_sid, x2, y2, ox1, oy1, ox2, oy2),
        ):
            found.append((whose, x, y, along & ((x - a) * (c - a) + (y - b) * (d - b) > 0) & ((x - c) * (a - c) + (y - d) * (b - d) > 0)))
        columns = [np.concatenate([f[k][f[3]] for f in found]) for k in range(3)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(np.stack(columns, axis=1), axis=0).T], ["sid", "px", "py"])


def arrange(segs: DataFrame, most_rounds: int = 12) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same segments cut so that any two share no more than ends in open cells, as (sid, doc_id, x1, y1, x2, y2, w); those in open cells under each of them; and the open cells."""
    numbered = lambda s: cut(s.withColumn("sid", F.monotonically_increasing_id()))
    state = numbered(segs.withColumn("fresh", F.lit(True)))
    cells = cut(_open_cells(state))
    for _ in range(most_rounds):
        placed = cut(_by_cells(state).join(cells.select("doc_id", "cx", "cy"), ["doc_id", "cx", "cy"], "left_semi"))
        cuts = cut(_cuts(placed))
        if not cuts.limit(1).count():
            return state, placed, cells
        points = cuts.groupBy("sid").agg(F.collect_list(F.struct("px", "py")).alias("points"))
        far = "(p.px - x1) * (p.px - x1) + (p.py - y1) * (p.py - y1)"
        joined = state.join(points, "sid")
        # Ends and cuts in order along the segment.
        path = F.expr(f"array_sort(transform(concat(array(named_struct('px', x1, 'py', y1), named_struct('px', x2, 'py', y2)), points), p -> named_struct('far', {far}, 'px', p.px, 'py', p.py)))")
        pieces = joined.select("doc_id", "w", path.alias("path")).select("doc_id", "w", F.explode(F.expr("transform(slice(path, 2, size(path) - 1), (b, i) -> named_struct('a', path[i], 'b', b))")).alias("s"))
        made = pieces.selectExpr("doc_id", "s.a.px AS x1", "s.a.py AS y1", "s.b.px AS x2", "s.b.py AS y2", "w")
        # A segment that lies on a new piece is the same segment again, and new.
        rest = state.join(points.select("sid"), "sid", "left_anti")
        both = made.withColumn("fresh", F.lit(True)).unionByName(rest.select("doc_id", "x1", "y1", "x2", "y2", "w").withColumn("fresh", F.lit(False)))
        state = numbered(_netted(both, F.min("fresh").alias("fresh")))
    raise RuntimeError("segments did not settle")


def boundary(planar: DataFrame, placed: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, x1, y1, x2, y2: directed sides of the union, which lies to their left (y grows upwards), of what arrange() returns."""
    corners = cut(_windings(planar, cells))
    out = None
    # Sides that rise or fall are probed at their middle along x, level ones along y: across is the axis of the last leg, from the corner's line to the side.
    for level, across, along in ((False, "x", "y"), (True, "y", "x")):
        a1, a2, b1, b2 = f"{across}1", f"{across}2", f"{along}1", f"{along}2"
        probes = planar.where("y1 = y2" if level else "y1 <> y2").selectExpr("doc_id", "sid", "x1", "y1", "x2", "y2", "w", f"({a1} + {a2}) / 2 AS qa", f"({b1} + {b2}) / 2 AS qb", f"{_cell('(x1 + x2) / 2')} AS cx", f"{_cell('(y1 + y2) / 2')} AS cy")
        probes = probes.join(corners.drop("touch"), ["doc_id", "cx", "cy"]).selectExpr("*", f"c{across} * {_CELL} - {_SHIFT + _BESIDE} AS a0", f"c{along} * {_CELL} - {_SHIFT + _BESIDE} AS b0")
        walls = placed.selectExpr("doc_id", "cx", "cy", "sid AS wall", f"{a1} AS a1", f"{b1} AS b1", f"{a2} AS a2", f"{b2} AS b2", "w AS ww")
        # The first leg goes along the corner's line up to the middle of the side, that much further that it meets no end there.
        first = "a1 <> a2 AND least(a1, a2) < a0 AND a0 < greatest(a1, a2) AND b0 < b1 + (b2 - b1) * ((a0 - a1) / nullif(a2 - a1, 0)) AND b1 + (b2 - b1) * ((a0 - a1) / nullif(a2 - a1, 0)) <= qb"
        second = "wall <> sid AND b1 <> b2 AND least(b1, b2) <= qb AND qb < greatest(b1, b2) AND a0 < a1 + (a2 - a1) * ((qb - b1) / nullif(b2 - b1, 0)) AND a1 + (a2 - a1) * ((qb - b1) / nullif(b2 - b1, 0)) < qa"
        # Towards larger x a rising side leads to a smaller number, towards larger y a side to the right to a larger one.
        turn = "" if level else "-"
        crossed = probes.join(walls, ["doc_id", "cx", "cy"]).selectExpr("sid", f"IF({first}, -({turn}ww) * sign(a2 - a1), 0) + IF({second}, {turn}ww * sign(b2 - b1), 0) AS turn").where("turn <> 0")
        before = crossed.groupBy("sid").agg(F.expr("CAST(sum(turn) AS BIGINT)").alias("more"))
        own = "w" if level else "-w * CAST(sign(y2 - y1) AS BIGINT)"
        told = probes.join(before, "sid", "left").selectExpr("doc_id", "x1", "y1", "x2", "y2", "winding + coalesce(more, 0) <> 0 AS lower_in", f"winding + coalesce(more, 0) + {own} <> 0 AS upper_in")
        edge = told.where("lower_in <> upper_in")
        # The smaller side of a rising edge is its left; the smaller side of an edge to the right is its right.
        forth = "upper_in" if level else "lower_in = (y2 > y1)"
        made = edge.selectExpr("doc_id", *(f"IF({forth}, {p}, {q}) AS {n}" for p, q, n in (("x1", "x2", "x1"), ("y1", "y2", "y1"), ("x2", "x1", "x2"), ("y2", "y1", "y2"))))
        out = made if out is None else out.unionByName(made)
    return out


def rings(sides: DataFrame) -> DataFrame:
    """doc_id, ring_id, pos, n, x, y in units: directed sides joined to rings, without points on straight lines, each from its smallest point on.

    Where rings touch in a point, the one that turns most towards the inside goes on, so
    that parts which only touch stay apart. ring_id counts the rings of a document by their smallest points.
    """
    sides = cut(sides.withColumn("e", F.monotonically_increasing_id()))
    leaving = sides.selectExpr("doc_id", "e AS nxt", "x1 AS x2", "y1 AS y2", "x2 - x1 AS ox", "y2 - y1 AS oy")
    turn = F.expr("atan2(CAST((x2 - x1) * oy - (y2 - y1) * ox AS DOUBLE), CAST((x2 - x1) * ox + (y2 - y1) * oy AS DOUBLE))")
    links = sides.join(leaving, ["doc_id", "x2", "y2"]).groupBy("doc_id", "e", "x1", "y1").agg(F.max_by("nxt", turn).alias("nxt"))
    tile = lambda c: F.floor((F.col(c) + _TILE / 4) / _TILE)  # noqa: E731  art reaches beyond the origin, and seldom far
    tiles = links.withColumns({"tx": tile("x1"), "ty": tile("y1")})
    placed = follow(tiles, ["doc_id"], ["tx", "ty"], ("x1", "y1"))
    ring = Window.partitionBy("doc_id", "ring").orderBy("pos")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = placed.select(
        "doc_id", "ring", "pos", "x1", "y1", *(F.coalesce(F.lag(c).over(ring), F.last(c).over(whole)).alias(f"p{c}") for c in ("x1", "y1")), *(F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)).alias(f"n{c}") for c in ("x1", "y1"))
    )
    bent = around.where("(x1 - px1) * (ny1 - y1) - (y1 - py1) * (nx1 - x1) <> 0")
    first = F.min(F.struct("x1", "y1", "pos")).over(Window.partitionBy("doc_id", "ring"))
    turned = bent.withColumn("first", first)
    order = Window.partitionBy("doc_id", "ring").orderBy(F.col("pos") < F.col("first.pos"), "pos")
    cleaned = turned.select("doc_id", "ring", "first", (F.row_number().over(order) - 1).cast("long").alias("pos"), F.count("*").over(Window.partitionBy("doc_id", "ring")).alias("n"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    numbers = cleaned.where("pos = 0").select("doc_id", "ring", (F.row_number().over(Window.partitionBy("doc_id").orderBy("first.x1", "first.y1", "n", "ring")) - 1).cast("long").alias("ring_id"))
    return cleaned.join(numbers, ["doc_id", "ring"]).select("doc_id", "ring_id", "pos", "n", "x", "y")


def _in_mm(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "ring_id", "pos", "n", (F.col("x") / UNIT).alias("x"), (F.col("y") / UNIT).alias("y"))


def union(outlines: DataFrame) -> DataFrame:
    """doc_id, ring_id, pos, n, x, y: rings of the union of a document's outlines; outer ones turn left, holes right. Documents without area have none."""
    return _in_mm(rings(boundary(*arrange(segments(outlines)))))


def _pieces(sides: DataFrame, offset_mm: float, join: str, miter_limit: float, arc_tolerance_mm: float) -> DataFrame:
    """doc_id, ring_id, pos, x, y: for every side of a ring the strip beside it, for every outward corner its join, all turning left."""
    step = 2 * math.acos(max(0.0, 1 - min(arc_tolerance_mm, offset_mm) / offset_mm))
    out = f"named_struct('x', x + {offset_mm} * (ny - y) / len, 'y', y - {offset_mm} * (nx - x) / len)"
    out_next = f"named_struct('x', nx + {offset_mm} * (ny - y) / len, 'y', ny - {offset_mm} * (nx - x) / len)"
    strip = sides.selectExpr("doc_id", "ring", "pos", "0 AS kind", f"array({out}, {out_next}, named_struct('x', nx, 'y', ny), named_struct('x', x, 'y', y)) AS points")
    # Directions of the two normals at a corner and the angle between them.
    corners = sides.where("cross > 0 OR (cross = 0 AND dot < 0)").selectExpr("doc_id", "ring", "pos", "x", "y", "atan2(-(x - px), y - py) AS from_angle", "atan2(CAST(cross AS DOUBLE), CAST(dot AS DOUBLE)) AS bend")
    arm = lambda angle, size: f"named_struct('x', x + {size} * cos({angle}), 'y', y + {size} * sin({angle}))"
    here, start, stop = "named_struct('x', x, 'y', y)", arm("from_angle", offset_mm), arm("from_angle + bend", offset_mm)
    if join == "round":
        arcs = f"greatest(1, CAST(ceil(bend / {step}) AS INT))"
        fan = f"concat(array({here}), transform(sequence(0, {arcs}), k -> {arm(f'from_angle + bend * k / {arcs}', offset_mm)}))"
    elif join == "miter":
        tip = arm("from_angle + bend / 2", f"{offset_mm} / greatest(cos(bend / 2), 1e-9)")
        fan = f"IF(cos(bend / 2) * {miter_limit} >= 1, array({here}, {start}, {tip}, {stop}), array({here}, {start}, {stop}))"
    elif join == "bevel":
        fan = f"array({here}, {start}, {stop})"
    else:
        raise ValueError(f"unknown join {join!r}")
    wedge = corners.selectExpr("doc_id", "ring", "pos", "1 AS kind", f"{fan} AS points")
    made = strip.unionByName(wedge).select("doc_id", F.struct("ring", "pos", "kind").alias("ring_id"), F.posexplode("points").alias("pos", "p"))
    return made.select("doc_id", "ring_id", "pos", "p.x", "p.y")


def offset(outlines: DataFrame, offset_mm: float, join: str = "round", miter_limit: float = 2.0, arc_tolerance_mm: float = 0.02) -> DataFrame:
    """doc_id, ring_id, pos, n, x, y: rings of the outlines' union grown by a distance; joins are round (to a tolerance), miter (to a limit, else bevel) or bevel."""
    if not 0.05 <= offset_mm <= 50:
        raise ValueError("offset must lie between 0.05 and 50 mm")
    base = cut(union(outlines))
    order = Window.partitionBy("doc_id", "ring_id").orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = base.select(
        "doc_id", F.col("ring_id").alias("ring"), "pos", "x", "y", *(F.coalesce(F.lag(c).over(order), F.last(c).over(whole)).alias(f"p{c}") for c in ("x", "y")), *(F.coalesce(F.lead(c).over(order), F.first(c).over(whole)).alias(f"n{c}") for c in ("x", "y"))
    )
    sides = around.selectExpr("*", "sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS len", "(x - px) * (ny - y) - (y - py) * (nx - x) AS cross", "(x - px) * (nx - x) + (y - py) * (ny - y) AS dot")
    kept = base.select("doc_id", F.struct("ring_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("kind")).alias("ring_id"), F.col("pos").cast("int").alias("pos"), "x", "y")
    pieces = _pieces(sides, offset_mm, join, miter_limit, arc_tolerance_mm)
    every = kept.select("doc_id", F.col("ring_id").cast("string").alias("ring_id"), "pos", "x", "y").unionByName(pieces.select("doc_id", F.col("ring_id").cast("string").alias("ring_id"), "pos", "x", "y"))
    return union(every)


def ring_areas(found: DataFrame) -> DataFrame:
    """doc_id, ring_id, is_hole, points, area_mm2."""
    order = Window.partitionBy("doc_id", "ring_id").orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sides = found.select("doc_id", "ring_id", "x", "y", *(F.coalesce(F.lead(c).over(order), F.first(c).over(whole)).alias(f"n{c}") for c in ("x", "y")))
    sums = sides.groupBy("doc_id", "ring_id").agg(F.count("*").alias("points"), (F.sum(F.expr("x * ny - nx * y")) / 2).alias("area"))
    return sums.select("doc_id", "ring_id", (F.col("area") < 0).alias("is_hole"), "points", F.round(F.abs("area"), 6).alias("area_mm2"))


def cut_contours(outlines: DataFrame, offset_mm: float = 2.0, join: str = "round", inner: bool = False, least_mm2: float = 1.0) -> DataFrame:
    """doc_id, ring_id, pos, n, x, y, is_hole: cut lines around a document's art; holes only on demand, islands and holes below a least area left out, but not a document's only ring."""
    found = cut(offset(outlines, offset_mm, join))
    areas = ring_areas(found)
    largest = F.row_number().over(Window.partitionBy("doc_id").orderBy("is_hole", F.desc("area_mm2"), "ring_id")) == 1
    kept = areas.withColumn("largest", largest).where((F.col("area_mm2") >= least_mm2) | F.col("largest"))
    if not inner:
        kept = kept.where("NOT is_hole")
    return found.join(kept.select("doc_id", "ring_id", "is_hole"), ["doc_id", "ring_id"])


def covered_cells(found: DataFrame, pitch_mm: float = 4.0, shift_mm: float = 0.3137) -> DataFrame:
    """doc_id, row, cells: points of a grid inside rings, by the crossings to their left; between one crossing and the next the winding number holds."""
    order = Window.partitionBy("doc_id", "ring_id").orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sides = found.select("doc_id", "x", "y", *(F.coalesce(F.lead(c).over(order), F.first(c).over(whole)).alias(f"n{c}") for c in ("x", "y"))).where("y <> ny")
    index = lambda v: f"CAST(ceil(({v} - {shift_mm}) / {pitch_mm}) AS BIGINT)"
    rows = sides.selectExpr("*", f"explode(sequence({index('least(y, ny)')}, {index('greatest(y, ny)')})) AS row").where(f"least(y, ny) <= row * {pitch_mm} + {shift_mm} AND row * {pitch_mm} + {shift_mm} < greatest(y, ny)")
    met = rows.selectExpr("doc_id", "row", f"{index(f'x + (nx - x) * ((row * {pitch_mm} + {shift_mm} - y) / (ny - y))')} AS col", "-CAST(sign(ny - y) AS BIGINT) AS turn")
    steps = met.groupBy("doc_id", "row", "col").agg(F.sum("turn").alias("turn"))
    line = Window.partitionBy("doc_id", "row").orderBy("col")
    runs = steps.select("doc_id", "row", F.sum("turn").over(line).alias("winding"), (F.lead("col").over(line) - F.col("col")).alias("size"))
    return runs.where("winding <> 0").groupBy("doc_id", "row").agg(F.sum("size").alias("cells"))
