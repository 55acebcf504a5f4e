"""Path language to polylines: cursor, curves and arcs, one path of a streamed partition at a time."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def _area(ring: np.ndarray) -> float:
    nxt = np.roll(ring, -1, axis=0)
    return float((ring[:, 0] * nxt[:, 1] - nxt[:, 0] * ring[:, 1]).sum() / 2)


def arc_points(start: tuple[float, float], rx: float, ry: float, degrees: float, large: bool, sweep: bool, end: tuple[float, float], tolerance: float) -> list[tuple[float, float]]:
    """Points of an elliptical arc after its start, from the end-point form of the path language; radii too small are scaled up, a radius of zero is a line."""
    (x0, y0), (x1, y1) = start, end
    rx, ry = abs(rx), abs(ry)
    if start == end:
        return []
    if rx == 0 or ry == 0:
        return [end]
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    # Half the chord in the ellipse's own axes, as parts of the radii: the arc is one of a unit circle.
    u, v = (cos * (x0 - x1) + sin * (y0 - y1)) / 2 / rx, (cos * (y0 - y1) - sin * (x0 - x1)) / 2 / ry
    far = math.hypot(u, v)
    if far > 1:
        rx, ry, u, v, far = rx * far, ry * far, u / far, v / far, 1.0
    lift = math.sqrt(max(0.0, 1 - far * far)) / far * (-1 if large == sweep else 1)
    cu, cv = lift * v, -lift * u
    first, last = math.atan2(v - cv, u - cu), math.atan2(-v - cv, -u - cu)
    turn = (last - first) % (2 * math.pi) if sweep else -((first - last) % (2 * math.pi))
    count = max(1, math.ceil(abs(turn) / (2 * math.acos(max(0.0, 1 - min(1.0, tolerance / max(rx, ry)))))))
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    out = []
    for k in range(1, count):
        p, q = rx * (cu + math.cos(first + turn * k / count)), ry * (cv + math.sin(first + turn * k / count))
        out.append((mx + cos * p - sin * q, my + sin * p + cos * q))
    return [*out, end]


def flatten(commands: list[tuple[str, list[float]]], tolerance: float = 0.05) -> list[np.ndarray]:
    """Polylines of a path's subpaths; relative commands follow the cursor, curves are split until flat to the tolerance, arcs have points to the tolerance."""
    out: list[list[tuple[float, float]]] = []
    x = y = sx = sy = 0.0
    last = ("", 0.0, 0.0)

    def curve(p: list[tuple[float, float]], depth: int = 0) -> None:
        (x0, y0), (x3, y3) = p[0], p[-1]
        size = np.hypot(x3 - x0, y3 - y0) or 1e-12
        off = max(abs((x3 - x0) * (b - y0) - (y3 - y0) * (a - x0)) / size if size > 1e-9 else np.hypot(a - x0, b - y0) for a, b in p[1:-1])
        if off <= tolerance or depth >= 10:
            out[-1].append((x3, y3))
            return
        left, right, level = [p[0]], [p[-1]], p
        while len(level) > 1:
            level = [((a + c) / 2, (b + d) / 2) for (a, b), (c, d) in zip(level, level[1:], strict=False)]
            left.append(level[0])
            right.append(level[-1])
        curve(left, depth + 1)
        curve(right[::-1], depth + 1)

    sizes = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
    for letter, args in commands:
        kind, relative = letter.upper(), letter.islower()
        n = sizes[kind]
        groups = [args[k : k + n] for k in range(0, len(args) - n + 1, n)] if n else [[]]
        for g in groups:
            bx, by = (x, y) if relative else (0.0, 0.0)
            if kind == "Z":
                x, y = sx, sy
                if out and out[-1]:
                    out[-1].append((x, y))
            elif kind == "M":
                x, y = bx + g[0], by + g[1]
                sx, sy = x, y
                out.append([(x, y)])
                kind = "L"  # further pairs are lines
            else:
                if not out:
                    out.append([(x, y)])
                if kind in "HV":
                    x, y = (bx + g[0], y) if kind == "H" else (x, by + g[0])
                    out[-1].append((x, y))
                elif kind == "A":
                    end = (bx + g[5], by + g[6])
                    out[-1] += arc_points((x, y), g[0], g[1], g[2], g[3] != 0, g[4] != 0, end, tolerance)
                    x, y = end
                elif kind == "L":
                    x, y = bx + g[0], by + g[1]
                    out[-1].append((x, y))
                else:
                    p = [(bx + g[k], by + g[k + 1]) for k in range(0, n, 2)]
                    if kind in "ST":
                        same = last[0] in ("CS" if kind == "S" else "QT")
                        p.insert(0, (2 * x - last[1], 2 * y - last[2]) if same else (x, y))
                    curve([(x, y), *p])
                    last = (kind, *p[-2])
                    x, y = p[-1]
                    continue
            last = (kind, x, y)
    return [np.array(s) for s in out]


_MOST = 20_000  # rows of a batch that is passed on


def _per_path(commands: DataFrame, columns: list[str], run: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """run(svg_id, path_no, commands, further columns of the first of them), as rows of a schema; paths stream through sorted partitions, one at a time."""
    fields = StructType.fromDDL(schema)
    types = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (svg_id, path_no), path in groupby(held, key=itemgetter(0, 1)):
            first = next(path)
            rows += run(svg_id, path_no, [(first[2], first[3]), *((r[2], r[3]) for r in path)], *first[4:])
            if len(rows) >= _MOST:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)

    # As many tasks as a shuffle has: without a number, small tables are put into one task, whatever a path costs.
    tasks = int(commands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = commands.repartition(tasks, "svg_id", "path_no").sortWithinPartitions("svg_id", "path_no", "pos")
    return dealt.select("svg_id", "path_no", "cmd", "args", *columns).mapInArrow(stream, schema)


def flatten_paths(commands: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """svg_id, path_no, subpath, points, length, area of the polylines of path commands (svg_id, path_no, pos, cmd, args)."""

    def run(svg_id: int, path_no: int, path: list[tuple[str, list[float]]]) -> list[tuple]:
        return [(svg_id, path_no, k, len(s), float(np.hypot(*np.diff(s, axis=0).T).sum()) if len(s) > 1 else 0.0, abs(_area(s))) for k, s in enumerate(flatten(path, tolerance))]

    return _per_path(commands, [], run, "svg_id long, path_no long, subpath long, points long, length double, area double")


def artboard_outlines(commands: DataFrame, placed: DataFrame, tolerance_mm: float = 0.05) -> DataFrame:
    """svg_id, path_no, subpath, pos, x, y: the subpaths of path commands as closed polygons in artboard millimetres.

    placed(svg_id, x_mm, y_mm, w_mm, h_mm, vb_x, vb_y, vb_w, vb_h): where a file's view box lies on
    the artboard. Curves and arcs are flat to the tolerance there. Points that their follower
    repeats go, subpaths of fewer than three points too; files without a placement, or
    with a view box or size of zero, have no rows.
    """
    spots = placed.where("vb_w > 0 AND vb_h > 0 AND w_mm > 0 AND h_mm > 0").selectExpr("svg_id", "x_mm", "y_mm", "vb_x", "vb_y", "w_mm / vb_w AS sx", "h_mm / vb_h AS sy")

    def run(svg_id: int, path_no: int, path: list[tuple[str, list[float]]], x_mm: float, y_mm: float, vb_x: float, vb_y: float, sx: float, sy: float) -> list[tuple]:
        rows = []
        for k, line in enumerate(flatten(path, tolerance_mm / max(sx, sy))):
            line = line[np.any(line != np.roll(line, -1, axis=0), axis=1)]
            if len(line) >= 3:
                xy = (line - [vb_x, vb_y]) * [sx, sy] + [x_mm, y_mm]
                rows += [(svg_id, path_no, k, p, x, y) for p, (x, y) in enumerate(xy.tolist())]
        return rows

    columns = ["x_mm", "y_mm", "vb_x", "vb_y", "sx", "sy"]
    return _per_path(commands.join(spots, "svg_id"), columns, run, "svg_id long, path_no long, subpath long, pos long, x double, y double")
