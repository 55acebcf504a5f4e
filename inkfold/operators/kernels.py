"""Per-contour kernels that are sequential by nature: simplification and fitting, one ring of a streamed partition at a time."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def rdp(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Mask of the points that Ramer-Douglas-Peucker keeps of an open polyline."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord = points[b] - points[a]
        off = points[a + 1 : b] - points[a]
        size = np.hypot(*chord)
        gap = np.hypot(off[:, 0], off[:, 1]) if size == 0 else np.abs(chord[0] * off[:, 1] - chord[1] * off[:, 0]) / size
        k = int(gap.argmax())
        if gap[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def closed_rdp(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed ring is split at its first point and the point farthest from it."""
    if len(ring) < 4:
        return np.ones(len(ring), bool)
    far = int(np.hypot(*(ring - ring[0]).T).argmax())
    keep = np.zeros(len(ring), bool)
    keep[: far + 1] |= rdp(ring[: far + 1], tolerance)
    back = rdp(np.concatenate([ring[far:], ring[:1]]), tolerance)
    keep[far:] |= back[:-1]
    return keep


def visvalingam(points: np.ndarray, least_area: float) -> np.ndarray:
    """Mask of the points left after removing the smallest triangles first."""
    import heapq

    n = len(points)
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n

    def area(i: int) -> float:
        (ax, ay), (bx, by), (cx, cy) = points[before[i]], points[i], points[after[i]]
        return abs((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) / 2

    current = {i: area(i) for i in range(1, n - 1)}
    heap = [(a, i) for i, a in current.items()]
    heapq.heapify(heap)
    while heap:
        a, i = heapq.heappop(heap)
        if not alive[i] or current[i] != a:
            continue
        if a >= least_area:
            break
        alive[i] = False
        p, q = before[i], after[i]
        after[p], before[q] = q, p
        for j in (p, q):
            if 0 < j < n - 1:
                current[j] = max(area(j), a)
                heapq.heappush(heap, (current[j], j))
    return np.array(alive)


@functools.lru_cache(maxsize=4096)
def _centred_circle(points: bytes) -> tuple[float, float, float, float]:
    x, y = np.frombuffer(points).reshape(-1, 2).T
    a = np.stack([x, y, np.ones(len(x))], axis=1)
    (p, q, c), *_ = np.linalg.lstsq(a, x * x + y * y, rcond=None)
    cx, cy = p / 2, q / 2
    r = float(np.sqrt(max(0.0, c + cx * cx + cy * cy)))
    return cx, cy, r, float(np.sqrt(np.mean((np.hypot(x - cx, y - cy) - r) ** 2)))


def fit_circle(points: np.ndarray) -> tuple[float, float, float, float]:
    """Algebraic least-squares circle: centre, radius, root mean square of radial errors; outlines equal but for their place are fitted once, while they are remembered."""
    m = points.mean(axis=0)
    cx, cy, r, rms = _centred_circle(np.ascontiguousarray(points - m, dtype=float).tobytes())
    return float(cx + m[0]), float(cy + m[1]), r, rms


def resample(ring: np.ndarray, count: int) -> np.ndarray:
    """Points at equal arc length of a closed ring."""
    closed = np.concatenate([ring, ring[:1]])
    at = np.concatenate(([0], np.cumsum(np.hypot(*np.diff(closed, axis=0).T))))
    want = np.arange(count) * at[-1] / count
    return np.stack([np.interp(want, at, closed[:, k]) for k in (0, 1)], axis=1)


def smooth(ring: np.ndarray, sigma: float) -> np.ndarray:
    """Periodic Gaussian smoothing of a closed ring."""
    reach = min(len(ring) - 1, max(1, int(np.ceil(3 * sigma))))
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight /= weight.sum()
    return sum(w * np.roll(ring, -k, axis=0) for w, k in zip(weight, range(-reach, reach + 1), strict=True))


def per_ring(rings: DataFrame, run: Callable[[int, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """run(ring_id, points in order) of every ring; a task streams through its rings in Arrow batches and holds one ring at a time."""
    fields = rings.sparkSession.createDataFrame([], schema).schema
    names, types = fields.names, [to_arrow_type(f.dataType) for f in fields]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []

        def done() -> list[tuple]:
            return run(held[0][0], np.concatenate([p for _, p in held])) if held else []

        for batch in batches:
            ring, points = batch.column(0).to_numpy(), np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)]).astype(float)
            starts = np.flatnonzero(np.diff(ring, prepend=ring[0] - 1 if len(ring) else 0))
            rows: list[tuple] = []
            for s, e in zip(starts, [*starts[1:], len(ring)], strict=True):
                if held and held[0][0] != ring[s]:
                    rows += done()
                    held.clear()
                held.append((int(ring[s]), points[s:e]))
            if rows:
                yield _batch(rows, names, types)
        if rows := done():
            yield _batch(rows, names, types)

    # As many tasks as a shuffle has: without a number, small tables are put into one task, whatever a ring costs.
    tasks = int(rings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rings.select("ring_id", "pos", "x", "y").repartition(tasks, "ring_id").sortWithinPartitions("ring_id", "pos").mapInArrow(stream, schema)


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def rdp_simplify(rings: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """ring_id, points, kept, area_before, area_after."""

    def run(ring: int, p: np.ndarray) -> list[tuple]:
        keep = closed_rdp(p, tolerance)
        return [(ring, len(p), int(keep.sum()), _area(p), _area(p[keep]))]

    return per_ring(rings, run, "ring_id long, points long, kept long, area_before double, area_after double")


def _area(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def vw_simplify(rings: DataFrame, least_area: float = 50.0) -> DataFrame:
    """ring_id, points, kept."""
    return per_ring(rings, lambda ring, p: [(ring, len(p), int(visvalingam(p, least_area).sum()))], "ring_id long, points long, kept long")


def crosses_itself(p: np.ndarray) -> bool:
    """Whether two sides of a closed ring that are not neighbours meet; one side against all later ones at a time."""
    q = np.roll(p, -1, axis=0)
    n = len(p)
    side = lambda a, b, c: (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
    for k in range(n - 2):
        last = n - 1 if k == 0 else n
        a, b, c, d = p[k], q[k], p[k + 2 : last], q[k + 2 : last]
        near = (np.minimum(c, d) <= np.maximum(a, b)).all(axis=1) & (np.minimum(a, b) <= np.maximum(c, d)).all(axis=1)
        c, d = c[near], d[near]
        if len(c) and ((side(a, b, c) * side(a, b, d) <= 0) & (side(c, d, a) * side(c, d, b) <= 0)).any():
            return True
    return False


def checked_simplify(p: np.ndarray, tolerance: float, most_area_loss: float = 0.05, attempts: int = 3) -> tuple[np.ndarray, float, str]:
    """Points kept, tolerance used and outcome: Ramer-Douglas-Peucker with the tolerance halved until the ring keeps its area, does not cross itself and has three points.

    A ring without area, that crosses itself or that no attempt simplifies well stays as it was.
    """
    whole, area = np.ones(len(p), bool), abs(_area(p))
    if len(p) < 4 or area == 0:
        return whole, 0.0, "UNCHANGED"
    if crosses_itself(p):
        return whole, 0.0, "CROSSING"
    for k in range(attempts):
        used = tolerance / 2**k
        keep = closed_rdp(p, used)
        if keep.sum() >= 3 and abs(abs(_area(p[keep])) - area) <= most_area_loss * area and not crosses_itself(p[keep]):
            return keep, used, "SIMPLIFIED" if keep.sum() < len(p) else "UNCHANGED"
    return whole, 0.0, "REJECTED"


def validated_simplify(rings: DataFrame, tolerance: float = 2.0, most_area_loss: float = 0.05, attempts: int = 3) -> DataFrame:
    """ring_id, points, kept, tolerance, outcome, area_before, area_after: simplification under gates of area, deviation (the tolerance) and crossings."""

    def run(ring: int, p: np.ndarray) -> list[tuple]:
        keep, used, outcome = checked_simplify(p, tolerance, most_area_loss, attempts)
        return [(ring, len(p), int(keep.sum()), used, outcome, _area(p), _area(p[keep]))]

    return per_ring(rings, run, "ring_id long, points long, kept long, tolerance double, outcome string, area_before double, area_after double")


def circle_fit(rings: DataFrame) -> DataFrame:
    """ring_id, cx, cy, radius, rms; nulls below three points."""
    return per_ring(rings, lambda ring, p: [(ring, *(fit_circle(p) if len(p) > 2 else (None,) * 4))], "ring_id long, cx double, cy double, radius double, rms double")


def diverse_palette(colours: DataFrame, most: int = 8, least_distance: float = 40.0) -> DataFrame:
    """rank, r, g, b, n: greedy choice of frequent colours at least a distance apart, one aggregate over all colours for each."""
    left = colours.where("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL")
    chosen: list[tuple[int, int, int, int, int]] = []
    while len(chosen) < most:
        top = left.agg(F.min(F.struct((-F.col("n")).alias("o"), "r", "g", "b")).alias("c")).first()["c"]
        if top is None:
            break
        chosen.append((len(chosen), int(top["r"]), int(top["g"]), int(top["b"]), -int(top["o"])))
        left = left.where(F.sqrt((F.col("r") - top["r"]) ** 2 + (F.col("g") - top["g"]) ** 2 + (F.col("b") - top["b"]) ** 2) >= least_distance)
    return colours.sparkSession.createDataFrame(chosen, "rank long, r long, g long, b long, n long")
