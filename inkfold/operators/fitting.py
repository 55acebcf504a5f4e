"""Curves and ellipses fitted to rings: tangent-bound cubics merged bottom-up, direct ellipses from moment sums."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.operators.copies import classes, firsts, for_all
from inkfold.operators.graph import cut
from inkfold.operators.kernels import fit_circle, per_ring, smooth
from inkfold.operators.selection import pareto_frontier


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.hypot(*v)
    return v / size if size > 0 else v


def bezier(control: np.ndarray, t: np.ndarray) -> np.ndarray:
    s = 1 - t
    return np.outer(s**3, control[0]) + np.outer(3 * s * s * t, control[1]) + np.outer(3 * s * t * t, control[2]) + np.outer(t**3, control[3])


def tangent_cubics(points: np.ndarray, start: np.ndarray, stop: np.ndarray, rounds: int = 24) -> Iterator[tuple[np.ndarray, float, int]]:
    """Control points, largest error and its place, round by round: the cubic through both ends whose arms lie along the end tangents, least squares over arm lengths, parameters bettered by Newton steps."""
    first, last = points[0], points[-1]
    steps = np.hypot(*np.diff(points, axis=0).T)
    t = np.concatenate(([0.0], np.cumsum(steps))) / max(steps.sum(), 1e-12)
    chord = np.hypot(*(last - first))
    for _ in range(rounds):
        s = 1 - t
        b1, b2 = 3 * s * s * t, 3 * s * t * t
        rest = points - np.outer(s**3 + b1, first) - np.outer(t**3 + b2, last)
        a, b = np.outer(b1, start), np.outer(b2, stop)
        aa, ab, bb = (a * a).sum(), (a * b).sum(), (b * b).sum()
        ra, rb = (a * rest).sum(), (b * rest).sum()
        det = aa * bb - ab * ab
        arms = ((ra * bb - rb * ab) / det, (aa * rb - ab * ra) / det) if abs(det) > 1e-12 * max(aa * bb, 1e-300) else (0.0, 0.0)
        least = 1e-6 * max(chord, steps.sum())
        if min(arms) < least:  # an arm that would point backwards: a third of the chord for both
            arms = (chord / 3, chord / 3)
        control = np.stack([first, first + arms[0] * start, last + arms[1] * stop, last])
        gap = bezier(control, t) - points
        off = np.hypot(*gap.T)
        at = int(off.argmax())
        yield control, float(off[at]), at
        d1 = 3 * (np.outer(s * s, control[1] - control[0]) + 2 * np.outer(s * t, control[2] - control[1]) + np.outer(t * t, control[3] - control[2]))
        d2 = 6 * (np.outer(s, control[2] - 2 * control[1] + control[0]) + np.outer(t, control[3] - 2 * control[2] + control[1]))
        slope = (d1 * d1).sum(axis=1) + (gap * d2).sum(axis=1)
        t = np.clip(np.where(np.abs(slope) > 1e-12, t - (gap * d1).sum(axis=1) / np.where(np.abs(slope) > 1e-12, slope, 1), t), 0, 1)
        t[0], t[-1] = 0, 1


def best_cubic(found: Iterable[tuple[np.ndarray, float, int]], tolerance: float) -> tuple[np.ndarray, float, int]:
    """The best of the rounds up to the first that is good, no longer better, or hopeless."""
    best: tuple[np.ndarray, float, int] | None = None
    last_off = np.inf
    for one in found:
        off = one[1]
        if best is None or off < best[1]:
            best = one
        if off <= tolerance * 0.5 or off > 0.97 * last_off or off > 100 * tolerance:
            break
        last_off = off
    return best


def fit_tangent_cubic(points: np.ndarray, start: np.ndarray, stop: np.ndarray, tolerance: float, rounds: int = 24) -> tuple[np.ndarray, float, int]:
    """Control points, largest error and its place of the tangent-bound cubic that is good enough for a tolerance."""
    return best_cubic(tangent_cubics(points, start, stop, rounds), tolerance)


class Rounds:
    """Rounds of a fit, made as they are asked for and kept for the next tolerance."""

    def __init__(self, found: Iterator[tuple[np.ndarray, float, int]]):
        self.found, self.made = found, []

    def __iter__(self) -> Iterator[tuple[np.ndarray, float, int]]:
        k = 0
        while True:
            if k == len(self.made):
                one = next(self.found, None)
                if one is None:
                    return
                self.made.append(one)
            yield self.made[k]
            k += 1


def corners_of(ring: np.ndarray, degrees: float) -> np.ndarray:
    """Places where the ring's direction turns by at least so much."""
    before, after = ring - np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0) - ring
    turn = np.degrees(np.abs(np.arctan2(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0], (before * after).sum(axis=1))))
    return np.flatnonzero(turn >= degrees)


def end_tangent(p: np.ndarray) -> np.ndarray:
    """Direction in which a run leaves its first point: the slope there of the parabola through its first three, unless that turns far from the first side."""
    side = _unit(p[1] - p[0])
    if len(p) < 3:
        return side
    d1, d2 = np.hypot(*(p[1] - p[0])), np.hypot(*(p[2] - p[1]))
    slope = _unit(side * (2 * d1 + d2) - _unit(p[2] - p[1]) * d1)
    return slope if slope @ side > 0.9 else side


def fit_ring(ring: np.ndarray, tolerance: float, corner_degrees: float = 38.0, kept: dict[tuple[int, int, int], Rounds] | None = None) -> list[tuple[int, int, np.ndarray, float, bool]]:
    """(first, last, control points, error, smooth start) of cubics round a closed ring; last may pass the ring's end.

    Runs between corners are split at the largest error until every cubic is within the
    tolerance; joints inside a run share a tangent. Then neighbours inside a run are merged,
    the pair with the smallest joint error first, while that error is within the tolerance.
    kept holds rounds of fits from one tolerance to the next of the same ring.
    """
    keep = np.any(ring != np.roll(ring, 1, axis=0), axis=1)
    place = np.flatnonzero(keep)
    ring = ring[keep]
    n = len(ring)
    if n < 2:
        return []
    sharp = corners_of(ring, corner_degrees) if n > 2 else np.arange(n)
    smooth_all = not len(sharp)
    cuts = sharp.tolist() if len(sharp) else [0]
    out = []
    for k, a in enumerate(cuts):
        b = cuts[k + 1] if k + 1 < len(cuts) else cuts[0] + n
        run = ring[np.arange(a, b + 1) % n]
        tangent = {0: end_tangent(run), len(run) - 1: -end_tangent(run[::-1])}
        if smooth_all:
            tangent[0] = tangent[len(run) - 1] = _unit(ring[1 % n] - ring[-1])

        def along(i: int, run: np.ndarray = run, tangent: dict = tangent) -> np.ndarray:
            if i not in tangent:
                d = _unit(run[i + 1] - run[i - 1])
                tangent[i] = d if d.any() else _unit(run[i + 1] - run[i])
            return tangent[i]

        def fit(i: int, j: int, run: np.ndarray = run, along: Callable = along, k: int = k) -> tuple[np.ndarray, float, int]:
            p = run[i : j + 1]
            if j - i == 1:
                third = np.hypot(*(p[1] - p[0])) / 3
                return np.stack([p[0], p[0] + third * along(i), p[1] - third * along(j), p[1]]), 0.0, 0
            if kept is None:
                return fit_tangent_cubic(p, along(i), -along(j), tolerance)
            if (k, i, j) not in kept:
                kept[k, i, j] = Rounds(tangent_cubics(p, along(i), -along(j)))
            return best_cubic(kept[k, i, j], tolerance)

        parts, todo = [], [(0, len(run) - 1)]
        while todo:
            i, j = todo.pop()
            control, error, at = fit(i, j)
            if error <= tolerance or j - i < 2:
                parts.append((i, j, control, error))
            else:
                middle = min(max(i + at, i + 1), j - 1)
                todo += [(middle, j), (i, middle)]
        parts = _merged(sorted(parts, key=lambda p: p[0]), fit, tolerance)
        out += [(int(place[(a + i) % n]), int(place[(a + j) % n]), control, error, i > 0 or smooth_all) for i, j, control, error in parts]
    return out


def _merged(parts: list, fit: Callable, tolerance: float) -> list:
    """Neighbours joined while one cubic holds for both, smallest error first."""
    alive = {k: p for k, p in enumerate(parts)}
    after = {k: k + 1 if k + 1 < len(parts) else None for k in alive}
    before = {k: k - 1 if k else None for k in alive}
    heap: list = []
    fresh = len(parts)

    def offer(k: int | None) -> None:
        if k is not None and after[k] is not None:
            i, j = alive[k][0], alive[after[k]][1]
            control, error, _ = fit(i, j)
            if error <= tolerance:
                heapq.heappush(heap, (error, k, after[k], (i, j, control, error)))

    for k in list(alive):
        offer(k)
    while heap:
        _, a, b, part = heapq.heappop(heap)
        if a not in alive or b not in alive or after[a] != b:
            continue
        c, p, q = fresh, before[a], after[b]
        fresh += 1
        alive[c] = part
        before[c], after[c] = p, q
        if p is not None:
            after[p] = c
        if q is not None:
            before[q] = c
        del alive[a], alive[b]
        offer(p)
        offer(c)
    return sorted(alive.values(), key=lambda p: p[0])


def fit_curves(rings: DataFrame, tolerance: float = 2.0, corner_degrees: float = 38.0, sigma: float = 0.0) -> DataFrame:
    """ring_id, seg_no, first_pos, last_pos, x0..y3, error, smooth: cubics round every ring, in order; smooth tells whether the joint at its start shares a tangent.

    With sigma, points are smoothed along the ring first. Rings of fewer than two different points have none.
    """
    names = ["x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3"]
    schema = "ring_id long, seg_no long, first_pos long, last_pos long, " + ", ".join(f"{n} double" for n in names) + ", error double, smooth boolean"

    def run(ring: int, points: np.ndarray) -> list[tuple]:
        return [(ring, k, a, b, *c.ravel().tolist(), e, bool(s)) for k, (a, b, c, e, s) in enumerate(fit_ring(smooth(points, sigma) if sigma and len(points) > 2 else points, tolerance, corner_degrees))]

    return per_ring(rings, run, schema)


def _runs(ring: np.ndarray, corner_degrees: float) -> list[np.ndarray]:
    """Points of a ring's runs between corners, ends included; a ring without corners is one run back to its start."""
    ring = ring[np.any(ring != np.roll(ring, 1, axis=0), axis=1)]
    n = len(ring)
    if n < 3:
        return []
    cuts = corners_of(ring, corner_degrees).tolist() or [0]
    return [ring[np.arange(a, (cuts[k + 1] if k + 1 < len(cuts) else cuts[0] + n) + 1) % n] for k, a in enumerate(cuts)]


def line_gaps(p: np.ndarray) -> np.ndarray:
    """Distances to the total least-squares line."""
    off = p - p.mean(axis=0)
    return np.abs(off @ np.linalg.svd(off, full_matrices=False)[2][-1])


def ellipse_gaps(p: np.ndarray) -> np.ndarray | None:
    """First-order distances to the direct ellipse; None without one."""
    middle = p.mean(axis=0)
    size = max(np.sqrt(((p - middle) ** 2).sum(axis=1).mean()), 1e-300)
    u, v = ((p - middle) / size).T
    a, b, c, d, e, f = ellipse_of({(i, j): np.array([(u**i * v**j).sum()]) for i, j in _POWERS})[0]
    if not np.isfinite(a):
        return None
    value, gx, gy = a * u * u + b * u * v + c * v * v + d * u + e * v + f, 2 * a * u + b * v + d, b * u + 2 * c * v + e
    return np.abs(value) / np.maximum(np.hypot(gx, gy), 1e-12) * size


#: Parameters of each model. Fixed values.
MODELS = {"LINE": 2, "ARC": 3, "ELLIPSE": 5, "BEZIER": 8}


def interval_models(rings: DataFrame, corner_degrees: float = 38.0, tolerance: float = 2.5) -> DataFrame:
    """ring_id, interval_id, model, params, rms, worst: every model that fits a run between corners, with its errors.

    Lines and arcs from two and three points on, ellipses from five, one tangent-bound cubic; a run of too few points or without a model's shape lacks that model.
    """

    def run(ring: int, points: np.ndarray) -> list[tuple]:
        out = []
        for k, p in enumerate(_runs(points, corner_degrees)):
            found = {"LINE": line_gaps(p)}
            if len(p) >= 3 and found["LINE"].max() > 1e-9:
                cx, cy, r, _ = fit_circle(p)
                found["ARC"] = np.abs(np.hypot(p[:, 0] - cx, p[:, 1] - cy) - r)
            if len(p) >= 5 and (gaps := ellipse_gaps(p)) is not None:
                found["ELLIPSE"] = gaps
            if len(p) >= 4 and np.any(p[0] != p[-1]):
                _, worst, _ = fit_tangent_cubic(p, end_tangent(p), end_tangent(p[::-1]), tolerance)
                found["BEZIER"] = np.full(1, worst)
            out += [(ring, k, m, MODELS[m], float(np.sqrt((g * g).mean())), float(g.max())) for m, g in found.items()]
        return out

    return per_ring(rings, run, "ring_id long, interval_id long, model string, params int, rms double, worst double")


def fit_trials(rings: DataFrame, tolerances: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0), sigmas: tuple[float, ...] = (0.0, 1.0, 2.0)) -> DataFrame:
    """case_id, trial, tolerance, sigma, error, nodes, editability: every ring fitted with every setting; error is the largest distance of a point from its curve, editability the share of smooth joints in hundredths."""

    def run(ring: int, points: np.ndarray) -> list[tuple]:
        out = []
        lines = {s: (smooth(points, s) if s and len(points) > 2 else points, {}) for s in sigmas}
        for k, (tolerance, sigma) in enumerate((t, s) for t in tolerances for s in sigmas):
            smoothed, kept = lines[sigma]
            curves = fit_ring(smoothed, tolerance, kept=kept)
            moved = float(np.hypot(*(smoothed - points).T).max()) if len(points) else 0.0
            if curves:
                out.append((ring, k, tolerance, sigma, round(max(c[3] for c in curves) + moved, 6), len(curves), 100 * sum(c[4] for c in curves) // len(curves)))
        return out

    return per_ring(rings, run, "case_id long, trial long, tolerance double, sigma double, error double, nodes long, editability long")


def fit_frontier(rings: DataFrame) -> DataFrame:
    """case_id, trial, error, nodes, editability: the trials of every ring that no other trial of it beats; equal rings are fitted once."""
    of = classes(rings)
    best = pareto_frontier(trials=cut(fit_trials(firsts(rings, of))))
    return for_all(best, of, ring="case_id")


_POWERS = [(i, j) for i in range(5) for j in range(5 - i)]


def ellipse_of(m: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """Conics (a, b, c, d, e, f) of least algebraic error under 4ac - b*b = 1 from moments, NaN where there is no ellipse; all rings at once."""
    at = lambda *p: np.stack([m[q] for q in p], axis=-1)
    s1 = np.stack([at((4, 0), (3, 1), (2, 2)), at((3, 1), (2, 2), (1, 3)), at((2, 2), (1, 3), (0, 4))], axis=-2)
    s2 = np.stack([at((3, 0), (2, 1), (2, 0)), at((2, 1), (1, 2), (1, 1)), at((1, 2), (0, 3), (0, 2))], axis=-2)
    s3 = np.stack([at((2, 0), (1, 1), (1, 0)), at((1, 1), (0, 2), (0, 1)), at((1, 0), (0, 1), (0, 0))], axis=-2)
    out = np.full((len(s1), 6), np.nan)
    flat = np.abs(np.linalg.det(s3)) > 1e-12 * np.maximum(m[0, 0], 1) ** 3
    ok = np.flatnonzero(flat & (m[0, 0] >= 5))
    if not len(ok):
        return out
    t = -np.linalg.solve(s3[ok], np.swapaxes(s2[ok], -1, -2))
    reduced = s1[ok] + s2[ok] @ t
    turned = np.stack([reduced[:, 2] / 2, -reduced[:, 1], reduced[:, 0] / 2], axis=1)
    values, vectors = np.linalg.eig(turned)
    real = np.real(vectors)
    kind = 4 * real[:, 0] * real[:, 2] - real[:, 1] ** 2
    kind = np.where((np.abs(np.imag(values)) < 1e-9 * (1 + np.abs(values))) & (kind > 1e-12), kind, -np.inf)
    best = kind.argmax(axis=1)
    rows = np.arange(len(ok))
    a1 = real[rows, :, best]
    conic = np.concatenate([a1, np.einsum("nij,nj->ni", t, a1)], axis=1)
    conic[~np.isfinite(kind[rows, best])] = np.nan
    out[ok] = conic
    return out


def ellipse_fit(rings: DataFrame) -> DataFrame:
    """ring_id, points, cx, cy, major, minor, angle_degrees: the direct least-squares ellipse of every ring, half axes, angle of the longer one in [0, 180).

    Points are centred and scaled by their own mean and spread, their powers summed in one
    aggregate that can be merged in any order, and one eigenproblem of three is solved a ring.
    Arcs give the ellipse they lie on; rings of fewer than five points, on a line or without an
    ellipse have nulls.
    """
    ring = Window.partitionBy("ring_id")
    centred = rings.where("x IS NOT NULL AND y IS NOT NULL").select("ring_id", "x", "y", F.avg("x").over(ring).alias("mx"), F.avg("y").over(ring).alias("my"))
    spread = F.sqrt(F.avg(F.expr("(x - mx) * (x - mx) + (y - my) * (y - my)")).over(ring))
    scaled = centred.withColumn("size", F.greatest(spread, F.lit(1e-300))).selectExpr("ring_id", "mx", "my", "size", "(x - mx) / size AS u", "(y - my) / size AS v")
    power = lambda c, k: " * ".join([c] * k) or "1e0"
    sums = scaled.groupBy("ring_id").agg(F.first("mx").alias("mx"), F.first("my").alias("my"), F.first("size").alias("size"), *[F.sum(F.expr(f"{power('u', i)} * {power('v', j)}")).alias(f"m{i}{j}") for i, j in _POWERS])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            a, b, c, d, e, f = ellipse_of({(i, j): col(f"m{i}{j}") for i, j in _POWERS}).T
            with np.errstate(invalid="ignore", divide="ignore"):
                det = 4 * a * c - b * b
                x, y = (b * e - 2 * c * d) / det, (b * d - 2 * a * e) / det
                level = -(a * x * x + b * x * y + c * y * y + d * x + e * y + f)
                turn = np.hypot(a - c, b)
                low, high = (a + c - turn) / 2, (a + c + turn) / 2  # eigenvalues of the quadratic form
                sign = np.where(level < 0, -1, 1)
                p, q = np.sqrt(level * sign / np.where(sign > 0, low, -high)), np.sqrt(level * sign / np.where(sign > 0, high, -low))
                major, minor = np.maximum(p, q), np.minimum(p, q)
                angle = np.degrees(np.arctan2(sign * -b, sign * (c - a)) / 2) % 180
            good = np.isfinite(major) & np.isfinite(minor) & (minor > 0)
            size = col("size")
            back = [col("mx") + x * size, col("my") + y * size, major * size, minor * size, angle]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(col("m00").astype(np.int64)), *[pa.array(v, mask=~good) for v in back]], ["ring_id", "points", "cx", "cy", "major", "minor", "angle_degrees"])

    return sums.mapInArrow(solve, "ring_id long, points long, cx double, cy double, major double, minor double, angle_degrees double")
