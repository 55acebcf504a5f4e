"""All rings against all: rings are dealt to blocks, and a task compares the rings of two blocks, so that no pair is shuffled or held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.operators.graph import cut

MOST_SIDES = 1 << 17  # sides of a block of rings that are asked for points
MOST_PROBES = 1 << 16  # points of a block
MOST_KINDS = 1 << 19  # sides of a block of rings that are met with those of another
_TOLD = 1 << 20  # ring numbers of a batch that leaves a task, and points that are looked at in one step
_PART, _PARTS = 4096, 16  # points of a part of a block, and parts

Told = Iterator[tuple[int, bool, np.ndarray, np.ndarray]]  # number, whether both lists are of one class in one block, rings of either side


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _dealt(of: DataFrame, blocks: int) -> DataFrame:
    """block, ring_id, members: the first rings whose class has members in a block, and these."""
    dealt = of.select(F.pmod(F.xxhash64("ring_id"), F.lit(blocks)).cast("int").alias("block"), F.col("first"), F.col("ring_id").alias("member"))
    return dealt.groupBy("block", F.col("first").alias("ring_id")).agg(F.collect_list("member").alias("members"))


def _compared(rows: DataFrame, units: int, compare: Callable[[pa.Table], Told]) -> DataFrame:
    """number, a, b: compare() of every unit's rows, one unit a task; lists of rings become pairs of them beyond Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        made: list[tuple] = []
        size = 0
        for told in compare(pa.Table.from_batches(held)):
            made.append(told)
            size += len(told[2]) + len(told[3])
            if size >= _TOLD or len(made) >= 10_000:
                yield _batch(made)
                made, size = [], 0
        if made:
            yield _batch(made)

    # A unit's number is its partition: hashed ones would fall together in some tasks.
    told = rows.repartitionById(units, F.col("unit")).mapInArrow(run, "number long, equal boolean, some array<bigint>, others array<bigint>")
    pairs = told.select("number", "equal", F.explode("some").alias("a"), "others").select("number", "equal", "a", F.explode("others").alias("b"))
    return pairs.where("NOT equal OR a < b").select("number", "a", "b")


def _batch(made: list[tuple]) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(m[k]) for m in made)]), pa.int32()), pa.array(np.concatenate([m[k] for m in made]), pa.int64())) for k in (2, 3)]
    return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.bool_()), *lists], ["number", "equal", "some", "others"])


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Where every row's list begins and ends, and the lists' values one after another."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.cumsum([0, *sizes]), lists.flatten()


def _numbers(values: pa.Array, field: str | None = None) -> np.ndarray:
    return (values if field is None else values.field(field)).to_numpy(zero_copy_only=False)


def _members(at: np.ndarray, members: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The members of some rows, one row after another."""
    sizes = at[of + 1] - at[of]
    if (sizes == 1).all():
        return members[at[of]]
    shift = np.repeat(at[of] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return members[np.arange(sizes.sum()) + shift]


def _by_number(numbers: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every different number with those that have it."""
    if numbers.max(initial=0) < 1 << 16:
        numbers = numbers.astype(np.uint16)  # sorted by its digits
    order = np.argsort(numbers, kind="stable")
    numbers, of = numbers[order], of[order]
    cuts = np.flatnonzero(np.diff(numbers)) + 1
    for start, stop in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
        if stop > start:
            yield int(numbers[start]), of[start:stop]


class _Points:
    """Points in parts of neighbouring x, each by rising y, and the sides of a unit's rings laid on them.

    In a part most points lie clearly to the left or right of a side; these are told by ranges, and only the others by arithmetic.
    """

    def __init__(self, qx: np.ndarray, qy: np.ndarray, sides: tuple[np.ndarray, ...]):
        parts = np.array_split(np.argsort(qx, kind="stable"), min(_PARTS, 1 + len(qx) // _PART))
        parts = [p[np.argsort(qy[p], kind="stable")] for p in parts]
        self.order = np.concatenate(parts)
        self.qx, self.qy, self.sides = qx[self.order], qy[self.order], sides
        laid = [self._lay(at, at + len(p)) for p, at in zip(parts, np.cumsum([0, *map(len, parts)]), strict=False)]
        self.sure, self.open = (np.stack([part[k] for part in laid], axis=1) for k in (0, 1))  # side, part, start and stop

    def _lay(self, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Per side where its points of a part begin and end that surely lie to its left, and those to be looked at."""
        lx, ly, nx, ny = self.sides
        qx, qy = self.qx[first:end], self.qy[first:end]
        start, stop = np.searchsorted(qy, np.fmin(ly, ny)), np.searchsorted(qy, np.maximum(ly, ny))
        margin, slack = 1e-9 * (1 + np.abs(lx) + np.abs(nx)), 1e-9 * (1 + np.abs(ly) + np.abs(ny))
        with np.errstate(all="ignore"):
            steep = (ny - ly) / (nx - lx)
            left, right = ly + (qx.min() - margin - lx) * steep, ly + (qx.max() + margin - lx) * steep
        sloped = np.isfinite(left) & np.isfinite(right)
        low = np.where(sloped, np.searchsorted(qy, np.minimum(left, right) - slack), start).clip(start, stop)
        high = np.where(sloped, np.searchsorted(qy, np.maximum(left, right) + slack), stop).clip(start, stop)
        sure = np.stack([np.where(steep > 0, high, start), np.where(steep > 0, stop, low)], axis=1)
        sure[~sloped] = 0
        return (first + sure).astype(np.int32), (first + np.stack([low, high], axis=1)).astype(np.int32)

    def crossings(self, ring: slice) -> np.ndarray:
        """How many sides of a ring a ray to the right crosses from every point."""
        many = len(self.qx)
        sure, look = self.sure[ring].reshape(-1, 2), self.open[ring].reshape(-1, 2)
        found = np.cumsum(np.bincount(sure[:, 0], minlength=many + 1) - np.bincount(sure[:, 1], minlength=many + 1))[:many]
        sizes = (look[:, 1] - look[:, 0]).astype(np.int64)
        side = ring.start + np.repeat(np.arange(ring.stop - ring.start), self.open.shape[1])
        some = np.flatnonzero(sizes)
        ends = np.cumsum(sizes[some])
        for block in np.split(some, np.searchsorted(ends, np.arange(_TOLD, ends[-1], _TOLD)) if len(some) else []):
            if len(block):
                n = sizes[block]
                at = np.arange(n.sum()) + np.repeat(look[block, 0] - np.cumsum(n) + n, n)
                lx, ly, nx, ny = (np.repeat(c[side[block]], n) for c in self.sides)
                with np.errstate(all="ignore"):
                    meets = (nx - lx) * (self.qy[at] - ly) / (ny - ly) + lx
                found += np.bincount(at[~(self.qx[at] >= meets)], minlength=many)  # a side that begins or ends at no number lies beyond all, as in SQL
        return found


def _points_in_rings(unit: pa.Table) -> Told:
    """The rings of a unit with its points inside of them."""
    probe = unit.column("role").to_numpy() == 1
    points, rings = unit.filter(pa.array(probe)), unit.filter(pa.array(~probe))
    if not points.num_rows or not rings.num_rows:
        return
    p_at, p_members = _ragged(points.column("members"))
    r_at, r_members = _ragged(rings.column("members"))
    p_members, r_members = _numbers(p_members), _numbers(r_members)
    s_at, sides = _ragged(rings.column("sides"))
    laid = _Points(points.column("qx").to_numpy(), points.column("qy").to_numpy(), tuple(_numbers(sides, c) for c in ("x", "y", "nx", "ny")))
    for k in range(rings.num_rows):
        found = laid.crossings(slice(s_at[k], s_at[k + 1]))
        inside = np.flatnonzero(found & 1)
        for number, of in _by_number(found[inside], laid.order[inside]):
            yield number, False, r_members[r_at[k] : r_at[k + 1]], _members(p_at, p_members, of)


def points_in_rings(shapes: DataFrame, of: DataFrame) -> DataFrame:
    """probe_id, ring_id, crossings: rings and the points of other rings that lie in them, of shapes(ring_id, qx, qy, sides) of first rings and the classes of all.

    Every block of rings meets every block of points in a task.
    """
    shapes = cut(shapes)
    rings = of.count()
    sides = of.join(shapes.select(F.col("ring_id").alias("first"), F.size("sides").alias("n")), "first").agg(F.sum("n")).first()[0] or 0
    down, across = max(_tasks(shapes), -(-sides // MOST_SIDES)), max(1, -(-rings // MOST_PROBES))
    asked = _dealt(of, down).join(shapes.where("size(sides) > 0").select("ring_id", "sides"), "ring_id")
    points = _dealt(of, across).join(shapes.where("qx IS NOT NULL AND qy IS NOT NULL AND NOT isnan(qx) AND NOT isnan(qy)").select("ring_id", "qx", "qy"), "ring_id")
    empty = F.expr("filter(array(named_struct('x', 0e0, 'y', 0e0, 'nx', 0e0, 'ny', 0e0)), v -> false)")
    asked = asked.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).selectExpr(f"block * {across} + other AS unit", "0 AS role", "members", "sides", "0e0 AS qx", "0e0 AS qy")
    points = points.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).select(F.expr(f"other * {across} + block").alias("unit"), F.lit(1).alias("role"), "members", empty.alias("sides"), "qx", "qy")
    told = _compared(asked.unionByName(points), down * across, _points_in_rings)
    return told.where("a <> b").selectExpr("b AS probe_id", "a AS ring_id", "number AS crossings")


def _shared(unit: pa.Table) -> Told:
    """The rings of two blocks, or of one, and how many of their sides fall together."""
    role = unit.column("role").to_numpy()
    alone = (role == 2).any()
    m_at, members = _ragged(unit.column("members"))
    k_at, kinds = _ragged(unit.column("kinds"))
    members, key, times = _numbers(members), _numbers(kinds, "key"), _numbers(kinds, "n").astype(float)
    owner = np.repeat(np.arange(len(role)), np.diff(k_at))
    other = np.flatnonzero(role[owner] != 0)  # sides of the second block
    order = other[np.argsort(key[other], kind="stable")]
    sorted_key, ring, count = key[order], owner[order], times[order]
    start, stop = np.searchsorted(sorted_key, key, "left"), np.searchsorted(sorted_key, key, "right")
    single = (times == 1).all()
    for k in np.flatnonzero(role != 1):
        met = [(start[s], stop[s], times[s]) for s in range(k_at[k], k_at[k + 1]) if stop[s] > start[s]]
        if not met:
            continue
        spots = np.concatenate([ring[s:e] for s, e, _ in met])
        found = np.bincount(spots) if single else np.bincount(spots, np.concatenate([count[s:e] * n for s, e, n in met])).astype(np.int64)
        if alone:
            found[:k] = 0
        own = members[m_at[k] : m_at[k + 1]]
        if alone and found[k] and len(own) > 1:
            yield int(found[k]), True, own, own
        if alone:
            found[k] = 0
        at = np.flatnonzero(found)
        for number, of in _by_number(found[at], at):
            yield number, False, own, _members(m_at, members, of)


def shared_sides(kinds: DataFrame, of: DataFrame) -> DataFrame:
    """ring_a, ring_b, shared_edges of rings with sides that fall together, of kinds(ring_id, ex0, ex1, ey0, ey1, n) of first rings and the classes of all.

    Every block of rings meets itself and every later one in a task. Sides that fall together get a number first.
    """
    place = ["ex0", "ex1", "ey0", "ey1"]
    kinds = cut(kinds)
    keys = cut(kinds.select(*place).distinct().withColumn("key", F.monotonically_increasing_id()))
    shapes = cut(kinds.join(keys, place).groupBy("ring_id").agg(F.collect_list(F.struct("key", "n")).alias("kinds")))
    sides = of.join(shapes.select(F.col("ring_id").alias("first"), F.size("kinds").alias("n")), "first").agg(F.sum("n")).first()[0] or 0
    blocks = max(int(np.ceil(np.sqrt(2 * _tasks(shapes)))), -(-sides // MOST_KINDS))
    rows = _dealt(of, blocks).join(shapes, "ring_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low = "least(block, other)"
    unit = f"CAST({low} * {blocks} - {low} * ({low} - 1) / 2 + abs(block - other) AS INT) AS unit"
    met = rows.selectExpr(unit, "CASE WHEN block < other THEN 0 WHEN block > other THEN 1 ELSE 2 END AS role", "members", "kinds")
    told = _compared(met, blocks * (blocks + 1) // 2, _shared)
    return told.selectExpr("least(a, b) AS ring_a", "greatest(a, b) AS ring_b", "number AS shared_edges")
