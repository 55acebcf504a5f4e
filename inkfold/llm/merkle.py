"""Merkle manifest of a dataset: mountain ranges over range-partitioned leaves, merged across partitions.

Leaves are hashes of rows, ordered inside a group. Rows are dealt by range to parts of a
bounded size, counted, and so numbered without a global sort in one task. Each part keeps
a stack of completed nodes: a node that ends a run of siblings carries into its parent as
an odometer does, in any fanout. What a part cannot complete, at its unaligned edges, are
its peaks; neighbouring parts' peaks are merged by the same stack, a bounded number of
parts at a time. The last run of a level is short, without padding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm._common import stored

Node = tuple[int, int, bytes]  # level, index in the level, digest

_SHIFT = 33  # bits of a row's place in its partition, as monotonically_increasing_id() lays them out


def width(total: int, level: int, fanout: int) -> int:
    """Nodes of a level above `total` leaves."""
    return -(-total // fanout**level)


def height(total: int, fanout: int) -> int:
    """Levels above the leaves until one node remains."""
    h = 0
    while width(total, h, fanout) > 1:
        h += 1
    return h


def join(digests: Iterable[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def climb(nodes: Iterable[Node], total: int, fanout: int) -> tuple[list[Node], list[Node]]:
    """Peaks left on the stack and nodes made, from neighbouring nodes in order of what they cover."""
    stack: list[Node] = []
    made: list[Node] = []
    widths = [width(total, h, fanout) for h in range(height(total, fanout) + 1)]
    for node in nodes:
        stack.append(node)
        while True:
            level, at, _ = stack[-1]
            first = at - at % fanout
            size = min(first + fanout, widths[level]) - first
            if widths[level] == 1 or at != first + size - 1 or len(stack) < size or stack[-size][:2] != (level, first):
                break
            parent = (level + 1, at // fanout, join(d for _, _, d in stack[-size:]))
            del stack[-size:]
            stack.append(parent)
            made.append(parent)
    return stack, made


def outside(first: int, count: int, total: int, fanout: int) -> list[tuple[int, int]]:
    """(level, index) of the siblings of a part's leaves and their ancestors that the part cannot make itself."""
    out = []
    for h in range(height(total, fanout)):
        span, last = fanout**h, width(total, h, fanout)
        runs = {first // span // fanout, (first + count - 1) // span // fanout}
        for run in sorted(runs):
            for j in range(run * fanout, min(run * fanout + fanout, last)):
                if j * span < first or min((j + 1) * span, total) > first + count:
                    out.append((h, j))
    return out


def paths(leaves: list[bytes], first: int, total: int, fanout: int, others: dict[tuple[int, int], bytes]) -> tuple[list[str], list[str], np.ndarray]:
    """before, after, steps: strings of sibling digests left and right of an ancestor, and for each leaf (rows) and level (columns) which of them it has."""
    known = {(h, j): d.hex() for (h, j), d in others.items()}
    known |= {(0, first + k): d.hex() for k, d in enumerate(leaves)}
    known |= {(h, j): d.hex() for h, j, d in climb(((0, first + k, d) for k, d in enumerate(leaves)), total, fanout)[1]}
    before, after = [], []
    at = first + np.arange(len(leaves))
    steps = np.zeros((len(leaves), height(total, fanout)), np.int64)
    for h in range(steps.shape[1]):
        low, high, last = int(at[0]), int(at[-1]), width(total, h, fanout)
        steps[:, h] = at - low + len(before)
        for j in range(low, high + 1):
            run = j - j % fanout
            before.append("".join(known[h, k] for k in range(run, j)))
            after.append("".join(known[h, k] for k in range(j + 1, min(run + fanout, last))))
        at = at // fanout
    return before, after, steps


def leaf(fields: dict[str, Column]) -> Column:
    """Hex digest of a row: each field '-' if null, else its UTF-8 byte count, ':' and its value."""
    texts = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


@dataclass
class Forest:
    """placed(part, pos, d, carried), runs(part, gid, group, first_pos, n, offset, total), nodes(gid, level, idx, d) at and above part edges, roots(gid, group, root)."""

    placed: DataFrame
    runs: DataFrame
    nodes: DataFrame
    roots: DataFrame
    fanout: int


def _runs_in(part: pa.Table, runs: pa.Table, column: str) -> Iterator[tuple[dict, pa.Table]]:
    """Each run of a part with its rows in order."""
    rows = part.take(pa.array(np.argsort(part.column("pos").to_numpy(), kind="stable"))) if part.num_rows else part
    for run in sorted(runs.to_pylist(), key=lambda r: r["first_pos"]):
        yield run, rows.slice(run["first_pos"], run["n"])


def _peaks(fanout: int, every: bool):
    """Of a part's runs: the peaks, and with every the nodes below them too."""

    def run(part: pa.Table, runs: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for r, rows in _runs_in(part, runs, "d"):
            own = [(0, r["offset"] + k, d) for k, d in enumerate(rows.column("d").to_pylist())]
            peaks, made = climb(own, r["total"], fanout)
            out += [(r["gid"], r["part"], *n, True) for n in peaks]
            if every:
                top = {n[:2] for n in peaks}
                out += [(r["gid"], r["part"], *n, False) for n in own + made if n[:2] not in top]
        return _table(out, [("gid", pa.int64()), ("part", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("d", pa.binary()), ("peak", pa.bool_())])

    return run


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def grow(leaves: DataFrame, fanout: int, rows_per_part: int, parts_merged: int, every: bool = False) -> Forest:
    """Trees of leaves(g, k, d, c0...), one per value of g, leaves by k then digest, nulls first."""
    spark = leaves.sparkSession
    held = stored(leaves, "merkle-leaves")
    parts = max(-(-held.count() // rows_per_part), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Rows equal in everything may fill more than one part; among them no order matters.
    dealt = held.withColumn("salt", F.floor(F.rand(3) * 1024)).repartitionByRange(parts, F.asc_nulls_first("g"), F.asc_nulls_first("k"), "d", "salt").sortWithinPartitions(F.asc_nulls_first("g"), F.asc_nulls_first("k"), "d").drop("salt")
    place = F.monotonically_increasing_id()
    placed = stored(dealt.withColumn("part", F.shiftright(place, _SHIFT)).withColumn("pos", place.bitwiseAND(F.lit((1 << _SHIFT) - 1))), "merkle-placed")
    whole, earlier = Window.partitionBy("g"), Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("part", "g").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))
    runs = runs.select(
        "part", F.min(F.shiftleft("part", _SHIFT) + F.col("first_pos")).over(whole).alias("gid"), "g", "first_pos", "n",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"), F.sum("n").over(whole).alias("total"),
    )
    runs = stored(runs, "merkle-runs")
    schema = "gid long, part long, level int, idx long, d binary"
    peaks = placed.select("part", "pos", "d").groupBy("part").cogroup(runs.drop("g").groupBy("part")).applyInArrow(_peaks(fanout, every), schema + ", peak boolean")
    found = stored(peaks, "merkle-peaks")
    nodes = found.drop("part", "peak")
    # Groups that lie in one part have their root; the others' peaks are merged, parts_merged neighbours at a time.
    torn = runs.where("n < total").groupBy("gid").agg(F.max("total").alias("total"))
    left = found.where("peak").drop("peak").join(torn, "gid")

    def merge(rows: pa.Table) -> pa.Table:
        total, gid, part = (rows.column(c)[0].as_py() for c in ("total", "gid", "part"))
        given = sorted(zip(*(rows.column(c).to_pylist() for c in ("level", "idx", "d")), strict=True), key=lambda n: n[1] * fanout ** n[0])
        peaks, made = climb(given, total, fanout)
        top, old = {n[:2] for n in peaks}, {n[:2] for n in given}
        out = [(gid, part, *n, True, total, n[:2] not in old) for n in peaks] + [(gid, part, *n, False, total, True) for n in made if n[:2] not in top]
        return _table(out, [("gid", pa.int64()), ("part", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("d", pa.binary()), ("peak", pa.bool_()), ("total", pa.int64()), ("fresh", pa.bool_())])

    most = (runs.agg(F.max("part")).first()[0] or 0) + 1
    while most > 1:
        most = -(-most // parts_merged)
        grouped = left.withColumn("part", F.floor(F.col("part") / parts_merged).cast("long")).groupBy("gid", "part")
        merged = stored(grouped.applyInArrow(merge, schema + ", peak boolean, total long, fresh boolean"), "merkle-merged")
        nodes = nodes.unionByName(merged.where("fresh").select("gid", "level", "idx", "d"))
        left = merged.where("peak").select("gid", "part", "level", "idx", "d", "total")
    groups = runs.groupBy("gid").agg(F.first("g").alias("group"), F.max("total").alias("total"))
    roots = groups.join(nodes.where("idx = 0").groupBy("gid").agg(F.max_by("d", "level").alias("root")), "gid")
    return Forest(placed, runs, nodes, stored(roots, "merkle-roots"), fanout)


_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def proofs(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """leaf, subroot, root, path and carried columns of every leaf; above(gid, root, upper) carries on to a root over the groups."""
    fanout = forest.fanout
    ends = forest.roots.select("gid", F.col("root").alias("subroot"))
    if above is None:
        ends = ends.withColumn("root", F.col("subroot")).withColumn("upper", F.array().cast("array<struct<before:string,after:string>>"))
    else:
        ends = ends.join(above, "gid")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["gid"], r["part"], h, j) for r in batch.to_pylist() for h, j in outside(r["offset"], r["n"], r["total"], fanout)]
            yield from _table(rows, [("gid", pa.int64()), ("part", pa.int64()), ("level", pa.int32()), ("idx", pa.int64())]).to_batches()

    wanted = forest.runs.drop("g").mapInArrow(needed, "gid long, part long, level int, idx long")
    # At most twice the fanout a level of each run.
    edges = wanted.join(forest.nodes, ["gid", "level", "idx"]).groupBy("gid", "part").agg(F.collect_list(F.struct("level", "idx", "d")).alias("others"))
    runs = forest.runs.drop("g").join(edges, ["gid", "part"], "left").join(ends, "gid")
    carried = [c for c in forest.placed.columns if c not in ("part", "pos", "g", "k", "d")]
    types = {f.name: f.dataType.simpleString() for f in forest.placed.schema}

    def run(part: pa.Table, runs: pa.Table) -> pa.Table:
        out = []
        for r, rows in _runs_in(part, runs, "d"):
            others = {(o["level"], o["idx"]): o["d"] for o in r["others"] or []}
            before, after, steps = paths(rows.column("d").to_pylist(), r["offset"], r["total"], fanout, others)
            up = len(before) + np.arange(len(r["upper"]))
            steps = np.concatenate([steps, np.broadcast_to(up, (len(steps), len(up)))], axis=1)
            before, after = before + [u["before"] for u in r["upper"]], after + [u["after"] for u in r["upper"]]
            flat = pa.array(steps.ravel())
            pair = pa.StructArray.from_arrays([pa.array(before, pa.string()).take(flat), pa.array(after, pa.string()).take(flat)], ["before", "after"])
            path = pa.ListArray.from_arrays(pa.array(np.arange(len(steps) + 1, dtype=np.int32) * steps.shape[1]), pair)
            same = [pa.array([r[c].hex()] * len(steps)) for c in ("subroot", "root")]
            leaves = pa.array([d.hex() for d in rows.column("d").to_pylist()])
            out.append(pa.table([leaves, *same, path, *(rows.column(c) for c in carried)], names=["leaf", "subroot", "root", "path", *carried]))
        return pa.concat_tables(out)

    schema = "leaf string, subroot string, root string, path array<struct<before:string,after:string>>" + "".join(f", {c} {types[c]}" for c in carried)
    return forest.placed.drop("g", "k").groupBy("part").cogroup(runs.groupBy("part")).applyInArrow(run, schema)


def _leaves(docs: DataFrame, group: str, order: str, fields: list[str], carry: list[str]) -> DataFrame:
    return docs.select(docs[group].alias("g"), docs[order].alias("k"), F.unhex(leaf({c: docs[c] for c in fields})).alias("d"), *(docs[c].alias(f"c{k}") for k, c in enumerate(carry)))


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), *, fanout: int = 2, rows_per_part: int = 16_384, parts_merged: int = 256) -> DataFrame:
    """group, level, idx, digest (hex): every node of every group's tree, leaves at level 0. Cases as in prove()."""
    forest = grow(_leaves(docs, group, order, list(fields), []), fanout, rows_per_part, parts_merged, every=True)
    return forest.nodes.join(forest.roots.select("gid", "group"), "gid").select("group", "level", "idx", F.lower(F.hex("d")).alias("digest"))


def prove(
    docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), carry: tuple[str, ...] = ("doc_id",), *, fanout: int = 2, rows_per_part: int = 16_384, parts_merged: int = 256
) -> DataFrame:
    """leaf, subroot, root (hex), path and the carried columns of every row.

    A group's leaves ascend by `order`, nulls first, ties by digest; the groups' roots,
    ordered by group, nulls first, are the leaves of the root's tree. path lists, from the
    leaf up to the root, the digests left and right of the ancestor among its siblings:
    H(before, ancestor, after) is the next ancestor; a step may have neither. A group of
    one row has the leaf as its subroot, a single group its subroot as root. Nulls in any
    field are leaves of their own kind; repeated rows are leaves each; texts of any length
    are hashed whole by Spark; an empty table gives no rows; other columns are not read.

    A task holds rows_per_part rows (digests and carried columns) and their paths, or the
    peaks of parts_merged parts, at most 2 * fanout a level each.
    """
    forest = grow(_leaves(docs, group, order, list(fields), list(carry)), fanout, rows_per_part, parts_merged)
    over = grow(forest.roots.select(F.lit(0).alias("g"), F.col("gid").alias("k"), F.col("root").alias("d"), F.col("gid").alias("c0")), fanout, rows_per_part, parts_merged)
    above = proofs(over).select(F.col("c0").alias("gid"), F.unhex("root").alias("root"), F.col("path").alias("upper"))
    return proofs(forest, above).withColumnsRenamed({f"c{k}": c for k, c in enumerate(carry)})


def fold(leaf_hex: Column, path: Column) -> Column:
    """Root that a leaf and its path lead to."""
    return F.aggregate(path, leaf_hex, lambda at, step: F.sha2(F.concat(step["before"], at, step["after"]), 256))


def siblings_digest(path: Column) -> Column:
    """Hash of a path's sibling digests, from the leaf's level to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)
