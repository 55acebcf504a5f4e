"""Hard-negative mining by dual-tree search over inner products.

A top tree, grown on a bounded sample, deals all rows into blocks of a bounded size. A
pair of an anchor group and a block is only searched if the interval of inner products
between their balls can hold an answer. Inside a block a ball tree of its rows meets a
ball tree of each batch of anchors: a pair of nodes whose interval lies outside what every
anchor of the node still needs is dropped for the whole group at once; pairs of leaves are
scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm._common import stored

FEW = np.iinfo(np.int64).min + 1  # no score; its negative is a number too


@dataclass
class Ball:
    """A node over rows[begin:end] of a tree's order, with its children or none."""

    begin: int
    end: int
    centre: np.ndarray
    radius: float
    kids: tuple[int, int] | None


def ball_tree(x: np.ndarray, leaf: int) -> tuple[np.ndarray, list[Ball]]:
    """Row order and nodes, root first; nodes are halved at the median along the line between two far points, equal points by place."""
    order, nodes = np.arange(len(x)), []

    def grow(begin: int, end: int) -> int:
        rows = x[order[begin:end]]
        centre = rows.mean(axis=0)
        off = ((rows - centre) ** 2).sum(axis=1)
        at = len(nodes)
        nodes.append(Ball(begin, end, centre, math.sqrt(off.max()) * (1 + 1e-12), None))
        if end - begin > leaf and off.max() > 0:
            a = rows[off.argmax()]
            b = rows[((rows - a) ** 2).sum(axis=1).argmax()]
            middle = (end - begin) // 2
            order[begin:end] = order[begin:end][np.argsort(rows @ (b - a), kind="stable")]
            nodes[at].kids = (grow(begin, begin + middle), grow(begin + middle, end))
        return at

    if len(x):
        grow(0, len(x))
    return order, nodes


def bounds(a: np.ndarray, ra, b: np.ndarray, rb):
    """Least and greatest inner product between points of two balls (arrays of balls broadcast), widened for rounding."""
    middle = a @ b.T if a.ndim > 1 else b @ a
    na, nb = np.sqrt((a * a).sum(axis=-1)), np.sqrt((b * b).sum(axis=-1))
    if a.ndim > 1:
        na, ra = na[:, None], np.asarray(ra)[:, None]
    reach = na * rb + nb * ra + ra * rb
    slack = 1e-9 * (na * nb + reach) + 1e-9
    return middle - reach - slack, middle + reach + slack


class Wants:
    """What anchors still need: per row up to `top` best (score, smallest id) with low <= score <= high; rows may belong to the same anchor."""

    def __init__(self, label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, top: int, self_id: np.ndarray) -> None:
        self.label, self.low, self.high, self.same, self.top, self.self_id = label, low.copy(), high, same, top, self_id
        n = len(label)
        self.score, self.id = np.full((n, top), FEW, np.int64), np.full((n, top), np.iinfo(np.int64).max, np.int64)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Exact scores (len(rows) by len(ids)); keeps the best, higher first, ties by smaller id."""
        fits = (score >= self.low[rows, None]) & (score <= self.high[rows, None]) & ((labels[None, :] == self.label[rows, None]) == self.same) & (ids[None, :] != self.self_id[rows, None])
        for k in np.flatnonzero(fits.any(axis=1)).tolist():
            row, hit = rows[k], np.flatnonzero(fits[k])
            s, i = np.concatenate([self.score[row], score[k, hit]]), np.concatenate([self.id[row], ids[hit]])
            best = np.lexsort((i, -s))[: self.top]
            self.score[row], self.id[row] = s[best], i[best]
            self.low[row] = max(self.low[row], self.score[row, -1])  # a tie may still win by its id


def search(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, tree: tuple[np.ndarray, list[Ball]], q: np.ndarray, wants: Wants, leaf: int) -> int:
    """Fill wants from one block; the number of scores computed."""
    order, nodes = tree
    q_order, q_nodes = ball_tree(q, leaf)
    scored, todo = 0, [(0, 0)] if nodes and q_nodes else []
    while todo:
        a, b = todo.pop()
        p, c = q_nodes[a], nodes[b]
        mine = q_order[p.begin : p.end]
        least, most = bounds(p.centre, p.radius, c.centre, c.radius)
        mine = mine[(wants.low[mine] <= most) & (wants.high[mine] >= least)]
        if not len(mine):
            continue
        if p.kids is None and c.kids is None:
            theirs = order[c.begin : c.end]
            wants.offer(mine, np.rint(q[mine] @ x[theirs].T).astype(np.int64), ids[theirs], labels[theirs])
            scored += len(mine) * len(theirs)
        elif c.kids is None or (p.kids is not None and p.radius > c.radius):
            todo += [(k, b) for k in p.kids]
        else:  # the nearer child is searched first
            todo += sorted(((a, k) for k in c.kids), key=lambda t: float(p.centre @ nodes[t[1]].centre))
    return scored


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim).astype(np.float64) if len(column) else np.zeros((0, dim))


def _deal(x: np.ndarray, tree: tuple[np.ndarray, list[Ball]]) -> np.ndarray:
    """Leaf of each row: from the root to the child whose centre is nearer."""
    nodes = tree[1]
    out = np.zeros(len(x), np.int32)
    todo = [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        if nodes[k].kids is None:
            out[rows] = k
            continue
        a, b = (nodes[j].centre for j in nodes[k].kids)
        right = x[rows] @ (b - a) > (b @ b - a @ a) / 2
        todo += [(nodes[k].kids[0], rows[~right]), (nodes[k].kids[1], rows[right])]
    return out


def _search_blocks(dim: int, top: int, leaf: int, batch_rows: int, same: bool):
    """Streams blocks: a block's rows come first, then its anchors, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, ready = None, [], None
        for batch in batches:
            block, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if s == e:
                    continue
                if block[s] != at:
                    at, parts, ready = block[s], [], None
                part = batch.slice(s, e - s)
                ids, labels, v = part.column(2).to_numpy(), part.column(3).to_numpy(), _matrix(part.column(4), dim)
                if not asks[s]:
                    parts.append((ids, labels, v))
                    continue
                if not parts:
                    continue
                if ready is None:
                    every = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    ready = (every[2], every[0], every[1], ball_tree(every[2], leaf))
                low, high, key = (part.column(k).to_numpy() for k in (5, 6, 7))
                for k in range(0, len(ids), batch_rows):
                    cut = slice(k, k + batch_rows)
                    wants = Wants(labels[cut], low[cut], high[cut], same, top, ids[cut])
                    search(*ready, v[cut], wants, leaf)
                    row, rank = np.nonzero(wants.score > FEW)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[cut][row]), pa.array(key[cut][row]), pa.array(wants.id[row, rank]), pa.array(wants.score[row, rank])], ["anchor_id", "key", "vec_id", "score"]
                    )

    return run


def _reachable(blocks: DataFrame, centres: dict[int, np.ndarray], groups: list[tuple[int, float, int, int]]) -> DataFrame:
    """(leaf, block) pairs whose interval meets what the group's anchors need; one pass over the blocks."""
    at = np.array([g[0] for g in groups], np.int32)
    centre = np.array([centres[g[0]] for g in groups])
    radius, low, high = (np.array([g[k] for g in groups], np.float64) for k in (1, 2, 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(at):
                leaf, block, wide = (batch.column(k).to_numpy() for k in range(3))
                least, most = bounds(centre, radius, np.array([centres[k] for k in leaf.tolist()]), wide[None, :])
                g, b = np.nonzero((low[:, None] <= most) & (high[:, None] >= least))
                yield pa.RecordBatch.from_arrays([pa.array(at[g]), pa.array(block[b])], ["leaf", "block"])

    return blocks.select("leaf", "block", "radius").mapInArrow(run, "leaf int, block long")


def mine(
    vectors: DataFrame, anchors: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, *, sample_rows: int = 8192, top_leaves: int = 64, block_rows: int = 131_072, leaf: int = 64, batch_rows: int = 512
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; 0 <= least <= most.

    vectors(vec_id, label, v): whole-number components as array<double>; a shorter vector
    counts as filled up with zeros. Anchors are rows whose vec_id is divisible by `anchors`; an anchor's positives
    are its best other rows of the same label; of the rows of another label whose score lies
    between `least` and `most` hundredths of a positive's, the first are its negatives.
    Higher scores come first, ties by smaller vec_id. Every row is searched: blocks and
    groups are only left out where no score in them can be an answer. An anchor without
    positives, or a positive without rows in its interval (always so below zero), has no
    rows. Repeated rows count as often as they occur, but a repeated id asks once, by its
    smallest label and vector, and is never its own answer; null ids, labels or vectors take no part, other columns are
    not read. Components so large that a product may exceed 2**53 are refused.

    The top tree is fitted to sample_rows rows (by a hash) and has at most top_leaves
    leaves; a leaf above block_rows rows is dealt to several blocks by a hash, so that
    copies of one vector do not meet in one task. A task holds one block and a batch of anchors.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v")
    out_schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    shape = rows.agg(F.min(F.size("v")).alias("d"), F.max(F.size("v")).alias("e"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).first()
    if shape["d"] is None:
        return spark.createDataFrame([], out_schema)
    if shape["norm"] >= 2.0**53:
        raise ValueError("components so large that inner products are not exact")
    dim = max(1, shape["e"])
    if shape["d"] < dim:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v"))))
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(sample_rows).select("v").collect()], np.float64).reshape(-1, dim)
    tree = ball_tree(sample, max(1, -(-len(sample) // top_leaves)))
    centres = {k: n.centre for k, n in enumerate(tree[1]) if n.kids is None}
    sent = spark.sparkContext.broadcast((tree, centres))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, centres = sent.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2), dim)
                at = _deal(x, tree)
                off = np.sqrt(((x - np.array([centres[k] for k in at.tolist()])) ** 2).sum(axis=1)) * (1 + 1e-12)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(off)], ["vec_id", "label", "v", "leaf", "off"])

    placed = stored(rows.mapInArrow(deal, "vec_id long, label long, v array<double>, leaf int, off double"), "negatives-placed")
    sizes = F.broadcast(placed.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("blocks")))  # at most top_leaves rows
    inside = placed.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks") * 65_536 + F.col("leaf"))
    blocks = inside.groupBy("leaf", "block").agg(F.max("off").alias("radius"))
    candidates = inside.select("block", F.lit(0).alias("asks"), "vec_id", "label", "v", *(F.lit(0).cast("long").alias(c) for c in ("low", "high", "key")), "leaf")
    asking = inside.where(F.col("vec_id") % anchors == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v", "leaf", "off", "block")).alias("a")).select("vec_id", "a.label", "a.v", "a.leaf", "a.off", F.col("a.block").alias("home"))
    columns = ["block", F.lit(1).alias("asks"), "vec_id", "label", "v", "low", "high", "key", "leaf"]

    def searched(sends: DataFrame, top: int, same: bool, n: str) -> DataFrame:
        dealt = candidates.unionByName(sends.select(*columns)).repartition("block").sortWithinPartitions("block", "asks", "leaf", "vec_id")
        return stored(dealt.mapInArrow(_search_blocks(dim, top, leaf, batch_rows, same), "anchor_id long, key long, vec_id long, score long"), n)

    def needs(asked: DataFrame) -> list[tuple[int, float, int, int]]:
        """Per leaf of the top tree, at most top_leaves rows: radius of its anchors, least and greatest score they need."""
        return [tuple(r) for r in asked.groupBy("leaf").agg(F.max("off"), F.min("low"), F.max("high")).collect()]

    far = np.iinfo(np.int64).max
    at_home = searched(asking.withColumns({"low": F.lit(FEW + 1), "high": F.lit(far), "key": F.lit(0).cast("long"), "block": F.col("home")}), positives, True, "negatives-home")
    held = at_home.groupBy("anchor_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    asked = asking.join(held, F.col("vec_id") == F.col("anchor_id"), "left").withColumns({"low": F.when(F.col("n") >= positives, F.col("worst")).otherwise(F.lit(FEW + 1)), "high": F.lit(far), "key": F.lit(0).cast("long")})
    elsewhere = asked.join(_reachable(blocks, centres, needs(asked)), "leaf").where("block <> home")
    found = at_home.unionByName(searched(elsewhere, positives, True, "negatives-same"))
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    chosen = stored(
        found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives).where("score >= 0").select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives"
    )
    # Equal positive scores of an anchor ask once; a negative score has an empty interval.
    ranges = chosen.select("anchor_id", F.col("positive_score").alias("key")).distinct().select("anchor_id", "key", F.expr(f"(key * {least} + 99) div 100").alias("low"), F.expr(f"key * {most} div 100").alias("high"))
    ranged = asking.join(ranges, F.col("vec_id") == F.col("anchor_id")).where("low <= high")
    hits = searched(ranged.join(_reachable(blocks, centres, needs(ranged)), "leaf"), negatives, False, "negatives-other")
    top = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= negatives)
    return chosen.join(ranked, (chosen["anchor_id"] == ranked["anchor_id"]) & (chosen["positive_score"] == ranked["key"])).select(
        chosen["anchor_id"], "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def whole_vectors(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, label, v: components scaled and floored; rows with a null label or vector, or a null or non-finite component, are left out."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above infinity in Spark
    ok = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite
    return embeddings.where(ok).select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
