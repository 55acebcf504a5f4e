"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``sample_rows``, chosen by a hash of the id) a neighbour graph is
cut into equal parts, and a small network learns to tell a vector's parts from its
coordinates. Every row is indexed under its most probable part; a query goes to as many
of its most probable parts as the neighbours of sampled rows kept out of the training need
for ``recall``, and the candidates there are reranked by exact cosine. The number of parts
follows the sample. A part above ``rows_per_part`` rows is cut once more the same way, by a
graph and a network of its own, fitted to a bounded sample of the part.

Equal vectors are indexed once with their few smallest ids, since ties go to the smaller
id, and equal queries are searched once, so a vector that a third of all rows share
costs no more than another. Large parts are dealt out in blocks that any task can hold.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm._common import stored


def valid(vector: Column) -> Column:
    """Whether a vector takes part: not null or zero, every component present and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbour_graph(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """Indices of the k nearest rows by dot product, nearest first, self left out."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), block):
        sim = x[s : s + block] @ x.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -np.inf
        top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        out[s : s + block] = np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, axis=1), axis=1, kind="stable"), axis=1)
    return out


def partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Balanced parts of a neighbour graph: equal halves along main directions, then moves that cut fewer edges within the slack."""
    n = len(x)
    label = np.zeros(n, np.int64)
    open_parts, made = [(np.arange(n), parts, 0)], 0
    while open_parts:
        rows, share, first = open_parts.pop()
        if share == 1:
            label[rows] = first
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        axis = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
        for _ in range(12):
            axis = centred.T @ (centred @ axis)
            axis /= max(1e-12, np.linalg.norm(axis))
        left = share // 2
        order = rows[np.argsort(centred @ axis, kind="stable")]
        at = len(rows) * left // share
        open_parts += [(order[:at], left, first), (order[at:], share - left, first + left)]
    sizes = np.bincount(label, minlength=parts)
    most, least = int(np.ceil(slack * n / parts)), int(n / parts / slack)
    back: list[list[int]] = [[] for _ in range(n)]
    for v in range(n):
        for u in graph[v].tolist():
            back[u].append(v)
    both = [np.array(graph[v].tolist() + back[v]) for v in range(n)]
    for _ in range(rounds):
        moved = 0
        for v in range(n):
            votes = np.bincount(label[both[v]], minlength=parts)
            mine = label[v]
            if sizes[mine] <= least:
                continue
            votes[(sizes >= most) & (np.arange(parts) != mine)] = -1
            to = int(votes.argmax())
            if votes[to] > votes[mine]:
                label[v] = to
                sizes[mine] -= 1
                sizes[to] += 1
                moved += 1
        if moved < n // 500:
            break
    return label


class Router:
    """One hidden layer: probabilities of parts for unit vectors."""

    def __init__(self, dim: int, parts: int, hidden: int = 64, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, np.sqrt(2 / dim), (dim, hidden)), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts))]
        self.b = [np.zeros(hidden), np.zeros(parts)]
        self.probes = parts

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w[0] + self.b[0], 0) @ self.w[1] + self.b[1]

    def train(self, x: np.ndarray, target: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 3e-3, seed: int = 5) -> None:
        """Adam steps on the cross-entropy with soft targets."""
        rng = np.random.default_rng(seed)
        params = [*self.w, *self.b]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                a = x[order[s : s + batch]]
                h = np.maximum(a @ self.w[0] + self.b[0], 0)
                z = h @ self.w[1] + self.b[1]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                d = (p - target[order[s : s + batch]]) / len(a)
                dh = (d @ self.w[1].T) * (h > 0)
                t += 1
                for k, g in enumerate([a.T @ dh, h.T @ d, dh.sum(axis=0), d.sum(axis=0)]):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector, most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(x: np.ndarray, parts: int, top: int = 5, neighbours: int = 10, recall: float = 0.98, seed: int = 5) -> Router:
    """A router for unit vectors x, trained on four fifths of them, with the number of probes that the nearest rows of the others need."""
    router = Router(x.shape[1], parts)
    if parts == 1 or len(x) < 2:
        router.probes = parts
        return router
    graph = neighbour_graph(x, neighbours)
    label = partition(x, graph, parts)
    target = np.zeros((len(x), parts))
    near = np.concatenate([np.arange(len(x))[:, None], graph], axis=1)
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].ravel()), 1 / near.shape[1])
    out = np.random.default_rng(seed).random(len(x)) < 0.2
    if not out.any() or out.all():
        out[:] = False
    router.train(x[~out], target[~out])
    order = router.order(x)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(x), axis=0), axis=1)
    ask = np.flatnonzero(out) if out.any() else np.arange(len(x))
    needed = np.take_along_axis(rank[ask], order[:, 0][graph[ask, :top]], axis=1).ravel()
    router.probes = int(min(parts, 1 + np.searchsorted(np.cumsum(np.bincount(needed, minlength=parts)) / len(needed), recall)))
    return router


def _parts(sampled: int, most: int) -> int:
    """Parts for a sample: 32 rows each, whatever the table's size."""
    return int(max(1, min(most, sampled // 32)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 50,
    top: int = 5,
    sample_rows: int = 8192,
    most_parts: int = 64,
    rows_per_part: int = 65_536,
    block_rows: int = 8192,
    recall: float = 0.95,
    probes: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows by cosine for each row whose id is divisible by ``every``.

    Ties go to the smaller id; a query's own id is no candidate. Invalid vectors, null ids
    and vectors of another length than most take no part. Repeated queries count once.
    Other columns are ignored; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null").where(valid(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes["d"]
    rows = rows.where(F.size("v") == dim)
    # Of equal vectors the top + 1 smallest ids are enough; the limit holds before the shuffle too.
    first = Window.partitionBy("v").orderBy("id")
    distinct = stored(
        rows.select("id", "v").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= top + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("key", F.element_at("ids", 1)),
        "ann",
    )
    sample = distinct.select("key", "v").orderBy(F.xxhash64("key", F.lit(11)), "key").limit(sample_rows).toPandas()
    parts = _parts(len(sample), most_parts)
    router = fit(_unit(np.stack(sample["v"].to_numpy()).astype(np.float64)), parts, top, recall=math.sqrt(recall))
    sent = spark.sparkContext.broadcast(router)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = sent.value.order(_unit(_matrix(batch.column(1), dim)))[:, 0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], ["key", "v", "ids", "part"])

    placed = stored(distinct.select("key", "v", "ids").mapInArrow(home, "key long, v array<double>, ids array<long>, part int"), "ann-placed")
    under = _sub_routers(placed, rows_per_part, sample_rows, most_parts, top, math.sqrt(recall))
    if probes is not None:
        for r in (router, *under.values()):
            r.probes = min(probes, len(r.b[1]))
    subs, sent = spark.sparkContext.broadcast(under), spark.sparkContext.broadcast(router)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, out = batch.column(3).to_numpy(), np.zeros(batch.num_rows, np.int32)
            x = _unit(_matrix(batch.column(1), dim)) if batch.num_rows else None
            for p in np.unique(part).tolist():
                if p in subs.value:
                    mine = np.flatnonzero(part == p)
                    out[mine] = subs.value[p].order(x[mine])[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array((part * most_parts + out).astype(np.int32)), *batch.columns[:3]], ["leaf", "key", "v", "ids"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column(1), dim))
            order = sent.value.order(x)[:, : sent.value.probes]
            leaves: list[list[int]] = [[] for _ in range(len(x))]
            for p in np.unique(order).tolist():
                mine = np.flatnonzero((order == p).any(axis=1))
                sub = subs.value[p].order(x[mine])[:, : subs.value[p].probes] if p in subs.value else np.zeros((len(mine), 1), np.int64)
                for row, some in zip(mine.tolist(), (p * most_parts + sub).tolist(), strict=True):
                    leaves[row] += some
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int32()))], ["key", "v", "leaves"])

    indexed = stored(placed.mapInArrow(leaf, "leaf int, key long, v array<double>, ids array<long>"), "ann-indexed")
    # At most most_parts squared rows: one per leaf.
    blocks = F.broadcast(indexed.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")))
    candidates = indexed.join(blocks, "leaf").select("leaf", F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block"), F.lit(0).alias("asks"), "key", "v", "ids")
    asked = rows.where(F.col("id") % every == 0).select("id", "v").distinct()
    asking = placed.join(asked.select("v").distinct(), "v", "left_semi").select("key", "v").mapInArrow(ask, "key long, v array<double>, leaves array<int>")
    questions = (
        asking.select("key", "v", F.explode("leaves").alias("leaf"))
        .join(blocks, "leaf")
        .select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "key", "v", F.array().cast("array<long>").alias("ids"))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x, ids = None, [], []
        ready: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            part, block, asks = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
            bounds = [0, *cuts.tolist(), batch.num_rows] if batch.num_rows else []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if (part[s], block[s]) != at:
                    at, x, ids, ready = (part[s], block[s]), [], [], None
                v = _matrix(batch.column(4).slice(s, e - s), dim)
                if not asks[s]:
                    x.append(v)
                    ids += batch.column(5).slice(s, e - s).to_pylist()
                    continue
                if not x:
                    continue
                if ready is None:
                    every_x = np.concatenate(x)
                    ready = every_x, _unit(every_x)
                yield _answer(batch.column(3).slice(s, e - s).to_numpy(), v, *ready, ids, top + 1)

    dealt = candidates.unionByName(questions).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "asks")
    found = dealt.mapInArrow(search, "key long, vec_id long, score double")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top + 1).drop("n")
    of_query = asked.join(distinct.select("v", "key"), "v").select(F.col("id").alias("query_id"), "key")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        of_query.join(merged, "key")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(mine))
        .where(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )


def _sub_routers(placed: DataFrame, rows_per_part: int, sample_rows: int, most_parts: int, top: int, recall: float) -> dict[int, Router]:
    """A router for each part above rows_per_part rows, fitted in a task of its own to at most sample_rows rows of the part."""
    large = placed.groupBy("part").count().where(F.col("count") > rows_per_part).select("part")  # at most most_parts rows
    chosen = Window.partitionBy("part").orderBy(F.xxhash64("key", F.lit(13)), "key")
    sample = placed.join(F.broadcast(large), "part").select("part", "key", "v").withColumn("n", F.row_number().over(chosen)).where(F.col("n") <= sample_rows)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        router = fit(_unit(np.stack(rows["v"].to_numpy()).astype(np.float64)), _parts(len(rows), most_parts), top, recall=recall)
        return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "router": [pickle.dumps(router)]})

    return {r["part"]: pickle.loads(r["router"]) for r in sample.groupBy("part").applyInPandas(learn, "part int, router binary").collect()}


def _answer(keys: np.ndarray, q: np.ndarray, x: np.ndarray, unit: np.ndarray, ids: list[list[int]], top: int) -> pa.RecordBatch:
    """The top rows of one block for each query: a matrix product finds them, the exact cosine in a fixed order of sums ranks them."""
    out_key, out_id, out_score = [], [], []
    for s in range(0, len(q), 256):
        near = _unit(q[s : s + 256]) @ unit.T
        k = min(top, near.shape[1])
        least = np.partition(near, -k, axis=1)[:, -k] - 1e-9
        for r, key in enumerate(keys[s : s + 256].tolist()):
            a, rows = q[s + r], np.flatnonzero(near[r] >= least[r])
            b = x[rows]
            scores = (b * a).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))
            flat = [(-sc, i) for sc, row in zip(scores.tolist(), rows.tolist(), strict=True) for i in ids[row]]
            for sc, i in sorted(flat)[:top]:
                out_key.append(key)
                out_id.append(i)
                out_score.append(-sc)
    return pa.RecordBatch.from_arrays([pa.array(out_key, pa.int64()), pa.array(out_id, pa.int64()), pa.array(out_score, pa.float64())], ["key", "vec_id", "score"])
