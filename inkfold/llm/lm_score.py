"""Masked pseudo-likelihood by a bidirectional window network trained in numpy.

Every word of the corpus is in the vocabulary, a distributed table of counts. The network
predicts a token's class: the most frequent words are classes of their own, all others
are hashed to ``rare`` classes; a token's probability is that of its class, given
``reach`` tokens on either side, times the word's share of its class by the counts of all
documents. Position-specific embeddings of the neighbours' classes are summed, squashed
and projected to two softmaxes, over groups of classes and over the classes of a group,
whose biases start from the corpus frequencies.

Texts are dealt to tasks by a hash of id and text and split into words once; a *chunk* of
them holds its own dictionary, so only distinct words of chunks are joined with the
counts, and later passes read one byte a token. In each pass every chunk takes mini-batch
steps from the common parameters over its own masked tokens (one in ``mask``, in turn; one
in ``passes`` unless given, so that the passes together mask every token once), and the
changes are averaged by the tokens behind them. Chunks depend on rows alone and changes
travel as whole numbers of 2**-20, so neither the layout of the input files nor the order
in which tasks end shows in the scores. A document's score is the sum of the
log-probabilities of all its tokens, each masked in turn.
"""

from __future__ import annotations

import copy
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm._common import cut, stored
from inkfold.llm._text import words

_SCALE = float(1 << 20)
CHUNK_WORDS = 200_000  # distinct words and tokens after which a chunk ends with the text at hand
CHUNK_TOKENS = 1 << 21
SHARD_BYTES = 16 << 20


def chunk_texts(docs: DataFrame) -> DataFrame:
    """chunk, ids, lens, tokens (places in the chunk's dictionary), words, counts; docs: id long, text."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    shards = max(8, math.ceil(size / SHARD_BYTES))
    dealt = docs.withColumn("key", F.xxhash64("id", "text")).repartition(shards, "key").sortWithinPartitions("key", "id").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made = TaskContext.get().partitionId(), 0
        local: defaultdict[str, int] = defaultdict()
        local.default_factory = local.__len__
        ids: list[int | None] = []
        texts: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            tokens = np.concatenate(texts).astype(np.int32)
            packed = tokens.astype(np.uint16) if len(local) <= 1 << 16 else tokens
            cols = [
                pa.array([(shard << 32) + made], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int32())),
                pa.array([packed.tobytes()], pa.binary()),
                pa.array([list(local)], pa.list_(pa.string())),
                pa.array([np.bincount(tokens, minlength=len(local))], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(cols, ["chunk", "ids", "lens", "tokens", "words", "counts"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(np.array([local[w] for w in words(text)], np.int32))
                held += len(texts[-1])
                if len(local) >= CHUNK_WORDS or held >= CHUNK_TOKENS or len(ids) >= CHUNK_TOKENS:
                    yield out()
                    made += 1
                    local.clear()
                    ids, texts, held = [], [], 0
        if ids:
            yield out()

    return stored(dealt.mapInArrow(run, "chunk long, ids array<long>, lens array<int>, tokens binary, words array<string>, counts array<long>"), "lm-chunks")


def count_words(chunks: DataFrame) -> DataFrame:
    """word, n over all documents; grows with the corpus and stays distributed."""
    return stored(chunks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n")), "lm-words")


def word_class(word: Column, frequent: int, rare: int) -> Column:
    """Class of a word that is not among the frequent ones."""
    return (F.pmod(F.crc32(word.cast("binary")), F.lit(rare)) + frequent).cast("int")


def classes(counts: DataFrame, frequent: int, rare: int) -> tuple[list[tuple[str, int]], np.ndarray]:
    """The ``frequent`` most frequent words with their counts (ties in order of the word), and the count of every class."""
    known = [(r["word"], r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(frequent).collect()]
    total = np.zeros(len(known) + rare)
    total[: len(known)] = [n for _, n in known]
    rest = counts.where(~F.col("word").isin([w for w, _ in known])) if known else counts
    for r in rest.groupBy(word_class(F.col("word"), len(known), rare).alias("c")).agg(F.sum("n").alias("n")).collect():  # at most rare rows
        total[r["c"]] = r["n"]
    return known, total


def encode(chunks: DataFrame, counts: DataFrame, known: list[tuple[str, int]], total: np.ndarray) -> DataFrame:
    """chunk, ids, lens, tokens (one byte each: classes), inner (per text: sum of log P(word | class))."""
    spark, frequent, rare = chunks.sparkSession, len(known), len(total) - len(known)
    if len(total) > 256:
        raise ValueError("frequent and rare classes together must be at most 256")
    local = chunks.select("chunk", F.posexplode("words").alias("at", "word"))
    top = F.broadcast(spark.createDataFrame([(w, k) for k, (w, _) in enumerate(known)], "word string, class int"))
    sizes = F.array(*[F.lit(float(n)) for n in total])
    others = counts.join(top, "word", "left_anti").select("word", word_class(F.col("word"), frequent, rare).alias("class"), "n")
    others = others.select("word", "class", F.ln(F.col("n") / F.get(sizes, F.col("class"))).alias("inner"))
    looked = local.join(top, "word").select("chunk", "at", "class", F.lit(0.0).alias("inner")).unionByName(
        local.join(top, "word", "left_anti").join(others, "word").select("chunk", "at", "class", "inner")
    )
    looked = looked.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "class", "inner"))).alias("w")).select("chunk", "w.class", "w.inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one chunk at a time, as arrays
                n, c, x = (np.asarray(batch.column(j)[k].values if batch.column(j)[k].is_valid else [], kind) for j, kind in ((2, np.int64), (4, np.uint8), (5, np.float64)))
                t = batch.column(3)[k].as_py()
                at = np.frombuffer(t, np.uint16 if len(t) == 2 * n.sum() else np.int32)
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns[:3], pa.array([c[at].tobytes()], pa.binary()), pa.array([_sums(x[at], n)], pa.list_(pa.float64()))], ["chunk", "ids", "lens", "tokens", "inner"]
                )

    joined = chunks.select("chunk", "ids", "lens", "tokens").join(looked, "chunk", "left")
    return stored(joined.mapInArrow(run, "chunk long, ids array<long>, lens array<int>, tokens binary, inner array<double>"), "lm-ready")


def _sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sum per text of values laid end to end."""
    out, some = np.zeros(len(lens)), lens > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(lens) - lens)[some])
    return out


class Window:
    """The network: neighbours' embeddings per offset, a squashed sum, a softmax over groups of classes and one over the classes of the group.

    Classes stand by frequency, so groups of about the square root of their number hold
    classes alike in frequency; a token costs two small softmaxes instead of a large one.
    """

    def __init__(self, size: int, reach: int = 2, dim: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.reach, self.size = reach, size
        self.per = max(1, math.ceil(math.sqrt(size)))
        groups = -(-size // self.per)
        self.into = rng.normal(0, 0.3, (2 * reach, size + 1, dim)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (dim, size)).astype(np.float32)
        self.bias = np.zeros(size, np.float32)
        self.top = rng.normal(0, 0.1, (dim, groups)).astype(np.float32)
        self.top_bias = np.zeros(groups, np.float32)

    @property
    def params(self) -> list[np.ndarray]:
        return [self.into, self.out, self.bias, self.top, self.top_bias]

    def neighbours(self, laid: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Classes at each offset from places in texts laid out with padding."""
        return [laid[at + k] for k in range(-self.reach, self.reach + 1) if k]

    def hidden(self, near: list[np.ndarray]) -> np.ndarray:
        total = self.into[0][near[0]]
        for table, n in zip(self.into[1:], near[1:], strict=True):
            total = total + table[n]
        return np.tanh(total)

    def by_group(self, group: np.ndarray) -> Iterator[tuple[slice, slice]]:
        """The classes of every group at hand and its rows; group is in order."""
        cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
        for s, e in zip(cuts, [*cuts[1:], len(group)], strict=True):
            g = int(group[s])
            yield slice(g * self.per, min((g + 1) * self.per, self.size)), slice(s, e)

    def log_probs(self, near: list[np.ndarray], target: np.ndarray) -> np.ndarray:
        order = _order(target)
        target = target[order]
        h, group = self.hidden([n[order] for n in near]), target // self.per
        logs = _log_softmax_at(self.top.T @ h.T + self.top_bias[:, None], group)
        for block, rows in self.by_group(group):
            logs[rows] += _log_softmax_at(self.out[:, block].T @ h[rows].T + self.bias[block, None], target[rows] - block.start)
        out = np.empty_like(logs)
        out[order] = logs
        return out

    def gradients(self, near: list[np.ndarray], target: np.ndarray) -> list[np.ndarray]:
        """Summed gradients of the negative log-likelihood for params."""
        order = _order(target)
        target, near = target[order], [n[order] for n in near]
        h, group = self.hidden(near), target // self.per
        z = _softmax_less_one(self.top.T @ h.T + self.top_bias[:, None], group)
        g_top, g_top_bias, d = (z @ h).T, z.sum(axis=1), z.T @ self.top.T
        g_out, g_bias = np.zeros_like(self.out), np.zeros_like(self.bias)
        for block, rows in self.by_group(group):
            mine = h[rows]
            z = _softmax_less_one(self.out[:, block].T @ mine.T + self.bias[block, None], target[rows] - block.start)
            g_out[:, block], g_bias[block] = (z @ mine).T, z.sum(axis=1)
            d[rows] += z.T @ self.out[:, block].T
        d *= 1 - h * h
        g_in = np.zeros_like(self.into)
        for table, n in zip(g_in, near, strict=True):
            order = _order(n)
            first = np.flatnonzero(np.concatenate(([True], np.diff(n[order]) != 0)))
            table[n[order][first]] = np.add.reduceat(d[order], first, axis=0)
        return [g_in, g_out, g_bias, g_top, g_top_bias]


def _order(classes: np.ndarray) -> np.ndarray:
    """Stable order of classes; two-byte numbers are sorted digit by digit."""
    return np.argsort(classes.astype(np.uint16), kind="stable")


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """z: classes down, tokens across, so that sums run over whole rows."""
    z -= z.max(axis=0)
    own = z[at, np.arange(len(at))]
    return own - np.log(np.exp(z, out=z).sum(axis=0))


def _softmax_less_one(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Softmax, less one at the target."""
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0)
    z[at, np.arange(len(at))] -= 1
    return z


def _padded(tokens: bytes, lens: np.ndarray, reach: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's classes with padding around every text, and the place of each token there."""
    at = np.arange(int(lens.sum())) + reach * (np.repeat(np.arange(len(lens)), lens) + 1)
    laid = np.full(len(at) + reach * (len(lens) + 1), pad, np.int32)
    laid[at] = np.frombuffer(tokens, np.uint8)
    return laid, at


def _steps(net: Window, laid: np.ndarray, at: np.ndarray, rate: float, batch: int) -> None:
    """AdaGrad mini-batches over masked places, in place."""
    params = net.params
    squares = [np.full(p.shape, 1e-3, np.float32) for p in params]
    for s in range(0, len(at), batch):
        some = at[s : s + batch]
        g = net.gradients(net.neighbours(laid, some), laid[some])
        for p, q, x in zip(params, squares, g, strict=True):
            x = x / len(some)
            q += x * x
            p -= rate * x / np.sqrt(q)


def train(ready: DataFrame, total: np.ndarray, passes: int = 2, mask: int | None = None, rate: float = 0.1, batch: int = 2048, reach: int = 2, dim: int = 16, seed: int = 3) -> Window:
    """Passes over every chunk, masking each token in one of them unless mask is given; total: counts of the classes, the biases to begin with."""
    mask = mask or max(1, passes)
    net = Window(len(total), reach, dim, seed)
    share = (total + 1.0) / (total + 1.0).sum()
    net.bias += np.log(share).astype(np.float32)
    net.top_bias += np.log(np.add.reduceat(share, np.arange(0, len(total), net.per))).astype(np.float32)
    sizes = [p.size for p in net.params]
    for turn in range(passes):
        sent = ready.sparkSession.sparkContext.broadcast((net, turn))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            common, turn = sent.value
            flat = np.zeros(sum(sizes) + 1, np.int64)
            for batch_ in batches:
                for lens, tokens in zip(batch_.column(0).to_pylist(), batch_.column(1).to_pylist(), strict=True):
                    laid, at = _padded(tokens, np.array(lens, np.int64), reach, common.size)
                    at = at[(np.arange(len(at)) + turn) % mask == 0]
                    if not len(at):
                        continue
                    mine = copy.deepcopy(common)
                    _steps(mine, laid, at, rate, batch)
                    change = np.concatenate([(x - y).ravel() for x, y in zip(mine.params, common.params, strict=True)])
                    flat[:-1] += np.rint(change.astype(np.float64) * len(at) * _SCALE).astype(np.int64)
                    flat[-1] += len(at)
            hit = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(flat[hit])], ["at", "value"])

        # As many rows as the network has parameters, whatever the corpus.
        summed = ready.select("lens", "tokens").mapInArrow(run, "at long, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("double").alias("value"))
        sums = np.zeros(sum(sizes) + 1)
        for r in summed.collect():
            sums[r["at"]] = r["value"]
        if not sums[-1]:
            break
        parts = np.split(sums[:-1] / _SCALE / sums[-1], np.cumsum(sizes)[:-1])
        for p, x in zip(net.params, parts, strict=True):
            p += x.reshape(p.shape).astype(np.float32)
        sent.unpersist()
    return net


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = 192, rare: int = 64, **training) -> DataFrame:
    """id, n_tokens, pseudo_log_likelihood (sum over tokens), mean_log_prob per row.

    Null texts and texts without words have no tokens, sum 0 and a null mean; rows with
    null or repeated ids each give a row. Texts of any length are scored whole. Other
    columns are ignored; an empty table gives an empty one.
    """
    chunks = chunk_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    counts = count_words(chunks)
    known, total = classes(counts, frequent, rare)
    ready = encode(chunks, counts, known, total)
    net = train(ready, total, **training)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            for ids, lens, tokens, inner in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                lens = np.array(lens, np.int64)
                laid, at = _padded(tokens, lens, held.reach, held.size)
                logs = np.concatenate([np.empty(0), *(held.log_probs(held.neighbours(laid, at[s : s + 16384]), laid[at[s : s + 16384]]) for s in range(0, len(at), 16384))])
                sums = _sums(logs.astype(np.float64), lens) + np.array(inner)
                means = pa.array(sums / np.maximum(lens, 1), mask=lens == 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lens), pa.array(sums), means], ["id", "n_tokens", "pseudo_log_likelihood", "mean_log_prob"])

    return ready.select("ids", "lens", "tokens", "inner").mapInArrow(run, "id long, n_tokens long, pseudo_log_likelihood double, mean_log_prob double")
