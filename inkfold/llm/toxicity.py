"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of two rows of one hashed table, for the word and for its
first letters. Filters of several widths slide over the text, a max pool over the whole
text feeds a logistic layer. Training takes a bounded sample of labelled rows
(``sample_rows``); rows never seen in it keep a zero embedding, so unknown words add
nothing to any maximum. Thresholds are calibrated per language, guessed from function
words of the text itself, on a part of the sample that the filters are not fitted to;
the score maps each language's threshold to 0.7.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm._common import cut, small_enough
from inkfold.llm._text import words

BUCKETS = 1 << 18
WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 8
PREFIX = 4
THRESHOLD = 0.7

# Function words that tell the languages apart.
LANGUAGES = {
    "en": "the and of to is that with for it was are this by from on as be not".split(),
    "de": "der die und das den von ist mit dem des nicht sich auf für als auch ein eine".split(),
    "fr": "le la les des est et que dans pour qui sur pas par au une un du en".split(),
    "es": "el los las que del por con para una como su se lo de y es no".split(),
}
_LANGUAGE_OF = {w: [k for k, ws in enumerate(LANGUAGES.values()) if w in ws] for ws in LANGUAGES.values() for w in ws}


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Hasher:
    """Words to bucket pairs, remembered for words seen before."""

    def __init__(self, most: int = 1 << 20):
        self.known: dict[str, tuple[int, int]] = {}
        self.most = most

    def _hash(self, word: str) -> tuple[int, int]:
        pair = 1 + zlib.crc32(word.encode()) % (BUCKETS - 1), 1 + zlib.crc32(b"^" + word[:PREFIX].encode()) % (BUCKETS - 1)
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[word] = pair
        return pair

    def encode(self, text: str | None) -> tuple[np.ndarray, int]:
        """int32 pairs of a whole text, and its language (index into LANGUAGES, or their number if none leads)."""
        ws = words(text)
        get, make = self.known.get, self._hash
        pairs = np.array([get(w) or make(w) for w in ws], np.int32).reshape(-1, 2)
        votes = [0] * len(LANGUAGES)
        look = _LANGUAGE_OF.get
        for w in ws:
            for k in look(w, ()):
                votes[k] += 1
        most = max(votes)
        return pairs, votes.index(most) if votes.count(most) == 1 else len(LANGUAGES)


class Network:
    """Embedding table, filters per width, logistic layer, one offset per language."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = np.zeros((BUCKETS, DIM), np.float32)
        self.filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for k in self.filters:
            k[:, 0, :] = np.abs(k[:, 0, :]) + 0.5 / len(k)
        self.bias = np.full((len(WIDTHS), FILTERS), -0.2, np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
        self.out_bias = np.float32(-1.0)
        self.offsets = np.zeros(len(LANGUAGES) + 1)
        self.scale = 1.0

    def responses(self, pairs: np.ndarray) -> list[np.ndarray]:
        """Per width: filter responses at every position of words laid end to end."""
        e = self.table[pairs[:, 0]] + self.table[pairs[:, 1]]
        n = len(e)
        out = []
        for w, k, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            r = np.tile(b, (n, 1))
            for j in range(w):
                r[: n - j] += e[j:] @ k[j]
            r[pairs[:, 0] == 0] = 0  # no window starts in the padding
            out.append(np.maximum(r, 0))
        return out

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        """One logit per text; texts go through together, parted by zero rows as wide as the widest filter."""
        pad = np.zeros((max(WIDTHS), 2), np.int32)
        laid = np.concatenate([x for t in texts for x in (t, pad)])
        starts = np.cumsum([0] + [len(t) + len(pad) for t in texts[:-1]])
        pooled = np.concatenate([np.maximum.reduceat(r, starts, axis=0) for r in self.responses(laid)], axis=1)
        return pooled @ self.out + self.out_bias

    def score(self, logit: np.ndarray, language: np.ndarray) -> np.ndarray:
        z = self.scale * (logit.astype(np.float64) - self.offsets[language]) + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _log_odds(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Shrunken log-odds of a bucket's presence in label-1 texts: where the first embedding coordinate starts."""
    n = np.zeros((2, BUCKETS), np.float32)
    for t, k in zip(texts, y, strict=True):
        n[k, np.unique(t)] += 1
    total = np.bincount(y, minlength=2).astype(np.float32)
    z = np.log((n[1] + 0.5) / (total[1] + 1)) - np.log((n[0] + 0.5) / (total[0] + 1))
    both = n.sum(axis=0)
    z *= np.where(both >= 2, both**2 / (both**2 + 60), 0)  # words of a few copied texts count little
    z[0] = 0
    return z


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = 5, batch: int = 32, rate: float = 0.05, seed: int = 7) -> Network:
    """Fit by mini-batches of AdaGrad steps; the gradient of a max pool reaches only the winning windows."""
    net, rng = Network(seed), np.random.default_rng(seed)
    odds = _log_odds(texts, y)
    seen = np.flatnonzero(odds)
    net.table[seen] = rng.normal(0, 0.02, (len(seen), DIM))
    net.table[:, 0] = odds / 4
    sums = {"table": np.full(BUCKETS, 1e-2, np.float32), "out": np.full(len(net.out), 1e-2), "b": 1e-2, "f": [np.full(k.shape, 1e-2) for k in net.filters], "fb": np.full(net.bias.shape, 1e-2)}
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).mean()), 0.5 / max(1e-9, (y == 0).mean()))
    weight = np.where(y == 1, min(10.0, 0.5 / max(1e-9, (y == 1).mean())), weight)
    pad = np.zeros((max(WIDTHS), 2), np.int32)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), batch):
            some = order[s : s + batch]
            laid = np.concatenate([x for k in some for x in (texts[k], pad)])
            bounds = np.cumsum([0] + [len(texts[k]) + len(pad) for k in some])
            resp = net.responses(laid)
            where = [np.stack([a + r[a:b].argmax(axis=0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]) for r in resp]
            pooled = np.concatenate([np.take_along_axis(r, w, axis=0) for r, w in zip(resp, where, strict=True)], axis=1)
            p = 1 / (1 + np.exp(-(pooled @ net.out + net.out_bias)))
            g = ((p - y[some]) * weight[some] / len(some)).astype(np.float32)
            g_out, g_b = pooled.T @ g, g.sum()
            g_pool = np.outer(g, net.out) * (pooled > 0)
            sums["out"] += g_out**2
            net.out -= (rate * g_out / np.sqrt(sums["out"])).astype(np.float32)
            sums["b"] += g_b**2
            net.out_bias -= np.float32(rate * g_b / math.sqrt(sums["b"]))
            rows, grads = [], []
            for i, w in enumerate(WIDTHS):
                gp, at = g_pool[:, i * FILTERS : (i + 1) * FILTERS], where[i]
                g_f = np.zeros_like(net.filters[i])
                for j in range(w):
                    pos = np.minimum(at + j, len(laid) - 1)
                    e = net.table[laid[pos, 0]] + net.table[laid[pos, 1]]
                    g_f[j] = np.einsum("df,dfk->kf", gp, e)
                    ge = gp[:, :, None] * net.filters[i][j].T[None]
                    for side in (0, 1):
                        rows.append(laid[pos, side].ravel())
                        grads.append(ge.reshape(-1, DIM))
                sums["f"][i] += g_f**2
                net.filters[i] -= (rate * g_f / np.sqrt(sums["f"][i])).astype(np.float32)
                g_fb = gp.sum(axis=0)
                sums["fb"][i] += g_fb**2
                net.bias[i] -= (rate * g_fb / np.sqrt(sums["fb"][i])).astype(np.float32)
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            hit, back = np.unique(rows, return_inverse=True)
            total = np.zeros((len(hit), DIM), np.float32)
            np.add.at(total, back, grads)
            total[(odds[hit] == 0) | (hit == 0)] = 0  # what the sample hardly shows stays at zero
            sums["table"][hit] += (total**2).sum(axis=1)
            net.table[hit] -= rate * total / np.sqrt(sums["table"][hit])[:, None]
    return net


def _cutoff(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap with the best F1; ties go to the widest gap."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    above = np.cumsum(y[::-1])[::-1]
    n = len(z)
    f1 = 2 * above / (above[0] + np.arange(n, 0, -1))
    low = np.concatenate(([z[0] - 1], z[:-1]))
    gap = np.where(z > low, z - low, -1)
    best = max(range(n), key=lambda k: (round(float(f1[k]), 12) if gap[k] > 0 else -1.0, gap[k]))
    return float(z[best] + low[best]) / 2


def calibrate(net: Network, z: np.ndarray, y: np.ndarray, language: np.ndarray, least: int = 8) -> None:
    """One threshold per language, the common one where a language has fewer than least rows of either label."""
    common = _cutoff(z, y)
    net.offsets[:] = common
    for k in range(len(LANGUAGES)):
        mine = language == k
        if min(y[mine].sum(), (1 - y[mine]).sum()) >= least:
            known = int(y[mine].sum())
            net.offsets[k] = (known * _cutoff(z[mine], y[mine]) + least * common) / (known + least)
    spread = np.abs(z - net.offsets[language])
    net.scale = float(3.0 / max(1e-3, np.median(spread)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 4000, sample_bytes: int = 96 << 20, seed: int = 7) -> Network | None:
    """Train on at most sample_rows labelled rows of together at most sample_bytes of text, chosen by a hash of the id; None without both labels.

    An id with several labels counts as toxic if any is, one with several texts by the text
    of the smallest hash; ids without a text are left out, and texts that no longer fit in
    sample_bytes are passed over. What reaches the driver is bounded by these two numbers.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = usable.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows)
    slim = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    texts_of = slim.join(F.broadcast(chosen), "id").select("id", "y", "t", F.xxhash64("t").alias("h"))
    known = texts_of.groupBy("id").agg(F.min(F.struct("h", F.octet_length("t").alias("n"))).alias("s")).select("id", "s.h", "s.n")
    fits, room = [], sample_bytes
    for r in known.orderBy(F.xxhash64("id", F.lit(seed)), "id").collect():  # at most sample_rows rows of three numbers
        if r["n"] <= room:
            fits.append((r["id"], r["h"]))
            room -= r["n"]
    if not fits:
        return None
    use = docs.sparkSession.createDataFrame(fits, "id long, h long")
    picked = texts_of.join(F.broadcast(use), ["id", "h"]).groupBy("id").agg(F.first("y").alias("y"), F.min("t").alias("t"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            done = [hasher.encode(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p.tobytes() for p, _ in done], pa.binary()), pa.array([k for _, k in done], pa.int32())], ["id", "y", "pairs", "language"]
            )

    rows = sorted(picked.mapInArrow(encode, "id long, y int, pairs binary, language int").collect(), key=lambda r: (r["id"], r["pairs"]))
    if len({r["y"] for r in rows}) < 2:
        return None
    texts = [np.frombuffer(r["pairs"], np.int32).reshape(-1, 2) for r in rows]
    y = np.array([r["y"] for r in rows])
    language = np.array([r["language"] for r in rows])
    apart = np.array([zlib.crc32(f"{r['id']}|calibrate".encode()) % 4 == 0 for r in rows])
    if min(np.bincount(y[apart], minlength=2).min(), np.bincount(y[~apart], minlength=2).min()) < 8:
        apart[:] = False  # too few rows to part: fit and calibrate on all
    net = train([t for t, a in zip(texts, apart, strict=True) if not a], y[~apart], seed=seed)
    use = apart if apart.any() else ~apart
    z = np.concatenate([net.logits(some) for some in _groups([t for t, a in zip(texts, use, strict=True) if a])])
    calibrate(net, z, y[use], language[use])
    return net


def _groups(texts: list[np.ndarray], most: int = 50_000) -> Iterator[list[np.ndarray]]:
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t)
        if n >= most:
            yield out
            out, n = [], 0
    if out:
        yield out


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted for every row from its whole text, however long; null and empty texts get the score of no words.

    Rows with null or repeated ids each give a row; other columns are ignored. Without a network (no labelled rows of both kinds) every score is 0.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    if net is None:
        return slim.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    used = np.flatnonzero(net.table.any(axis=1))
    rows, net.table = net.table[used], np.empty((0, DIM), np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((net, used, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, values = sent.value
        held.table = np.zeros((BUCKETS, DIM), np.float32)
        held.table[at] = values
        hasher = Hasher()
        for batch in batches:
            made: list[np.ndarray] = []
            texts, tongues, n = [], [], 0
            for t in batch.column(1).to_pylist():
                pairs, tongue = hasher.encode(t)
                texts.append(pairs)
                tongues.append(tongue)
                n += len(pairs)
                if n >= 20_000:
                    made.append(held.score(held.logits(texts), np.array(tongues)))
                    texts, tongues, n = [], [], 0
            if texts:
                made.append(held.score(held.logits(texts), np.array(tongues)))
            scores = np.concatenate([np.empty(0), *made])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["id", "score", "predicted"])

    return slim.mapInArrow(run, "id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """id, held_out, score, predicted per row."""
    net = fit(docs, labels, id_col, text_col, **fitting)
    return score(docs, net, id_col, text_col).select("id", held_out(F.col("id")).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 1_000_000, **fitting) -> DataFrame:
    """Rows not predicted toxic; all columns are kept, rows with a null id too."""
    bad = cut(classify(docs, labels, id_col, text_col, **fitting).where("predicted = 1 and id is not null").select(F.col("id").alias("__bad")).distinct())
    if small_enough(bad, most_broadcast):
        bad = F.broadcast(bad)
    return docs.join(bad, docs[id_col].cast("long") == bad["__bad"], "left_anti")
