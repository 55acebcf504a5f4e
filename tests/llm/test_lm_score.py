import math
import zlib

import numpy as np

from inkfold.llm import lm_score as lm
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, n_tokens int, id string"


def corpus(n=300, seed=0):
    rng = np.random.default_rng(seed)
    after = {w: [f"n{(k * 7 + j) % 20}" for j in range(2)] for k, w in enumerate(f"n{i}" for i in range(20))}
    rows = []
    for i in range(n):
        w, out = "n0", []
        for _ in range(int(rng.integers(20, 120))):
            out.append(w)
            w = after[w][int(rng.random() < 0.2)]
        rows.append((i, " ".join(out)))
    return rows


def test_scores_match_a_plain_version(spark):
    rows = [*corpus(40), (100, None), (101, ""), (102, "n1"), (None, "n1 n2"), (103, "unseen words only here"), (5, "n1 n2 n3"), (104, "n3 " * 9000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    chunks = lm.chunk_texts(df.select(F.col("doc_id").alias("id"), "text"))
    table = lm.count_words(chunks)
    counts = {}
    for _, t in rows:
        for w in lm.words(t):
            counts[w] = counts.get(w, 0) + 1
    assert {r["word"]: r["n"] for r in table.collect()} == counts
    known, total = lm.classes(table, 10, 4)
    assert known == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:10]
    top = [w for w, _ in known]
    cls = {w: top.index(w) if w in top else 10 + zlib.crc32(w.encode()) % 4 for w in counts}
    of = np.bincount([cls[w] for w in counts], list(counts.values()), minlength=14)
    assert of.tolist() == total.tolist()
    net = lm.train(lm.encode(chunks, table, known, total), total)
    got = sorted(map(tuple, lm.score(df, frequent=10, rare=4).collect()), key=str)
    want = []
    for i, t in rows:
        ws = lm.words(t)
        ids = [cls[w] for w in ws]
        ext, total = [14, 14, *ids, 14, 14], 0.0
        for p, (y, w) in enumerate(zip(ids, ws, strict=True)):
            h = np.tanh(sum(net.into[k][ext[p + o]].astype(float) for k, o in enumerate((0, 1, 3, 4))))
            z, group = h @ net.out.astype(float) + net.bias, np.arange(14) // 4 == y // 4
            top_z = h @ net.top.astype(float) + net.top_bias
            total += top_z[y // 4] - math.log(np.exp(top_z).sum()) + z[y] - math.log(np.exp(z[group]).sum()) + math.log(counts[w] / of[y])
        want.append((i, len(ids), total, total / len(ids) if ids else None))
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 * max(1, b[1]) and (a[3] is None) == (b[3] is None)


def test_layout_does_not_show(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_WORDS", 12)  # many chunks
    rows = [(i, t, 1, "x") for i, t in corpus(60)] + [(900 + k, f"twice met words a{k % 5}", 1, "x") for k in range(10)] + [(950 + k, f"once{k} met{k} words{k} b{k}", 1, "x") for k in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [sorted(map(tuple, lm.score(x).collect())) for x in (df.repartition(2), df.repartition(7, "text"))]
    assert got[0] == got[1]
    mean = {r[0]: r[3] for r in got[0]}
    assert min(mean[900 + k] for k in range(10)) > max(mean[950 + k] for k in range(10))  # counts of the whole corpus tell them apart


def test_gradients_by_differences():
    net = lm.Window(7, 2, 3, 1)
    ids = np.array([7, 7, 1, 4, 2, 6, 0, 3, 3, 7, 7], np.int32)
    at = np.array([2, 5, 8])
    for name in ("into", "out", "bias", "top", "top_bias"):
        setattr(net, name, getattr(net, name).astype(float))
    near = net.neighbours(ids, at)
    loss = lambda: -float(net.log_probs(near, ids[at]).sum())
    for p, g in zip(net.params, net.gradients(near, ids[at]), strict=True):
        for k in np.random.default_rng(2).integers(0, p.size, 12):
            was = p.flat[k]
            p.flat[k] = was + 1e-5
            up = loss()
            p.flat[k] = was - 1e-5
            down = loss()
            p.flat[k] = was
            assert abs((up - down) / 2e-5 - g.flat[k]) < 1e-4


def test_context_beats_frequencies(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in corpus()], SCHEMA)
    mean = lambda d: d.where("n_tokens > 0").selectExpr("sum(pseudo_log_likelihood) / sum(n_tokens)").first()[0]
    trained = mean(lm.score(df, frequent=20, rare=4, passes=6, mask=2, batch=256))
    plain = mean(lm.score(df, frequent=20, rare=4, passes=0))
    assert trained > plain + 0.5


def test_repeats_exactly_and_empty(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in corpus(30)], SCHEMA)
    assert sorted(lm.score(df).collect()) == sorted(lm.score(df).collect())
    assert lm.score(df.limit(0)).count() == 0


def test_padding_parts_the_texts():
    laid, at = lm._padded(bytes([1, 2, 3, 4, 5]), np.array([0, 2, 0, 3]), 2, 9)
    assert laid.tolist() == [9, 9, 9, 9, 1, 2, 9, 9, 9, 9, 3, 4, 5, 9, 9] and laid[at].tolist() == [1, 2, 3, 4, 5]
    assert lm._sums(np.arange(5.0), np.array([0, 2, 0, 3])).tolist() == [0, 1, 0, 9]
