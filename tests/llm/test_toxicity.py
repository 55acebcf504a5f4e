import zlib

import numpy as np
import pytest

from inkfold.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, score double, id int"


def made(n=400, seed=1):
    rng = np.random.default_rng(seed)
    prose = {"en": "the and of to with from this stone river cloud walking", "de": "der die und das mit nicht stein fluss wolke laufen"}
    bad = {"en": ["idiotic", "scummy", "vile"], "de": ["lowein", "loweist", "loweiung"]}
    rows, labels = [], []
    for i in range(n):
        lang = ["en", "de"][i % 2]
        ws = rng.choice(prose[lang].split(), 60).tolist() + [f"w{rng.integers(10**6)}" for _ in range(20)]
        y = int(rng.random() < 0.2)
        if y:
            ws[int(rng.integers(80))], ws[int(rng.integers(80))] = rng.choice(bad[lang], 2)
        rows.append((i, " ".join(ws), lang, 0.5, 1))
        labels.append((i, 1, y))
    return rows, labels


def test_held_out_accuracy_and_contract(spark):
    rows, labels = made()
    rows += [(9000, None, "en", 0.0, 1), (9001, "", "en", 0.0, 1), (None, "the vile scummy", "en", 0.0, 1), (5, rows[5][1], "en", 0.0, 1), (9002, "the scummy " + "river " * 50000, "en", 0.0, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if r["id"] in truth and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got if r["id"] is not None)
    assert len(held) > 80 and np.mean([r["predicted"] == truth[r["id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    by_id = {r["id"]: r for r in got}
    assert by_id[9000]["score"] == by_id[9001]["score"] and by_id[9000]["predicted"] == 0 and by_id[9002]["predicted"] == 1


def test_held_out_labels_never_matter(spark):
    rows, labels = made(120, 2)
    docs = spark.createDataFrame(rows, SCHEMA)
    schema = "doc_id long, quality int, toxic int"
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, q, y in labels]
    a = toxicity.classify(docs, spark.createDataFrame(labels, schema)).collect()
    b = toxicity.classify(docs, spark.createDataFrame(flipped, schema)).collect()
    assert sorted((r["id"], r["score"]) for r in a) == sorted((r["id"], r["score"]) for r in b)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(None, 1, 1), (3, None, None)]])
def test_without_both_labels(spark, labels):
    docs = spark.createDataFrame([(k, "some text", "en", 0.0, 1) for k in range(5)], SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {(r["score"], r["predicted"]) for r in toxicity.classify(docs, lab).collect()} == {(0.0, 0)}
    assert toxicity.keep_clean(docs, lab).count() == 5
    assert toxicity.classify(docs.limit(0), lab).count() == 0


def test_pooling_matches_a_plain_loop():
    net = toxicity.Network(3)
    rng = np.random.default_rng(4)
    net.table[1:50] = rng.normal(0, 1, (49, toxicity.DIM))
    texts = [rng.integers(1, 50, (n, 2)).astype(np.int32) for n in (1, 2, 7, 0, 30)]
    for t, z in zip(texts, net.logits(texts), strict=True):
        e = np.concatenate([net.table[t[:, 0]] + net.table[t[:, 1]], np.zeros((6, toxicity.DIM), np.float32)])
        pooled = [max([0.0] + [float(sum(e[p + j] @ k[j, :, f] for j in range(w)) + b[f]) for p in range(len(t))]) for w, k, b in zip(toxicity.WIDTHS, net.filters, net.bias, strict=True) for f in range(toxicity.FILTERS)]
        assert abs(np.dot(pooled, net.out) + net.out_bias - z) < 1e-4


def test_filtering_keeps_clean_rows_and_columns(spark):
    rows, labels = made()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = toxicity.keep_clean(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    clean = {i for i, _, y in labels if not y}
    assert len(clean - ids) <= 2 and len(ids - clean) <= 3


def test_sample_is_bounded_in_rows_and_bytes(spark):
    rows, labels = made(200, 5)
    rows += [(i, "river " * 20_000, "en", 0.0, 1) for i in range(0, 200, 3) for _ in range(3)]  # repeated ids with long texts
    docs, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    toxicity_train = toxicity.train
    try:
        toxicity.train = lambda texts, y, **how: (seen.append(sum(8 * len(t) for t in texts)), toxicity_train(texts, y, **how))[1]
        assert toxicity.fit(docs, lab, sample_bytes=200_000) is not None and seen[-1] < 400_000
        assert toxicity.fit(docs, lab, sample_rows=60) is not None
    finally:
        toxicity.train = toxicity_train
    assert toxicity.fit(docs, lab, sample_bytes=10) is None
