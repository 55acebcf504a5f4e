import numpy as np

from inkfold.llm import decontaminate as dc

SCHEMA = "doc_id long, text string, item_id int, score string"


def slow_score(item, text):
    """Smith-Waterman over whole texts, one cell at a time."""
    a, b = dc.words(item), dc.words(text)
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (dc.MATCH if x == y else dc.MISMATCH), above[j + 1] + dc.GAP, row[j] + dc.GAP))
        above, best = row, max(best, *row)
    return best / (dc.MATCH * len(a)) if a else 0.0


def corpus():
    rng = np.random.default_rng(11)
    vocab = [f"word{k}" for k in range(300)] + ["the", "of", "and"] * 40
    items = [(k, " ".join(rng.choice(vocab, int(rng.integers(12, 50))))) for k in range(12)]
    docs = []
    for d in range(80):
        ws = rng.choice(vocab, int(rng.integers(5, 400))).tolist()
        if d % 4 == 0:
            leak = dc.words(items[d % 12][1])
            for _ in range(d % 3 * len(leak) // 12):
                leak[int(rng.integers(len(leak)))] = "edited"
            if d % 8 == 0:
                del leak[len(leak) // 2]
            at = int(rng.integers(len(ws)))
            ws[at:at] = [w.upper() + "," for w in leak]
        docs.append((d, " ".join(ws)))
    docs += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (None, items[4][1]), (103, " ".join(["filler"] * 30000) + " " + items[5][1])]
    items += [(50, None), (51, ""), (52, "the of"), (53, items[0][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 3):
        got = sorted((-1 if r["id"] is None else r["id"], r["item_id"], round(r["score"], 9)) for r in dc.matches(df, bench, block_items=block).collect())
        want = []
        for i, t in docs:
            for k, x in items:
                if (s := slow_score(x, t)) >= (dc.THRESHOLD if len(dc.words(x)) >= 5 else 1.0):
                    want.append((-1 if i is None else i, k, round(s, 9)))
        assert got == sorted(want) and len(want) > 20 and any(k == 52 for _, k, _ in want)


def test_a_passage_in_every_document_is_still_found(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    df = spark.createDataFrame([(k, f"start{k} {item} end{k}", 1, "s") for k in range(300)], SCHEMA)
    assert dc.matches(df, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 300


def test_filtering(spark):
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = dc.keep_clean(df, bench)
    assert kept.columns == df.columns
    dirty = {r["id"] for r in dc.matches(df, bench).collect() if r["id"] is not None}
    assert kept.count() == sum(i not in dirty for i, _ in docs)
    assert dc.keep_clean(df.limit(0), bench).count() == 0 and dc.keep_clean(df, bench.limit(0)).count() == len(docs)


def test_long_passages_in_pieces():
    assert list(dc._pieces(0, 100, 10)) == [(0, 100)]
    pieces = list(dc._pieces(5, 5000, 50))
    for s in range(5, 5000 - 100):
        assert any(x <= s and s + 100 <= y for x, y in pieces)


def test_common_leaks_keep_their_edited_and_truncated_copies(spark):
    """Over 100 exact copies of an item hide none of its partial, edited or stretched copies."""
    rng = np.random.default_rng(5)
    vocab = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocab, 30))) for k in range(4)]
    texts = [f"start{k} {t} end{k}" for _, t in items for k in range(110)]
    for _, t in items:
        w = t.split()
        variants = [w[12:], w[15:], w[:15], ["edited"] * 10 + w[10:], [x if i % 3 else "edited" for i, x in enumerate(w)], [y for x in w for y in (x, "put")]]
        for _ in range(20):
            v = list(w)
            for i in rng.choice(30, 7, replace=False):
                v[i] = "edited"
            variants.append(v)
        texts += [" ".join([*rng.choice(vocab, 40), *v, *rng.choice(vocab, 40)]) for v in variants]
    df = spark.createDataFrame([(k, t, 1, "s") for k, t in enumerate(texts)], SCHEMA)
    got = sorted((r["id"], r["item_id"], round(r["score"], 9)) for r in dc.matches(df, spark.createDataFrame(items, "item_id long, text string")).collect())
    want = [(k, i, round(s, 9)) for k, t in enumerate(texts) for i, x in items if (s := slow_score(x, t)) >= dc.THRESHOLD]
    assert got == sorted(want) and len(want) > 500
