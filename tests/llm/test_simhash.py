import re

import numpy as np
import pytest
import xxhash

from inkfold.llm import simhash

DOCS = "doc_id long, text string, fp string, id int"


def slow_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(rows, radius=4):
    fps = {i: slow_fingerprint(t) for i, t in rows}
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= radius and label[b] < label[a]:
                    label[a], changed = label[b], True
    return fps, label


def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{k}É" for k in range(80)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (5, "x " * 30000)]
    for k in range(40):
        base = rng.choice(words, 120).tolist()
        rows.append((10 + 3 * k, " ".join(base)))
        if k % 2:
            base[int(rng.integers(120))] = "edited"
            rows.append((11 + 3 * k, " ".join(base)))
        if k % 3 == 0:
            rows.append((12 + 3 * k, rows[-1][1]))
    return rows


@pytest.mark.parametrize("hot", [20_000, 3])
def test_against_brute_force(spark, hot):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    got = {r["id"]: r for r in simhash.near_duplicates(df, hot=hot).collect()}
    fps, label = slow_components(rows)
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == label
    assert len(set(label.values())) < len(label)


def test_keeps_one_of_each_group_and_all_columns(spark):
    df = spark.createDataFrame([(7, "a b c d e", "p", 1), (3, "a b c d e", "q", 2), (None, "a b c d e", "r", 3), (9, "other words entirely here now", "s", 4)], DOCS)
    kept = simhash.keep_representatives(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 9]


def shingles(text, width=5):
    w = text.lower().split()
    return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} or {" ".join(w)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("hot", [20_000, 8])
def test_similar_texts(spark, hot):
    """Edited copies at 0.8 and above are found, unrelated texts and texts with a shared half stay apart, whatever is crowded."""
    rng = np.random.default_rng(9)
    rows, pairs, apart = [(0, None), (1, ""), (2, "two words"), (3, "Two  Words"), (4, "other words")], [], []
    for k in range(120):
        base = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(150, 900)))]
        edited = list(base)
        for at in rng.choice(len(base), max(1, int(len(base) * (0.005 + 0.035 * k / 120))), replace=False):
            edited[at] = f"e{k}x{at}"
        half = base[: len(base) // 2] + [f"h{k}x{x}" for x in range(len(base) // 2)]
        a, b, c = 10 + 3 * k, 11 + 3 * k, 12 + 3 * k
        rows += [(a, " ".join(base)), (b, " ".join(edited)), (c, " ".join(half))]
        pairs.append((a, b, jaccard(" ".join(base), " ".join(edited))))
        apart.append(c)
    rows += [(1000 + k, " ".join([f"w{x}" for x in range(200)] + [f"tail{k}"])) for k in range(50)]  # one crowd of near copies
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    label = {r["id"]: r["component_id"] for r in simhash.similar(df, hot=hot).collect()}
    close = [(a, b, j) for a, b, j in pairs if j >= 0.85]
    assert len(close) > 40 and sum(label[a] == label[b] == a for a, b, _ in close) >= 0.95 * len(close)
    edge = [(a, b) for a, b, j in pairs if 0.8 <= j < 0.85]
    assert len(edge) > 5 and sum(label[a] == label[b] for a, b in edge) >= 0.95 * len(edge)
    assert all(label[a] != label[b] for a, b, j in pairs if j < 0.8)
    assert all(label[c] == c for c in apart)
    assert {label[1000 + k] for k in range(50)} == {1000} and label[1] == 0 and label[3] == 2 and label[4] == 4


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert simhash.similar(df).count() == 0
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_representatives(df).count() == 0


def test_tiles_skip_nothing():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(6)]))
    label = np.arange(len(fps))
    x, y = simhash.forest(fps, 4, tile=32)
    label[x] = label[y]
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = np.arange(len(fps))
    for _ in range(20):
        want = np.array([want[near[k]].min() for k in range(len(fps))])
    assert ((label[:, None] == label[None, :]) == (want[:, None] == want[None, :])).all()
