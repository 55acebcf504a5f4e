import numpy as np
import pytest

from inkfold.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, key string, score double"


def brute(rows, every=100, positives=5, negatives=10):
    """All scores, one anchor at a time; rows (id, label, whole vector), each as often as it occurs."""
    ids, labels, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64)
    first = {}
    for i, lab, v in rows:
        if i % every == 0:
            first[i] = min(first.get(i, (lab, v)), (lab, v))
    out = []
    for i, (lab, v) in first.items():
        scores = (x @ np.array(v, np.int64)).tolist()
        for minus, p in sorted((-s, j) for s, j, k in zip(scores, ids.tolist(), labels.tolist(), strict=True) if k == lab and j != i)[:positives]:
            near = sorted((-s, j) for s, j, k in zip(scores, ids.tolist(), labels.tolist(), strict=True) if k != lab and j != i and 30 * -minus <= 100 * s <= 90 * -minus)[:negatives]
            out += [(i, p, n + 1, j, -minus, -s) for n, (s, j) in enumerate(near)]
    return sorted(out)


def made(n=1200, dim=6):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.5, (8, dim))
    rows = [(i, (centres[i % 8] + rng.normal(0, 0.2, dim)).tolist(), int(rng.integers(4))) for i in range(n)]
    return rows + [(5_000 + i, rows[3][1], 1) for i in range(400)]  # a quarter of the rows share a vector


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA)


def whole(rows):
    return [(i, lab, [int(np.floor(256 * c)) for c in v]) for i, v, lab in rows]


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force_with_ties_and_copies(spark):
    rows = made()
    vectors = hn.whole_vectors(frame(spark, rows))
    want = brute(whole(rows))
    assert len(want) > 300
    assert found(hn.mine(vectors, top_leaves=8, block_rows=100, leaf=16, batch_rows=8)) == want
    assert found(hn.mine(vectors, sample_rows=50)) == want


def test_groups_are_pruned(spark):
    rng = np.random.default_rng(4)
    near = np.floor(256 * rng.normal(0, 0.05, (400, 4)))
    x = np.concatenate([near + [2000, 0, 0, 0], near + [-2000, 0, 0, 0]])
    labels, ids = np.zeros(800, np.int64), np.arange(800)
    wants = hn.Wants(labels[:40], np.full(40, hn.FEW + 1), np.full(40, np.iinfo(np.int64).max), True, 5, ids[:40])
    scored = hn.search(x, ids, labels, hn.ball_tree(x, 16), x[:40], wants, 16)
    exact = np.sort(x[:40] @ x.T - np.where(np.eye(40, 800, dtype=bool), 10**12, 0), axis=1)[:, :-6:-1]
    assert (wants.score == exact).all()
    assert scored < 40 * 450  # the far cloud is never scored


def test_nulls_lengths_repeated_ids_and_empty(spark):
    rows = made(300)
    odd = [(700, None, 1), (800, rows[0][1], None), (900, [float("nan")] * 6, 1), (1000, [float("inf")] * 6, 1), (1100, [None] + [0.1] * 5, 1), (None, rows[0][1], 1)]
    short = [(1200, rows[0][1][:3], 2), (1300, [], 2), (100, rows[9][1], 3), (100, rows[5][1], 0)]
    kept = rows + [(i, v + [0.0] * (6 - len(v)), lab) for i, v, lab in short]
    assert found(hn.mine(hn.whole_vectors(frame(spark, rows + odd + short)))) == brute(whole(kept))
    assert found(hn.mine(hn.whole_vectors(frame(spark, rows).limit(0)))) == []
    with pytest.raises(ValueError, match="exact"):
        hn.mine(hn.whole_vectors(frame(spark, [(0, [1e30], 1)])))
