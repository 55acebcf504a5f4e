import hashlib
import random
from collections import Counter

import pytest

from inkfold.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, row long, at int"


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(repeat_ids=False):
    r = random.Random(4)
    prose = lambda n: " ".join(r.choice(["the", "of", "niño", "river", "stone", "cloud", "a", "über"]) + str(r.randrange(50)) for _ in range(n))
    passage, base = prose(90), prose(400)
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 1500), (4, "ab" * 400), (5, prose(200)), (6, passage), (7, passage)]
    for k in range(12):
        rows.append((10 + k, prose(r.randrange(60)) + " " + passage[r.randrange(60) :] + " " + prose(r.randrange(60))))
    for k in range(12):
        b = list(base)
        for _ in range(k):
            b[r.randrange(len(b))] = "#"
        rows.append((30 + k, "".join(b)))
    rows += [(50, base + base), (51, "x" + "a" * 199), (52, passage[:150]), (53, base[:1000] + passage + base[1000:])]
    if repeat_ids:
        rows += [(5, rows[5][1]), (None, passage), (None, None)]
    return rows


@pytest.mark.parametrize(("length", "hot", "repeat"), [(200, 20_000, False), (200, 2, False), (64, 20_000, True), (100, 3, True)])
def test_against_brute_force(spark, length, hot, repeat):
    rows = corpus(repeat)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA)
    got = sd.dedup(df, length=length, hot=hot).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)


def test_kept_bytes(spark):
    df = spark.createDataFrame([(1, "é" * 300, 1, 2), (2, "unique", 1, 2)], SCHEMA)
    got = {r["id"]: bytes(r["kept"]) for r in sd.dedup(df).collect()}
    assert got == {1: b"", 2: b"unique"}
    assert sd.dedup(df.limit(0)).count() == 0


def test_sorting_is_exact():
    r = random.Random(9)
    for _ in range(60):
        strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(80))) for _ in range(r.randrange(1, 60))]
        strings += [b"a" * r.randrange(90) for _ in range(10)] + strings[:3]
        order = sd.deep_shallow_sort(strings)
        assert sorted(order) == list(range(len(strings)))
        assert [strings[i] for i in order] == sorted(strings)


def test_anchors_follow_content_only():
    r = random.Random(1)
    text = bytes(r.randrange(97, 100) for _ in range(3000))
    inside = sd.anchors(text, 200)[0]
    for s in (0, 400, 2750):
        window = text[s : s + 200]
        (a,), _ = sd.anchors(window, 200)
        assert s + a in inside and (7 + a) in sd.anchors(b"z" * 7 + window + b"q" * 30, 200)[0]
