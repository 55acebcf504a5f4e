import math
import time

import pytest

from inkfold.llm import mixing
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, n int"


def test_counts_match_an_inverted_poisson(spark):
    import hashlib

    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 7}", 1) for i in range(2000)] + [(5000, None, None, 1), (None, "x", "hot", 1), (7, "t7", "hot", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df, weights={"hot": 2.0, "s1": 0.0}, total=4000).collect()
    n = {}
    for _, _, s, _ in rows:
        n[s] = n.get(s, 0) + 1
    w = {s: {"hot": 2.0, "s1": 0.0}.get(s, 1.0) for s in n}
    want = []
    for i, t, s, _ in rows:
        rate = 4000 * w[s] / sum(w.values()) / n[s]
        parts = max(1, math.ceil(rate / 64))
        tail = "" if i is None else f"|{i}"
        k = 0
        for j in range(parts):  # a large mean is a sum of equal ones
            key = f"count-42{tail}" if j == 0 else f"count-42-part|{j}{tail}"
            u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 16**13
            m, c = 0, math.exp(-rate / parts)
            p = c
            while rate > 0 and c <= u:
                m += 1
                p *= rate / parts / m
                c += p
            k += m
        want += [(i, s, j) for j in range(k)]
    as_key = lambda x: tuple(str(v) for v in x)
    assert sorted([(r["doc_id"], r["source"], r["copy"]) for r in out], key=as_key) == sorted(want, key=as_key)
    keys = [r["shuffle_key"] for r in out]
    assert keys == sorted(keys)
    assert abs(len(out) - 4000) < 400 and not any(r["source"] == "s1" for r in out)


def test_same_rows_whatever_the_partitioning_and_join(spark):
    df = spark.createDataFrame([(i, "t", f"s{i % 5}", 1) for i in range(500)], SCHEMA)
    a = mixing.mix(df).drop("rate").collect()
    b = mixing.mix(df.repartition(7), most_broadcast=2).drop("rate").collect()
    assert a == b


def test_large_rates(spark):
    """One row in a source of its own against many: its copies are numbered without a gap and near the mean, in seconds."""
    rows = [(i, "t", "many", 1) for i in range(300)] + [(1000, "t", "one", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    began = time.monotonic()
    got = [r["copy"] for r in mixing.mix(df, weights={"one": 1000.0, "many": 1.0}, total=100_000).where("source = 'one'").select("copy").collect()]
    assert sorted(got) == list(range(len(got))) and abs(len(got) - 100_000 * 1000 / 1001) < 6 * math.sqrt(100_000)
    assert time.monotonic() - began < 60
    top = spark.range(1).select(mixing.poisson_cdf(F.lit(64.0)).alias("c")).first()["c"]
    assert abs(top[-1] - 1) < 1e-12 and abs(top[63] - 0.5) < 0.04


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df).count() == 0
    full = spark.createDataFrame([(i, "t", "s", i) for i in range(50)], "doc_id long, rate string, source string, copy int").withColumn("cdf", F.lit(1)).withColumn("row", F.lit(2))
    out = mixing.mix(full)
    assert out.columns == ["doc_id", "rate_in", "source", "copy_in", "cdf", "row", "rate", "copy", "shuffle_key"]
    assert all(r["copy_in"] == r["doc_id"] and r["rate_in"] == "t" for r in out.collect())
    with pytest.raises(ValueError):
        mixing.mix(full, weights={"s": -1.0})
