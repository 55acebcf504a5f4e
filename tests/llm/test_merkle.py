import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from inkfold.llm import merkle
from inkfold.llm.queries import op13_merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, path string, gid int, d int"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, bump=False):
    values = dict(row)
    if bump and values["n_chars"] is not None:
        values["n_chars"] += 1
    return h("".join("-" if values[f] is None else f"{len(str(values[f]).encode())}:{values[f]}" for f in FIELDS))


def levels(nodes, b):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + b])) for k in range(0, len(out[-1]), b)])
    return out


def siblings(tree, at, b):
    for level in tree[:-1]:
        first = at - at % b
        run = level[first : first + b]
        yield run[: at - first], run[at - first + 1 :]
        at //= b


def plain(rows, b):
    """The whole tree at once."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    trees = {g: levels([leaf_of(r) for r in groups[g]], b) for g in order}
    top = levels([trees[g][-1][0] for g in order], b)
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps = [*siblings(trees[g], i, b), *siblings(top, k, b)]
            at = leaf_of(r, bump=r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0)
            for left, right in steps:
                at = h("".join(left) + at + "".join(right))
            out.append((r["doc_id"], leaf_of(r), trees[g][-1][0], top[-1][0], h("".join("".join(x + y) for x, y in steps)), at, at == top[-1][0]))
    return sorted(out, key=repr)


def made():
    rows = [(i, f"text {i % 40} é", ["de", "en", "fr", None, "zh"][i % 5 if i < 90 else 1], None if i % 11 == 0 else f"s{i % 3}", None if i % 13 == 0 else i) for i in range(230)]
    rows += [(7, "text", "en", "s", 3)] * 9 + [(None, "same", "en", "s", 3)] * 60 + [(1, None, "only", None, None), (2, "", "Zz", "s", 0), (3, "x" * 300_000, "zz", "s", 1)]
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame([(*r.values(), 1, "p", 2, 3) for r in rows], SCHEMA)


@pytest.mark.parametrize(("b", "per", "merged"), [(2, 7, 2), (3, 10, 256), (2, 16_384, 256)])
def test_equals_the_plain_tree(spark, b, per, merged):
    rows = made()
    docs = frame(spark, rows)
    fields = {f: F.col(f) for f in FIELDS} | {"n_chars": F.col("n_chars") + 1}
    marked = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    proven = merkle.prove(docs.withColumn("tampered", F.when(marked, merkle.leaf(fields))), carry=("doc_id", "tampered"), fanout=b, rows_per_part=per, parts_merged=merged)
    root = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    got = proven.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")), root, root == F.col("root")).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, b)


def test_manifest_holds_every_node(spark):
    rows = made()
    got = {(r["group"], r["level"], r["idx"]): r["digest"] for r in merkle.manifest(frame(spark, rows), rows_per_part=9, parts_merged=3).collect()}
    want = {}
    for g in {r["lang"] for r in rows}:
        mine = sorted((r for r in rows if r["lang"] == g), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        for level, nodes in enumerate(levels([leaf_of(r) for r in mine], 2)):
            want |= {(g, level, k): d for k, d in enumerate(nodes)}
    assert got == want


def test_stack_carries_in_any_fanout():
    leaves = [bytes([k]) * 32 for k in range(23)]
    for b in (2, 3, 4, 10):
        whole = merkle.climb([(0, k, d) for k, d in enumerate(leaves)], 23, b)[0]
        assert [n[:2] for n in whole] == [(merkle.height(23, b), 0)]
        for cut in range(1, 22):
            left = merkle.climb([(0, k, leaves[k]) for k in range(cut)], 23, b)[0]
            right = merkle.climb([(0, k, leaves[k]) for k in range(cut, 23)], 23, b)[0]
            assert merkle.climb(left + right, 23, b)[0] == whole


def test_empty_table_and_single_row(spark, tmp_path):
    rows = made()
    assert merkle.prove(frame(spark, rows).limit(0)).count() == 0
    frame(spark, rows[:1]).write.parquet(f"{tmp_path}/documents.parquet")
    r = op13_merkle(spark, str(tmp_path)).first()
    assert r["leaf"] == r["subroot"] == r["root"] == leaf_of(rows[0]) and r["proof_sha256"] == h("") and r["verified"]
