"""The pipeline against a plain version of each stage on the smallest tables."""

import re

import pytest

import corpus_pipeline
from inkfold.llm import _common, decontaminate, mixing, toxicity
from tests.llm.test_decontaminate import slow_score
from tests.llm.test_simhash import shingles
from tests.llm.test_spans import slow_secrets

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r["id"] for r in toxicity.classify(docs, labels).where("predicted = 1").collect()}
    rows = [r for r in docs.collect() if r["doc_id"] not in bad]
    out = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in rows} and out.schema == docs.schema

    sets = {r["doc_id"]: shingles(r["text"] or "") for r in rows}
    label, changed = {i: i for i in sets}, True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a], changed = label[b], True
    assert len(set(label.values())) < len(label)
    rows = [r for r in rows if label[r["doc_id"]] == r["doc_id"]]
    out = corpus_pipeline.drop_near_duplicates(spark, out, SF)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in rows}

    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    grams = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (decontaminate.words(t) for _, t in items)]
    kept = []
    for r in rows:
        w = decontaminate.words(r["text"])
        mine = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        if not any(len(mine & g) > 2 and slow_score(t, r["text"]) >= decontaminate.THRESHOLD for (_, t), g in zip(items, grams, strict=True)):
            kept.append(r)
    out = corpus_pipeline.drop_contaminated(spark, out, SF)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in kept} and len(kept) < len(rows)

    out = corpus_pipeline.mask_secrets(spark, out, SF)
    assert out.schema == docs.schema
    for got, was in zip(sorted(out.collect()), sorted(kept), strict=True):
        assert got["doc_id"] == was["doc_id"] and got["n_chars"] == len(got["text"])
        assert (got["text"] == was["text"]) == (not slow_secrets(was["text"])) and not slow_secrets(re.sub(r"\[SECRET\]", "", got["text"]))

    ran = corpus_pipeline.run(spark, SF).collect()
    assert sorted(ran) == sorted(mixing.mix(out).collect())


def test_stages_keep_clashing_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS __bad", "2 AS __copy", "3 AS __dirty", "4 AS row", "5 AS spans", "6 AS id", "7 AS component_id").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema and 0 < out.count() <= 40
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), SF).count() == 0


def test_scratch_goes_when_a_stage_is_done(spark, tmp_path):
    mark = _common.scratch_mark()
    a, b = _common.stored(spark.range(3), "a"), _common.stored(spark.range(4), "b")
    kept = _common._MADE[-1]
    _common.discard(spark, mark, keep=(kept,))
    assert _common._MADE[mark:] == [kept] and b.count() == 4
    with pytest.raises(Exception):
        a.count()
