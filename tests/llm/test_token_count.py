import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkfold.llm import token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "aa", "aaaa", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "​", "　", "é", "日本", "’", "'s", "'re", "'", "1", "½", "²", "😀", "<|endoftext|>", "<|endof", "The", " the", "!!!", "----", "̀", "\r\n", "ß", "İ", "﻿", "_", "x9"]


def library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def made(n=3000):
    r = random.Random(5)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return [*texts, None, "", "a" * 20_001, "ab" * 9_000, "".join(chr(97 + r.randrange(26)) for _ in range(8_000)), " " * 3_000 + "x", *texts[:3]]


def test_counts_equal_the_library():
    texts = made()
    assert token_count.Counter(token_count.load(PATH)).count(texts) == library(texts)


def test_small_steps_and_caches_change_nothing():
    texts = made(300)
    assert token_count.Counter(token_count.load(PATH), words_kept=40, letters_a_step=50).count(texts) == library(texts)


def test_query_on_rows(spark):
    texts = made(200)
    df = spark.createDataFrame([(i if i else None, t, 7, True) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, over_limit boolean")
    rows = token_count.count(df, limit=20).collect()
    got = sorted((r["id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows)
    assert got == [(i, len((t or "").encode()), n, n > 20) for i, (t, n) in enumerate(zip(texts, library(texts), strict=True))]
    assert token_count.count(df.limit(0)).count() == 0


def test_whole_table_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = dict(zip(texts, library(list(texts.values())), strict=True))
    assert {r["id"]: r["n_tokens"] for r in token_count.count(docs).collect()} == want


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_count.load(public_tokenizers.path("word_bpe_49k.json"))
