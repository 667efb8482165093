"""The tree of encodings against the library on whole texts."""

import random

import numpy as np
import pytest

import public_tokenizers
from voxtally.llm import bpe
from voxtally.llm.queries import queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(bpe.VOCABULARY)
ALPHABET = ["a", "the", " ", "  ", "\n", " \n", "'", "'s", "'re", "'ll", "é", "9", "12", "-", "!", " ", "\x1c", "日本", "🙂", "x" * 50]


def random_text(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(ALPHABET) for _ in range(n))


@pytest.mark.parametrize("leaf", [2, 3, 7, 40, 2048])
def test_tree_equals_the_library(leaf):
    rng, codec = random.Random(leaf), bpe.Codec(PATH, leaf)
    for n in [0, 1, 2, 5, 30, 200, 900]:
        for _ in range(12):
            text = random_text(rng, n)
            want = codec._short.encode_ordinary(text)
            got = codec.encode(text)
            assert got.tolist() == want
            assert codec.decode(got).decode() == text


def test_text_without_a_sure_place():
    codec = bpe.Codec(PATH, 16)
    for text in ["ab" * 4000, " " * 3000, "\n " * 2000, "9" * 2000, "'" * 1500, "日本語" * 900]:
        assert codec.encode(text).tolist() == codec._short.encode_ordinary(text)


def test_rows_nulls_and_clashing_names(spark):
    rows = [(1, "the end", 5), (None, None, 6), (3, "", 7), (1, "the end", 5), (4, "a b " * 60_000, 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int").repartition(3)
    out = bpe.decode(bpe.encode(df)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.decoded).decode()) for r in out) == sorted(
        (i is None, i or 0, t or "") for i, t, _ in rows
    )
    assert all(len(r.ids) == 4 * r.n_tokens for r in out)
    assert bpe.encode(df.limit(0)).collect() == []
    replaced = bpe.decode(bpe.encode(df), name="n_tokens")
    assert replaced.columns == ["doc_id", "ids", "n_tokens"] and replaced.count() == 5


def test_unknown_id_fails(spark):
    bad = spark.createDataFrame([(1, bytearray(np.array([10**6], "<u4").tobytes()))], "doc_id bigint, ids binary")
    with pytest.raises(Exception):
        bpe.decode(bad).collect()


def test_query_against_the_library(spark):
    import hashlib

    codec = bpe.Codec(PATH)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries()["op10_byte_bpe"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = codec._short.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
