"""Packing against a plain best fit, and its exact round trip."""

import random
from collections import defaultdict

import numpy as np

import public_tokenizers
from voxtally.llm import bpe, packing
from voxtally.llm.queries import queries

SF = "/root/testdata/sf0.001"


def plain_best_fit(lengths, width):
    rows, room = [], []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in range(len(rows)) if room[r] >= lengths[piece]]
        if fits:
            best = min(fits, key=lambda r: room[r])
        else:
            rows.append([])
            room.append(width)
            best = len(rows) - 1
        rows[best].append(piece)
        room[best] -= lengths[piece]
    return rows, sorted(room)


def test_segment_tree_finds_the_best_fit():
    rng = random.Random(1)
    for width in (1, 2, 7, 8, 9, 64, 100):
        for n in (0, 1, 5, 60):
            lengths = [rng.randint(1, width) for _ in range(n)]
            rows = packing.best_fit_decreasing(lengths, width)
            want, room = plain_best_fit(lengths, width)
            assert sorted(i for r in rows for i in r) == list(range(n))
            assert len(rows) == len(want)
            assert sorted(width - sum(lengths[i] for i in r) for r in rows) == room


def rebuilt(rows, width):
    pieces = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == width and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert r.resets == r.cu_seqlens[:-1] and (ids[r.n_tokens :] == packing.END_ID).all()
        for doc, offset, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces[doc].append((offset, ids[a:b].tolist()))
    return {d: sum((p for _, p in sorted(ps)), []) for d, ps in pieces.items()}


def test_documents_come_back_whole(spark):
    codec = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY))
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "word " * 9000), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    for width, shard in ((16, 40), (2048, packing.SHARD_TOKENS)):
        got = rebuilt(packing.pack(df, width=width, shard_tokens=shard).collect(), width)
        assert got == {i: codec.encode(t or "").tolist() + [packing.END_ID] for i, t in rows}
    assert packing.pack(df.limit(0)).collect() == []


def test_query_holds_every_document(spark):
    codec = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = queries()["op3_packing"](spark, SF).collect()
    assert rebuilt(rows, packing.WIDTH) == {
        d.doc_id: codec.encode(d.text or "").tolist() + [packing.END_ID] for d in docs
    }
    assert sum(r.n_tokens for r in rows) / (len(rows) * packing.WIDTH) > 0.9
