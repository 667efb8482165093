"""The stages one by one, each against plain checks on its own input."""

import hashlib
import sys
import tempfile
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline  # noqa: E402
import public_tokenizers  # noqa: E402
from test_minhash import brute_classes  # noqa: E402
from test_pii import plain  # noqa: E402
from voxtally.llm import bpe, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, folder = docs.columns, tempfile.mkdtemp(prefix="stages-")
    held = [{r.doc_id: r for r in docs.collect()}]
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
        rows = docs.collect()
        held.append({r.doc_id: r for r in rows})
        assert len(rows) == len(held[-1])
    raw, clean, single, private, mixed, ids = held

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()
    assert set(clean) == {r.doc_id for r in scored if not r.predicted}
    assert all(clean[i] == raw[i] for i in clean)

    classes = brute_classes([(i, r.text) for i, r in clean.items()])
    assert set(single) == {i for i, c in classes.items() if i == c}
    assert all(single[i] == clean[i] for i in single)

    assert set(private) == set(single)
    assert all(plain(r.text or "") == "" for r in private.values())
    assert all(private[i].text == single[i].text for i in single if not plain(single[i].text or ""))
    assert all(r.n_chars == len(r.text) for r in private.values() if r.text is not None)

    assert set(mixed) < set(private) and all(mixed[i] == private[i] for i in mixed)

    codec = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY))
    assert set(ids) == set(mixed)
    for i, r in ids.items():
        text = mixed[i].text or ""
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == codec._short.encode_ordinary(text)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()

    whole = pipeline.run(spark, SF).collect()
    assert {(r.doc_id, bytes(r.ids)) for r in whole} == {(i, bytes(r.ids)) for i, r in ids.items()}


def test_stages_take_empty_and_odd_tables(spark):
    odd = spark.createDataFrame(
        [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (2, "x@y.zz", None, None, 6, 1), (2, "x@y.zz", None, None, 6, 1)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, score int",
    )
    for docs in (odd, odd.limit(0)):
        for i, (name, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, docs, SF)
            if i < len(pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            rows = out.collect()
            if docs is odd and name == "near_duplicates":
                assert sorted((r.doc_id for r in rows), key=str) == [1, 2, None]
            if docs is odd and name == "private_data":
                assert sorted(r.text or "" for r in rows) == ["", "", "[EMAIL]", "[EMAIL]"]
