"""The automata against plain searches; held-out accuracy; odd rows."""

import random
import zlib

import numpy as np

from voxtally.llm import langid
from voxtally.llm.queries import queries

SF = "/root/testdata/sf0.01"


def plain_phrases(source: list[int], codes: list[int]) -> int:
    joined = "".join(map(chr, source))
    count = 0
    for low in range(0, len(codes), langid.PIECE):
        piece = "".join(map(chr, codes[low : low + langid.PIECE]))
        at = 0
        while at < len(piece):
            n = 1
            while at + n < len(piece) and piece[at : at + n + 1] in joined:
                n += 1
            at, count = at + n, count + 1
    return count


def test_phrases_are_longest_matches():
    rng = random.Random(5)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(1, 6)))
    a = " ".join(word("abcd") for _ in range(150))
    b = " ".join(word("cdeé") for _ in range(150))
    parser = langid.Parser(langid.Samples(("a", "b"), (a, b), (a[:50], b[:50])))
    texts = [" ".join(word("abcdeéz9.") for _ in range(n)) for n in (1, 3, 40, 300)] + ["zzz", "日本 abc", a]
    counts, lengths = parser.phrases(texts)
    for i, t in enumerate(texts):
        codes = parser.alphabet.encode(t).tolist()
        assert lengths[i] == len(codes)
        assert counts[i].tolist() == [plain_phrases(parser.alphabet.encode(s).tolist(), codes) for s in (a, b)]


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries()["op5_language"](spark, SF).collect()}
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in docs if got[d.doc_id].held_out]) > 0.95


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog sat" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", "x") for i in range(40)]
    rows += [(None, "the dog", None, "x"), (100, None, "en", "x"), (101, "", "de", "x"), (102, "12 .,!", "fr", "x"),
             (103, "und die " * 60_000, None, "x"), (1, rows[1][1], "en", "x"), (104, "日本語", None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string").repartition(3)
    samples = langid.learn(df)
    assert samples.languages == ("de", "en")
    got = langid.identify(df, samples).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by_id[100] == by_id[101] == by_id[102] == ("und", 0.0)
    assert by_id[103][0] == "de" and by_id[None][0] == "en" and by_id[104][0] in ("de", "en")
    assert langid.identify(df.limit(0), samples).collect() == []
    nothing = langid.learn(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
