"""Classes against all pairs, alignment against plain dynamic programming."""

import random

import numpy as np

from voxtally.llm import minhash
from voxtally.llm.queries import queries

SF = "/root/testdata/sf0.01"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


def test_alignment_equals_plain_lcs():
    rng = random.Random(1)
    for _ in range(150):
        a = rng.sample(range(1000), rng.randint(1, 60))
        b = [x for x in a if rng.random() > 0.08]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), 2000 + rng.randint(0, 10**6))
        if rng.random() < 0.3:
            i, k = rng.randint(0, len(b)), rng.randint(0, 8)
            b = b[i : i + k] + b[:i] + b[i + k :]
        b = list(dict.fromkeys(b))
        got = minhash.aligned_share(np.array(a, "<u4"), np.array(b, "<u4")) if b else 0.0
        n = lcs(a, b)
        want = n / (len(a) + len(b) - n)
        assert abs(got - (want if want >= 0.8 - 1e-12 else 0)) < 1e-9


def test_labels_do_not_repeat():
    words = minhash.Words()
    a = minhash.kmers(words.of("a b c d e " * 40))
    assert len(set(a.tolist())) == len(a) == 196
    assert (a[:96] == minhash.kmers(words.of("A, b! c. d (e) " * 20))).all()
    assert len(minhash.kmers(words.of("one two"))) == 1 and len(minhash.kmers(words.of(" ... !! "))) == 0


def brute_classes(docs, similarity=0.8):
    words = minhash.Words()
    seqs = {i: minhash.kmers(words.of(t or "")) >> np.uint64(32) for i, t in docs}
    sets = {i: set(s.tolist()) for i, s in seqs.items()}
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(seqs)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            n, m = len(seqs[i]), len(seqs[j])
            if n and m and min(n, m) >= similarity * max(n, m):
                c = len(sets[i] & sets[j])
                if c >= similarity * (n + m - c) - 1e-9 and minhash.aligned_share(seqs[i], seqs[j], similarity):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: find(i) for i in ids}


def test_query_finds_the_classes_of_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.kept) for r in queries()["op9_near_documents"](spark, SF).collect()}
    want = brute_classes(docs)
    assert len(got) == len(docs)
    wrong = [i for i in want if got[i][0] != want[i]]
    assert len(wrong) == 0, wrong[:10]
    assert all(k == (i == c) for i, (c, k) in got.items())


def test_hot_groups_and_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 400)}" for _ in range(200)]
    passage = " ".join(f"p{i}" for i in range(60))

    def copy(k):
        words = base[:]
        for _ in range(k):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        return " ".join(words)

    docs = [(i, copy(0 if i % 5 == 0 else rng.randint(1, 2))) for i in range(300)]
    docs += [(1000 + i, passage + " " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(150))) for i in range(80)]
    docs += [(2000, None), (2001, ""), (2002, " !! "), (2003, "one two"), (2004, "One two!"), (2005, "one"), (2006, "v " * 50_000), (2007, "v " * 50_001)]
    monkeypatch.setattr(minhash, "BUCKET", 40)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs] + [(None, docs[0][1], 1), (2003, "one two", 1)], "doc_id bigint, text string, class_id int").repartition(5)
    rows = minhash.near_documents(df).collect()
    assert len(rows) == len(docs) + 2
    got = {r.doc_id: (r.class_id, r.kept) for r in rows}
    assert got.pop(None) == (None, True)
    assert {i: c for i, (c, _) in got.items()} == brute_classes(docs)
    kept = minhash.one_of_each(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([None, *[i for i, (c, _) in got.items() if i == c]], key=str)
    assert minhash.near_documents(df.limit(0)).collect() == [] and minhash.one_of_each(df.limit(0)).collect() == []


def test_failed_neighbours_do_not_hide_a_near_one(spark, monkeypatch):
    """Nearest by bands, but failing, documents take all places of a crowded bucket; the near pair is found all the same."""
    real = minhash.bucket_pairs
    # what the bucket proposes at first is nothing at all if it is crowded
    monkeypatch.setattr(minhash, "bucket_pairs", lambda short: real(short) if len(short) <= minhash.SMALL_BUCKET else [])
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(60):
        words = base[:]
        words[rng.randrange(200)] = f"x{i}"
        docs.append((i, " ".join(words)))
    monkeypatch.setattr(minhash, "BUCKET", 16)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_documents(df).collect()}
    assert got == brute_classes(docs) == dict.fromkeys(range(60), 0)


def test_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(i, text if i < 3 else f"{text} other {i} " * 3, -7, i, i) for i in range(5)],
                               "doc_id bigint, text string, _mark int, _gone int, _twice int").repartition(2)
    got = minhash.one_of_each(df)
    assert got.columns == df.columns
    assert all(r._mark == -7 and r._gone == r.doc_id for r in got.collect())
