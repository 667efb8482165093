"""Held-out accuracy, thresholds, odd rows."""

import hashlib
import zlib

import numpy as np

from voxtally.llm import toxicity
from voxtally.llm.queries import queries

SF = "/root/testdata/sf0.01"


def test_threshold_has_the_fewest_errors():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = rng.normal(size=30).round(1), rng.integers(0, 2, 30)
        got = toxicity.best_threshold(x, y)
        errors = lambda t: ((x >= t) != y).sum()
        assert errors(got) == min(errors(t) for t in [*x, x.max() + 1])
    assert toxicity.best_threshold(np.zeros(0), np.zeros(0)) == 0.0


def test_largest_filter_values_against_plain_loops():
    rng = np.random.default_rng(2)
    n = toxicity.Network(rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS],
                         [rng.normal(size=toxicity.FILTERS) for _ in toxicity.WIDTHS], np.ones(toxicity.FILTERS * 3), 0.0)
    texts = ["one two three four", "", "a", "b c", "d e f d e f g"]
    scorer = toxicity.Scorer(n)
    scorer.scores(texts)
    rows = {w: toxicity.hashes(w) for t in texts for w in t.split()}
    for t in texts:
        words, want = t.split(), []
        for f, b in zip(n.filters, n.biases):
            values = [b + sum(n.embeddings[rows[words[i + k]]].sum(0) @ f[k] for k in range(len(f))) for i in range(len(words) - len(f) + 1)]
            want += np.maximum(0, np.max(values, axis=0)).tolist() if values else [0.0] * toxicity.FILTERS
        got = scorer._pooled([words])[0]
        assert np.allclose(got, want, atol=1e-4)


def test_held_out_documents(spark):
    got = {r.doc_id: r for r in queries()["op4_toxicity"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = [got[r.doc_id].predicted == r.toxic for r in labels]
    assert len(right) > 50 and np.mean(right) >= 0.95
    pos = [got[r.doc_id].score for r in labels if r.toxic]
    neg = [got[r.doc_id].score for r in labels if not r.toxic]
    assert np.mean([p > n for p in pos for n in neg]) > 0.95


def test_odd_rows(spark):
    rows = [(i, ("vile " if i % 2 else "kind ") * 3 + f"w{i}", "x") for i in range(1, 80)]
    rows += [(None, None, None), (900, "", "x"), (901, None, "x"), (902, "vile " * 50_000, "x"), (5, rows[4][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 80)] + [(None, 1), (3, None), (4000, 1)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[902].predicted == 1 and by_id[900].predicted == 0 and by_id[900].score == by_id[901].score == by_id[None].score
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.where("text like 'vile%'").count() == 0 and kept.where("text is null").count() == 2
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_long_texts_are_scored_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    n = toxicity.Network(rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS],
                         [rng.normal(size=toxicity.FILTERS) for _ in toxicity.WIDTHS], rng.normal(size=toxicity.FILTERS * 3) / 50, 0.0)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 500, size)) for size in (0, 1, 2, 3, 9, 10, 11, 12, 13, 100, 1000)]
    whole = toxicity.Scorer(n).scores(texts)
    monkeypatch.setattr(toxicity, "WORDS_PER_STEP", 10)
    assert np.allclose(toxicity.Scorer(n).scores(texts), whole, atol=1e-6)


def test_one_huge_text_does_not_stop_the_learning(spark):
    ids = sorted(range(400), key=lambda i: hashlib.md5(f"toxicity:{i}".encode()).hexdigest())
    ids = [i for i in ids if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, "vile filth scum" if i % 2 else "kind fair good", 1 if i % 2 else 0) for i in ids]
    rows[0] = (ids[0], "long word " * 1_300_000, rows[0][2])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(4)
    network = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    low, high = toxicity.Scorer(network).scores(["kind fair good", "vile filth scum"])
    assert low < 0.5 < high


def test_samples_leave_out_only_what_does_not_fit():
    rows = [("a", 5), ("b", 20), ("c", 4), ("d", 2), ("e", 1)]
    assert toxicity.chosen_within(rows, 10) == [("a",), ("c",), ("e",)]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 7, 8)], "doc_id bigint, text string, _toxicity_score int, _scored_text int")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.clean(df, labels)
    assert got.columns == df.columns and got.collect() == df.collect()


def test_every_labelled_text_is_learned_from(spark):
    ids = [i for i in range(14_000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"vile{i % 29} some words" if i % 2 else f"kind{i % 29} some words", i % 2) for i in ids]
    # each of these words is in a handful of texts: a sample of some thousand rows misses most of them
    rare = {n: [i for i in ids[n * 8 : n * 8 + 8]] for n in range(400)}
    word = {i: n for n, of in rare.items() for i in of}
    rows = [(i, t if i not in word else f"rareword{word[i]}q other text", y if i not in word else word[i] % 2) for i, t, y in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(6)
    found = toxicity.labelled(df.drop("toxic"), df.select("doc_id", "toxic"), "doc_id", "text", "toxic")
    assert found.count() == len(rows)
    network = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    scores = toxicity.Scorer(network).scores([f"rareword{n}q other text" for n in rare])
    assert np.mean([(x >= 0.5) == (n % 2 == 1) for n, x in zip(rare, scores)]) >= 0.95


def test_counts_and_means_of_several_tasks_are_those_of_one(spark):
    rows = [(f"w{i % 7} v{i % 3} {'x ' * (i % 4)}".encode(), i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "_text binary, _y int").repartition(5)
    hits, totals = toxicity.counted(df)
    want = toxicity.bucket_counts([([t.decode() for t, _ in rows], np.array([y for _, y in rows]))])
    assert (hits == want[0]).all() and (totals == want[1]).all()
    at, values = toxicity._means([
        (np.array([1, 2]), np.array([1, 3]), np.full((2, toxicity.DIM + 1), 1.0)), (np.array([2]), np.array([1]), np.full((1, toxicity.DIM + 1), 5.0)),
    ])
    assert at.tolist() == [1, 2] and (values[:, 0] == [1, 2]).all()
    few = toxicity.best_threshold(np.array([1.0, 1, 2, 2]), np.array([0, 1, 0, 1]), np.array([9, 1, 2, 8]))
    assert few == toxicity.best_threshold(np.repeat([1.0, 1, 2, 2], [9, 1, 2, 8]), np.repeat([0, 1, 0, 1], [9, 1, 2, 8]))


def test_words_are_hashed_together_with_the_same_hashes(monkeypatch):
    rng = np.random.default_rng(4)
    letters = list("abAZ09.,!?-_…«»¿¡ßäöÉİΣσςœ€漢字😀'\"()ŉﬃ") + ["é", "\ud800"]
    words = ["".join(rng.choice(letters, n)) for n in rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 20, 64], 3000)]
    words += ["ΑΣ", "ΣΑ", "...", "=", "filth!", "x" * 5000, "." * 100 + "ab", "€" * 65]
    want = [toxicity.hashes(w) for w in words]
    alone, plainly = [], toxicity.hashes
    monkeypatch.setattr(toxicity, "hashes", lambda w: alone.append(w) or plainly(w))
    got = toxicity.hash_rows(iter(words))
    assert got.dtype == np.int32 and got.tolist() == want
    # one at a time only words that are very long without their punctuation; lower case may add a letter
    assert {"x" * 5000, "€" * 65} <= set(alone) and "filth!" not in alone and min(map(len, alone)) > toxicity.LONG_WORD // 2
    assert toxicity.hash_rows([]).shape == (0, 1 + len(toxicity.STEMS))


def test_known_words_are_not_hashed_again_nor_copied_for_each_batch(monkeypatch):
    asked = []

    def rows_of(words):
        asked.append(list(words))
        return np.array([[len(w)] for w in words], dtype=np.int32).reshape(-1, 1)

    vocabulary, spaces = toxicity.Vocabulary(rows_of), set()
    for i in range(200):
        (doc,) = vocabulary.numbered([f"again {'x' * i} again"])
        assert vocabulary.rows[doc, 0].tolist() == ([5, i, 5] if i else [5, 5])
        spaces.add(vocabulary.rows.base.__array_interface__["data"][0])
    assert sum(map(len, asked)) == 200 and len(spaces) < 12
    monkeypatch.setattr(toxicity, "WORDS_PER_STEP", 7)
    (doc,) = vocabulary.numbered([" ".join(f"{i:0{1 + i % 9}}y" for i in range(100))])
    assert max(map(len, asked[200:])) == 7 and vocabulary.rows[doc, 0].tolist() == [len(f"{i:0{1 + i % 9}}y") for i in range(100)]
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 3)
    (doc,) = vocabulary.numbered(["ab c ab"])
    assert vocabulary.rows[doc, 0].tolist() == [2, 1, 2] and len(vocabulary.rows) == 2


def test_largest_values_alone_are_those_with_places():
    rng = np.random.default_rng(5)
    n = toxicity.first_network(rng.integers(0, 9, (2, toxicity.BUCKETS)), np.array([50, 50]))
    places = rng.normal(size=(60, sum(toxicity.WIDTHS) * toxicity.FILTERS)).astype(np.float32)
    bounds = np.array([0, 0, 1, 3, 6, 6, 40, 60])
    assert (n.largest(places, bounds) == n.pooled(places, bounds)[0]).all()
