"""Base spans against plain Python patterns; the choice of further ones; redaction."""

import hashlib
import random
import re

import numpy as np

from voxtally.llm import pii
from voxtally.llm.queries import queries

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": kind == "card" and 14 <= len(d) <= 19 and luhn(d),
                "phone": 10 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


PIECES = ["a", "B9", ".", "..", "-", "_", "@", "x@y.z", "a@b.co_m@x.y", " ", "  ", "+", "+1", "(555) 123", "4", "42", "255", "256", "0001",
          "1.2.3.4", ".5", "4111 1111 1111 1111", "4111-1111-1111-1111", "79927398713", "49927398716", "\n", "é", "🙂", "", "", "%"]


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["", "1 " * 30_000, "1" * 30_000, "a." * 20_000, "a@b" + ".c" * 20_000, "1.2.3.4 " * 800, "x" * 60_000 + "@", "+1" * 5000, "+1 2" * 3000 + "555 1234"]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id bigint, text string").repartition(8)
    got = {r.doc_id: r.spans for r in pii.find_private(df).collect()}
    for i, text in enumerate([*texts, None]):
        base = [s for s in got[i] if s.base]
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in base) == plain(text or ""), repr(text)[:200]


def test_query_against_plain_patterns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries()["op8_pii"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        want, r = plain(d.text or ""), got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert set(want.split(",")) - {""} <= set(spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{k}:") for k in PATTERNS]


def test_trees_learn_and_score_alike(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    rows = [(int(b), int(k)) for b in rng.integers(0, 1 << pii.N_FEATURES, 300) for k in range(4)]
    x = pii._matrix(rows)
    truth = (x[:, 0] == 1) & (x[:, 4] == 0) | (x[:, 13] == 1)
    trees, start, margin = pii.boost(x, truth * 10.0, ~truth * 10.0)
    assert ((margin > 0) == truth).mean() > 0.99
    model = pii.Trees(trees, start, (0.5,) * 4)
    df = spark.createDataFrame([(b, k, float(m)) for (b, k), m in zip(rows, margin)], "bits int, kind int, m double")
    worst = df.select(F.max(F.abs(model.score(F.col("bits"), F.col("kind")) - 1 / (1 + F.exp(-F.col("m")))))).first()[0]
    assert worst < 1e-9


def test_further_spans_need_their_threshold(spark):
    good = [(i, f"tel +1 (555) 123-{1000 + i % 9000} ok, short +1 22 3") for i in range(600)]
    df = spark.createDataFrame([*good, (9999, "phone (555) 123-4567 end"), (9998, "call 001 555 123 4567 now")], "doc_id bigint, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in pii.find_private(df).collect()}
    assert all([(k, b) for k, _, _, b in got[i]] == [("phone", True)] for i in range(600))
    assert all(not s[3] for i in (9998, 9999) for s in got[i])


def test_redaction(spark):
    rows = [(1, "é write x@y.zz, or 1.2.3.4!", "q"), (2, None, "q"), (3, "", None), (None, "+1 555 123 4567", "z"), (5, "clean", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    out = pii.redacted(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "é write [EMAIL], or [IP]!", "q"), (2, None, "q"), (3, "", None), (None, "[PHONE]", "z"), (5, "clean", "z")], key=str)
    assert pii.redacted(df.limit(0)).collect() == [] and pii.find_private(df.limit(0)).collect() == []


def test_written_addresses_and_local_phones_are_found_and_redacted(spark):
    rare = [(9001, "write to jo.doe (at) mail (dot) com or phone (555) 123-4567 now", "write to [EMAIL] or phone [PHONE] now"),
            (9002, "we look (at) page. In all", "we look (at) page. In all")]
    # few candidates: the prior thresholds; many, some of which fail: learned ones
    many = [(i, f"mail me{i}@host.org, me{i} [at] host.org, look (at) page. In, a@b.{'c' * 9}, tel +1 (555) 123-{1000 + i}, short +1 22 3") for i in range(600)]
    for others in ([], many):
        df = spark.createDataFrame([*((i, t) for i, t, _ in rare), *others], "doc_id bigint, text string")
        found = pii.with_candidates(df).drop("text")
        thresholds = pii.fit(found).thresholds
        assert thresholds == pii.PRIOR if not others else 0 < thresholds[pii.EMAIL] <= 1
        got = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in pii.find_private(df).collect()}
        assert got[9001] == [("email", False), ("phone", False)] and got[9002] == []
        clean = {r.doc_id: r.text for r in pii.redacted(df).collect()}
        assert all(clean[i] == want for i, _, want in rare)


def test_clashing_names(spark):
    names = ["_plain", "_base", "_candidates", "spans", "_clean", "_found", "_joined", "_loose", "_dotted"]
    df = spark.createDataFrame([(1, "mail a@b.cc now", *range(9))], ["doc_id", "text", *names])
    got = pii.redacted(df)
    assert got.columns == df.columns
    assert [tuple(r) for r in got.collect()] == [(1, "mail [EMAIL] now", *range(9))]
