"""The prefix trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.llm import trie


def originals(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by_conv[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in by_conv.items()}


def borrowed(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    out = []
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(m) - 1) * (len(node[-1][1]) if node else 0)
            leaves[node[:d]] += not children[node]
    for node, m in members.items():
        text = ",".join(map(str, sorted(ends[node])))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node],
                    saved[node], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def run(df, rebuild=True):
    turns = trie.numbered_turns(df)
    if rebuild:
        turns, sizes = trie.with_borrowed_heads(turns)
    else:
        sizes = trie.conversation_sizes(turns)
        turns = turns.drop("n_turns").join(sizes, "conv_id").select(*turns.columns)
    return sorted(map(tuple, trie.prefix_trie(turns, sizes).collect()), key=str)


def rows_of(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 12])):
            text = rng.choice(["Hello", "Hé", "How are you?", f"own {c}"]) if t < 3 else f"turn {c % 7} {t}"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("rebuild", [True, False])
def test_all_kinds_of_rows(spark, rebuild):
    rows = rows_of(150, 1)
    rows += [(200, None, None, None), (200, None, "a", None), (200, 3, None, "x"), (200, 3, None, "x"), (200, 3, "", "x"),
             (None, 1, "user", "lost"), (2001, 0, "user", "no base"), (2002, 5, "user", "no base"), (-7, 0, "user", "Hello"),
             (300, 0, "us", "erx"), (301, 0, "user", "x"), (302, 0, "u", "\n" * 100000)]
    rows += rows[:5]
    rows += [(400, t, "user", "Hello" if t < 5 else f"long {t}") for t in range(700)]
    rows += [(c, t, "user", f"copy {t}") for c in range(500, 900) for t in range(4)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6).withColumn("pos", F.lit(1)).withColumn("p1", F.lit(2)).withColumn("n_turns", F.lit(7))
    convs = originals(rows)
    assert run(df, rebuild) == brute(borrowed(convs) if rebuild else convs)


def test_a_conversation_over_all_partitions(spark):
    rows = [(c, t, "user", f"deep {t}" if t < 900 else f"{c} {t}") for c in (1, 2) for t in range(1500)] + rows_of(20, 5)[:30]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert run(df, rebuild=False) == brute(originals(rows))


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(trie, "sketch_width", lambda n: trie._BLOCK)
    monkeypatch.setattr(trie.Sketch, "alone", lambda self, p1, p2, depth: np.zeros(len(p1), dtype=bool))
    rows = rows_of(60, 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert run(df) == brute(borrowed(originals(rows)))


def test_ends_of_a_hot_node_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT_BYTES", 100)
    rows = [(c, t, "user", "same") for c in range(3000) for t in range(2)] + [(5000, 0, "user", "same"), (6000, 0, "user", "z")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert run(df, rebuild=False) == brute(originals(rows))


def test_empty(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    assert run(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []


def test_a_sketch_never_calls_a_shared_prefix_alone(spark):
    df = spark.range(3000).selectExpr("id % 2000 AS depth", "id % 2000 * 7919 AS p1", "id % 2000 * 104729 AS p2").repartition(5)
    sketch = trie._counted(df, trie.sketch_width(3000))
    at = np.arange(2000)
    alone = sketch.alone(at * 7919, at * 104729, at)
    assert not alone[:1000].any()
    assert alone[1000:].mean() > 0.95


def test_digests_join():
    turns = [trie.turn_digest(b"user", str(i).encode()) for i in range(9)]
    whole = (0, 0)
    for t in turns:
        whole = trie.joined_digest(whole, t, 1)
    for cut in range(10):
        left = right = (0, 0)
        for t in turns[:cut]:
            left = trie.joined_digest(left, t, 1)
        for t in turns[cut:]:
            right = trie.joined_digest(right, t, 1)
        assert trie.joined_digest(left, right, 9 - cut) == whole
