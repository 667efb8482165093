"""Line dedup against plain Python."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from voxtally.llm import linededup

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """Kept texts by row; a null id comes after all others."""
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\v\f\r").translate(A_TO_Z)
    rank = lambda i: (i is None, i or 0)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(rank(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == rank(doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=lambda r: (rank(r[0]), r))


def run(df):
    got = linededup.with_kept_text(df, linededup.keep_bitmaps(df))
    return sorted((tuple(r) for r in got.collect()), key=lambda r: ((r[0] is None, r[0] or 0), r))


def rows_of(n, seed):
    rng = random.Random(seed)
    pool = [f"shared line number {i} of many" for i in range(30)] + ["  Ünïcödé lines  ", "ünïcödé lines", "ÜNÏCÖDÉ LINES", "short", ""]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.6 else f"own line {i} {j}" for j in range(rng.randrange(12))]
        if rng.random() < 0.7:
            lines.append(rng.choice(["Common Line Of A Third", "\tcommon line of a third \r", "common line of a third\x0b"]))
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows


def test_all_kinds_of_rows(spark):
    rows = rows_of(300, 1)
    rows += [(5000, None), (5001, ""), (5002, "\n"), (None, rows[0][1]), (None, "only without an id here\nshared line number 3 of many"),
             (7, rows[7][1]), (7, "another text of seven\nshared line number 1 of many"), (3, None),
             (6000, "\n".join(f"long text line {i % 40000}" for i in range(60000))), (6001, "long text line 39999\nlong text line 1"),
             (6002, "ééééééééé"), (6003, "ééééééééé"), (6004, "éééééééééé"), (6005, "éééééééééé"), (-9, "shared line number 0 of many")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    df = df.withColumn("n_lines", F.lit(-1)).withColumn("keep", F.lit("x")).withColumn("h1", F.lit(0)).withColumn("id", F.lit(1))
    assert run(df) == brute(rows)


def test_one_hash_over_many_partitions(spark):
    rows = [(i, "the very same line everywhere\n" * (1 + i % 3)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    bits = linededup.keep_bitmaps(df).collect()
    assert {r["id"] for r in bits if r["n_dropped"] == 0} == {0}
    assert run(df) == brute(rows)


def test_no_partition_setting_changes_the_result(spark):
    rows = rows_of(60, 3)
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "2", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert run(df) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty(spark):
    assert run(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_bitmaps():
    for n, dropped in ((1, []), (1, [0]), (9, [0, 8]), (1000, range(0, 1000, 3))):
        keep = linededup.unpack_keep(linededup.pack_keep(n, dropped), n)
        assert np.flatnonzero(~keep).tolist() == list(dropped)
