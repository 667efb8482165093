"""Hard negatives against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxtally.llm import negatives


def brute(rows, k=5, m=10):
    ok = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows
          if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, lab, v in ok:
        if a % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in ok if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == lab][:k]:
            fit = [(n, i) for n, i, other in scored if other != lab and 30 * -s <= 100 * -n <= 90 * -s][:m]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(fit)]
    return sorted(out)


def run(df, **kw):
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **kw).collect()))


def rows_of(n, seed, dim=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(3)]
    return [(i, [c + rng.gauss(0, 0.6) for c in centres[i % 3]], rng.choice([i % 3, rng.randrange(4)])) for i in range(n)]


SCHEMA = "vec_id bigint, embedding array<double>, label int"


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 16, "anchor_rows": 4}])
def test_all_kinds_of_rows(spark, blocks):
    rows = rows_of(160, 1)
    rows += [(200 + i, rows[20][1], i % 2) for i in range(15)] + [rows[30], rows[30], rows[40]]
    rows += [(300, None, 1), (301, [1.0, None] + [1.0] * 4, 1), (302, [float("nan")] * 6, 1), (305, [float("inf")] * 6, 0), (310, [1.0] * 6, None),
             (None, [1.0] * 6, 1), (320, [0.0] * 6, 1), (321, [0.0] * 6, 2), (330, [1.0, 2.0], 1), (331, [2.0, 2.0], 1), (332, [1.0, 1.0], 2),
             (333, [0.5, 0.9], 0), (340, [], 1), (341, [], 1), (342, [], 2), (350, [3e6] * 6, 1), (351, [2e6] * 6, 2), (352, [-1e5] * 6, 1), (-10, rows[3][1], 0)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).withColumn("id", F.lit(2)).withColumn("key", F.lit("x")).repartition(4)
    assert run(df, **blocks) == brute(rows)


def test_one_label_holds_most_rows(spark):
    rows = [(i, v, 0 if i % 5 else lab) for i, v, lab in rows_of(400, 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert run(df, block_rows=64) == brute(rows)


def test_empty(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    assert run(spark.createDataFrame([(10, [1.0], 1)], SCHEMA)) == []


def test_keys_sort_as_their_fields():
    rng = np.random.default_rng(0)
    n = 500
    number, anchor = rng.integers(0, 5, n), rng.integers(-3, 3, n)
    score = rng.choice([-(1 << 62), -1, 0, 1, 1 << 62], n)
    ids = rng.integers(-(1 << 63), 1 << 62, n)
    keys = negatives.pack_keys(number, anchor, score, 1, ids)
    order = sorted(range(n), key=lambda i: keys[i].as_py())
    assert order == sorted(range(n), key=lambda i: (number[i], anchor[i], -int(score[i]), ids[i]))
    back = negatives.unpack_keys(pa.concat_arrays([keys]))
    for a, b in zip(back, (number, anchor, score, np.ones(n), ids)):
        assert (a == b).all()
