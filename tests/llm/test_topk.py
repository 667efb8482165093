"""Inner products against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.llm import topk


def brute(rows, k):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 5 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(b) == len(a))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("coordinate_from", [0.0, 0.8])
def test_all_kinds_of_rows(spark, coordinate_from):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * rng.choice([0.1, 1, 3]) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[10][1]) for i in range(15)]
    rows += [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (302, [float("nan")] * 6), (305, [float("inf")] * 6),
             (None, [1.0] * 6), (310, [0.0] * 6), (315, [1.0, 2.0]), (316, [2.0, 2.0]), (320, []), (10, rows[10][1]),
             (325, [3e6] * 6), (326, [-1e5] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1)).repartition(4)
    got = topk.top_products(df, F.col("vec_id") % 5 == 0, k=3, bucket_rows=16, block_rows=8, coordinate_from=coordinate_from)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_products(df, F.col("vec_id") % 5 == 0).collect() == []


def test_coordinates_never_lose_a_near_vector():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for q in x[:40]:
        for cosine in (-0.5, 0.0, 0.3, 0.9, 0.99):
            assert topk._near_coordinates(q, x, cosine)[x @ q >= cosine].all()
