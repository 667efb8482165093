"""Positions and running totals against brute force, with hot keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.operators.assign import assign_groups, group_lists, shuffled
from voxtally.operators.bandwidth import exact_quantiles
from voxtally.operators.model import concurrency_steps, max_concurrency
from voxtally.operators.ordering import balanced_group, with_dense_index, with_running_total


def hot(spark, n=5000):
    """A third of all rows share one key."""
    k = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50)
    return spark.range(0, n, 1, 6).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("id"), k.alias("k"))


def test_dense_index(spark):
    df = hot(spark)
    got = with_dense_index(df, ["k", "id"], "idx", total="n").collect()
    want = {(r.k, r.id): i for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.k, r.id)))}
    assert {(r.k, r.id): r.idx for r in got} == want
    assert {r.n for r in got} == {5000}


def test_dense_index_descending_and_empty(spark):
    df = hot(spark, 100)
    got = with_dense_index(df, [F.desc("id")]).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.idx)] == sorted((r.id for r in df.collect()), reverse=True)
    assert with_dense_index(df.filter("k < 0"), ["id"]).count() == 0


def test_running_total(spark):
    df = hot(spark).withColumn("v", F.pmod("id", F.lit(11)) - 5)
    got = {r.id: r.running for r in with_running_total(df, ["k", "id"], "v").collect()}
    rows = sorted(df.collect(), key=lambda r: (r.k, r.id))
    assert got == dict(zip((r.id for r in rows), np.cumsum([r.v for r in rows]).tolist()))


@pytest.mark.parametrize("groups", [1, 7, 15])
def test_balanced_groups_are_contiguous_and_the_first_are_longer(spark, groups):
    for n in (0, 1, 14, 15, 16, 125, 750, 751):
        df = spark.range(n).withColumn("g", balanced_group(F.col("id"), F.lit(n), groups))
        got = [r.g for r in df.orderBy("id").collect()]
        want = [g for g, part in enumerate(np.array_split(np.arange(n), groups)) for _ in part]
        assert got == want


def test_125_chunks_over_15_nodes(spark):
    df = spark.range(125).select(F.format_string("c%03d", "id").alias("path"))
    lists = group_lists(assign_groups(df, ["path"]), segment=4).collect()
    sizes = {}
    for r in lists:
        sizes[r.grp] = sizes.get(r.grp, 0) + r.n_paths
        assert r.n_paths <= 4
    assert sorted(sizes.values()) == [8] * 10 + [9] * 5
    in_order = [p for r in sorted(lists) for p in r.paths.split(",")]
    assert in_order == [f"c{i:03d}" for i in range(125)]


def test_shuffle_repeats(spark):
    df = spark.range(100).repartition(4)
    a = [r.id for r in shuffled(df, "id", 1).collect()]
    assert a == [r.id for r in shuffled(df.coalesce(1), "id", 1).collect()]
    assert sorted(a) == list(range(100)) and a != sorted(a)
    assert a != [r.id for r in shuffled(df, "id", 2).collect()]


def test_exact_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(v)) for v in rng.integers(0, 40, 3000)] + [("a", 1e5)] * 1500
    rows += [("b", float(v)) for v in rng.normal(size=997)] + [("c", 3.0), ("d", 1.0), ("d", 2.0), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    points = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", points).collect()}
    assert set(got) == set("abcde")
    assert got["e"].n == 0 and got["e"].low is None and got["e"].p50 is None
    for g in "abcd":
        values = [v for k, v in rows if k == g]
        for name, p in points.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12), (g, name)


def test_quantiles_over_all_groups(spark):
    rows = [("a", float(v)) for v in range(9)] + [("b", float(v)) for v in range(5, 40)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"p50": 0.5}, over_all="g").collect()}
    assert got["all"].n == 44 and got["all"].p50 == np.quantile([v for _, v in rows], 0.5)
    assert (got["a"].p50, got["b"].p50) == (4.0, 22.0)


def test_groups_of_each_dataset(spark):
    rows = [("a", i) for i in range(125)] + [("b", i) for i in range(30)] + [(None, i) for i in range(4)] + [("c", 1)]
    df = spark.createDataFrame(rows, "dataset string, n int").repartition(5)
    got = assign_groups(df, ["n"], 15, by=["dataset"]).collect()
    assert len(got) == len(rows)
    for dataset, total in (("a", 125), ("b", 30), (None, 4), ("c", 1)):
        own = sorted((r for r in got if r.dataset == dataset), key=lambda r: r.n)
        assert [r.idx for r in own] == list(range(total)) and {r.total for r in own} == {total}
        sizes = [sum(r.grp == g for r in own) for g in range(15)]
        assert sizes == [total // 15 + (g < total % 15) for g in range(15)]


def concurrency(tasks):
    points = sorted([(s, 1) for s, _ in tasks] + [(e, -1) for _, e in tasks], key=lambda p: p)
    now = best = 0
    for _, step in points:
        now += step
        best = max(best, now)
    return best


def test_concurrency_per_node_and_cluster(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        start = float(rng.integers(0, 500))
        node = "hot" if i % 3 == 0 else f"n{i % 10}"
        rows.append((node, start, start + float(rng.integers(0, 20))))
    df = spark.createDataFrame(rows, "node string, start double, end double").repartition(5)
    steps = concurrency_steps(df, ["node"])
    got = {r.node: r.max_tasks for r in max_concurrency(steps, ["node"]).collect()}
    assert got == {n: concurrency([(s, e) for m, s, e in rows if m == n]) for n in {r[0] for r in rows}}
    assert max_concurrency(steps, []).first().max_tasks == concurrency([(s, e) for _, s, e in rows])


def test_back_to_back_tasks_do_not_overlap(spark):
    df = spark.createDataFrame([("a", 0.0, 5.0), ("a", 5.0, 9.0)], "node string, start double, end double")
    assert max_concurrency(concurrency_steps(df, ["node"]), ["node"]).first().max_tasks == 1


def test_a_hot_key_is_split_over_partitions(spark):
    from voxtally.operators.ordering import _ranged

    df = spark.range(0, 9000, 1, 16).withColumn("k", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")))
    hot = _ranged(df, ["k"]).filter("k = 7").groupBy("_part").count().collect()
    assert len(hot) >= 3 and sum(r["count"] for r in hot) == 3000 + 1
    got = with_dense_index(df, ["k"], "idx")
    assert sorted(r.idx for r in got.collect()) == list(range(9000))
    ordered = [r.k for r in sorted(got.collect(), key=lambda r: r.idx)]
    assert ordered == sorted(ordered)


def test_concurrency_of_copies(spark):
    df = spark.range(0, 3000, 1, 8).select(
        F.lit("a").alias("node"), F.lit(1.0).alias("start"), F.lit(2.0).alias("end")
    )
    assert max_concurrency(concurrency_steps(df, ["node"]), ["node"]).first().max_tasks == 3000
