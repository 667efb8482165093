"""Speed-up against in-memory runs, and the data-write-rate model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voxtally.functions import fixed
from voxtally.functions.modeling import (
    break_even,
    compute_volume,
    data_volume,
    region,
    write_rate,
)
from voxtally.operators.ordering import max_running_total
from voxtally.session import literal_table

#: What a run and its in-memory counterpart have in common, besides engine.
CONDITION = ["iterations", "blocks", "image", "delay"]


def image_dim(spark: SparkSession) -> DataFrame:
    return literal_table(spark, list(fixed.IMAGE_MIB.items()), ["image", "image_mib"])


def fs_dim(spark: SparkSession) -> DataFrame:
    return literal_table(spark, list(fixed.FS_MIB_PER_S.items()), ["fs", "fs_mib_s"])


def concurrency_dim(spark: SparkSession, cluster: dict[int, int] | None = None) -> DataFrame:
    cluster = cluster or fixed.CLUSTER_CONCURRENCY
    rows = [(blocks, node, cluster[blocks]) for blocks, node in fixed.NODE_CONCURRENCY.items()]
    return literal_table(spark, rows, ["blocks", "gamma", "gamma_cluster"])


def with_dims(runs: DataFrame, cluster: dict[int, int] | None = None) -> DataFrame:
    """Runs with image size, storage bandwidth and concurrency.

    Each dimension is a fixed table of three rows, hence the broadcasts. Runs
    in memory have no storage bandwidth. Runs with an image or a number of
    blocks that the tables do not have stay, without size or concurrency.
    """
    spark = runs.sparkSession
    return (
        runs.join(F.broadcast(image_dim(spark)), "image", "left")
        .join(F.broadcast(concurrency_dim(spark, cluster)), "blocks", "left")
        .join(F.broadcast(fs_dim(spark)), "fs", "left")
    )


def with_volumes(runs: DataFrame) -> DataFrame:
    """Adds C (compute seconds) and D (MiB written) to runs with dimensions."""
    return runs.withColumn(
        "c", compute_volume(F.col("delay"), F.col("iterations"), F.col("blocks"))
    ).withColumn("d", data_volume(F.col("image_mib"), F.col("iterations")))


def with_rate(runs: DataFrame) -> DataFrame:
    names = ("fs", "d", "c", "fs_mib_s", "gamma", "gamma_cluster")
    return runs.withColumn("rate", write_rate(*(F.col(n) for n in names)))


def with_baseline(runs: DataFrame, engine: str = "sp") -> DataFrame:
    """Runs with the in-memory makespan of their condition, null where none.

    This is the join of the runs with themselves, done in one pass over them.
    ``runs`` has one row per run name, so a condition has at most one row per
    engine and file system, and the window's partitions stay that small. Runs
    whose condition is not known have no baseline; they are spread by name,
    as they would all meet in one partition otherwise.
    """
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in CONDITION])
    own = F.when(
        known & (F.col("engine") == engine) & (F.col("fs") == fixed.BASELINE_FS), F.col("makespan")
    )
    apart = F.when(~known, F.xxhash64("run"))
    return runs.withColumn("baseline", F.min(own).over(Window.partitionBy(*CONDITION, apart)))


def speedups(runs: DataFrame, engine: str = "sp") -> DataFrame:
    """Runs of one engine over their in-memory counterpart.

    Runs without counterpart drop out, and the in-memory runs themselves.
    """
    return (
        with_baseline(runs, engine)
        .filter((F.col("engine") == engine) & (F.col("fs") != fixed.BASELINE_FS))
        .filter(F.col("baseline").isNotNull())
        .withColumn("speedup", F.col("makespan") / F.col("baseline"))
    )


def speedup_curve(runs: DataFrame) -> DataFrame:
    """Speed-up against normalized write rate, per file system."""
    return with_rate(with_volumes(with_dims(speedups(runs))))


def with_region(curve: DataFrame) -> DataFrame:
    """Where the model puts a run. It has no say on memory-backed storage."""
    return curve.filter(F.col("fs") != fixed.MEMORY_BACKED_FS).withColumn(
        "region", region(F.col("rate"), F.col("speedup"))
    )


def linear_fit(curve: DataFrame) -> DataFrame:
    return curve.groupBy("fs").agg(
        F.regr_slope("speedup", "rate").alias("slope"),
        F.regr_intercept("speedup", "rate").alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    )


def average_slowdown(runs: DataFrame, baseline_engine: str = "sp") -> DataFrame:
    """Makespan averaged over the engines, over the in-memory makespan."""
    others = with_baseline(runs, baseline_engine).filter(
        (F.col("fs") != fixed.BASELINE_FS) & F.col("baseline").isNotNull()
    )
    return (
        others.groupBy("fs", *CONDITION)
        .agg(
            F.avg("makespan").alias("mean_makespan"),
            F.max("baseline").alias("baseline"),
            F.count(F.lit(1)).alias("n_runs"),
        )
        .withColumn("slowdown", F.col("mean_makespan") / F.col("baseline"))
    )


def break_even_concurrency(rates: DataFrame, rate: Column) -> DataFrame:
    """Tasks at a time, per storage, from which it limits a given write rate.

    The storage table has three rows: every rate meets each of them.
    """
    storages = F.array(
        *[
            F.struct(F.lit(fs).alias("fs"), F.lit(bw).alias("fs_mib_s"))
            for fs, bw in fixed.FS_MIB_PER_S.items()
            if fs != fixed.MEMORY_BACKED_FS
        ]
    )
    return rates.select("*", F.inline(storages)).withColumn(
        "break_even", break_even(F.col("fs_mib_s"), rate)
    )


def concurrency_steps(
    tasks: DataFrame, group: list[str], start: str = "start", end: str = "end"
) -> DataFrame:
    """``(*group, t, step)``: by how much the number of tasks changes at each time.

    Steps at the same time are added up, on the map side first. Where tasks
    end and start at one time the ends come first, so their sum is all that
    the largest number depends on.
    """
    points = tasks.select(
        *group,
        F.inline(
            F.array(
                F.struct(F.col(start).alias("t"), F.lit(1).alias("step")),
                F.struct(F.col(end).alias("t"), F.lit(-1).alias("step")),
            )
        ),
    )
    return points.groupBy(*group, "t").agg(F.sum("step").alias("step"))


def max_concurrency(steps: DataFrame, group: list[str]) -> DataFrame:
    """Largest number of tasks at a time per group (no group: the cluster).

    ``steps`` as ``concurrency_steps`` gives them, of this grouping or a finer
    one. A sweep: the largest running total, from one range shuffle; no group
    has to fit in a task.
    """
    points = steps.groupBy(*group, "t").agg(F.sum("step").alias("step"))
    return max_running_total(points, group, ["t"], "step", "max_tasks")
