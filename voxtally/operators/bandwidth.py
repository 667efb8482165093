"""I/O bandwidth distributions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from voxtally.functions import fixed
from voxtally.functions.modeling import bandwidth, chunk_mb
from voxtally.operators.ordering import with_running_total
from voxtally.session import materialize

GROUP = ["engine", "fs", "op"]


def io_bandwidths(events: DataFrame) -> DataFrame:
    """Bandwidth of each file read and write outside memory.

    ``events`` carries the fields of the run's name.
    """
    seconds = F.col("end") - F.col("start")
    op = F.when(F.col("name") == fixed.READ_FILE, "read").when(
        F.col("name") == fixed.WRITE_FILE, "write"
    )
    return (
        events.filter(
            (F.col("fs") != fixed.BASELINE_FS)
            & F.col("name").isin(fixed.READ_FILE, fixed.WRITE_FILE)
        )
        .withColumn("op", op)
        .withColumn("floored", (seconds == 0).cast("int"))
        .withColumn("mb_s", bandwidth(chunk_mb(F.col("image"), F.col("blocks")), seconds))
    )


def exact_quantiles(
    df: DataFrame,
    group: list[str],
    value: str,
    points: dict[str, float],
    sums: Sequence[str] = (),
    over_all: str | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group, with the group's
    ``n``, ``low`` and ``high``, and the sums of some integer columns.

    ``percentile()`` would hold a whole group's distinct values in one task.
    Here equal values are counted on the map side first; the distinct values
    are range-sorted, and their running count tells which of them sit at the
    wanted ranks. Only those reach the last aggregate. ``df`` is read once.

    ``over_all`` names a column of the group over whose values there are
    quantiles too, as its value ``all``; they come from the same counts and
    the same sort. A group without any value has n = 0 and null quantiles.
    """
    # a null counts 0 and so holds no rank
    counted = df.groupBy(*group, value).agg(
        F.count(value).alias("_c"), *[F.sum(s).alias(s) for s in sums]
    )
    if over_all:
        both = F.explode(F.array(F.col(over_all), F.lit("all")))
        counted = counted.withColumn(over_all, both).groupBy(*group, value).agg(
            F.sum("_c").alias("_c"), *[F.sum(s).alias(s) for s in sums]
        )
    ranked = with_running_total(counted, [*group, value], "_c", "_upto")
    # One row per group, with the running count just before the group.
    whole = ranked.groupBy(*group).agg(
        F.sum("_c").alias("n"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.min(F.col("_upto") - F.col("_c")).alias("_base"),
        *[F.sum(s).alias(s) for s in sums],
    )
    whole = materialize(whole, "groups")
    placed = ranked.select(*group, value, "_c", "_upto").join(whole, group)
    placed = placed.withColumn("_hi", F.col("_upto") - F.col("_base") - 1)
    placed = placed.withColumn("_lo", F.col("_hi") - F.col("_c") + 1)

    def rank(p: float) -> Column:
        return F.lit(p) * (F.col("n") - 1)

    def holds(r: Column) -> Column:
        return (F.col("_lo") <= r) & (r <= F.col("_hi"))

    def at(r: Column) -> Column:
        return F.max(F.when(holds(r), F.col(value)))

    def quantile(p: float) -> Column:
        below, above = at(F.floor(rank(p))), at(F.ceil(rank(p)))
        return below + (above - below) * F.max(rank(p) - F.floor(rank(p)))

    wanted = [holds(edge(rank(p))) for p in points.values() for edge in (F.floor, F.ceil)]
    return (
        placed.filter(reduce(Column.__or__, wanted) | (F.col("n") == 0))
        .groupBy(*group, "n", "low", "high", *sums)
        .agg(*[quantile(p).alias(name) for name, p in points.items()])
    )


def distribution(bandwidths: DataFrame) -> DataFrame:
    """Count, floored count, extrema and quartiles per engine, and over all
    engines, file system and op."""
    points = {"p25_mb_s": 0.25, "median_mb_s": 0.5, "p75_mb_s": 0.75}
    out = exact_quantiles(bandwidths, GROUP, "mb_s", points, sums=["floored"], over_all="engine")
    names = {"floored": "n_floored", "low": "min_mb_s", "high": "max_mb_s"}
    return out.withColumnsRenamed(names)


def histogram(bandwidths: DataFrame, width: float) -> DataFrame:
    """Counts in buckets of ``width`` MB/s, the density behind a violin plot."""
    return (
        bandwidths.withColumn("bucket", F.floor(F.col("mb_s") / width))
        .groupBy(*GROUP, "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def both_levels(bandwidths: DataFrame) -> DataFrame:
    """Counts per file system over all engines, and per engine, in one pass.

    The rows are counted per engine; only those few counts are rolled up.
    """
    fine = bandwidths.groupBy("engine", "fs", "op").agg(
        F.count(F.lit(1)).alias("n"), F.max("mb_s").alias("max_mb_s")
    )
    return fine.groupingSets(
        [[F.col("fs"), F.col("op")], [F.col("engine"), F.col("fs"), F.col("op")]],
        F.col("engine"),
        F.col("fs"),
        F.col("op"),
    ).agg(F.sum("n").alias("n"), F.max("max_mb_s").alias("max_mb_s"))


def write_time_by_count(writes: DataFrame, chunks: str, seconds: str) -> DataFrame:
    """Total write time for each number of chunks written."""
    return writes.groupBy(chunks).agg(F.sum(seconds).alias("write_seconds"))


def realized(writes: DataFrame, group: list[str], size: str, seconds: str) -> DataFrame:
    """Bandwidth over all writes of a group: sum of sizes over sum of times."""
    return writes.groupBy(*group).agg((F.sum(size) / F.sum(seconds)).alias("mb_s"))


def write_times(times: DataFrame, path: str) -> None:
    """Write times per number of chunks as JSON, one object per number."""
    times.write.mode("overwrite").json(path)


#: The normalized rank error that is promised is that of a sketch with k = 200, at 99 % confidence (a fixed value); a
#: larger k errs less, so that many groups keep to it at once.
SKETCH_K, SKETCH_ERROR = 800, 0.0133


def rank_sketches(df: DataFrame, group: list[str], value: str, over_all: str | None = None) -> DataFrame:
    """``(group..., sketch)``: a mergeable sketch of the ranks of a column.

    One scan: each task adds to sketches of a few kilobytes, and these are all
    that is shuffled. ``over_all`` names a column of the group; sketches of its
    values are merged into one under the value ``all``, which reads no row again.
    """
    own = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.kll_sketch_agg_double(F.col(value), SKETCH_K).alias("sketch"))
    if not over_all:
        return own
    own = materialize(own, "sketches")
    rest = [g for g in group if g != over_all]
    merged = own.groupBy(*rest).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return own.unionByName(merged.withColumn(over_all, F.lit("all")))


def sketched_quantiles(sketches: DataFrame, group: list[str], points: Sequence[float]) -> DataFrame:
    """``(group..., n, point, value)`` of each sketch."""
    at = F.array(*[F.lit(float(p)) for p in points])
    both = F.arrays_zip(at.alias("point"), F.kll_sketch_get_quantile_double("sketch", at).alias("value"))
    return sketches.select(*group, F.kll_sketch_get_n_double("sketch").alias("n"), F.explode(both).alias("_q")).select(*group, "n", "_q.*")


def rank_errors(df: DataFrame, group: list[str], value: str, quantiles: DataFrame, over_all: str | None = None) -> DataFrame:
    """The quantiles with ``error``, the share of rows by which their true rank is off.

    Rows are counted below and up to each value, on the map side; nothing is
    sorted. There are as many quantiles as groups and points, so they are
    written once and Spark compares their size with its broadcast threshold.
    """
    fixed_points = materialize(quantiles, "quantiles")
    keys = [F.col(g) for g in group]
    rows = df.where(F.col(value).isNotNull())
    if over_all:
        keys = [F.explode(F.array(F.col(over_all), F.lit("all"))).alias(over_all) if g == over_all else F.col(g) for g in group]
    # equal values are one row of a task
    counted = rows.select(*keys, F.col(value).alias("_v")).groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
    met = counted.join(fixed_points, group).groupBy(*group, "n", "point", "value").agg(
        F.sum(F.when(F.col("_v") < F.col("value"), F.col("_c")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("_v") <= F.col("value"), F.col("_c")).otherwise(0)).alias("up_to"),
    )
    off = F.greatest(F.lit(0.0), F.col("below") / F.col("n") - F.col("point"), F.col("point") - F.col("up_to") / F.col("n"))
    return met.select(*group, "n", "point", "value", off.alias("error"))
