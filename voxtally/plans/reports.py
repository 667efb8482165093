"""Comparison tables per experiment: makespan by one factor and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtally.functions import fixed
from voxtally.functions.runs import delay_text
from voxtally.session import literal_table


def experiment_filter(exp: int, condition: float | None = None) -> Column:
    """Which runs belong to an experiment."""
    if exp == 1:
        return F.col("delay") == (fixed.EXP1_DELAY if condition is None else condition)
    if exp == 2:
        return F.col("delay").isin(fixed.EXP2_DELAYS)
    if exp == 3:
        return F.col("delay") == fixed.EXP3_DELAY
    if exp == 4:
        iterations = fixed.EXP4_ITERATIONS if condition is None else int(condition)
        return F.col("delay").isin(fixed.EXP4_DELAYS) & (F.col("iterations") == iterations)
    raise ValueError(f"no experiment {exp}")


def experiment_label(exp: int) -> Column:
    """The factor of an experiment, as its axis shows it."""
    if exp == 1:
        return F.col("iterations").cast("string")
    if exp == 2:
        return F.col("blocks").cast("string")
    if exp == 3:
        return F.col("image")
    return delay_text(F.col("delay"))


def axis_dim(spark: SparkSession, exps: Sequence[int]) -> DataFrame:
    """The fixed axes of some experiments: three or four labels each."""
    rows = [(exp, pos, label) for exp in exps for pos, label in enumerate(fixed.AXES[exp])]
    return literal_table(spark, rows, ["exp", "pos", "label"])


def series_names() -> list[str]:
    return [f"{engine}_{fs}" for engine, fs in fixed.SERIES]


def series_of(
    runs: DataFrame, exps: Sequence[int], conditions: dict[int, float] | None = None
) -> DataFrame:
    """Runs as ``(exp, series, label, makespan)``, once for each of the
    experiments they belong to: a map over the runs, whatever the number."""
    conditions = conditions or {}
    places = [
        F.struct(
            F.lit(exp).alias("exp"),
            experiment_label(exp).alias("label"),
            experiment_filter(exp, conditions.get(exp)).alias("_in"),
        )
        for exp in exps
    ]
    belongs = F.filter(F.array(*places), lambda p: p["_in"])
    return (
        runs.select(F.concat_ws("_", "engine", "fs").alias("series"), "makespan", F.inline(belongs))
        .filter(F.col("series").isin(series_names()))
        .drop("_in")
    )


def comparison(runs: DataFrame, exp: int, condition: float | None = None) -> DataFrame:
    """One row per axis label, one column per series, in axis order.

    Several runs of a series at one label are averaged.
    """
    conditions = {} if condition is None else {exp: condition}
    table = (
        series_of(runs, [exp], conditions)
        .groupBy("label")
        .pivot("series", series_names())
        .agg(F.avg("makespan"))
    )
    axis = axis_dim(runs.sparkSession, [exp]).drop("exp")
    return table.join(F.broadcast(axis), "label").orderBy("pos")


def axis_positions(
    runs: DataFrame, exps: Sequence[int] = (1, 2, 3, 4), conditions: dict[int, float] | None = None
) -> DataFrame:
    """For each series, where its labels sit on the axis; labels it has no
    run for stay as gaps (null makespan)."""
    axis = axis_dim(runs.sparkSession, exps).withColumn(
        "series", F.explode(F.array(*[F.lit(n) for n in series_names()]))
    )
    means = series_of(runs, exps, conditions).groupBy("exp", "series", "label").agg(
        F.avg("makespan").alias("makespan")
    )
    # Grouping by the axis bounds both sides to some ninety rows.
    return axis.join(means, ["exp", "series", "label"], "left")
