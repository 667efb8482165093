"""Makespans: how long a run took from first driver start to last end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtally.functions import fixed
from voxtally.functions.events import seconds_text
from voxtally.functions.runs import parse_run_name
from voxtally.operators.events import driver_rows

# Both aggregates combine on the map side, so a run that holds a large part
# of all rows costs its reducer one small row per map task.


def multi_driver(events: DataFrame) -> DataFrame:
    """Runs with one driver per node group: last end minus first start."""
    return driver_rows(events).groupBy("run").agg(
        (F.max("end") - F.min("start")).alias("makespan")
    )


def single_driver(events: DataFrame, position: str) -> DataFrame:
    """Runs with one driver: the end of its first row by ``position``."""
    return driver_rows(events).groupBy("run").agg(F.min_by("end", position).alias("makespan"))


def makespans(events: DataFrame, position: str) -> DataFrame:
    """One makespan per run, by the rule of the run's engine."""
    both = driver_rows(events).groupBy("run").agg(
        (F.max("end") - F.min("start")).alias("_multi"),
        F.min_by("end", position).alias("_single"),
    )
    several = F.contains(F.col("run"), F.lit("np"))
    return both.select("run", F.when(several, F.col("_multi")).otherwise(F.col("_single")).alias("makespan"))


def join_runs(makespan: DataFrame, runs: DataFrame) -> DataFrame:
    """Makespans of the known runs, with the fields of the run's name."""
    return makespan.join(runs, "run", "inner")


def parsed_runs(names: DataFrame) -> DataFrame:
    return names.select("run", *parse_run_name(F.col("run")))


def makespan_line(run: Column, makespan: Column, node: Column, executor: Column) -> Column:
    event = F.concat_ws(
        " ",
        F.lit(fixed.DRIVER),
        F.lit("0"),
        seconds_text(makespan),
        node,
        F.lit(fixed.ALL_FILES),
        executor.cast("string"),
    )
    return F.concat_ws(":", run, event)


def write_makespans(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)
