"""Task-event operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtally.functions import fixed
from voxtally.functions.events import render_event
from voxtally.operators.ordering import with_dense_index
from voxtally.session import materialize


def driver_rows(events: DataFrame) -> DataFrame:
    return events.filter(F.col("name") == fixed.DRIVER)


def driver_starts(events: DataFrame) -> DataFrame:
    """Earliest driver start of each run: partial minima, one row per run."""
    return driver_rows(events).groupBy("run").agg(F.min("start").alias("driver_start"))


def with_driver_start(events: DataFrame) -> DataFrame:
    """Events with their run's driver start, null for a run without driver.

    A hot run never meets in one task: the starts are a small written table,
    which Spark broadcasts if it is below its threshold. Beyond that it is a
    shuffle join whose skewed partitions AQE splits.
    """
    return events.join(materialize(driver_starts(events), "starts"), "run", "left")


def rebase(events: DataFrame, epoch: Column) -> DataFrame:
    """Start and end relative to the driver, where ``epoch`` says that the
    run's clock is absolute; other runs stay as they are."""
    shift = F.when(epoch, F.coalesce(F.col("driver_start"), F.lit(0))).otherwise(F.lit(0))
    return (
        with_driver_start(events)
        .withColumn("start", F.col("start") - shift)
        .withColumn("end", F.col("end") - shift)
        .drop("driver_start")
    )


def on_one_clock(events: DataFrame) -> DataFrame:
    """Start and end relative to the run's start, in logs that mix clocks.

    Some engines stamp their file events with absolute times and the others
    relative to the driver. Absolute times are counted from the driver's start
    where that is absolute too, and from the run's first absolute time where
    it is not; relative times stay.
    """
    absolute = F.col("start") >= fixed.ABSOLUTE_FROM
    driver = F.when((F.col("name") == fixed.DRIVER) & absolute, F.col("start"))
    first = events.groupBy("run").agg(
        F.coalesce(F.min(driver), F.min(F.when(absolute, F.col("start")))).alias("_zero")
    )
    shift = F.when(absolute, F.coalesce("_zero", F.lit(0.0))).otherwise(F.lit(0.0))
    return (
        events.join(materialize(first, "clocks"), "run")
        .withColumn("_shift", shift)
        .withColumn("start", F.col("start") - F.col("_shift"))
        .withColumn("end", F.col("end") - F.col("_shift"))
        .drop("_zero", "_shift")
    )


def render(events: DataFrame) -> DataFrame:
    parts = ("name", "start", "end", "node", "filename", "executor")
    return events.select("run", render_event(*(F.col(c) for c in parts)).alias("value"))


def merge(driver: DataFrame, tasks: DataFrame) -> DataFrame:
    """Driver and task events as one table; the parts need no other merge."""
    return driver.unionByName(tasks)


def timeline(events: DataFrame, order: list[str]) -> DataFrame:
    """Tasks for a timeline: file reads and writes dropped, ids from 0."""
    kept = events.filter(~F.col("name").isin(fixed.READ_FILE, fixed.WRITE_FILE))
    return with_dense_index(kept, order, "id", total="n_tasks")


def task_json(task: DataFrame) -> Column:
    return F.to_json(
        F.struct(
            F.col("name"),
            F.col("id"),
            F.col("start").alias("start-time"),
            F.col("end").alias("end-time"),
            F.col("node"),
        )
    )


def write_timeline(tasks: DataFrame, path: str) -> None:
    """The document ``{"tasks": [...]}`` as a folder of text parts.

    The parts in name order, one after the other, are the document. Nothing
    is gathered: each task's line knows from its id what belongs around it.
    """
    first = F.when(F.col("id") == 0, F.lit('{"tasks": [')).otherwise(F.lit(""))
    last = F.when(F.col("id") == F.col("n_tasks") - 1, F.lit("]}")).otherwise(F.lit(","))
    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        tasks.repartitionByRange(n, "id")
        .sortWithinPartitions("id")
        .select(F.concat(first, task_json(tasks), last).alias("value"))
        .write.mode("overwrite")
        .text(path)
    )
