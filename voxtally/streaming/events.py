"""Event logs while they are being written.

Tasks of a running pipeline add log files to a folder. The batch operators
serve here too: parsing is a map, and the makespan of a run is an aggregate
that needs three numbers of state per run, however many events arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtally.operators.makespan import makespans
from voxtally.sources.logs import parse_event_lines


def follow_event_logs(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Events of the logs in a folder, as new files appear."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return parse_event_lines(lines.select(F.col("_metadata.file_name").alias("run"), "value"))


def running_makespans(events: DataFrame) -> DataFrame:
    """Makespan so far of every run, by the rule of its engine; write it in
    update or complete mode. The earliest driver row counts as the first."""
    return makespans(events, "start")
