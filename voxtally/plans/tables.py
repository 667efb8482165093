"""The given tables, seen as chunks, task events, runs and conditions.

Plain projections (one equi-join for the runs), so scans stay pruned to the
columns a query needs and every query's work grows with its tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtally.functions import fixed
from voxtally.functions.runs import parse_run_name
from voxtally.operators.makespan import makespans, parsed_runs

# How columns of the tables stand for parts of a run name.
FS = ["mem", "tmpfs", "local", "lustre"]
TAGS = ["125BB", "30BB", "750BB", "125HBB", "125MRI"]
ITERATIONS = ["1", "10", "100"]
DELAYS = ["2.4", "3.44", "7.68", "320", "0.59", "1.76", "3.52", "14.67"]
PHASES = {
    "click": fixed.READ_FILE,
    "view": fixed.WRITE_FILE,
    "error": fixed.INCREMENT,
    "signup": fixed.SAVE,
    "purchase": fixed.DRIVER,
}
SEGMENT_FS = {
    "AUTOMOBILE": "mem",
    "BUILDING": "tmpfs",
    "FURNITURE": "local",
    "HOUSEHOLD": "lustre",
    "MACHINERY": "local",
}
PRIORITY_TAG = {
    "1-URGENT": "30BB",
    "2-HIGH": "125BB",
    "3-MEDIUM": "750BB",
    "4-NOT SPECIFIED": "125HBB",
    "5-LOW": "125MRI",
}
SHAPE = (4, 4, 4)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(values: list, at: Column) -> Column:
    """``values[at mod length]``"""
    place = F.pmod(at, F.lit(len(values))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), place)


def lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def _div(column: Column, by: int) -> Column:
    return F.floor(column / F.lit(by)).cast("bigint")


def micros(ts: str) -> Column:
    """Microseconds since the epoch; the tables' times have no zone, so the
    session's zone is taken out again."""
    return F.unix_micros(F.from_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone()))


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as task events; the user decides the run."""
    e = read(spark, sf_dir, "events")
    u = F.col("user_id")
    run = F.concat(
        pick(fixed.ENGINES, u),
        F.lit("_"),
        pick(FS, _div(u, 2)),
        F.lit("_"),
        pick(ITERATIONS, _div(u, 40)),
        F.lit("it"),
        pick(TAGS, _div(u, 8)),
        F.lit("_"),
        pick(DELAYS, _div(u, 120)),
        F.lit("delay.out"),
    )
    i = F.col("event_id")
    chunk = F.concat(
        F.lit("img_"),
        (F.pmod(i, F.lit(5)) * 769).cast("string"),
        F.lit("_"),
        (F.pmod(_div(i, 5), F.lit(5)) * 603).cast("string"),
        F.lit("_"),
        (F.pmod(_div(i, 25), F.lit(5)) * 694).cast("string"),
        F.lit(".nii"),
    )
    name = lookup(PHASES, F.col("event_type"))
    start = micros("ts") / F.lit(1e6)
    return e.select(
        "event_id",
        run.alias("run"),
        name.alias("name"),
        start.alias("start"),
        (start + F.col("value")).alias("end"),
        F.concat(F.lit("node"), F.pmod(u, F.lit(fixed.NODES)).cast("string")).alias("node"),
        F.when(name == fixed.DRIVER, F.lit(fixed.ALL_FILES)).otherwise(chunk).alias("filename"),
        u.alias("executor"),
    )


def driver_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers as driver rows of runs.

    Both sides grow, so this is a shuffle join on the customer key, left to
    AQE: it broadcasts a side that turns out small and splits a hot key.
    """
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    run = F.concat(
        F.when(F.col("o_orderstatus") == "O", F.lit("np")).otherwise(F.lit("sp")),
        F.lit("_"),
        lookup(SEGMENT_FS, F.col("c_mktsegment")),
        F.lit("_"),
        pick(ITERATIONS, F.col("o_custkey")),
        F.lit("it"),
        lookup(PRIORITY_TAG, F.col("o_orderpriority")),
        F.lit("_"),
        pick(DELAYS, F.col("o_orderkey")),
        F.lit("delay.out"),
    )
    start = (F.dayofmonth("o_orderdate") * 60).cast("double")
    return joined.select(
        "o_orderkey",
        run.alias("run"),
        F.lit(fixed.DRIVER).alias("name"),
        start.alias("start"),
        (start + F.col("o_totalprice") / 1000).alias("end"),
    )


def measured_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run: name, its fields, makespan."""
    spans = makespans(driver_events(spark, sf_dir), "o_orderkey")
    return spans.select("*", *parse_run_name(F.col("run")))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that have task events, with the fields of their names."""
    return parsed_runs(task_events(spark, sf_dir).select("run").distinct())


def embedding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 4 x 4 x 4 chunks of float voxels."""
    e = read(spark, sf_dir, "embeddings")
    path = F.concat(F.lit("img"), F.col("label").cast("string"), F.lit("_"),
                    F.col("vec_id").cast("string"), F.lit("_0_0.nii"))
    return e.select(
        "vec_id",
        "label",
        path.alias("path"),
        F.array(*[F.lit(s) for s in SHAPE]).alias("shape"),
        F.lit("float32").alias("dtype"),
        F.col("embedding").alias("voxels"),
    )


def voxel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as voxels of an image."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_partkey").alias("x"),
        F.col("l_suppkey").alias("y"),
        (F.col("l_linenumber") - 1).alias("z"),
        F.col("l_quantity").cast("int").alias("v"),
    )


def condition_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as experiment conditions, one JSON object per row."""
    k = F.col("p_partkey")
    text = F.concat(
        F.lit('{"experiment": '),
        F.col("p_size").cast("string"),
        F.lit('.5, "framework": "'),
        pick(["spark", "workflow"], k),
        F.lit('", "filesystem": "'),
        pick(FS, _div(k, 2)),
        F.lit('", "delay": '),
        pick(DELAYS, _div(k, 8)),
        F.lit(', "dataset": "'),
        pick(list(fixed.DATASETS), F.col("p_size")),
        F.lit('", "iterations": '),
        pick(ITERATIONS, _div(k, 64)),
        F.lit("}"),
    )
    return read(spark, sf_dir, "part").select("p_partkey", text.alias("value"))
