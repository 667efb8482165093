"""Session set-up and the one way this package cuts lineage."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "voxtally", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on.

    AQE stays on: it coalesces small shuffle partitions and splits skewed
    join partitions, which the large equi-joins here rely on. Times are UTC.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        b = b.config(key, value)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, one per application.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``. Only
    a local session may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="voxtally-"))
        named = context.getCheckpointDir()
    return f"{named.rstrip('/')}/voxtally/{context.applicationId}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark's readers resolve it.

    A plain path belongs to the session's default file system, so listing,
    reading and writing mean the same file on every machine.
    """
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return path
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
    return default.rstrip("/") + posixpath.abspath(path)


def literal_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A small fixed table, as a local relation inside the plan."""

    def sql(v: object) -> str:
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{v!r}D" if isinstance(v, float) else repr(v)

    values = ", ".join(f"({', '.join(map(sql, row))})" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result is read twice, or where row positions must not change
    when a lost task is run again. The table survives lost executors, and its
    size on disk is what Spark compares with
    ``spark.sql.autoBroadcastJoinThreshold``: a join with it is broadcast only
    when it is known to be small, and is a shuffle join otherwise.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
