"""Positions and running totals over a whole table, without one big window.

A window with no partition key, or with one hot key, puts all its rows into
one task. Here the table is range-partitioned by the order instead, each
partition counts (or sums) on its own, and the few per-partition totals say
where each partition starts. Rows with equal keys are told apart by the task
they came from, so a hot key is split too; their positions among each other
are arbitrary, unless the order ends with a unique column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtally.session import materialize

_PART, _LOCAL, _TIE = "_part", "_local", "_tie"


def _ranged(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    # With the number given, AQE neither merges nor splits the partitions.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, _TIE]
    return (
        df.withColumn(_TIE, F.spark_partition_id())
        .repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .drop(_TIE)
        .withColumn(_PART, F.spark_partition_id())
    )


def _summed_locally(
    df: DataFrame, order: Sequence[str | Column], value: str, keep: Sequence[str]
) -> DataFrame:
    """Ranged rows, with the sum of ``value`` since the partition's start."""
    ranged = _ranged(df, order).select(*keep, _PART, F.col(value).cast("bigint").alias(_LOCAL))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            at = batch.schema.get_field_index(_LOCAL)
            sums = pc.cumulative_sum(batch.column(at), start=carry)
            carry = sums[-1].as_py()
            yield batch.set_column(at, batch.schema.field(at), sums)

    return ranged.mapInArrow(add_up, ranged.schema)


def _with_start(table: DataFrame, amount: Column) -> DataFrame:
    """Join each row with the amount in all partitions before its own.

    The totals are at most one row per shuffle partition, so their window and
    their broadcast do not grow with the table.
    """
    everywhere = Window.orderBy(_PART)
    before = everywhere.rowsBetween(Window.unboundedPreceding, -1)
    whole = everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = table.groupBy(_PART).agg(amount.alias("_n")).select(
        _PART,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(whole).alias("_total"),
    )
    return table.join(F.broadcast(starts), _PART)


def with_dense_index(
    df: DataFrame, order: Sequence[str | Column], name: str = "idx", total: str | None = None
) -> DataFrame:
    """Add 0, 1, 2, ... in the given order: one range shuffle, one write.

    ``total`` names a further column for the number of rows.
    """
    # The low 33 bits of this id are the row's position in its partition.
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    table = materialize(_ranged(df, order).withColumn(_LOCAL, local), "index")
    out = _with_start(table, F.count(F.lit(1)))
    out = out.withColumn(name, F.col("_start") + F.col(_LOCAL))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop(_PART, _LOCAL, "_start", "_total")


def with_running_total(
    df: DataFrame, order: Sequence[str | Column], value: str, name: str = "running"
) -> DataFrame:
    """Add the sum of bigint ``value`` over all rows up to and with this one."""
    table = materialize(_summed_locally(df, order, value, df.columns), "running")
    out = _with_start(table, F.sum(value))
    out = out.withColumn(name, F.col("_start") + F.col(_LOCAL))
    return out.drop(_PART, _LOCAL, "_start", "_total")


def max_running_total(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], value: str, name: str
) -> DataFrame:
    """The largest running total of each group, where each group's values sum
    to zero, so that the total over the whole table is also the group's own.

    Only the maxima leave a partition: a row for each of its groups, and a
    group's rows lie in neighbouring partitions.
    """
    local = _summed_locally(df, [*group, *order], value, [*group, value])
    maxima = local.groupBy(*group, _PART).agg(
        F.max(_LOCAL).alias("_max"), F.sum(value).alias("_sum")
    )
    out = _with_start(materialize(maxima, "maxima"), F.sum("_sum"))
    return out.groupBy(*group).agg(F.max(F.col("_start") + F.col("_max")).alias(name))


def balanced_group(idx: Column, total: Column, groups: int) -> Column:
    """Group (from 0) of position ``idx`` when ``total`` rows are cut into
    ``groups`` contiguous runs, the first ``total mod groups`` one longer."""
    size = F.floor(total / F.lit(groups)).cast("bigint")
    longer = F.pmod(total, F.lit(groups)).cast("bigint")
    edge = longer * (size + 1)
    return (
        F.when(idx < edge, F.floor(idx / (size + 1)))
        .otherwise(longer + F.floor((idx - edge) / F.when(size > 0, size)))
        .cast("int")
    )
