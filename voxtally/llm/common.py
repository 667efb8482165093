"""What several of these operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

ROWS_PER_BATCH = 256
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """A text, where null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed only; DuckDB can compute the same."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text falls in the fold; a null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds)) == F.lit(fold)


def under_safe_names(docs: DataFrame, own: Sequence[str], fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``fn``, which keeps all columns, with other names for those that it does not look at.

    So whatever the caller's columns are called, none meets a name that an
    operator uses inside.
    """
    safe = [c if c in own else f"carried{i}__" for i, c in enumerate(docs.columns)]
    return fn(docs.toDF(*safe)).toDF(*docs.columns)


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with batches of few rows, as rows may hold whole texts.

    The default of 10 000 rows would hold tens of megabytes of text several
    times over, in the JVM's buffers and in Python. The session's setting is
    lowered to ``BATCH_ROWS``, never raised.
    """
    conf = df.sparkSession.conf
    now = int(conf.get(_BATCH))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        # a worker may wait for its next task for long
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def by_rows(
    df: DataFrame, schema: str | T.StructType, fn: Callable[[Iterator[dict]], Iterator[tuple]],
    rows_per_batch: int = ROWS_PER_BATCH,
) -> DataFrame:
    """Run ``fn`` over the rows of each partition as Python values, in Arrow batches of bounded size.

    ``fn`` gets an iterator of dicts and gives tuples in the order of the
    schema, so that it can carry state along a sorted partition.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for start in range(0, batch.num_rows, rows_per_batch):
                    yield from batch.slice(start, rows_per_batch).to_pylist()

        def packed(done: list[tuple]) -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

        done: list[tuple] = []
        for row in fn(rows()):
            done.append(row)
            if len(done) >= rows_per_batch:
                yield packed(done)
                done = []
        if done:
            yield packed(done)

    return in_arrow(df, run, fields)
