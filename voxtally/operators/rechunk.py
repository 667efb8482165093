"""Images cut anew: slabs into grid cells and cells into slabs, whatever the size of the image.

An image is a set of boxes. Each task cuts its boxes into the pieces that lie
in one target box each; only pieces are shuffled, by target box, and are put in
their places one after the other. So a task holds one box and one target box
at a time, and no row ever holds an image.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxtally.operators.chunks import element_of
from voxtally.schemas import chunk_schema
from voxtally.sources.nifti import CELL_BYTES, in_batches, parse_header, resized

_META = "struct<image:string,start:array<int>,dtype:string,affine:array<double>,header:binary>"


def _piece_schema(element: str) -> T.StructType:
    return T.StructType.fromDDL(
        f"key string, cell array<int>, at array<int>, shape array<int>, extent array<int>, width array<int>, meta {_META}, voxels array<{element}>"
    )


def _ints(values: object) -> tuple[int, ...]:
    return tuple(int(v) for v in values)


def pieces_of(
    block: np.ndarray, origin: Sequence[int], extent: Sequence[int], width: Sequence[int]
) -> Iterator[tuple[tuple[int, ...], tuple[int, ...], np.ndarray]]:
    """``(target box, place in it, voxels)`` of a box; what lies beyond the extent is left out."""
    low = _ints(origin)
    high = [min(o + s, e) for o, s, e in zip(low, block.shape, extent)]
    if any(h <= o for o, h in zip(low, high)):
        return
    for cell in product(*[range(o // w, (h - 1) // w + 1) for o, h, w in zip(low, high, width)]):
        first = [max(o, c * w) for o, c, w in zip(low, cell, width)]
        last = [min(h, (c + 1) * w) for h, c, w in zip(high, cell, width)]
        part = block[tuple(slice(f - o, n - o) for f, n, o in zip(first, last, low))]
        yield cell, tuple(f - c * w for f, c, w in zip(first, cell, width)), part


class _Target:
    """One target box and what of it is there."""

    def __init__(self, row: dict, pad: bool):
        self.row = row
        cell, width, extent = row["cell"], row["width"], row["extent"]
        inside = [max(0, min(w, e - c * w)) for c, w, e in zip(cell, width, extent)]
        self.wanted = int(np.prod(inside, dtype=np.int64))
        self.shape = list(width) if pad else inside
        self.voxels = np.zeros(self.shape, row["voxels"].dtype, order="F")
        self.there = np.zeros(self.shape, dtype=bool, order="F")

    def place(self, row: dict) -> None:
        box = tuple(slice(a, a + n) for a, n in zip(row["at"], row["shape"]))
        if self.there[box].any():
            raise ValueError(f"{row['key']}: two parts cover the same voxels of box {row['cell']}")
        self.there[box] = True
        self.voxels[box] = row["voxels"].reshape(row["shape"], order="F")

    def done(self) -> dict:
        there = int(self.there.sum())
        if there != self.wanted:
            raise ValueError(f"{self.row['key']}: box {self.row['cell']} got {there} of {self.wanted} voxels")
        return {**self.row, "path": self.row["key"], "shape": self.shape, "voxels": self.voxels.reshape(-1, order="F")}


def recut(boxes: DataFrame, pad: bool) -> DataFrame:
    """Boxes of each ``key``, cut along a grid of ``width``.

    ``boxes`` has ``key``, ``origin``, ``extent`` and ``width`` (arrays of as many
    numbers as the image has axes), ``shape``, ``meta`` and ``voxels``. Gives
    ``(key, cell, shape, extent, width, meta, voxels)``: with ``pad``, all boxes have
    the full width, with zeros beyond the extent; else those at the far end
    are smaller. A target box of which some voxels are missing, or are given
    twice, fails the job; one of which nothing is there gives no row.
    """
    element = element_of(boxes)
    schema = _piece_schema(element)
    arrow = to_arrow_schema(schema)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            plain = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "voxels"}
            for i, v in enumerate(batch.column("voxels")):
                yield {**{c: values[i] for c, values in plain.items()}, "voxels": v.values.to_numpy(zero_copy_only=False)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[dict]:
            for row in rows_of(batches):
                block = row["voxels"].reshape(row["shape"], order="F")
                for cell, at, part in pieces_of(block, row["origin"], row["extent"], row["width"]):
                    yield {**row, "path": row["key"], "cell": cell, "at": at, "shape": part.shape, "voxels": part.reshape(-1, order="F")}

        yield from in_batches(pieces(), arrow)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def targets() -> Iterator[dict]:
            now = None
            for row in rows_of(batches):
                if now is None or (row["key"], row["cell"]) != (now.row["key"], now.row["cell"]):
                    if now:
                        yield now.done()
                    now = _Target(row, pad)
                now.place(row)
            if now:
                yield now.done()

        yield from in_batches(targets(), arrow)

    columns = ["key", "origin", "extent", "width", "shape", "meta", "voxels"]
    cut_up = boxes.select(*columns).mapInArrow(cut, schema)
    dealt = cut_up.repartition("key", "cell").sortWithinPartitions("key", "cell", "at")
    return dealt.mapInArrow(place, schema).drop("at")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _dimensions(header: pa.Array) -> pa.Array:
    return pa.array([list(parse_header(h).shape) for h in header.to_pylist()], pa.list_(pa.int32()))


@F.arrow_udf(T.BinaryType())
def _with_shape(header: pa.Array, shape: pa.Array) -> pa.Array:
    return pa.array([resized(h, dims) for h, dims in zip(header.to_pylist(), shape.to_pylist())], pa.binary())


def _checked_width(element: str, width: Column) -> Column:
    """Target boxes have to fit a row."""
    size = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}[element]
    cells = F.aggregate(width, F.lit(1).cast("bigint"), lambda a, w: a * w)
    fits = (cells * size <= CELL_BYTES) & F.forall(width, lambda w: w > 0)
    return F.when(fits, width).otherwise(F.raise_error(F.lit("a part of these sides does not fit into a row")).cast("array<int>"))


def _meta(image: Column, start: Column) -> Column:
    return F.struct(image.alias("image"), start.alias("start"), F.col("dtype"), F.col("affine"), F.col("header"))


def _sides(names: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(n), F.lit(0)) for n in names])


def split_images(
    chunks: DataFrame, grid: Sequence[int] | None = None, *, width: Sequence[int] | None = None
) -> DataFrame:
    """Images, read in as many blocks as they have, into parts of equal sides.

    Name the number of parts along each axis (``grid``) or their sides
    (``width``). Parts at the far end are filled up with zeros. Each part is an
    image of its own: offsets, name, header and shape are those of the part,
    ``cell`` is its place in the grid. All blocks of an image have to be there.
    """
    if (grid is None) == (width is None):
        raise ValueError("name either the grid or the sides of its parts")
    given = [int(n) for n in (grid if width is None else width)]
    element = element_of(chunks)
    read = chunks.withColumn("extent", _dimensions("header"))
    if any(n < 1 for n in given):
        raise ValueError(f"{given}: numbers from 1 on are needed")
    axes = F.when(F.size("extent") == len(given), F.col("extent")).otherwise(
        F.raise_error(F.lit(f"an image does not have {len(given)} axes")).cast("array<int>"))
    fixed = F.array(*[F.lit(n) for n in given])
    sides = fixed if width else F.transform(
        F.arrays_zip(axes.alias("e"), fixed.alias("g")), lambda z: F.ceil(z["e"] / z["g"]).cast("int"))
    depth, layers = F.element_at("extent", -1), F.element_at("shape", -1)
    low = F.when(F.col("block") < F.col("n_blocks") - 1, F.col("block") * layers).otherwise(depth - layers)
    # the blocks of an image in three axes carry their own z0
    own = F.when((F.size("extent") == 3) & (F.col("n_blocks") > 1), low).otherwise(F.lit(0))
    start = F.array(F.coalesce("x0", F.lit(0)), F.coalesce("y0", F.lit(0)), F.coalesce(F.col("z0") - own, F.lit(0)))
    boxes = read.select(
        F.col("path").alias("key"), axes.alias("extent"), _checked_width(element, sides).alias("width"), "shape", "voxels",
        F.transform("shape", lambda _, i: F.when(i == F.size("shape") - 1, low).otherwise(F.lit(0)).cast("int")).alias("origin"),
        _meta(F.col("image"), start).alias("meta"),
    )
    parts = recut(boxes, pad=True)
    offsets = [
        (F.element_at("meta.start", i + 1) + F.coalesce(F.get("cell", i) * F.get("width", i), F.lit(0))).cast("int") for i in range(3)
    ]
    named = parts.select(
        F.concat(F.concat_ws("_", "meta.image", *[o.cast("string") for o in offsets]), F.lit(".nii")).alias("path"),
        F.col("meta.image").alias("image"), *[o.alias(n) for o, n in zip(offsets, ("x0", "y0", "z0"))], "shape",
        F.col("meta.dtype").alias("dtype"), F.col("meta.affine").alias("affine"), _with_shape("meta.header", "shape").alias("header"),
        F.lit(0).alias("block"), F.lit(1).alias("n_blocks"), "voxels", "cell",
    )
    return named


def join_images(parts: DataFrame, layers: int, extent: Sequence[int] | None = None) -> DataFrame:
    """Parts named by their offsets into whole images of three axes, in slabs of so many layers.

    The inverse of ``split_images``. ``extent`` names the sides of the images, so
    that what was filled up is cut off again; by default an image is as large as
    its parts reach. Parts may come in several blocks. Missing voxels, and
    voxels that two parts give, fail the job.
    """
    if layers < 1:
        raise ValueError("a slab has one layer at least")
    element = element_of(parts)
    origin = _sides(("x0", "y0", "z0"))
    ends = F.transform(F.arrays_zip(origin.alias("o"), F.col("shape").alias("s")), lambda z: z["o"] + z["s"])
    if extent is not None:
        sized = parts.withColumn("extent", F.array(*[F.lit(int(n)) for n in extent]))
    else:
        # one row for each image
        reach = parts.select("image", ends.alias("e")).groupBy("image").agg(
            F.array(*[F.max(F.get("e", i)) for i in range(3)]).alias("extent"))
        sized = parts.join(reach, "image")
    sides = F.array(F.get("extent", 0), F.get("extent", 1), F.lit(layers))
    boxes = sized.select(
        F.col("image").alias("key"), origin.alias("origin"), "extent", _checked_width(element, sides).alias("width"),
        "shape", "voxels", _meta(F.col("image"), F.array().cast("array<int>")).alias("meta"),
    )
    slabs = recut(boxes, pad=False)
    zero = F.lit(0)
    block = F.get("cell", 2)
    out = slabs.select(
        F.concat("key", F.lit(".nii")).alias("path"), F.col("key").alias("image"), zero.alias("x0"), zero.alias("y0"),
        (block * layers).cast("int").alias("z0"), "shape", F.col("meta.dtype").alias("dtype"), F.col("meta.affine").alias("affine"),
        _with_shape("meta.header", "extent").alias("header"), block.alias("block"),
        F.ceil(F.get("extent", 2) / layers).cast("int").alias("n_blocks"), "voxels",
    )
    return out.select(*chunk_schema(T.StringType()).names)
