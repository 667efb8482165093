"""Chunk operators: iterate, split, pad, and user functions per chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from voxtally.functions.arrays import add_steps, increment, pad_to_grid, to_lists
from voxtally.sources.nifti import MIB, parse_header, resized

_NUMPY_OF_ELEMENT = {
    "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64",
}


#: Voxels of a buffer that chunks are put together in.
SCATTER_VOXELS = 1 << 22


def element_of(chunks: DataFrame, voxels: str = "voxels") -> str:
    """Element type of the voxel column, as a DDL name."""
    return chunks.schema[voxels].dataType.elementType.simpleString()


def increment_chunks(
    chunks: DataFrame, steps: int = 1, *, voxels: str = "voxels", overflow: str = "raise"
) -> DataFrame:
    """All steps in one pass over the chunk; nothing in between is kept."""
    dtype = F.col("dtype") if "dtype" in chunks.columns else None
    return chunks.withColumn(
        voxels,
        increment(
            F.col(voxels), steps, element=element_of(chunks, voxels), dtype=dtype, overflow=overflow
        ),
    )


def all_steps(rows: DataFrame, steps: int, value: str, element: str) -> DataFrame:
    """Every intermediate version of an integer value, in one pass.

    Adds ``iteration`` 1..n; integers are the case where k times +1 is +k.
    """
    return rows.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn(
        value, F.col(value) + F.col("iteration").cast(element)
    )


def all_step_chunks(
    chunks: DataFrame, steps: int, *, voxels: str = "voxels", overflow: str = "raise", max_bytes: int = 4 * MIB
) -> DataFrame:
    """Every intermediate version of chunk arrays, with ``iteration`` 1..n.

    Each step is one addition to what the step before gave, so floats round as
    they do step by step. A chunk's versions leave Python in batches of about
    ``max_bytes``, so no task holds more than a few of them. Null chunks have
    null versions, null voxels stay null. Other columns are repeated.
    """
    if steps < 1:
        raise ValueError("at least one step is needed")
    element = element_of(chunks, voxels)
    names = chunks.columns
    schema = T.StructType([*chunks.schema.fields, T.StructField("iteration", T.IntegerType())])
    own = _NUMPY_OF_ELEMENT[element]

    def versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, iterations, parts = [], [], []
            size = 0

            def packed() -> pa.RecordBatch:
                repeated = batch.take(pa.array(at, pa.int64()))
                lists = pa.array(parts, batch.schema.field(voxels).type) if any(
                    p is None or isinstance(p, pa.Array) for p in parts
                ) else to_lists(np.array([len(p) for p in parts], dtype=np.int64), np.concatenate(parts)).cast(batch.schema.field(voxels).type)
                columns = [lists if n == voxels else repeated.column(n) for n in names]
                return pa.RecordBatch.from_arrays([*columns, pa.array(iterations, pa.int32())], names=[*names, "iteration"])

            types = batch.column("dtype").to_pylist() if "dtype" in names else [None] * batch.num_rows
            for i, (v, dtype) in enumerate(zip(batch.column(voxels), types)):
                values, mask = None, None
                if v.is_valid:
                    flat = v.values
                    mask = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
                    values = (flat if mask is None else flat.fill_null(0)).to_numpy(zero_copy_only=False)
                for iteration in range(1, steps + 1):
                    if values is not None:
                        values = add_steps(values, dtype or own, 1, overflow)
                        size += values.nbytes
                    at.append(i)
                    iterations.append(iteration)
                    parts.append(values if mask is None else pa.array(values, mask=mask))
                    if size >= max_bytes or len(at) >= 4096:
                        yield packed()
                        at, iterations, parts, size = [], [], [], 0
            if at:
                yield packed()

    return chunks.mapInArrow(versions, schema)


@F.arrow_udf(T.BinaryType())
def _resized_header(header: pa.Array, shape: pa.Array, dtype: pa.Array) -> pa.Array:
    """Headers with other dimensions (null: their own) and another voxel type (null: their own)."""
    return pa.array([
        None if h is None else resized(h, dims or parse_header(h).shape, name)
        for h, dims, name in zip(header.to_pylist(), shape.to_pylist(), dtype.to_pylist())
    ], pa.binary())


def _name_of(fn: Callable[..., Any]) -> str:
    # an event's name has no blanks
    return "_".join(getattr(fn, "__name__", type(fn).__name__).split())


def _stepped(block: np.ndarray, fn: Callable[..., Any], params: dict[str, Any], size: int) -> np.ndarray:
    block = np.asarray(fn(block, **params))
    if block.size != size:
        raise ValueError(f"a step made {block.size} voxels of {size}")
    return block


def _cast(block: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The values in another type, without loss."""
    kept = block.astype(kind, copy=False)
    if kept.dtype != block.dtype and not np.array_equal(kept, block, equal_nan=block.dtype.kind == "f"):
        raise ValueError(f"values of type {block.dtype} do not fit {kind}; name another type")
    return kept


@dataclass(frozen=True)
class Steps:
    """User functions applied to each chunk, one after the other.

    A function takes the whole chunk as an n-d array and its parameters by
    name, and returns an array of the same size. Only steps added by
    ``pointwise``, which look at each voxel alone, may run on the slabs of an
    image that is read in several blocks; any other refuses them. All steps
    run in one Arrow UDF, so a chunk goes to Python and back once.
    """

    steps: tuple[tuple[Callable[..., np.ndarray], dict[str, Any]], ...] = field(default=())
    whole: bool = False

    def step(self, fn: Callable[..., np.ndarray], **params: Any) -> Steps:
        return replace(self, steps=(*self.steps, (fn, params)), whole=True)

    def pointwise(self, fn: Callable[..., np.ndarray], **params: Any) -> Steps:
        return replace(self, steps=(*self.steps, (fn, params)))

    def timed(self, element: str | None = None) -> Callable[[dict, Callable[[str], None]], dict]:
        """A function of one image, as a dict of a chunk row, that says after each step which one is done."""
        # only the steps travel to the tasks
        kind, steps = np.dtype(_NUMPY_OF_ELEMENT[element]) if element else None, self.steps

        def work(row: dict, done: Callable[[str], None]) -> dict:
            block = row["voxels"].copy().reshape(row["shape"], order="F")
            size = block.size
            for fn, params in steps:
                block = _stepped(block, fn, params, size)
                done(_name_of(fn))
            header = row["header"] if kind is None else resized(row["header"], parse_header(row["header"]).shape, kind.name)
            return {**row, "header": header, "voxels": _cast(block, kind or row["voxels"].dtype).reshape(-1, order="F")}

        return work

    def column(self, voxels: Column, shape: Column, element: str, n_blocks: Column | None = None) -> Column:
        steps, whole = self.steps, self.whole

        @F.arrow_udf(f"array<{element}>")
        def run(voxels: pa.Array, shape: pa.Array, n_blocks: pa.Array) -> pa.Array:
            parts = []
            for v, dims, blocks in zip(voxels, shape, n_blocks.to_pylist()):
                if whole and blocks != 1:
                    raise ValueError(f"a step needs the whole image, and this one came in {blocks} blocks")
                # a copy: Arrow buffers are read-only, user code may write
                block = v.values.to_numpy(zero_copy_only=False).copy()
                block = block.reshape(dims.as_py(), order="F")
                size = block.size
                for fn, params in steps:
                    block = _stepped(block, fn, params, size)
                parts.append(_cast(block, kind).reshape(-1, order="F"))
            flat = np.concatenate(parts) if parts else np.array([], kind)
            return to_lists(np.array([len(p) for p in parts], dtype=np.int64), flat)

        kind = np.dtype(_NUMPY_OF_ELEMENT[element])
        return run(voxels, shape, F.lit(1) if n_blocks is None else n_blocks)

    def apply(self, chunks: DataFrame, voxels: str = "voxels", element: str | None = None) -> DataFrame:
        """``element`` names another type for the results (double, say); then
        ``dtype`` and ``header``, where the chunks have them, follow it."""
        target = element or element_of(chunks, voxels)
        blocks = F.col("n_blocks") if "n_blocks" in chunks.columns else None
        done = chunks.withColumn(voxels, self.column(F.col(voxels), F.col("shape"), target, blocks))
        if element and "dtype" in chunks.columns:
            done = done.withColumn("dtype", F.lit(_NUMPY_OF_ELEMENT[element]))
            if "header" in chunks.columns:
                # the header's dimensions are those of the image, not of one of its blocks
                done = done.withColumn("header", _resized_header(F.col("header"), F.lit(None).cast("array<int>"), F.col("dtype")))
        return done


def map_chunks(
    chunks: DataFrame, fn: Callable[[Any], Any], schema: str
) -> DataFrame:
    """A user function over batches of chunk rows (pandas in, pandas out)."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        for pdf in batches:
            yield fn(pdf)

    return chunks.mapInPandas(run, schema)


# -- voxel tables -----------------------------------------------------------


def grid_position(axes: dict[str, tuple[Column, int]]) -> list[Column]:
    """Grid coordinates ``c<axis>`` of a voxel: its position over chunk width."""
    return [F.floor(at / F.lit(width)).cast("int").alias(f"c{a}") for a, (at, width) in axes.items()]


def lower_half(voxels: DataFrame, position: Column, extent: int) -> DataFrame:
    """The half of an image below the middle of one axis."""
    return voxels.filter(position < extent / 2)


def chunk_totals(voxels: DataFrame, axes: dict[str, tuple[Column, int]], value: Column) -> DataFrame:
    """Voxel count and sum of each grid chunk, combined on the map side."""
    return (
        voxels.select(*grid_position(axes), value.alias("_v"))
        .groupBy(*[f"c{a}" for a in axes])
        .agg(F.count(F.lit(1)).alias("n_voxels"), F.sum("_v").alias("total"))
    )


def assemble_chunks(
    voxels: DataFrame, axes: dict[str, tuple[Column, int]], value: str, element: str
) -> DataFrame:
    """Voxel rows to chunk arrays; voxels that no row gives are 0.

    A chunk has at most as many entries as its volume, because rows of the
    same voxel are added up (on the map side) before any chunk is collected.
    """
    widths = [w for _, w in axes.values()]
    volume = int(np.prod(widths))
    linear, stride = F.lit(0), 1
    for at, width in axes.values():
        linear = linear + F.pmod(at, F.lit(width)).cast("int") * F.lit(stride)
        stride *= width
    cells = [f"c{a}" for a in axes]

    @F.arrow_udf(f"array<{element}>")
    def scatter(at: pa.Array, values: pa.Array) -> pa.Array:
        kind = values.type.value_type.to_pandas_dtype()
        parts = []
        # few chunks at a time, by their volume
        step = max(1, SCATTER_VOXELS // max(1, volume))
        for first in range(0, len(at), step):
            some_at, some = at.slice(first, step), values.slice(first, step)
            rows = len(some_at)
            out = np.zeros((rows, volume), kind)
            counts = np.asarray(some_at.value_lengths())
            out[np.repeat(np.arange(rows), counts), some_at.flatten().to_numpy(zero_copy_only=False)] = (
                some.flatten().to_numpy(zero_copy_only=False)
            )
            parts.append(to_lists(np.full(rows, volume), out.reshape(-1)))
        return pa.concat_arrays(parts) if parts else to_lists(np.zeros(0, dtype=np.int64), np.zeros(0, kind))

    unique = (
        voxels.select(*grid_position(axes), linear.alias("_at"), F.col(value).alias("_v"))
        .groupBy(*cells, "_at")
        .agg(F.sum("_v").cast(element).alias("_v"))
    )
    filled = unique.groupBy(*cells).agg(F.collect_list(F.struct("_at", "_v")).alias("_cells"))
    return filled.select(
        *cells,
        F.array(*[F.lit(w) for w in widths]).alias("shape"),
        scatter(F.col("_cells._at"), F.col("_cells._v")).alias("voxels"),
    )


def split_chunks(chunks: DataFrame, grid: tuple[int, ...], voxels: str = "voxels") -> DataFrame:
    """Each chunk array into a regular grid of smaller ones.

    Adds the grid position ``cell`` and replaces shape and voxels. The grid
    has to divide the shape; pad first where it does not. Of image chunks, each
    part becomes an image of its own: offsets, name, header and block number
    are those of the part, so that it can be saved. Images in several blocks
    are refused here; ``rechunk.split_images`` takes them.
    """
    element = element_of(chunks, voxels)
    if "n_blocks" in chunks.columns:
        whole = F.when(F.col("n_blocks") == 1, F.col(voxels))
        chunks = chunks.withColumn(
            voxels, whole.otherwise(F.raise_error(F.lit("only images in one block can be split")).cast(f"array<{element}>"))
        )

    @F.arrow_udf(f"array<struct<cell:array<int>,shape:array<int>,voxels:array<{element}>>>")
    def cut(voxels: pa.Array, shape: pa.Array) -> pa.Array:
        cells, shapes, lengths, parts = [], [], [], []
        for v, dims in zip(voxels, shape):
            dims = dims.as_py()
            if any(d % g for d, g in zip(dims, grid)):
                raise ValueError(f"a grid of {grid} does not divide the shape {dims}")
            width = [d // g for d, g in zip(dims, grid)]
            block = v.values.to_numpy(zero_copy_only=False).reshape(dims, order="F")
            for cell in np.ndindex(*grid):
                part = block[tuple(slice(c * w, (c + 1) * w) for c, w in zip(cell, width))]
                cells.append(list(cell))
                shapes.append(width)
                lengths.append(part.size)
                parts.append(part.reshape(-1, order="F"))
        per_row = int(np.prod(grid))
        flat = np.concatenate(parts) if parts else np.array([])
        inner = pa.StructArray.from_arrays(
            [
                pa.array(cells, pa.list_(pa.int32())),
                pa.array(shapes, pa.list_(pa.int32())),
                to_lists(np.array(lengths, dtype=np.int64), flat),
            ],
            names=["cell", "shape", "voxels"],
        )
        offsets = np.arange(len(voxels) + 1, dtype=np.int32) * per_row
        return pa.ListArray.from_arrays(pa.array(offsets), inner)

    rest = [c for c in chunks.columns if c not in (voxels, "shape")]
    parts = chunks.select(*rest, F.explode(cut(F.col(voxels), F.col("shape"))).alias("_part"))
    parts = parts.select(*rest, "_part.cell", "_part.shape", F.col("_part.voxels").alias(voxels))
    return _as_images(parts) if {"path", "image", "x0", "y0", "z0", "header", "block", "n_blocks"} <= set(rest) else parts


def _as_images(parts: DataFrame) -> DataFrame:
    """Parts of images under their own offsets and names."""
    offsets = {
        f"{a}0": (F.coalesce(f"{a}0", F.lit(0)) + F.coalesce(F.get("cell", i) * F.get("shape", i), F.lit(0))).cast("int")
        for i, a in enumerate("xyz")
    }
    named = parts.withColumns(offsets)
    name = F.concat_ws("_", "image", *[F.col(a).cast("string") for a in offsets])
    return named.withColumns({
        "path": F.concat(name, F.lit(".nii")),
        "header": _resized_header(F.col("header"), F.col("shape"), F.lit(None).cast("string")),
        "block": F.lit(0),
        "n_blocks": F.lit(1),
    })


def _padded_block(element: str, grid: tuple[int, ...]) -> Callable[..., Column]:
    kind = f"struct<shape:array<int>,sides:array<int>,voxels:array<{element}>>"

    @F.arrow_udf(kind)
    def pad(voxels: pa.Array, shape: pa.Array, header: pa.Array, block: pa.Array, n_blocks: pa.Array) -> pa.Array:
        shapes, sides, parts = [], [], []
        for v, dims, head, at, n in zip(voxels, shape.to_pylist(), header.to_pylist(), block.to_pylist(), n_blocks.to_pylist()):
            whole = parse_header(head).shape
            if len(whole) != len(grid):
                raise ValueError(f"an image of {len(whole)} axes and a grid of {len(grid)}")
            more = [-d % g for d, g in zip(whole, grid)]
            sides.append([d + m for d, m in zip(whole, more)])
            # layers are added behind the last block only
            own = [*more[:-1], more[-1] if at == n - 1 else 0]
            part = np.pad(v.values.to_numpy(zero_copy_only=False).reshape(dims, order="F"), [(0, m) for m in own])
            shapes.append(list(part.shape))
            parts.append(part.reshape(-1, order="F"))
        flat = np.concatenate(parts) if parts else np.array([], _NUMPY_OF_ELEMENT[element])
        ints = pa.list_(pa.int32())
        return pa.StructArray.from_arrays(
            [pa.array(shapes, ints), pa.array(sides, ints), to_lists(np.array([len(p) for p in parts], dtype=np.int64), flat)],
            names=["shape", "sides", "voxels"],
        )

    return pad


def pad_chunks(chunks: DataFrame, grid: tuple[int, ...], voxels: str = "voxels") -> DataFrame:
    """Zeros at the far end of each axis, so that the grid divides it; shape and header follow.

    Images in several blocks are padded block by block, without meeting: each
    block along its own axes, and the last one also behind its last layer.
    """
    if {"header", "block", "n_blocks"} <= set(chunks.columns):
        pad = _padded_block(element_of(chunks, voxels), grid)
        done = chunks.withColumn("_pad", pad(F.col(voxels), F.col("shape"), F.col("header"), F.col("block"), F.col("n_blocks")))
        header = _resized_header(F.col("header"), F.col("_pad.sides"), F.lit(None).cast("string"))
        return done.withColumns({voxels: F.col("_pad.voxels"), "shape": F.col("_pad.shape"), "header": header}).drop("_pad")
    padded = pad_to_grid(F.col(voxels), F.col("shape"), grid, element_of(chunks, voxels))
    sides = [(F.ceil(F.get("shape", i) / g) * g).cast("int") for i, g in enumerate(grid)]
    return chunks.withColumns({voxels: padded, "shape": F.array(*sides)})
