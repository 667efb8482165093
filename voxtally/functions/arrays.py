"""Voxel-array expressions.

Voxels are a flat array column in file order (x fastest). Steps and reshaping
go through Arrow UDFs: array lambdas are interpreted per element, while one
Arrow batch is a single numpy operation and carries only the array columns to
Python.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

#: Spark element type of each voxel type of a file. Spark has no unsigned
#: integers, so those are held in the next wider type.
ELEMENT_OF_DTYPE = {
    "int8": T.ByteType(),
    "uint8": T.ShortType(),
    "int16": T.ShortType(),
    "uint16": T.IntegerType(),
    "int32": T.IntegerType(),
    "uint32": T.LongType(),
    "int64": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
}
_OWN_DTYPE = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64"}


def like_lists(column: pa.ListArray, values: np.ndarray | pa.Array) -> pa.ListArray:
    """Lists of ``values`` with the lengths and nulls of ``column``."""
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    return to_lists(lengths, values, column.is_null() if column.null_count else None)


def to_lists(lengths: np.ndarray, values: np.ndarray | pa.Array, mask: pa.Array | None = None) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask)


def add_steps(values: np.ndarray, dtype: str, steps: int, overflow: str = "raise") -> np.ndarray:
    """``values`` plus one, ``steps`` times, within the range of ``dtype``.

    ``dtype`` is the voxel type; the array may be of a wider one. Integers
    past their range raise, or start over at the low end.
    """
    if values.dtype.kind == "f":
        out = values.copy()
        one = out.dtype.type(1)
        for _ in range(steps):
            out += one
        return out
    own = np.iinfo(dtype)
    if overflow == "wrap":
        # adding n times 1 is adding n, and whole turns of the type change nothing
        n = np.array(steps % (int(own.max) - int(own.min) + 1), dtype=np.uint64).astype(dtype)
        return (values.astype(dtype) + n).astype(values.dtype)
    if values.size and int(values.max()) > int(own.max) - steps:
        raise OverflowError("voxel overflow")
    if steps <= np.iinfo(values.dtype).max:
        return values + values.dtype.type(steps)
    return (values.astype(np.int64) + steps).astype(values.dtype)


def _add(element: str, steps: int, overflow: str) -> Callable[[Column, Column], Column]:
    @F.arrow_udf(f"array<{element}>")
    def add(voxels: pa.Array, dtype: pa.Array) -> pa.Array:
        flat = voxels.flatten()
        missing = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
        values = (flat.fill_null(0) if flat.null_count else flat).to_numpy(zero_copy_only=False)
        names = dtype.to_pylist()
        if len(set(names)) <= 1:
            done = add_steps(values, names[0] if names else "int8", steps, overflow)
        else:
            lengths = np.asarray(voxels.value_lengths().fill_null(0), dtype=np.int64)
            ends = np.cumsum(lengths)
            done = np.concatenate([
                add_steps(values[e - n : e], name, steps, overflow) for n, e, name in zip(lengths, ends, names)
            ])
        return like_lists(voxels, done if missing is None else pa.array(done, mask=missing))

    return add


def increment(
    voxels: Column,
    steps: int = 1,
    *,
    element: str,
    dtype: Column | None = None,
    overflow: str = "raise",
) -> Column:
    """Every voxel plus one, ``steps`` times; the element type stays.

    For floats the additions happen one by one, because n steps of +1 and one
    step of +n round differently. ``dtype`` names the voxel type per row where
    the column is wider than the voxels (uint16 held as int). Integers past
    their range raise, or start over at the low end with ``overflow="wrap"``.
    """
    if steps < 1:
        raise ValueError("at least one step is needed")
    if overflow not in ("raise", "wrap"):
        raise ValueError(f"unknown overflow rule {overflow!r}")
    if element not in _OWN_DTYPE and element not in ("float", "double"):
        raise ValueError(f"cannot increment array<{element}>")
    if steps == 1 and element in ("float", "double"):
        return F.transform(voxels, lambda v: v + F.lit(1).cast(element))
    own = F.lit(_OWN_DTYPE.get(element, element))
    name = own if dtype is None else F.coalesce(dtype, own)
    return _add(element, steps, overflow)(voxels, name)


def pad_to_multiple(voxels: Column, width: int, element: str) -> Column:
    """Zeros at the end of a flat array, up to a multiple of ``width``."""
    short = F.pmod(F.lit(width) - F.pmod(F.size(voxels), F.lit(width)), F.lit(width))
    return F.concat(voxels, F.array_repeat(F.lit(0).cast(element), short))


def pad_to_grid(voxels: Column, shape: Column, grid: tuple[int, ...], element: str) -> Column:
    """Zeros at the far end of each axis, so that the grid divides it."""

    @F.arrow_udf(f"array<{element}>")
    def pad(voxels: pa.Array, shape: pa.Array) -> pa.Array:
        lengths, parts = [], []
        for v, dims in zip(voxels, shape):
            dims = dims.as_py()
            block = v.values.to_numpy(zero_copy_only=False).reshape(dims, order="F")
            block = np.pad(block, [(0, -d % g) for d, g in zip(dims, grid)])
            lengths.append(block.size)
            parts.append(block.reshape(-1, order="F"))
        return to_lists(np.array(lengths), np.concatenate(parts) if parts else np.array([]))

    return pad(voxels, shape)
