"""Path and chunk-name expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Base name ``<image>_<x>_<y>_<z>.nii``, with ``inc-`` / ``inc<n>-`` or not.
CHUNK_NAME = r"^(?:inc\d*-)*(.+)_\d+_\d+_\d+\.nii$"
#: The same seen from its end, which is all that the offsets need.
CHUNK_TAIL = r"[^/]_\d+_\d+_\d+\.nii$"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; '/' for a file in the root."""
    head = F.regexp_replace(path, r"/[^/]*$", "")
    return (
        F.when(~F.contains(path, F.lit("/")), F.lit(""))
        .when(head == "", F.lit("/"))
        .otherwise(head)
    )


def join_path(directory: Column, name: Column) -> Column:
    """Join as a file system would: an absolute ``name`` stands alone."""
    return (
        F.when(F.startswith(name, F.lit("/")) | (directory == ""), name)
        .when(F.endswith(directory, F.lit("/")), F.concat(directory, name))
        .otherwise(F.concat_ws("/", directory, name))
    )


def strip_scheme(path: Column) -> Column:
    """Drop the first five characters of a name that holds ``file:``."""
    return F.when(F.contains(path, F.lit("file:")), F.substring(path, 6, 2**31 - 1)).otherwise(path)


def strip_suffix(name: Column, suffix: str) -> Column:
    return F.when(
        F.endswith(name, F.lit(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix))
    ).otherwise(name)


def intermediate_name(path: Column, rule: str = "prefix") -> Column:
    """Name of an intermediate image.

    ``rule="prefix"`` adds ``inc-`` unless the name starts with it.
    ``rule="anywhere"`` is the looser literal rule: a name that holds ``inc``
    anywhere (``province.nii``) is left alone.
    """
    name = basename(path)
    if rule == "prefix":
        marked = F.startswith(name, F.lit("inc-"))
    elif rule == "anywhere":
        marked = F.contains(name, F.lit("inc"))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return F.when(marked, name).otherwise(F.concat(F.lit("inc-"), name))


def final_name(path: Column, iterations: int | Column) -> Column:
    """``inc<n>-<name>`` with every ``inc-`` removed from the name first."""
    n = iterations if isinstance(iterations, Column) else F.lit(iterations)
    bare = F.replace(basename(path), F.lit("inc-"), F.lit(""))
    return F.concat(F.lit("inc"), n.cast("string"), F.lit("-"), bare)


def chunk_image(path: Column) -> Column:
    """Image part of a chunk name, null when the name is not a chunk's."""
    return F.nullif(F.regexp_extract(basename(path), CHUNK_NAME, 1), F.lit(""))


def chunk_offsets(path: Column) -> list[Column]:
    """``x0, y0, z0`` of a chunk, null when the name is not a chunk's."""
    ok = F.rlike(path, F.lit(CHUNK_TAIL))
    stem = F.rtrim(path, F.lit(".ni"))

    def from_end(n: int) -> Column:
        return F.substring_index(F.substring_index(stem, "_", -n), "_", 1)

    return [
        F.when(ok, from_end(3 - i)).try_cast("int").alias(f"{axis}0") for i, axis in enumerate("xyz")
    ]
