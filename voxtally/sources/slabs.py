"""One image file written by several tasks, each its own slabs.

Voxels are not shuffled. Where files can be written at any place (a file
system that machines mount), each task writes its slabs where they belong in
one hidden file; a task that runs again writes the same bytes once more. Else
each task writes its neighbouring slabs to parts of its own, and a last step puts the
parts in order, piece by piece. The file gets its name in one move, once all
of its blocks and voxels are accounted for.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window, functions as F

from voxtally.functions.naming import join_path
from voxtally.session import materialize, qualified
from voxtally.sources.nifti import MIB, filesystem, parse_header, stored_voxels

_WRITTEN = "name string, path string, first int, last int, n_blocks int, voxels bigint, wanted bigint, part string"
_PIECE = 8 * MIB


def first_layer(block: int, n_blocks: int, layers: int, depth: int) -> int:
    """Where a block begins; all but the last have as many layers."""
    return block * layers if block < n_blocks - 1 else depth - layers


class SlabWriter:
    """Writes blocks, in any order, at their places in files of one folder."""

    def __init__(self, folder: str, job: str, seek: bool | None = None):
        self.fs, self.folder = filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.seek = isinstance(self.fs, pafs.LocalFileSystem) if seek is None else seek
        self.job = job
        self.run: dict | None = None  # the blocks that follow each other in the open part
        self.stream = None

    def _place(self, target: str, at: int, *pieces: bytes | np.ndarray) -> None:
        handle = os.open(target, os.O_CREAT | os.O_WRONLY, 0o644)
        try:
            for piece in pieces:
                view = memoryview(piece).cast("B")
                while len(view):
                    written = os.pwrite(handle, view[: 64 * MIB], at)
                    at, view = at + written, view[written:]
        finally:
            os.close(handle)

    def add(self, path: str, header: bytes, shape: list[int], block: int, n_blocks: int, voxels: np.ndarray) -> Iterator[tuple]:
        """Write one block; gives what is written for good, as rows of ``_WRITTEN``."""
        name = posixpath.basename(path)
        head = parse_header(header)
        values = stored_voxels(path, head, voxels)
        wanted = int(np.prod(head.shape, dtype=np.int64))
        if self.seek:
            plane = int(np.prod(head.shape[:-1], dtype=np.int64)) * head.file_dtype.itemsize
            low = first_layer(block, n_blocks, shape[-1], head.shape[-1])
            target = f"{self.folder}/._{name}-{self.job}"
            if block == 0:
                self._place(target, 0, header, values)
            else:
                self._place(target, len(header) + low * plane, values)
            yield name, path, block, block, n_blocks, values.size, wanted, target
            return
        run = self.run
        if run is None or run["path"] != path or run["last"] + 1 != block:
            yield from self.finish()
            part = f"{self.folder}/._{name}-{self.job}-{block}-{uuid.uuid4().hex}"
            run = self.run = {"name": name, "path": path, "first": block, "last": block, "n_blocks": n_blocks, "voxels": 0, "wanted": wanted, "part": part}
            self.stream = self.fs.open_output_stream(part)
            if block == 0:
                self.stream.write(header)
        self.stream.write(values.tobytes())
        run["last"], run["voxels"] = block, run["voxels"] + values.size

    def finish(self) -> Iterator[tuple]:
        if self.stream is not None:
            self.stream.close()
            self.stream = None
            yield tuple(self.run[c] for c in ("name", "path", "first", "last", "n_blocks", "voxels", "wanted", "part"))
            self.run = None


def write_slabs(chunks: DataFrame, folder: str, *, seek: bool | None = None) -> DataFrame:
    """Save images from their blocks, wherever they are; returns ``(out_path, status)``.

    A second image of the same name, missing or doubled blocks, and voxels
    that the header does not promise fail the job, before any file gets its
    name. Blocks must be slabs of equal depth, the last one excepted, as
    reading gives them. ``seek`` says whether files can be written at any
    place; by default, local and mounted ones can.
    """
    spark = chunks.sparkSession
    target, job = qualified(spark, folder), uuid.uuid4().hex
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64() if k == "bigint" else pa.int32())
                        for n, k in (f.split() for f in _WRITTEN.split(","))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = SlabWriter(target, job, seek)

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            cells = [batch.column(c).to_pylist() for c in ("path", "header", "shape", "block", "n_blocks")]
            rows: list[tuple] = []
            for *cell, voxels in zip(*cells, batch.column("voxels")):
                rows += out.add(*cell, voxels.values.to_numpy(zero_copy_only=False))
            yield packed(rows)
        yield packed(list(out.finish()))

    rows = chunks.select("path", "header", "shape", "block", "n_blocks", "voxels")
    written = materialize(rows.mapInArrow(write, _WRITTEN), "slabs")
    # numbers only: a row for each block, or for each run of them
    before = F.lag("last", 1, -1).over(Window.partitionBy("name").orderBy("first", "last"))
    images = written.withColumn("gap", F.col("first") - before - 1).groupBy("name").agg(
        F.count_distinct("path").alias("paths"), F.min("gap").alias("least_gap"), F.max("gap").alias("most_gap"),
        F.max("last").alias("last"), F.max("n_blocks").alias("n_blocks"), F.min("n_blocks").alias("least"),
        F.sum("voxels").alias("voxels"), F.max("wanted").alias("wanted"), F.count(F.lit(1)).alias("n"),
    )
    name = F.col("name")
    images = materialize(images.withColumn("wrong", F.coalesce(
        F.when(F.col("paths") > 1, F.concat(F.lit("two images are named "), name)),
        F.when(F.col("least_gap") < 0, F.concat(name, F.lit(": a block came twice"))),
        F.when((F.col("most_gap") > 0) | (F.col("last") + 1 != F.col("n_blocks")) | (F.col("least") != F.col("n_blocks")),
               F.concat(name, F.lit(": not all of "), F.col("n_blocks").cast("string"), F.lit(" blocks came"))),
        F.when(F.col("voxels") != F.col("wanted"),
               F.concat(name, F.lit(": "), F.col("voxels").cast("string"), F.lit(" voxels, and a header for "), F.col("wanted").cast("string"))),
    )), "slab-images")
    bad = images.where("wrong is not null").select("wrong").first()
    if bad:
        raise ValueError(bad["wrong"])
    return _named(written, images, target, folder, seek)


def _named(written: DataFrame, images: DataFrame, target: str, folder: str, seek: bool | None) -> DataFrame:
    """Give the files their names: a move each, after putting parts together where there are several.

    A step that runs again finds what it did the first time.
    """

    def name_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = filesystem(target)
        now, held = None, []

        def settle() -> Iterator[str]:
            if now is None:
                return
            final = f"{inner}/{now}"
            if len(held) == 1:
                source = held[0]
            else:
                source = f"{inner}/._{now}-{uuid.uuid4().hex}"
                with fs.open_output_stream(source) as sink:
                    for part in held:
                        with fs.open_input_stream(part) as piece:
                            while data := piece.read(_PIECE):
                                sink.write(data)
            # gone already, if this step was stopped after the move
            if len(held) > 1 or fs.get_file_info(source).is_file:
                fs.move(source, final)
            elif not fs.get_file_info(final).is_file:
                raise FileNotFoundError(source)
            yield now

        def names() -> Iterator[str]:
            nonlocal now, held
            for batch in batches:
                for name, part in zip(batch.column("name").to_pylist(), batch.column("part").to_pylist()):
                    if name != now:
                        yield from settle()
                        now, held = name, []
                    if not held or held[-1] != part:
                        held.append(part)
            yield from settle()

        done = list(names())
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["name"])

    # rows of names and numbers only
    dealt = written.select("name", "first", "part").repartition("name").sortWithinPartitions("name", "first")
    named = materialize(dealt.mapInArrow(name_files, "name string"), "named")
    if not _seeks(target, seek):
        _drop_parts(written, images)
    out = join_path(F.lit(folder.rstrip("/")), F.col("name"))
    return named.select(out.alias("out_path"), F.lit("SUCCESS").alias("status"))


def _seeks(target: str, seek: bool | None) -> bool:
    return isinstance(filesystem(target)[0], pafs.LocalFileSystem) if seek is None else seek


def _drop_parts(written: DataFrame, images: DataFrame) -> None:
    """Delete the parts that were put together; their rows are the only list of them."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("part").to_pylist():
                fs, inner = filesystem(part)
                if fs.get_file_info(inner).is_file:
                    fs.delete_file(inner)
            yield batch.slice(0, 0)

    several = written.join(images.where("n > 1").select("name"), "name", "left_semi").select("part")
    several.mapInArrow(drop, "part string").count()
