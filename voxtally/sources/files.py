"""File scans: binary content, listings, and input that names its files."""

from __future__ import annotations

import fnmatch
import hashlib
import os
import posixpath
import re
import socket
import threading
import time
import uuid
from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from voxtally.functions import fixed
from voxtally.functions.arrays import ELEMENT_OF_DTYPE
from voxtally.functions.naming import basename, join_path
from voxtally.operators.assign import assign_by_size
from voxtally.operators.ordering import with_dense_index
from voxtally.schemas import COPIED, chunk_schema
from voxtally.session import materialize, qualified
from voxtally.sources.nifti import (
    HEADER_BYTES, MIB, OPEN_COST, ImageAssembler, filesystem, in_batches, parse_header, read_blocks,
)

#: Tasks a core that opening small files may make.
TASKS_PER_CORE = 4

#: Files in a folder that only one task fills.
FILES_PER_FOLDER = 1000


def scan_binary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every file under ``path`` as ``(path, modificationTime, length, content)``.

    Spark's own splits decide how many tasks read, by size and opening cost
    (``spark.sql.files.maxPartitionBytes`` and ``openCostInBytes``, and at
    least as many as there are cores). Contents are never shuffled.
    """
    return spark.read.format("binaryFile").load(path)


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Paths and sizes only: the scan never opens the files."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def index_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Number the files from 0 in path order."""
    return with_dense_index(files, [path], "idx")


def split_path_list(paths: Column) -> Column:
    """Rows of a comma-separated list (a generator: one per select)."""
    return F.explode(F.split(paths, ","))


def legend_tokens(text: Column) -> Column:
    """Whitespace-separated names of a legend as ``(pos, token)`` rows."""
    # one kind of blank first: cutting at a single character needs no pattern
    blanks = F.translate(text, fixed.WHITESPACE, " " * len(fixed.WHITESPACE))
    return F.posexplode(F.array_remove(F.split(blanks, " "), ""))


def read_legend(spark: SparkSession, path: str) -> DataFrame:
    """Chunk names of a legend file as ``(pos, chunk)``, numbered over all lines.

    Lines stand in the order of the file's blocks and of the rows in each.
    """
    at = F.col("_metadata.file_block_start").alias("_block")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), at)
    lines = lines.withColumn("_row", F.monotonically_increasing_id())
    names = lines.select("_file", "_block", "_row", legend_tokens(F.col("value")).alias("_at", "chunk"))
    return with_dense_index(names, ["_file", "_block", "_row", "_at"], "pos").select("pos", "chunk")


def image_files(spark: SparkSession, spec: str) -> DataFrame:
    """``(path, length)`` of a folder, one file, or a comma-separated list, listed once and kept as a table.

    A folder, and a pattern of names in one (``*`` and ``?``), is listed by a task,
    entry by entry, as a folder of chunks has more of them than the driver
    can hold; single files and other patterns are listed by Spark. Either way,
    empty and hidden files are left out.
    """
    parts = [qualified(spark, p.strip().removesuffix("/*")) for p in spec.split(",")]
    folders, rest = [], []
    for part in parts:
        folder = _folder_of(spark, part)
        rest.append(part) if folder is None else folders.append(folder)
    listed = list_files(spark, rest).coalesce(spark.sparkContext.defaultParallelism) if rest else None
    for folder in folders:
        found = materialize(_folder_files(spark, *folder), "folder")
        if folder[1] and found.isEmpty():
            # Spark's words for a pattern that nothing matches
            found = list_files(spark, f"{folder[0]}/{folder[1]}")
        listed = found if listed is None else listed.unionByName(found)
    return materialize(listed, "listing") if rest else listed


def _folder_of(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """The folder, as Spark names it, and the pattern of names in it (none: empty); None for all else."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parent, _, name = path.rstrip("/").rpartition("/")
    special = re.compile(r"[][*?{}^\\]")
    pattern = name if special.search(name) else ""
    folder = parent if pattern else path
    if special.search(folder) or re.search(r"[][{}^\\]", pattern):
        return None
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(conf)
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return None
    return fs.makeQualified(at).toString().rstrip("/"), pattern


def _entries(folder: str) -> Iterator[tuple[str, bool, int]]:
    """``(name, is a folder, length)`` of what a folder holds; a local one is read as it is listed."""
    fs, inner = filesystem(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(inner) as found:
            for entry in found:
                yield entry.name, entry.is_dir(), 0 if entry.is_dir() else entry.stat().st_size
    else:
        for info in fs.get_file_info(pafs.FileSelector(inner)):
            yield info.base_name, info.type == pafs.FileType.Directory, info.size or 0


def _hidden(name: str) -> bool:
    """As Spark has it."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _folder_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``(path, length)`` of the files in a folder, and in folders named ``key=value`` there."""

    def below(at: str, wanted: str) -> Iterator[tuple[str, int]]:
        for name, is_folder, length in _entries(at):
            if _hidden(name) or (wanted and not fnmatch.fnmatchcase(name, wanted)):
                continue
            if is_folder:
                if wanted or "=" in name:
                    yield from below(f"{at}/{name}", "")
            elif length > 0:
                yield f"{at}/{name}", length

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column("folder").to_pylist():
                found = below(at, pattern)
                while some := list(islice(found, 10_000)):
                    paths, lengths = zip(*some)
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], names=["path", "length"])

    one = spark.range(1, numPartitions=1).select(F.lit(folder).alias("folder"))
    return one.mapInArrow(listing, "path string, length bigint")


def image_type(files: DataFrame) -> str:
    """Voxel type of the first file by name."""

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                fs, inner = filesystem(path)
                with fs.open_input_file(inner) as file:
                    h = parse_header(file.read_at(HEADER_BYTES, 0))
                found.append("float64" if h.scaled else h.dtype)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["dtype"])

    first = files.select("path").orderBy("path").limit(1).mapInArrow(head, "dtype string").first()
    if first is None:
        raise FileNotFoundError("there is no image to read")
    return first["dtype"]


def dealt_by_size(files: DataFrame, tasks: int, order: Sequence[str] = ("path",), size: str = "length") -> DataFrame:
    """Rows of listed files in at most so many partitions, in order, with about as many bytes each.

    Opening a file counts as ``OPEN_COST`` bytes more. No partition has more than
    the mean by more than one file.
    """
    if tasks <= 1:
        return files.coalesce(1).sortWithinPartitions(*order)
    cost = F.coalesce(F.col(size), F.lit(0)) + OPEN_COST
    cut = assign_by_size(files, list(order), cost, tasks, "_task")
    return cut.repartitionById(tasks, F.col("_task")).sortWithinPartitions(*order).drop("_task")


def read_files(
    files: DataFrame, dtype: str | None = None, *, max_block_bytes: int | None = 64 * MIB,
    max_partition_bytes: int = 128 * MIB, min_partitions: int | None = None, split_files: bool = False,
) -> DataFrame:
    """Chunk rows of listed images ``(path, length)``.

    Only names are dealt out, in order of their paths and by their bytes, to as
    many tasks as the bytes need and at least ``min_partitions`` (by default, the number of
    cores). Opening small files counts as bytes too, but makes no more than
    ``TASKS_PER_CORE`` tasks a core: blocks pass through a task one after the
    other, however many there are. A file's blocks stay in one task, in order, unless ``split_files``
    lets several tasks share a file larger than ``max_partition_bytes``.
    ``max_block_bytes=None`` makes each image one row, whatever its size.
    """
    spark = files.sparkSession
    schema = chunk_schema(ELEMENT_OF_DTYPE[dtype or image_type(files)])
    arrow_schema = to_arrow_schema(schema)
    opening = min(OPEN_COST, max_partition_bytes)
    sums = files.agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    cores, whole = spark.sparkContext.defaultParallelism, sums["bytes"] or 0
    least = min(min_partitions or cores, sums["n"])
    opened = min(TASKS_PER_CORE * cores, -(-(whole + opening * sums["n"]) // max_partition_bytes))
    tasks = max(1, least, opened, -(-whole // max_partition_bytes))
    cut = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.col("length") - 1), F.lit(max_partition_bytes).cast("bigint"))
    starts = cut if split_files else F.array(F.lit(0).cast("bigint"))
    pieces = files.select("path", "length", F.explode(starts).alias("first"))
    size = F.least(F.lit(max_partition_bytes), F.col("length") - F.col("first")) if split_files else F.col("length")
    sized = pieces.withColumn("bytes", size)
    dealt = dealt_by_size(sized, tasks, ("path", "first"), "bytes").select("path", "length", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for path, length, first in zip(*(c.to_pylist() for c in batch.columns)):
                    fs, inner = filesystem(path)
                    last = first + max_partition_bytes if split_files else None
                    with fs.open_input_file(inner) as file:
                        yield from read_blocks(file, path, length, max_block_bytes, first, last)

        yield from in_batches(rows(), arrow_schema)

    return dealt.mapInArrow(read, schema)


def read_images(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Images of a folder, one file, or a comma-separated list, as chunk rows; options as ``read_files``."""
    return read_files(image_files(spark, path), **options)


def write_images(chunks: DataFrame, folder: str, *, in_order: bool = False) -> DataFrame:
    """Save each image under its base name; returns ``(out_path, status)`` of what was saved.

    The blocks of an image are brought together by name, in order, which
    shuffles the voxels; ``in_order`` says that they already are together, as
    reading without ``split_files`` gives them. A second image of the same
    name, missing blocks, and voxels that the header does not promise fail the
    job. Nothing is listed: the rows are what this job's tasks report.
    """
    spark = chunks.sparkSession
    target = qualified(spark, folder)
    rows = chunks.select("path", "header", "block", "n_blocks", "voxels")
    if not in_order:
        name = basename(F.col("path"))
        rows = rows.withColumn("_name", name).repartition("_name").sortWithinPartitions("_name", "path", "block").drop("_name")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ImageAssembler(target)
        try:
            for batch in batches:
                cells = [batch.column(c).to_pylist() for c in ("path", "header", "block", "n_blocks")]
                done = []
                for path, header, block, n_blocks, voxels in zip(*cells, batch.column("voxels")):
                    values = voxels.values.to_numpy(zero_copy_only=False)
                    done.append(out.add(path, header, block, n_blocks, values))
                names = pa.array([d for d in done if d is not None], pa.string())
                yield pa.RecordBatch.from_arrays([names], names=["name"])
            out.finish()
        finally:
            out.discard()

    return saved_names(rows.mapInArrow(save, "name string"), folder)


def saved_names(names: DataFrame, folder: str) -> DataFrame:
    """Run a job that reports the names it saved, and give its manifest."""
    saved = materialize(names, "saved")
    twice = saved.groupBy("name").count().where("count > 1").first()
    if twice:
        raise ValueError(f"two images are named {twice['name']}")
    out = join_path(F.lit(folder.rstrip("/")), F.col("name"))
    return saved.select(out.alias("out_path"), F.lit("SUCCESS").alias("status"))


def decode_images(files: DataFrame, dtype: str, max_block_bytes: int | None = 64 * MIB) -> DataFrame:
    """Chunk rows from a binary scan: content and header from one buffer."""
    schema = chunk_schema(ELEMENT_OF_DTYPE[dtype])
    arrow_schema = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                buffer = content.as_buffer()
                found = read_blocks(pa.BufferReader(buffer), path.as_py(), buffer.size, max_block_bytes)
                yield from in_batches(found, arrow_schema)

    return files.select("path", "content").mapInArrow(decode, schema)


def write_binary(contents: DataFrame, folder: str, *, per_folder: int | None = None) -> DataFrame:
    """Save ``(name, content)`` rows as files; returns their listing ``(path, length)``.

    Each file gets its name in one move. A second file of a name, and a null
    name, fail the job before anything is written.

    ``per_folder`` puts at most so many files into a folder, in folders below
    ``folder`` that each belong to one run of a task: tasks that fill one
    folder wait for each other at each file. The listing says where a file
    is; folders of a task that failed stay and are in no listing.
    """
    if per_folder is not None and per_folder < 1:
        raise ValueError("a folder takes at least one file")
    target = qualified(contents.sparkSession, folder)
    bad = contents.groupBy("name").count().where("count > 1 or name is null").first()
    if bad:
        raise ValueError("a file has no name" if bad["name"] is None else f"two files are named {bad['name']}")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = filesystem(target)
        fs.create_dir(inner, recursive=True)
        own, place, n = f"/part-{TaskContext.get().partitionId():05}-{uuid.uuid4().hex}", "", 0
        for batch in batches:
            paths, lengths = [], []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                if per_folder and n % per_folder == 0:
                    place = f"{own}/{n // per_folder:05}"
                    fs.create_dir(inner + place, recursive=True)
                n += 1
                data = content.as_buffer() if content.is_valid else b""
                temp = f"{inner}{place}/._{name}-{uuid.uuid4().hex}"
                with fs.open_output_stream(temp) as sink:
                    sink.write(data)
                fs.move(temp, f"{inner}{place}/{name}")
                paths.append(f"{target.rstrip('/')}{place}/{name}")
                lengths.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], names=["path", "length"])

    return materialize(contents.select("name", "content").mapInArrow(save, "path string, length bigint"), "files")


def _digest_of(fs: pafs.FileSystem, inner: str) -> tuple[str, int]:
    """MD5 and length of a file of any size, by pieces."""
    digest, length = hashlib.md5(), 0
    with fs.open_input_stream(inner) as source:
        while piece := source.read(8 * MIB):
            digest.update(piece)
            length += len(piece)
    return digest.hexdigest(), length


def file_digests(files: DataFrame) -> DataFrame:
    """``(path, md5, length)`` of listed files ``(path, length)``, read in pieces.

    No content column, whose cells end at 2 GB: a task holds one piece.
    """
    dealt = dealt_by_size(files.select("path", "length"), files.sparkSession.sparkContext.defaultParallelism * 3)
    return _digests(dealt)


def _digests(dealt: DataFrame) -> DataFrame:
    """``(path, md5, length)`` of files that are dealt out already."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            found = [_digest_of(*filesystem(p)) for p in paths]
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array([d for d, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())],
                names=["path", "md5", "length"],
            )

    return dealt.select("path").mapInArrow(digests, "path string, md5 string, length bigint")


def verified_copy(files: DataFrame, target: str, name: Column | None = None, *, below: str | None = None) -> DataFrame:
    """Copy listed files ``(path, length)`` and compare both sides: ``(path, out_path, status, md5, length)``.

    Empty files are copied where the listing has them; Spark's own leaves them out.
    All copies lie in ``target`` itself, or, with ``below``, a folder that has
    all sources, in the folders below ``target`` that they come from below it.

    The digest of the source is that of the bytes as they lie there before
    the copy, the one of the copy is read back from the target; a difference
    fails the job. Files appear under their name only when they are whole.
    """
    spark = files.sparkSession
    wanted = basename(F.col("path") if name is None else name)
    if below is not None:
        wanted = F.concat(F.regexp_extract(_path_below(qualified(spark, below)), "(?s)^(.*/)?", 0), wanted)
    named = files.select("path", "length", wanted.alias("name"))
    twice = named.groupBy("name").count().where("count > 1").first()
    if twice:
        raise ValueError(f"two files are named {twice['name']}")
    # dealt out once, for all three passes over the files
    dealt = dealt_by_size(named, spark.sparkContext.defaultParallelism * 3)
    before = materialize(_digests(dealt), "digests-before")
    materialize(copy_files(dealt, target), "copied")
    goal = qualified(spark, target)
    copies = dealt.withColumn("path", join_path(F.lit(goal.rstrip("/")), F.col("name")))
    after = materialize(_digests(copies), "digests-after")
    both = compared_digests(
        before.join(named.select("path", "name"), "path"),
        after.withColumn("name", _path_below(goal)),
    )
    out = join_path(F.lit(target.rstrip("/")), F.col("name"))
    return both.select("path", out.alias("out_path"), F.lit("SUCCESS").alias("status"), "md5", "length")


def _path_below(folder: str) -> Column:
    """What of ``path`` comes after the folder, which must hold it."""
    # file:/a and file:///a are the same
    no_host = r"^([^:/]+:)///"
    start = re.sub(no_host, r"\1/", f"{folder.rstrip('/')}/")
    path = F.regexp_replace("path", no_host, "$1/")
    outside = F.raise_error(F.concat(path, F.lit(f" is not below {start}")))
    return F.when(path.startswith(start), F.substr(path, F.lit(len(start) + 1))).otherwise(outside)


def compared_digests(before: DataFrame, after: DataFrame) -> DataFrame:
    """``before``, once every file of it is found with the same digest in ``after``, by ``name``."""
    there = after.select("name", F.col("md5").alias("_md5"), F.col("length").alias("_length"))
    joined = materialize(before.join(there, "name", "left"), "compared")
    same = (F.col("md5") == F.col("_md5")) & (F.col("length") == F.col("_length"))
    bad = joined.where(~F.coalesce(same, F.lit(False))).select("name").first()
    if bad:
        raise ValueError(f"the copy of {bad['name']} differs")
    return joined.drop("_md5", "_length")


def copy_files(paths: DataFrame, target: str) -> DataFrame:
    """Copy files in the tasks: ``(out_path, status)`` and when, where and by
    which thread.

    ``paths`` has ``path`` and ``name``, the name under ``target``, which may
    lie in folders there. A missing file fails its task, with what its folder
    holds in the message.
    """
    goal = qualified(paths.sparkSession, target)

    def copy_one(path: str, out: str, out_fs: pafs.FileSystem) -> None:
        fs, inner = filesystem(path)
        folder, name = posixpath.split(out)
        temp = f"{folder}/._{name}-{uuid.uuid4().hex}"
        try:
            opened = fs.open_input_stream(inner)
        except OSError as error:
            if fs.get_file_info(inner).is_file:
                raise
            parent = pafs.FileSelector(inner.rsplit("/", 1)[0], allow_not_found=True)
            near = sorted(i.base_name for i in fs.get_file_info(parent))
            raise FileNotFoundError(f"{path}; its folder has {near}") from error
        with opened as source, out_fs.open_output_stream(temp) as sink:
            while piece := source.read(8 * 1024 * 1024):
                sink.write(piece)
        out_fs.move(temp, out)

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out_fs, folder = filesystem(goal)
        out_fs.create_dir(folder, recursive=True)
        there = folder
        node, executor = socket.gethostname(), threading.get_ident()
        for pdf in batches:
            rows = []
            for path, name in zip(pdf["path"], pdf["name"]):
                began = time.time()
                out = f"{folder}/{name}"
                if (parent := posixpath.dirname(out)) != there:
                    out_fs.create_dir(parent, recursive=True)
                    there = parent
                copy_one(path, out, out_fs)
                rows.append((f"{goal.rstrip('/')}/{name}", "SUCCESS", began, time.time(), node, executor))
            yield pd.DataFrame(rows, columns=COPIED.names)

    return paths.select("path", "name").mapInPandas(copy, COPIED)
