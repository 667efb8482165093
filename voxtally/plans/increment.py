"""The image pipelines: read chunks, process them, save the results.

A chunk of ordinary size is read, processed and saved by one task, and its
voxels are not shuffled; the slabs of a very large one are shared by several.
In memory, all steps are one pass. With ``materialize``, one task takes a file
through all steps and saves what each of them gives; where the time of every
read is asked for as well, each step is a job that reads the files of the one
before.
"""

from __future__ import annotations

import posixpath
import socket
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtally.functions import fixed
from voxtally.functions.arrays import add_steps
from voxtally.functions.naming import basename, final_name, intermediate_name, join_path
from voxtally.operators.chunks import Steps, increment_chunks
from voxtally.operators.events import merge, render
from voxtally.session import materialize as write_once, qualified
from voxtally.sources.files import (
    copy_files, dealt_by_size, image_files, image_type, read_files, saved_names, write_images,
)
from voxtally.sources.nifti import MIB, ImageAssembler, filesystem, read_blocks
from voxtally.sources.slabs import write_slabs

#: Images above this size are read and processed by several tasks.
LARGE_FILE = 128 * MIB


@dataclass(frozen=True)
class Outcome:
    """``manifest``: ``(out_path, status)``; ``events`` when asked for;
    ``steps``: ``(iteration, out_path, status)`` of what lies in between, when
    that is kept."""

    manifest: DataFrame
    events: DataFrame | None = None
    steps: DataFrame | None = None


def _save(chunks: DataFrame, name: Column, folder: str, in_order: bool) -> DataFrame:
    columns = ("header", "block", "n_blocks", "voxels")
    return write_images(chunks.select(name.alias("path"), *columns), folder, in_order=in_order)


def _checked(manifest: DataFrame, inputs: DataFrame) -> DataFrame:
    """The manifest of this run, which has to have one result for each input."""
    there, wanted = manifest.count(), inputs.count()
    if there != wanted:
        raise RuntimeError(f"{there} images were saved for {wanted} inputs")
    return manifest


def _distinct_names(files: DataFrame, name: Column) -> None:
    """Two inputs with one name would overwrite each other; found before anything is written."""
    twice = files.groupBy(name.alias("name")).count().where("count > 1").first()
    if twice:
        raise ValueError(f"two images are named {twice['name']}")


def _in_slabs(
    files: DataFrame, step: Callable[[DataFrame], DataFrame], name: Column, folder: str
) -> DataFrame:
    """Read, process and save images whose slabs several tasks share; each
    task writes its own slabs, so no voxels are shuffled."""
    chunks = read_files(files, split_files=True, max_partition_bytes=LARGE_FILE)
    columns = ("header", "shape", "block", "n_blocks", "voxels")
    return write_slabs(step(chunks).select(name.alias("path"), *columns), folder)


def _every_step(
    files: DataFrame, name: Column, final: Column, work: str, output: str, steps: int, overflow: str
) -> DataFrame:
    """``(name, iteration)`` of what is saved: each file after each step under
    ``<work>/iteration-<i>``, and in the end under its final name (iteration
    null). A file stays in one task; nothing is read again."""
    folders = [qualified(files.sparkSession, f"{work}/iteration-{i}") for i in range(steps)]
    target = qualified(files.sparkSession, output)

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        outs = [ImageAssembler(f) for f in [*folders, target]]
        for pdf in batches:
            rows: list[tuple[str, int | None]] = []
            for path, inner_name, last_name in zip(pdf["path"], pdf["name"], pdf["final"]):
                fs, inner = filesystem(path)
                with fs.open_input_file(inner) as file:
                    blocks = list(read_blocks(file, path, file.size(), 64 * MIB))
                for i, out in enumerate(outs):
                    try:
                        for block in blocks:
                            if i < steps:
                                block["voxels"] = add_steps(block["voxels"], block["dtype"], 1, overflow)
                            to = inner_name if i < steps else last_name
                            out.add(to, block["header"], block["block"], block["n_blocks"], block["voxels"])
                        out.finish()
                    finally:
                        out.discard()
                    rows.append((last_name if i == steps else inner_name, None if i == steps else i))
            yield pd.DataFrame(rows, columns=["name", "iteration"]).astype({"iteration": "Int32"})

    dealt = _spread(files.select("path", "length", name.alias("name"), final.alias("final")))
    return write_once(dealt.mapInPandas(job, "name string, iteration int"), "steps")


def _large_steps(
    files: DataFrame, name: Column, final: Column, work: str, output: str, steps: int, overflow: str
) -> DataFrame:
    """As ``_every_step``, for images whose slabs several tasks share: a job for
    each step, from the files that the one before wrote."""
    spark, out = files.sparkSession, None
    finals = write_once(files.select(name.alias("_base"), final.alias("_final")), "finals")
    for i in range(steps + 1):
        last = i == steps
        folder = output if last else f"{work}/iteration-{i}"
        named = files.withColumn("_name", name)
        to = named.join(finals, F.col("_name") == F.col("_base")).select("path", F.col("_final" if last else "_name").alias("_to"))
        step = (lambda c: c) if last else (lambda c: increment_chunks(c, 1, overflow=overflow))
        saved = _in_slabs(files, lambda c: step(c).join(to, "path"), F.col("_to"), folder)
        rows = saved.select(basename(F.col("out_path")).alias("name"), F.lit(None if last else i).cast("int").alias("iteration"))
        out = rows if out is None else out.unionByName(rows)
        if not last:
            files = files.select(join_path(F.lit(qualified(spark, folder)), name).alias("path"), "length")
    return out


Stamp = Callable[[str], None]


def _increments(steps: int, phase: str, overflow: str) -> Callable[[dict, Stamp], dict]:
    def work(block: dict, stamp: Stamp) -> dict:
        for _ in range(steps):
            block["voxels"] = add_steps(block["voxels"], block["dtype"], 1, overflow)
            stamp(phase)
        return block

    return work


def _timed_job(
    files: DataFrame,
    folder: str,
    work: Callable[[dict, Stamp], dict],
    phases: tuple[str, str],
    started: float,
    max_block_bytes: int | None = 64 * MIB,
) -> DataFrame:
    """Read, process and save whole files, with an event for each part.

    ``files`` has ``path`` and ``name``, the name to save under; ``phases``
    are the event names of reading and saving, and ``work`` stamps its own. A
    task that runs again reports its own events only, so each counts once.
    """
    reading, saving = phases
    target = qualified(files.sparkSession, folder)

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, executor = socket.gethostname(), threading.get_ident()
        out = ImageAssembler(target)
        rows: list[tuple] = []

        def stamp(phase: str, began: float, file: str) -> float:
            now = time.time()
            rows.append((phase, began - started, now - started, node, file, executor))
            return now

        try:
            for pdf in batches:
                for path, name in zip(pdf["path"], pdf["name"]):
                    base = posixpath.basename(path)
                    fs, inner = filesystem(path)
                    now = time.time()
                    with fs.open_input_file(inner) as file:
                        for block in read_blocks(file, path, file.size(), max_block_bytes):
                            now = stamp(reading, now, base)

                            def step_done(phase: str) -> None:
                                nonlocal now
                                now = stamp(phase, now, base)

                            block = work(block, step_done)
                            out.add(name, block["header"], block["block"], block["n_blocks"], block["voxels"])
                            now = stamp(saving, now, posixpath.basename(name))
                columns = ["name", "start", "end", "node", "filename", "executor"]
                yield pd.DataFrame(rows, columns=columns)
                rows.clear()
            out.finish()
        finally:
            out.discard()

    schema = "name string, start double, end double, node string, filename string, executor long"
    return files.mapInPandas(job, schema)


def _spread(files: DataFrame) -> DataFrame:
    """Only names move, in order, about as many bytes to each of the tasks."""
    return dealt_by_size(files, files.sparkSession.sparkContext.defaultParallelism * 3)


def _incremented(
    files: DataFrame, name: Column, folder: str, steps: int, phases: tuple[str, str, str],
    started: float, overflow: str, timed: bool,
) -> tuple[DataFrame, DataFrame]:
    """The manifest and the events of adding ``steps`` to all files.

    A file is read, incremented and saved inside one task, so its voxels never
    leave numpy. Files above ``LARGE_FILE`` are shared by several tasks
    instead, except where the events of each file are asked for.
    """
    large = F.col("length") > LARGE_FILE
    small = files if timed else files.where(~large)
    _distinct_names(files, name)
    named = _spread(small).select("path", name.alias("name"))
    work = _increments(steps, phases[1], overflow)
    events = write_once(_timed_job(named, folder, work, (phases[0], phases[2]), started), "events")
    saved = events.where(F.col("name") == phases[2]).select(F.col("filename").alias("name"))
    manifest = saved_names(saved.distinct(), folder)
    rest = files.where(large)
    if not timed and not rest.isEmpty():
        slabs = _in_slabs(rest, lambda c: increment_chunks(c, steps, overflow=overflow), name, folder)
        manifest = manifest.unionByName(slabs)
    return _checked(manifest, files), events


def increment_pipeline(
    spark: SparkSession,
    input: str,
    output: str,
    iterations: int,
    *,
    materialize: bool = False,
    events: bool = False,
    work_dir: str | None = None,
    run: str | None = None,
    overflow: str = "raise",
) -> Outcome:
    """Add 1 to every voxel ``iterations`` times and save each image.

    ``input`` is a folder, a file, or a comma-separated list. With
    ``materialize``, the result of step i goes to
    ``<work_dir>/app-<run>/iteration-<i>/``. With ``events``, the timed events
    are also saved as text under ``<output>/benchmark-<run>``.
    """
    if iterations < 1:
        raise ValueError("at least one iteration is needed")
    started = time.time()
    run = run or uuid.uuid4().hex
    inputs = image_files(spark, input)
    final = final_name(F.col("path"), iterations)
    tasks: list[DataFrame] = []

    work = f"{(work_dir or output).rstrip('/')}/app-{run}"
    saved_steps = None

    if materialize and not events:
        inner = intermediate_name(F.col("path"))
        large = F.col("length") > LARGE_FILE
        _distinct_names(inputs, inner)
        done = _every_step(inputs.where(~large), inner, final_name(inner, iterations), work, output, iterations, overflow)
        rest = inputs.where(large)
        if not rest.isEmpty():
            done = done.unionByName(_large_steps(rest, inner, final_name(inner, iterations), work, output, iterations, overflow))
        status = F.lit("SUCCESS").alias("status")
        manifest = done.where("iteration is null").select(join_path(F.lit(output.rstrip("/")), F.col("name")).alias("out_path"), status)
        manifest = _checked(manifest, inputs)
        folder = F.concat(F.lit(f"{work}/iteration-"), F.col("iteration").cast("string"))
        saved_steps = done.where("iteration is not null").select("iteration", join_path(folder, F.col("name")).alias("out_path"), status)
        return Outcome(manifest, steps=saved_steps)
    if not materialize:
        phases = (fixed.READ_IMG, fixed.INCREMENT, fixed.SAVE)
        manifest, log = _incremented(inputs, final, output, iterations, phases, started, overflow, events)
        tasks.append(log)
    else:
        source = inputs
        phases = (fixed.READ_FILE, fixed.INCREMENT, fixed.WRITE_FILE)
        for i in range(iterations):
            folder = f"{work}/iteration-{i}"
            name = intermediate_name(F.col("path"))
            _, log = _incremented(source, name, folder, 1, phases, started, overflow, events)
            tasks.append(log)
            source = image_files(spark, folder)
        last = _spread(source).select("path", final.alias("name"))
        copied = write_once(copy_files(last, output), "copied")
        names = copied.select(basename(F.col("out_path")).alias("name"))
        manifest = _checked(saved_names(names, output), inputs)
        tasks.append(
            copied.select(
                F.lit(fixed.SAVE).alias("name"),
                (F.col("start") - started).alias("start"),
                (F.col("end") - started).alias("end"),
                "node",
                F.replace(basename(F.col("out_path")), F.lit(f"inc{iterations}-"), F.lit("")).alias(
                    "filename"
                ),
                "executor",
            )
        )

    if not events:
        return Outcome(manifest)
    return Outcome(manifest, _saved_log(spark, tasks, started, run, output))


def _saved_log(spark: SparkSession, tasks: list[DataFrame], started: float, run: str, output: str) -> DataFrame:
    """The events of all tasks and of the driver, saved as text under ``<output>/benchmark-<run>``."""
    driver = (fixed.DRIVER, 0.0, time.time() - started, socket.gethostname(), fixed.ALL_FILES, threading.get_ident())
    log = spark.createDataFrame([driver], tasks[0].schema)
    for part in tasks:
        log = merge(log, part)
    log = log.withColumn("run", F.lit(run))
    render(log).select("value").write.mode("overwrite").text(f"{output}/benchmark-{run}")
    return log


def steps_pipeline(
    spark: SparkSession, input: str, output: str, steps: Steps, element: str | None = None,
    *, events: bool = False, run: str | None = None,
) -> Outcome:
    """User functions on each whole image; results keep their names.

    Each image is one row, whatever its size up to that of a cell; only if all
    steps are pointwise are large images read and processed in slabs.
    ``element`` names the type of the results, by default that of the images.
    With ``events``, reading, every step (by the name of its function) and
    saving of each image are timed, each once, and are also saved as text under
    ``<output>/benchmark-<run>``; all images are whole then.
    """
    started = time.time()
    files = image_files(spark, input)
    name = basename(F.col("path"))
    _distinct_names(files, name)
    if events:
        named = _spread(files).select("path", name.alias("name"))
        job = _timed_job(named, output, steps.timed(element), (fixed.READ_IMG, fixed.SAVE), started, None)
        log = write_once(job, "events")
        saved = log.where(F.col("name") == fixed.SAVE).select(F.col("filename").alias("name"))
        manifest = _checked(saved_names(saved, output), files)
        return Outcome(manifest, _saved_log(spark, [log], started, run or uuid.uuid4().hex, output))
    large = F.col("length") > LARGE_FILE
    whole, rest = (files, None) if steps.whole else (files.where(~large), files.where(large))
    dtype = image_type(files)
    done = steps.apply(read_files(whole, dtype, max_block_bytes=None), element=element)
    saved = _save(done, name, output, in_order=True)
    if rest is not None and not rest.isEmpty():
        slabs = _in_slabs(rest, lambda c: steps.apply(c, element=element), name, output)
        saved = saved.unionByName(slabs)
    return Outcome(_checked(saved, files))
