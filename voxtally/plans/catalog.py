"""The registered queries: each operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtally.functions import arrays, fixed, modeling, naming
from voxtally.functions.events import duration, render_event
from voxtally.functions.runs import dataset_tag, engine_of_framework, parse_run_name
from voxtally.operators import assign, bandwidth, chunks, conditions, events, graph, makespan, model, rechunk
from voxtally.plans import increment, reports, tables
from voxtally.session import materialize, scratch_dir
from voxtally.sources import files, logs, slabs
from voxtally.sources.nifti import build_header

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

DATA_DIR = "/data"
ITERATIONS = 10


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def voxel_table(df: DataFrame, *keys: str) -> DataFrame:
    """Chunk rows as voxel rows, so that every voxel is compared."""
    return df.select(*keys, F.posexplode("voxels").alias("pos", "_v")).select(
        *keys, "pos", F.col("_v").cast("double").alias("voxel")
    )


# -- chunks -------------------------------------------------------------------


@query
def chk_increment(spark: SparkSession, sf: str) -> DataFrame:
    return voxel_table(chunks.increment_chunks(tables.embedding_chunks(spark, sf)), "vec_id")


@query
def chk_iterate_n(spark: SparkSession, sf: str) -> DataFrame:
    done = chunks.increment_chunks(tables.embedding_chunks(spark, sf), ITERATIONS)
    return voxel_table(done, "vec_id")


def _quantity_chunks(spark: SparkSession, sf: str, dtype: Column) -> DataFrame:
    """Line-item quantities of each order as integer voxels, by line number."""
    rows = tables.read(spark, sf, "lineitem")
    voxel = F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_partkey")
    # an order has a handful of lines
    lines = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(voxel)).alias("v"))
    return lines.select("l_orderkey", dtype.alias("dtype"), F.col("v.q").alias("voxels"))


@query
def chk_increment_int(spark: SparkSession, sf: str) -> DataFrame:
    """Ten increments of integer voxels of two types."""
    dtype = F.when(F.pmod("l_orderkey", F.lit(2)) == 0, "uint16").otherwise("int32")
    done = chunks.increment_chunks(_quantity_chunks(spark, sf, dtype), ITERATIONS)
    return voxel_table(done, "l_orderkey", "dtype")


@query
def chk_increment_wrap(spark: SparkSession, sf: str) -> DataFrame:
    """Increments past the range of bytes, which start over at its low end."""
    dtype = F.when(F.pmod("l_orderkey", F.lit(2)) == 0, "uint8").otherwise("int8")
    done = chunks.increment_chunks(_quantity_chunks(spark, sf, dtype), 220, overflow="wrap")
    return voxel_table(done, "l_orderkey", "dtype")


@query
def chk_iterate_all_steps(spark: SparkSession, sf: str) -> DataFrame:
    """How often each value occurs in each slab after each step."""
    v = tables.voxel_rows(spark, sf).select("z", "v")
    steps = chunks.all_steps(v, ITERATIONS, "v", "int")
    return steps.groupBy("z", "iteration", "v").agg(F.count(F.lit(1)).alias("n_voxels"))


@query
def chk_all_steps_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Every version of float chunks and of integer chunks, as arrays."""
    real = chunks.all_step_chunks(tables.embedding_chunks(spark, sf).select("vec_id", "voxels"), 4)
    dtype = F.when(F.pmod("l_orderkey", F.lit(2)) == 0, "uint16").otherwise("int32")
    whole = chunks.all_step_chunks(_quantity_chunks(spark, sf, dtype), 4)
    rows = voxel_table(real.withColumnRenamed("vec_id", "id").withColumn("kind", F.lit("float")), "kind", "id", "iteration")
    return rows.unionByName(
        voxel_table(whole.withColumnRenamed("l_orderkey", "id").withColumn("kind", F.lit("integer")), "kind", "id", "iteration")
    )


@query
def chk_named_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Steps that hand named results to each other: layer sums, the largest of them, and a scaled chunk."""

    def layers(voxels: np.ndarray) -> np.ndarray:
        return np.floor(voxels.astype("f8") * 256).sum(axis=(0, 1))

    def extremes(sums: np.ndarray) -> tuple[float, int]:
        return float(sums.max()), int(sums.argmax())

    def scaled(voxels: np.ndarray, largest: float) -> np.ndarray:
        return np.floor(voxels.astype("f8") * 256) - largest

    g = (
        graph.StepGraph()
        .step(scaled, "scaled", ("voxels", "largest"))
        .step(extremes, ("largest", "layer"), {"sums": "layer_sums"})
        .step(layers, "layer_sums")
    )
    results = {"layer_sums": "array<double>", "layer": "int", "scaled": "array<double>"}
    done = g.apply(tables.embedding_chunks(spark, sf), results)
    return done.select(
        "vec_id", "layer", F.array_join(F.transform("layer_sums", lambda v: v.cast("bigint").cast("string")), ",").alias("layer_sums"),
        F.posexplode("scaled").alias("pos", "voxel"),
    )


@query
def chk_user_fn(spark: SparkSession, sf: str) -> DataFrame:
    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = [np.asarray(v, dtype="f8").sum() for v in pdf["voxels"]]
        return pd.DataFrame({"vec_id": pdf["vec_id"], "total": sums})

    c = tables.embedding_chunks(spark, sf).select("vec_id", "voxels")
    return chunks.map_chunks(c, total, "vec_id long, total double").withColumn("total", r6("total"))


@query
def chk_user_steps(spark: SparkSession, sf: str) -> DataFrame:
    def scale(block: np.ndarray, by: float) -> np.ndarray:
        return block * np.float32(by)

    def flip(block: np.ndarray, axis: int) -> np.ndarray:
        return np.flip(block, axis)

    steps = chunks.Steps().step(scale, by=2.0).step(flip, axis=2)
    return voxel_table(steps.apply(tables.embedding_chunks(spark, sf)), "vec_id")


def _axes() -> dict[str, tuple[Column, int]]:
    return {"x": (F.col("x"), 500), "y": (F.col("y"), 20), "z": (F.col("z"), 2)}


@query
def chk_grid_split(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.chunk_totals(tables.voxel_rows(spark, sf), _axes(), F.col("v"))


@query
def chk_half_split(spark: SparkSession, sf: str) -> DataFrame:
    voxels = tables.voxel_rows(spark, sf)
    # one number comes to the driver: the image's extent
    extent = voxels.agg(F.max("z") + 1).first()[0] or 0
    half = chunks.lower_half(voxels, F.col("z"), extent)
    return chunks.chunk_totals(half, _axes(), F.col("v"))


@query
def chk_grid_assemble(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.embedding_chunks(spark, sf)
    voxels = e.select(
        F.col("vec_id").alias("x"), F.posexplode("voxels").alias("y", "v")
    )
    axes = {"x": (F.col("x"), 8), "y": (F.col("y"), 16)}
    return voxel_table(chunks.assemble_chunks(voxels, axes, "v", "float"), "cx", "cy")


@query
def chk_array_split(spark: SparkSession, sf: str) -> DataFrame:
    parts = chunks.split_chunks(
        tables.embedding_chunks(spark, sf).select("vec_id", "shape", "voxels"), (2, 2, 2)
    )
    cell = [F.col("cell")[i].alias(f"c{a}") for i, a in enumerate("xyz")]
    return voxel_table(parts.select("vec_id", *cell, "voxels"), "vec_id", "cx", "cy", "cz")


@query
def chk_zero_pad(spark: SparkSession, sf: str) -> DataFrame:
    c = tables.embedding_chunks(spark, sf)
    return voxel_table(
        c.withColumn("voxels", arrays.pad_to_multiple(F.col("voxels"), 15, "float")), "vec_id"
    )


@query
def chk_zero_pad_grid(spark: SparkSession, sf: str) -> DataFrame:
    c = tables.embedding_chunks(spark, sf)
    padded = arrays.pad_to_grid(F.col("voxels"), F.col("shape"), (3, 3, 3), "float")
    return voxel_table(c.withColumn("voxels", padded), "vec_id")


# -- sources and sinks -----------------------------------------------------------


@query
def src_binary_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as image files, scanned as bytes and decoded from them."""
    scanned = files.scan_binary(spark, _saved_images(spark, sf))
    sized = scanned.select("length", "path", "content")
    decoded = files.decode_images(sized, "float32")
    length = F.octet_length("header") + 4 * F.size("voxels")
    return voxel_table(decoded.withColumn("length", length.cast("bigint")), "image", "x0", "length")


@query
def src_images_by_path(spark: SparkSession, sf: str) -> DataFrame:
    """Images picked by their paths before any is opened: those of low labels, and all others."""
    listed = files.image_files(spark, _saved_images(spark, sf))
    low = naming.basename(F.col("path")).rlike("^img[0-4]_")
    parts = [
        files.read_files(listed.where(chosen), dtype="float32").withColumn("part", F.lit(part))
        for part, chosen in (("low", low), ("other", ~low))
    ]
    return voxel_table(parts[0].unionByName(parts[1]), "part", "image", "x0")


@query
def src_path_index(spark: SparkSession, sf: str) -> DataFrame:
    pages = tables.read(spark, sf, "pages").select(F.col("url").alias("path"))
    return files.index_files(pages)


@query
def src_path_list(spark: SparkSession, sf: str) -> DataFrame:
    talk = tables.read(spark, sf, "conversations")
    return talk.select("conv_id", "turn", files.split_path_list(F.col("text")).alias("path"))


@query
def src_legend_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.read(spark, sf, "documents")
    return docs.select("doc_id", files.legend_tokens(F.col("text")).alias("pos", "token"))


@query
def src_conditions_json(spark: SparkSession, sf: str) -> DataFrame:
    lines = tables.condition_lines(spark, sf)
    return lines.select("p_partkey", logs.parse_condition(F.col("value")).alias("c")).select(
        "p_partkey", "c.*"
    )


@query
def snk_result_manifest(spark: SparkSession, sf: str) -> DataFrame:
    c = tables.embedding_chunks(spark, sf)
    out = naming.join_path(F.lit("/out"), naming.final_name(F.col("path"), ITERATIONS))
    return c.select("vec_id", out.alias("out_path"), F.lit("SUCCESS").alias("status"))


@query
def snk_image_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings saved as image files, read back, incremented ten times."""
    back = files.read_images(spark, _saved_images(spark, sf), dtype="float32")
    done = chunks.increment_chunks(back, ITERATIONS)
    return voxel_table(done, "image", "x0", "y0", "z0", "dtype")


def _saved_images(spark: SparkSession, sf: str, spacing: int = 1) -> str:
    """Embeddings as image files in a new folder, along x by id times spacing."""
    folder = f"{scratch_dir(spark)}/images-{uuid.uuid4().hex}"
    header = F.lit(build_header(tables.SHAPE, "float32"))
    at = (F.col("vec_id") * spacing).cast("string")
    path = F.concat(F.lit("img"), F.col("label").cast("string"), F.lit("_"), at, F.lit("_0_0.nii"))
    c = tables.embedding_chunks(spark, sf).select(
        path.alias("path"), header.alias("header"), F.lit(0).alias("block"), F.lit(1).alias("n_blocks"), "voxels"
    )
    files.write_images(c, folder)
    return folder


@query
def chk_split_saved(spark: SparkSession, sf: str) -> DataFrame:
    """Images split into eight parts each, the parts saved as images, and all of them read back."""
    parts = chunks.split_chunks(files.read_images(spark, _saved_images(spark, sf, 4), dtype="float32"), (2, 2, 2))
    folder = f"{scratch_dir(spark)}/parts-{uuid.uuid4().hex}"
    files.write_images(parts, folder)
    back = files.read_images(spark, folder, dtype="float32")
    return voxel_table(back, "image", "x0", "y0", "z0")


@query
def chk_rechunk_slabs(spark: SparkSession, sf: str) -> DataFrame:
    """Images read in slabs of one layer, cut into a filled-up grid of parts with sides of three, the parts saved and read back."""
    layers = files.read_images(spark, _saved_images(spark, sf, 6), dtype="float32", max_block_bytes=4 * 4 * 4)
    folder = f"{scratch_dir(spark)}/cells-{uuid.uuid4().hex}"
    files.write_images(rechunk.split_images(layers, width=(3, 3, 3)), folder)
    return voxel_table(files.read_images(spark, folder, dtype="float32"), "image", "x0", "y0", "z0")


@query
def chk_join_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Images cut into parts and put together again, in slabs that several tasks write into one file."""
    c = tables.embedding_chunks(spark, sf)
    path = F.concat(F.lit("whole"), F.col("vec_id").cast("string"), F.lit(".nii"))
    one = c.select(
        path.alias("path"), F.regexp_replace(path, "[.]nii$", "").alias("image"), *[F.lit(0).alias(a) for a in ("x0", "y0", "z0")],
        "shape", F.lit("float32").alias("dtype"), F.array().cast("array<double>").alias("affine"),
        F.lit(build_header(tables.SHAPE, "float32")).alias("header"), F.lit(0).alias("block"), F.lit(1).alias("n_blocks"), "voxels",
    )
    joined = rechunk.join_images(rechunk.split_images(one, (2, 3, 2)), layers=3, extent=tables.SHAPE)
    folder = f"{scratch_dir(spark)}/joined-{uuid.uuid4().hex}"
    slabs.write_slabs(joined, folder)
    return voxel_table(files.read_images(spark, folder, dtype="float32"), "image")


@query
def chk_user_steps_slabs(spark: SparkSession, sf: str) -> DataFrame:
    """User steps on images that are read in blocks of one layer: the pointwise
    step runs on the blocks, the other on the whole images that are saved from them."""
    layers = files.read_images(spark, _saved_images(spark, sf), dtype="float32", max_block_bytes=4 * 4 * 4)
    scaled = chunks.Steps().pointwise(lambda block: block * np.float32(2)).apply(layers)
    folder = f"{scratch_dir(spark)}/scaled-{uuid.uuid4().hex}"
    files.write_images(scaled, folder)
    whole = files.read_images(spark, folder, dtype="float32", max_block_bytes=None)
    done = chunks.Steps().step(np.flip, axis=2).apply(whole)
    return voxel_table(done.withColumn("vec_id", F.col("x0").cast("bigint")), "vec_id")


@query
def snk_each_iteration(spark: SparkSession, sf: str) -> DataFrame:
    """Images through three steps, what each step saved and the results read back."""
    out, n = f"{scratch_dir(spark)}/steps-{uuid.uuid4().hex}", 3
    increment.increment_pipeline(spark, _saved_images(spark, sf), out, n, materialize=True, run="steps")
    folders = [*[f"{out}/app-steps/iteration-{i}" for i in range(n)], f"{out}/inc{n}-*.nii"]
    parts = [files.read_images(spark, f, dtype="float32").withColumn("iteration", F.lit(i)) for i, f in enumerate(folders)]
    return voxel_table(reduce(DataFrame.unionByName, parts), "iteration", "image", "x0")


@query
def snk_step_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events of user steps, without their times: each step of each image once."""

    def twice(block: np.ndarray) -> np.ndarray:
        return block * np.float32(2)

    steps = chunks.Steps().step(twice).step(np.flip, axis=2)
    out = f"{scratch_dir(spark)}/timed-{uuid.uuid4().hex}"
    done = increment.steps_pipeline(spark, _saved_images(spark, sf), out, steps, events=True)
    in_order = (F.col("end") >= F.col("start")) & (F.col("start") >= 0)
    return done.events.groupBy("name", "filename").agg(F.count(F.lit(1)).alias("n"), F.min(in_order).alias("in_order"))


@query
def snk_copy_verified(spark: SparkSession, sf: str) -> DataFrame:
    """Document texts saved as files, copied, and compared by their digests on both sides."""
    folder = f"{scratch_dir(spark)}/texts-{uuid.uuid4().hex}"
    docs = tables.read(spark, sf, "documents").where("doc_id is not null")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    saved = files.write_binary(docs.select(name.alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content")),
                               f"{folder}/from", per_folder=files.FILES_PER_FOLDER)
    copied = files.verified_copy(saved, f"{folder}/to", below=f"{folder}/from")
    return copied.select(F.regexp_extract("out_path", "[^/]*$", 0).alias("name"), "md5", "length", "status")


@query
def scl_md5(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.read(spark, sf, "documents")
    return docs.select("doc_id", F.md5("text").alias("md5"))


# -- names -------------------------------------------------------------------------


@query
def nam_basename(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return tables.read(spark, sf, "pages").select(
        "page_id",
        naming.basename(url).alias("base"),
        naming.dirname(url).alias("dir"),
        naming.join_path(naming.dirname(url), F.lit("x.nii")).alias("sibling"),
    )


def _image_names(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses as image paths; some were incremented before."""
    n = F.pmod(F.col("page_id"), F.lit(4))
    mark = (
        F.when(n == 1, "inc-")
        .when(n == 2, "inc-inc-")
        .when(n == 3, "province-")
        .otherwise("")
    )
    base = naming.basename(F.col("url"))
    path = F.concat(naming.dirname(F.col("url")), F.lit("/"), mark, base, F.lit(".nii"))
    return tables.read(spark, sf, "pages").select("page_id", path.alias("path"))


@query
def nam_intermediate(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    return _image_names(spark, sf).select(
        "page_id",
        naming.intermediate_name(path).alias("by_prefix"),
        naming.intermediate_name(path, "anywhere").alias("by_anywhere"),
    )


@query
def nam_final(spark: SparkSession, sf: str) -> DataFrame:
    return _image_names(spark, sf).select(
        "page_id", naming.final_name(F.col("path"), ITERATIONS).alias("out_name")
    )


@query
def nam_strip_scheme(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.pmod("page_id", F.lit(2)) == 0, F.concat(F.lit("file:/"), F.col("url"))).otherwise(
        F.col("url")
    )
    return tables.read(spark, sf, "pages").select("page_id", naming.strip_scheme(path).alias("path"))


@query
def nam_chunk_offsets(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws("_", F.lit("/data/img"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"))
    named = tables.read(spark, sf, "lineitem").select(
        "l_orderkey", F.concat(name, F.lit(".nii")).alias("path")
    )
    path = F.col("path")
    return named.select(
        "l_orderkey", naming.chunk_image(path).alias("image"), *naming.chunk_offsets(path)
    )


# -- events --------------------------------------------------------------------------


def _line() -> Column:
    return render_event(*(F.col(c) for c in ("name", "start", "end", "node", "filename", "executor")))


@query
def evt_render(spark: SparkSession, sf: str) -> DataFrame:
    return tables.task_events(spark, sf).select("event_id", "run", _line().alias("line"))


@query
def evt_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as logs have them, with the irregular and the broken ones."""
    good = tables.task_events(spark, sf).select("event_id", "run", _line().alias("value"))
    odd = F.when(
        F.pmod("event_id", F.lit(10)) == 7, F.replace("value", F.lit("read_file"), F.lit("Read file"))
    ).when(F.pmod("event_id", F.lit(10)) == 3, F.replace("value", F.lit(" node"), F.lit(" on node")))
    lines = good.withColumn("value", F.coalesce(odd, F.col("value")))
    return logs.parse_event_lines(lines, keep=("event_id", "run"))


@query
def evt_duration(spark: SparkSession, sf: str) -> DataFrame:
    return tables.task_events(spark, sf).select(
        "event_id", r6(duration(F.col("start"), F.col("end"))).alias("seconds")
    )


@query
def evt_rebase(spark: SparkSession, sf: str) -> DataFrame:
    epoch = F.startswith(F.col("run"), F.lit("np_"))
    based = events.rebase(tables.task_events(spark, sf), epoch)
    return based.select("event_id", "run", r6("start").alias("start"), r6("end").alias("end"))


@query
def evt_relative_time(spark: SparkSession, sf: str) -> DataFrame:
    e = events.with_driver_start(tables.task_events(spark, sf))
    return e.select("event_id", r6(F.col("start") - F.col("driver_start")).alias("since_driver"))


@query
def evt_seq_id(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.task_events(spark, sf).filter(F.col("name") != fixed.DRIVER)
    return events.with_dense_index(e.select("event_id", "start"), ["start", "event_id"], "id").select(
        "event_id", "id"
    )


@query
def evt_merge_union(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.task_events(spark, sf)
    driver = events.driver_rows(e)
    tasks = e.filter(F.col("name") != fixed.DRIVER)
    return events.merge(driver, tasks).groupBy("run", "name").agg(F.count(F.lit(1)).alias("n"))


@query
def evt_timeline_json(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.task_events(spark, sf)
    for c in ("start", "end"):
        e = e.withColumn(c, F.col(c).cast("decimal(20,6)"))
    tasks = events.timeline(e, ["event_id"])
    return tasks.select("event_id", "id", events.task_json(tasks).alias("task"))


# -- runs and conditions -----------------------------------------------------------------


@query
def cnd_parse(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.task_events(spark, sf)
    return e.select("event_id", "run", *parse_run_name(F.col("run")))


def _conditions(spark: SparkSession, sf: str) -> DataFrame:
    return src_conditions_json(spark, sf)


@query
def cnd_render(spark: SparkSession, sf: str) -> DataFrame:
    return conditions.with_run_name(_conditions(spark, sf)).select("p_partkey", "run")


@query
def cnd_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Conditions to run names and back: every field comes out as it was."""
    named = conditions.with_run_name(_conditions(spark, sf))
    back = named.select("*", F.struct(*parse_run_name(F.col("run"))).alias("p"))
    same = [
        F.col("p.engine") == engine_of_framework(F.col("framework")),
        F.col("p.fs") == F.col("filesystem"),
        F.col("p.iterations") == F.col("iterations"),
        F.col("p.delay") == F.col("delay"),
        F.concat(F.col("p.blocks").cast("string"), F.col("p.image")) == dataset_tag(F.col("dataset")),
    ]
    return back.groupBy("framework", "filesystem").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(reduce(Column.__and__, same).cast("int")).alias("n_same"),
    )


@query
def cnd_dataset_join(spark: SparkSession, sf: str) -> DataFrame:
    legend = tables.read(spark, sf, "pages").select(
        tables.pick(list(fixed.DATASETS), F.col("page_id")).alias("dataset")
    )
    joined = conditions.with_dataset(_conditions(spark, sf), legend, DATA_DIR)
    return joined.select(
        "p_partkey",
        "dataset",
        "chunk_dir",
        "legend_path",
        "cpus_per_task",
        "n_images",
        "per_node",
        "nodes_with_one_more",
    )


@query
def cnd_node_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks that each node of a condition's run reads."""
    legend = tables.read(spark, sf, "pages").select(
        tables.pick(list(fixed.DATASETS), F.col("page_id")).alias("dataset"), F.col("url").alias("chunk")
    )
    some = _conditions(spark, sf).select("p_partkey", "dataset")
    lists = conditions.node_lists(some, legend, DATA_DIR, segment=20, form=lambda paths: F.md5(paths.cast("binary")))
    return lists.select("p_partkey", "dataset", "grp", "segment", "n_paths", F.col("paths").alias("paths_md5"))


# -- makespans ------------------------------------------------------------------------


@query
def mks_multi_driver(spark: SparkSession, sf: str) -> DataFrame:
    spans = makespan.multi_driver(tables.task_events(spark, sf))
    return spans.select("run", r6("makespan").alias("makespan"))


@query
def mks_single_driver(spark: SparkSession, sf: str) -> DataFrame:
    spans = makespan.single_driver(tables.task_events(spark, sf), "event_id")
    return spans.select("run", r6("makespan").alias("makespan"))


@query
def mks_join_runs(spark: SparkSession, sf: str) -> DataFrame:
    spans = makespan.makespans(tables.driver_events(spark, sf), "o_orderkey")
    joined = makespan.join_runs(spans, tables.event_runs(spark, sf))
    return joined.withColumn("makespan", r6("makespan"))


def _makespan_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.task_events(spark, sf)
    per_run = events.driver_rows(e).groupBy("run").agg(
        (F.max("end") - F.min("start")).alias("makespan"),
        F.min("node").alias("node"),
        F.min("executor").alias("executor"),
    )
    columns = (F.col(c) for c in ("run", "makespan", "node", "executor"))
    return per_run.select("run", makespan.makespan_line(*columns).alias("value"))


@query
def mks_line_render(spark: SparkSession, sf: str) -> DataFrame:
    return _makespan_lines(spark, sf)


@query
def mks_line_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _makespan_lines(spark, sf).select(*logs.parse_makespan_line(F.col("value")))


# -- I/O bandwidth -----------------------------------------------------------------------


def _named_events(spark: SparkSession, sf: str) -> DataFrame:
    """Task events with the fields of their run's name: a map, no join."""
    e = tables.task_events(spark, sf)
    return e.select("*", *parse_run_name(F.col("run")))


def _bandwidths(spark: SparkSession, sf: str) -> DataFrame:
    return bandwidth.io_bandwidths(_named_events(spark, sf))


@query
def iob_chunk_size(spark: SparkSession, sf: str) -> DataFrame:
    r = tables.event_runs(spark, sf)
    size = modeling.chunk_mb(F.col("image"), F.col("blocks"))
    return r.select("run", r6(size).alias("chunk_mb"))


@query
def iob_bandwidth(spark: SparkSession, sf: str) -> DataFrame:
    return _bandwidths(spark, sf).select("event_id", "engine", "fs", "op", r6("mb_s").alias("mb_s"))


@query
def iob_distribution(spark: SparkSession, sf: str) -> DataFrame:
    d = bandwidth.distribution(_bandwidths(spark, sf))
    return d.select(
        *bandwidth.GROUP,
        "n",
        "n_floored",
        *[r6(c).alias(c) for c in ("min_mb_s", "max_mb_s", "p25_mb_s", "median_mb_s", "p75_mb_s")],
    )


@query
def iob_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the quantiles of merged sketches keep to their rank error, counted over all rows."""
    b = _bandwidths(spark, sf)
    found = bandwidth.sketched_quantiles(bandwidth.rank_sketches(b, bandwidth.GROUP, "mb_s", "engine"), bandwidth.GROUP, (0.25, 0.5, 0.75))
    errors = bandwidth.rank_errors(b, bandwidth.GROUP, "mb_s", found, "engine")
    return errors.select(*bandwidth.GROUP, "point", "n", (F.col("error") <= bandwidth.SKETCH_ERROR).alias("within"))


@query
def iob_by_fs_and_engine(spark: SparkSession, sf: str) -> DataFrame:
    levels = bandwidth.both_levels(_bandwidths(spark, sf))
    return levels.select(
        F.coalesce("engine", F.lit("all")).alias("engine"), "fs", "op", "n", r6("max_mb_s").alias("max_mb_s")
    )


@query
def iob_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return bandwidth.histogram(_bandwidths(spark, sf), 50.0)


@query
def iob_write_time_by_count(spark: SparkSession, sf: str) -> DataFrame:
    writes = _named_events(spark, sf).filter(F.col("name") == fixed.WRITE_FILE)
    writes = writes.withColumn("seconds", F.col("end") - F.col("start"))
    out = bandwidth.write_time_by_count(writes, "blocks", "seconds")
    return out.withColumn("write_seconds", F.round("write_seconds", 4))


@query
def iob_realized_bw(spark: SparkSession, sf: str) -> DataFrame:
    writes = _named_events(spark, sf).filter(F.col("name") == fixed.WRITE_FILE)
    writes = writes.withColumn("seconds", F.col("end") - F.col("start")).withColumn(
        "mb", modeling.chunk_mb(F.col("image"), F.col("blocks"))
    )
    return bandwidth.realized(writes, ["engine", "fs"], "mb", "seconds").withColumn("mb_s", r6("mb_s"))


# -- model ------------------------------------------------------------------------------


@query
def mod_dims_join(spark: SparkSession, sf: str) -> DataFrame:
    runs = model.with_dims(tables.event_runs(spark, sf))
    return runs.select("run", r6("image_mib").alias("image_mib"), "fs_mib_s", "gamma", "gamma_cluster")


@query
def mod_cd(spark: SparkSession, sf: str) -> DataFrame:
    runs = model.with_volumes(model.with_dims(tables.event_runs(spark, sf)))
    return runs.select("run", r6("c").alias("c"), r6("d").alias("d"))


@query
def mod_rate(spark: SparkSession, sf: str) -> DataFrame:
    runs = model.with_rate(model.with_volumes(model.with_dims(tables.event_runs(spark, sf))))
    return runs.filter(F.col("fs") != fixed.BASELINE_FS).select("run", r6("rate").alias("rate"))


@query
def mod_region(spark: SparkSession, sf: str) -> DataFrame:
    curve = model.with_region(model.speedup_curve(tables.measured_runs(spark, sf)))
    return curve.select(
        "run", "region", modeling.cache_covers(F.col("rate")).cast("int").alias("cache_covers")
    )


@query
def mod_breakeven(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as subjects: MB and seconds of all their line items."""
    items = tables.read(spark, sf, "lineitem")
    rates = items.groupBy("l_suppkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("mb"),
        (F.sum(F.col("l_quantity").cast("bigint")) * 1200).cast("double").alias("seconds"),
    )
    out = model.break_even_concurrency(rates, F.col("mb") / F.col("seconds"))
    return out.select("l_suppkey", "fs", "break_even")


@query
def mod_speedup(spark: SparkSession, sf: str) -> DataFrame:
    return model.speedups(tables.measured_runs(spark, sf)).select(
        "run", r6("baseline").alias("baseline"), r6("speedup").alias("speedup")
    )


@query
def mod_speedup_curve(spark: SparkSession, sf: str) -> DataFrame:
    return model.speedup_curve(tables.measured_runs(spark, sf)).select(
        "fs", "run", r6("rate").alias("rate"), r6("speedup").alias("speedup")
    )


@query
def mod_avg_slowdown(spark: SparkSession, sf: str) -> DataFrame:
    return model.average_slowdown(tables.measured_runs(spark, sf)).select(
        "fs", *model.CONDITION, "n_runs", r6("slowdown").alias("slowdown")
    )


@query
def mod_linear_fit(spark: SparkSession, sf: str) -> DataFrame:
    fit = model.linear_fit(model.speedup_curve(tables.measured_runs(spark, sf)))
    return fit.select("fs", "n", F.round("slope", 9).alias("slope"), r6("intercept").alias("intercept"))


@query
def mod_concurrency(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.task_events(spark, sf).filter(F.col("name") != fixed.DRIVER).select("node", "start", "end")
    steps = materialize(model.concurrency_steps(e, ["node"]), "steps")
    per_node = model.max_concurrency(steps, ["node"])
    cluster = model.max_concurrency(steps, []).select(F.lit("cluster").alias("node"), "max_tasks")
    return per_node.unionByName(cluster)


# -- reports ---------------------------------------------------------------------------


def _exact_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with decimal makespans, whose mean does not depend on the order
    in which they are added up."""
    runs = tables.measured_runs(spark, sf)
    return runs.withColumn("makespan", F.col("makespan").cast("decimal(20,5)"))


def _report(exp: int) -> Query:
    def report(spark: SparkSession, sf: str) -> DataFrame:
        table = reports.comparison(_exact_runs(spark, sf), exp)
        series = [c for c in table.columns if c not in ("pos", "label")]
        return table.select("pos", "label", *[F.col(c).cast("double").alias(c) for c in series])

    report.__name__ = f"rpt_exp{exp}"
    return report


for _exp in (1, 2, 3, 4):
    query(_report(_exp))


@query
def rpt_axis_position(spark: SparkSession, sf: str) -> DataFrame:
    table = reports.axis_positions(_exact_runs(spark, sf))
    return table.withColumn("makespan", F.col("makespan").cast("double"))


# -- assignment ---------------------------------------------------------------------------


@query
def asg_ntile(spark: SparkSession, sf: str) -> DataFrame:
    orders = tables.read(spark, sf, "orders").select("o_orderkey")
    return assign.assign_groups(orders, ["o_orderkey"]).select("o_orderkey", "grp")


@query
def asg_group_csv(spark: SparkSession, sf: str) -> DataFrame:
    pages = tables.read(spark, sf, "pages").select(F.col("url").alias("path"))
    return assign.group_lists(assign.assign_groups(pages, ["path"]), segment=100)


@query
def asg_by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of each dataset, cut into one group per node on their own."""
    assigned = assign.assign_groups(_conditions(spark, sf), ["p_partkey"], by=["dataset"])
    return assigned.select("p_partkey", "dataset", "idx", "total", "grp")


@query
def asg_by_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in order, cut into one contiguous group a node by their bytes."""
    docs = tables.read(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("bytes"))
    return assign.assign_by_size(docs, ["doc_id"], "bytes", fixed.NODES).select("doc_id", "bytes", "grp")


@query
def asg_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = _named_events(spark, sf)
    return e.groupBy("engine", "fs").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.countDistinct("run").alias("n_conditions"),
        F.countDistinct(F.when(F.col("name") != fixed.DRIVER, F.col("filename"))).alias("n_images"),
    )


@query
def asg_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    """Conditions in a random but repeatable order (rows only)."""
    return assign.shuffled(_conditions(spark, sf), "p_partkey", seed=42).select("p_partkey", "dataset")
