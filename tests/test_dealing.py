"""Files dealt out by bytes, copies that are compared, lists of nodes, sketches, versions of chunks."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import images
from voxtally.functions import fixed
from voxtally.operators import conditions as operators_conditions
from voxtally.operators.assign import assign_by_size
from voxtally.operators.bandwidth import SKETCH_ERROR, rank_errors, rank_sketches, sketched_quantiles
from voxtally.operators.chunks import Steps, all_step_chunks
from voxtally.operators.conditions import in_blocks, node_lists, with_lists
from voxtally.plans import catalog, increment
from voxtally.plans.increment import increment_pipeline, steps_pipeline
from voxtally.session import scratch_dir
from voxtally.sources import files
from voxtally.sources.files import dealt_by_size, verified_copy, write_binary


def cut(sizes, groups):
    whole, at, out = max(1, sum(sizes)), 0, []
    for s in sizes:
        out.append(min(groups - 1, at * groups // whole))
        at += s
    return out


@pytest.mark.parametrize("groups", [1, 4, 15])
def test_groups_by_size(spark, groups):
    rng = random.Random(groups)
    for sizes in ([rng.choice([0, 1, 7, 1000]) for _ in range(200)], [5] * 40, [10**9] + [1] * 50, [0] * 5, []):
        rows = [(f"f{i:04}", s) for i, s in enumerate(sizes)] or []
        df = spark.createDataFrame(rows, "path string, length bigint").repartition(3)
        got = {r.path: r.grp for r in assign_by_size(df, ["path"], "length", groups).collect()}
        assert [got[p] for p, _ in rows] == cut(sizes, groups)
        if sizes:
            per = [sum(s for (p, s) in rows if got[p] == g) for g in range(groups)]
            assert max(per) <= sum(sizes) / groups + max(sizes)


def test_sizes_past_a_long_and_odd_ones(spark):
    rows = [(i, s) for i, s in enumerate([2**60, 2**60, None, -5, 2**60])]
    df = spark.createDataFrame(rows, "path int, length bigint")
    got = {r.path: r.grp for r in assign_by_size(df, ["path"], "length", 1000).collect()}
    assert got == {0: 0, 1: 333, 2: 666, 3: 666, 4: 666}


def test_partitions_hold_about_as_many_bytes(spark):
    rows = [(f"f{i:03}", 1000 if i % 10 else 10**9) for i in range(100)]
    df = spark.createDataFrame(rows, "path string, length bigint").repartition(4)
    dealt = dealt_by_size(df, 5).withColumn("task", F.spark_partition_id())
    per = {r.task: (r.bytes, r.least, r.most) for r in dealt.groupBy("task").agg(
        F.sum("length").alias("bytes"), F.min("path").alias("least"), F.max("path").alias("most")).collect()}
    assert len(per) == 5 and max(b for b, _, _ in per.values()) <= 3 * 10**9 + 10**6
    in_order = [per[t] for t in sorted(per)]
    assert all(a[2] < b[1] for a, b in zip(in_order, in_order[1:]))
    assert dealt.rdd.getNumPartitions() == 5 and dealt_by_size(df, 1).rdd.getNumPartitions() == 1


def listing(spark, folder):
    """By Python, as Spark's own listing leaves out empty files."""
    rows = [(f"file://{p}", p.stat().st_size) for p in folder.glob("*.bin")]
    return spark.createDataFrame(rows, "path string, length bigint").repartition(2)


def test_copies_are_compared(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = {"a.bin": b"", "b.bin": b"x" * 3, "c.bin": bytes(range(256)) * 80_000}
    for name, content in data.items():
        (tmp_path / "in" / name).write_bytes(content)
    got = {r.out_path: (r.md5, r.length, r.status) for r in verified_copy(listing(spark, tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert got == {f"{tmp_path}/out/{n}": (hashlib.md5(c).hexdigest(), len(c), "SUCCESS") for n, c in data.items()}
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").glob("*.bin")} == data

    before = files.file_digests(listing(spark, tmp_path / "in")).withColumn("name", F.regexp_extract("path", "[^/]*$", 0))
    (tmp_path / "out" / "c.bin").write_bytes(data["c.bin"][:-1] + b"!")
    after = files.file_digests(listing(spark, tmp_path / "out")).withColumn("name", F.regexp_extract("path", "[^/]*$", 0))
    with pytest.raises(ValueError, match="the copy of c.bin differs"):
        files.compared_digests(before, after)
    with pytest.raises(ValueError, match="the copy of b.bin differs"):
        files.compared_digests(before.where("name <> 'c.bin'"), after.where("name <> 'b.bin'"))
    with pytest.raises(ValueError, match="two files are named x"):
        verified_copy(listing(spark, tmp_path / "in"), str(tmp_path / "twice"), F.lit("x"))


def test_binary_files(spark, tmp_path):
    df = spark.createDataFrame([("a", bytearray(b"12")), ("b", None)], "name string, content binary")
    assert {(r.path.rsplit("/", 1)[1], r.length) for r in write_binary(df, str(tmp_path / "o")).collect()} == {("a", 2), ("b", 0)}
    for bad in (df.unionByName(df), df.withColumn("name", F.lit(None).cast("string"))):
        with pytest.raises(ValueError, match="named|no name"):
            write_binary(bad, str(tmp_path / "p"))


def test_files_in_folders_of_a_bounded_size(spark, tmp_path):
    data = {f"f{i:02}": bytes([i]) * i for i in range(23)}
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in data.items()], "name string, content binary").repartition(3)
    saved = write_binary(df, str(tmp_path / "from"), per_folder=4)
    place = {r.path.rsplit("/", 1)[1]: r.path.removeprefix(f"file:{tmp_path}/from/") for r in saved.collect()}
    copied = {r.out_path: (r.md5, r.length) for r in verified_copy(saved, str(tmp_path / "to"), below=f"file://{tmp_path}/from").collect()}
    assert copied == {f"{tmp_path}/to/{place[n]}": (hashlib.md5(c).hexdigest(), len(c)) for n, c in data.items()}
    for side in ("from", "to"):
        found = [p for p in (tmp_path / side).rglob("*") if p.is_file() and not p.name.endswith(".crc")]
        assert {p.name: p.read_bytes() for p in found} == data and len(found) == len(data)
        assert {str(p.relative_to(tmp_path / side)) for p in found} == set(place.values())
        held = [sum(f.is_file() for f in d.iterdir()) for d in {p.parent for p in found}]
        assert max(held) <= 4 and len(held) <= 23 // 4 + 3
    with pytest.raises(Exception, match="is not below"):
        verified_copy(saved, str(tmp_path / "other"), below=f"{tmp_path}/fro")
    with pytest.raises(ValueError, match="at least one file"):
        write_binary(df, str(tmp_path / "none"), per_folder=0)


def test_texts_do_not_fill_one_folder(spark, tmp_path):
    n, most = 2010, 1000
    text = F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), F.col("id").cast("string")))
    docs = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    root = Path(scratch_dir(spark).removeprefix("file:"))
    before = set(root.glob("texts-*"))
    got = {r.name: (r.md5, r.length) for r in catalog.queries()["snk_copy_verified"](spark, str(tmp_path)).collect()}
    want = {f"doc-{i}": f"t{i}".encode() if i % 7 else b"" for i in range(n)}
    assert got == {name: (hashlib.md5(c).hexdigest(), len(c)) for name, c in want.items()}
    (made,) = set(root.glob("texts-*")) - before
    for side in ("from", "to"):
        held = Counter(p.parent for p in (made / side).rglob("doc-*"))
        assert sum(held.values()) == n and max(held.values()) <= most


def test_lists_of_nodes(spark):
    name, empty = list(fixed.DATASETS)[:2]
    legend = spark.createDataFrame([(name, f"c{i:02}.nii") for i in range(47)] + [("other", "x")], "dataset string, chunk string")
    conditions = spark.createDataFrame([(1, name), (2, name), (3, empty), (4, None)], "id int, dataset string")
    got = node_lists(conditions, legend, "/d", segment=2).collect()
    assert {r.id for r in got} == {1, 2} and len(got) == 2 * (2 * 15)
    for i in (1, 2):
        rows = sorted((r.grp, r.segment, r.paths) for r in got if r.id == i)
        paths = ",".join(p for _, _, p in rows).split(",")
        assert [p.rsplit("/", 1)[1] for p in paths] == [f"c{i:02}.nii" for i in range(47)]
        assert [sum(r.n_paths for r in got if r.id == i and r.grp == g) for g in range(15)] == [4, 4, *[3] * 13]


def test_lists_meet_conditions_by_their_rows(spark, monkeypatch):
    """Few datasets: the join's rows are dealt out by their number, small lists and large ones alike."""
    name = list(fixed.DATASETS)[0]
    legend = spark.createDataFrame([(name, f"c{i:02}.nii") for i in range(47)], "dataset string, chunk string")
    conditions = spark.range(40).coalesce(1).select("id", F.lit(name).alias("dataset"))
    conditions = conditions.unionByName(conditions.where("id < 3")).coalesce(1)

    def rows(df):
        return sorted(tuple(r) for r in df.select("id", "dataset", "grp", "segment", "n_paths", "paths").collect())

    whole = rows(node_lists(conditions, legend, "/d", segment=2))
    assert len(whole) == 43 * 30
    monkeypatch.setattr(operators_conditions, "PAIRS_PER_TASK", 100)
    for shared in (1 << 20, 0):
        monkeypatch.setattr(operators_conditions, "SHARED_BYTES", shared)
        got = node_lists(conditions, legend, "/d", segment=2)
        at = got.groupBy(F.spark_partition_id()).count().collect()
        assert len(at) > 4 and rows(got) == whole
    digests = rows(node_lists(conditions, legend, "/d", segment=2, form=lambda p: F.md5(p.cast("binary"))))
    assert digests == sorted((*r[:5], hashlib.md5(r[5].encode()).hexdigest()) for r in whole)


def test_conditions_in_blocks(spark):
    rows = [(i, "b" if i % 3 else "a", "x" * (i % 5) or None) for i in range(100)] * 2 + [(1, None, "n"), (2, "other", "n")]
    df = spark.createDataFrame(rows, "id int, dataset string, more string").coalesce(1)
    got = in_blocks(df, {"a": 4, "b": 7, "c": 1}).collect()
    assert sorted(tuple(c) for r in got for c in r["_block"]) == sorted(tuple(r) for r in df.where("dataset in ('a', 'b')").collect())
    assert all(c.dataset == r.dataset for r in got for c in r["_block"])
    assert Counter((r.dataset, len(r["_block"])) for r in got) == {("a", 4): 17, ("b", 7): 18, ("b", 6): 1}
    assert len({r["_at"] for r in got}) == len(got)
    assert in_blocks(df, {}).count() == 0


@pytest.mark.parametrize("shared", [1 << 25, 0])
def test_lists_of_conditions_take_little_space(spark, tmp_path, monkeypatch, shared):
    """The rows are the product of both tables, but a file does not say a list anew for each condition."""
    monkeypatch.setattr(operators_conditions, "SHARED_BYTES", shared)
    monkeypatch.setattr(operators_conditions, "PAIRS_PER_TASK", 1 << 20)
    monkeypatch.setattr(operators_conditions, "LISTS_PER_TASK", 500)
    a, b, empty = list(fixed.DATASETS)[:3]
    lists = spark.range(0, 1707, 1, 3).select(
        F.when(F.col("id") < 1607, a).otherwise(b).alias("dataset"), F.pmod("id", F.lit(15)).cast("int").alias("grp"),
        (F.col("id") / 15).cast("int").alias("segment"), F.lit(20).cast("bigint").alias("n_paths"), F.md5(F.col("id").cast("string")).alias("paths"))
    name = F.element_at(F.array(F.lit(a), F.lit(b), F.lit(empty), F.lit(None)), F.pmod("id", F.lit(4)).cast("int") + 1)
    # keys come twice, or are null
    conditions = spark.range(0, 6400, 1, 2).select(F.when(F.col("id") % 100 > 1, F.col("id") % 5000).alias("key"), name.alias("dataset"))
    with_lists(conditions, lists).write.parquet(str(tmp_path / "out"))
    got, want = spark.read.parquet(str(tmp_path / "out")), conditions.join(F.broadcast(lists), "dataset")
    assert got.columns == want.columns

    def summed(df):
        row = F.xxhash64(*df.columns).cast("decimal(38,0)")
        return df.groupBy("dataset").agg(F.count(F.lit(1)), F.sum(row), F.sum(row * F.pmod(row, F.lit(1009)))).orderBy("dataset").collect()

    assert summed(got) == summed(want) and got.count() == 1600 * (1607 + 100)
    files = [p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")]
    # a join may take as many partitions as the session's shuffles
    assert sum(files) * 8 < 4 * got.count() and len(files) <= 8


def test_sketches_merge_and_keep_to_their_error(spark):
    rows = spark.range(0, 60_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("engine"), F.lit("x").alias("fs"),
        F.when(F.col("id") % 5 == 0, 4.0).otherwise(F.pmod(F.col("id") * 7919, F.lit(60_000)).cast("double")).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("c", "x", None)], "engine string, fs string, v double"))
    points = (0.0, 0.1, 0.5, 0.9, 1.0)
    sketches = rank_sketches(rows, ["engine", "fs"], "v", "engine")
    found = sketched_quantiles(sketches, ["engine", "fs"], points)
    errors = rank_errors(rows, ["engine", "fs"], "v", found, "engine").collect()
    assert {(r.engine, r.n) for r in errors} == {("a", 20_000), ("b", 40_000), ("all", 60_000)}
    assert len(errors) == 15 and all(r.error <= SKETCH_ERROR for r in errors)
    assert max(len(r.sketch) for r in sketches.collect()) < 40_000


@pytest.mark.parametrize("kind", ["array<float>", "array<smallint>"])
def test_all_versions_of_chunks(spark, kind):
    rows = [(i, [(i + j) / 7 if "float" in kind else i + j for j in range(i)], None if i % 2 else "int16", "x" * i) for i in range(40)]
    rows = [(*r[:2], "float32" if "float" in kind else r[2], r[3]) for r in rows] + [(99, None, None, None), (100, [None, rows[2][1][0]], None, "n")]
    df = spark.createDataFrame(rows, f"id int, voxels {kind}, dtype string, note string").repartition(3)
    got = {(r.id, r.iteration): r for r in all_step_chunks(df, 5, max_bytes=200).collect()}
    assert len(got) == len(rows) * 5
    for i, voxels, _, note in rows:
        want = None if voxels is None else np.array([0 if v is None else v for v in voxels], "f4" if "float" in kind else "i2")
        for step in range(1, 6):
            r = got[i, step]
            assert r.note == note
            if voxels is None:
                assert r.voxels is None
                continue
            want = want + want.dtype.type(1)
            assert r.voxels == [None if v is None else w for v, w in zip(voxels, want.tolist())]
    with pytest.raises(Exception, match="overflow"):
        all_step_chunks(spark.createDataFrame([([32766],)], "voxels array<smallint>"), 2).collect()


def test_every_step_is_in_the_manifest(spark, tmp_path):
    paths = images.grid(tmp_path / "in", parts=2)
    for large in (increment.LARGE_FILE, 300):
        increment.LARGE_FILE, kept = large, increment.LARGE_FILE
        try:
            out = tmp_path / f"out-{large}"
            done = increment_pipeline(spark, str(tmp_path / "in"), str(out), 3, materialize=True, run="r")
        finally:
            increment.LARGE_FILE = kept
        assert {(r.iteration, r.out_path) for r in done.steps.collect()} == {
            (i, f"{out}/app-r/iteration-{i}/inc-{p.name}") for i in range(3) for p in paths}
        assert {r.out_path for r in done.manifest.collect()} == {f"{out}/inc3-{p.name}" for p in paths}
        for p in paths:
            data = images.load(p)
            for i in range(3):
                assert np.array_equal(images.load(out / "app-r" / f"iteration-{i}" / f"inc-{p.name}"), data + np.uint16(i + 1))
            assert (out / f"inc3-{p.name}").read_bytes() == (out / "app-r" / "iteration-2" / f"inc-{p.name}").read_bytes()


def test_doubled_names_are_found_before_anything_is_written(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        images.write(tmp_path / folder, "same_0_0_0.nii", images.voxels())
    both = f"{tmp_path}/a,{tmp_path}/b"
    runs = [
        lambda o: increment_pipeline(spark, both, o, 2),
        lambda o: increment_pipeline(spark, both, o, 2, materialize=True),
        lambda o: steps_pipeline(spark, both, o, Steps().step(np.flip, axis=0)),
        lambda o: steps_pipeline(spark, both, o, Steps().pointwise(np.abs)),
    ]
    for i, go in enumerate(runs):
        with pytest.raises(ValueError, match="two images are named"):
            go(f"{tmp_path}/out-{i}")
        assert not (tmp_path / f"out-{i}").exists()


def test_events_of_user_steps(spark, tmp_path):
    images.grid(tmp_path / "in", parts=2, dtype="int16")

    def halved(block):
        return block / 2

    steps = Steps().step(np.flip, axis=1).step(halved)
    done = steps_pipeline(spark, str(tmp_path / "in"), str(tmp_path / "timed"), steps, element="float", events=True, run="r")
    steps_pipeline(spark, str(tmp_path / "in"), str(tmp_path / "plain"), steps, element="float")
    names = [p.name for p in (tmp_path / "plain").glob("*.nii")]
    assert len(names) == 8
    assert all((tmp_path / "plain" / n).read_bytes() == (tmp_path / "timed" / n).read_bytes() for n in names)
    counts = {(r.name, r.filename): r["count"] for r in done.events.groupBy("name", "filename").count().collect()}
    want = {(e, n): 1 for e in ("read_img", "flip", "halved", "save_incremented") for n in names}
    assert counts == want | {("driver_program", next(f for e, f in counts if e == "driver_program")): 1}
    assert spark.read.text(str(tmp_path / "timed" / "benchmark-r")).count() == len(want) + 1
