"""Both modes of the pipeline give the same bytes, with and without events."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

import images
from voxtally.operators.chunks import Steps, increment_chunks
from voxtally.plans import increment
from voxtally.plans.increment import increment_pipeline, steps_pipeline


def digests(folder):
    return {p.name: hashlib.md5(p.read_bytes()).hexdigest() for p in folder.glob("*.nii")}


@pytest.mark.parametrize("n", [1, 10])
@pytest.mark.parametrize("dtype", ["uint16", "float32"])
def test_modes_agree(spark, tmp_path, n, dtype):
    paths = images.grid(tmp_path / "in", parts=2, dtype=dtype)
    if dtype == "float32":  # values that do not add up exactly
        images.write(tmp_path / "in", paths[0].name, (images.voxels(dtype=dtype) / 7).astype("f4"))
    out = {}
    for mode in [
        {},
        {"materialize": True, "work_dir": str(tmp_path / "work")},
        {"events": True},
        {"materialize": True, "events": True},
    ]:
        folder = tmp_path / f"out-{len(out)}"
        result = increment_pipeline(spark, str(tmp_path / "in"), str(folder), n, run=f"r{len(out)}", **mode)
        out[str(mode)] = digests(folder)
        got = {(r.out_path, r.status) for r in result.manifest.collect()}
        assert got == {(f"{folder}/inc{n}-{p.name}", "SUCCESS") for p in paths}
    first, *others = out.values()
    assert len(first) == 8 and all(o == first for o in others)

    folder = tmp_path / "out-0"
    for p in paths:
        want = images.load(p)
        for _ in range(n):
            want = want + want.dtype.type(1)
        assert np.array_equal(images.load(folder / f"inc{n}-{p.name}"), want)
    steps = tmp_path / "work" / "app-r1"
    assert sorted(d.name for d in steps.iterdir()) == sorted(f"iteration-{i}" for i in range(n))
    assert all(len(list(d.glob("inc-dummy_*.nii"))) == 8 for d in steps.iterdir())


def test_events_of_both_modes(spark, tmp_path):
    images.grid(tmp_path / "in", parts=2)
    for mode, counts in [
        (False, {"driver_program": 1, "read_img": 8, "increment_data": 24, "save_incremented": 8}),
        (True, {"driver_program": 1, "read_file": 24, "increment_data": 24, "write_file": 24, "save_incremented": 8}),
    ]:
        folder = tmp_path / f"out-{mode}"
        result = increment_pipeline(spark, str(tmp_path / "in"), str(folder), 3, materialize=mode, events=True)
        got = {r.name: r["count"] for r in result.events.groupBy("name").count().collect()}
        assert got == counts
        assert result.events.filter("end < start or start < 0").count() == 0
        logs = [p for p in folder.iterdir() if p.name.startswith("benchmark")]
        assert len(logs) == 1
        assert spark.read.text(str(logs[0])).count() == sum(counts.values())


def test_input_list_and_missing_file(spark, tmp_path):
    paths = images.grid(tmp_path / "in", parts=2)
    listed = ",".join(map(str, paths[:3]))
    increment_pipeline(spark, listed, str(tmp_path / "out"), 2)
    assert set(digests(tmp_path / "out")) == {f"inc2-{p.name}" for p in paths[:3]}
    with pytest.raises(Exception, match="not exist|No such|none.nii"):
        increment_pipeline(spark, str(tmp_path / "none.nii"), str(tmp_path / "x"), 1).manifest.count()
    with pytest.raises(ValueError):
        increment_pipeline(spark, listed, str(tmp_path / "x"), 0)


def test_copy_names_what_is_there(spark, tmp_path):
    from voxtally.sources.files import copy_files

    images.grid(tmp_path, parts=1)
    gone = spark.createDataFrame([(f"{tmp_path}/gone.nii", "x.nii")], "path string, name string")
    with pytest.raises(Exception, match="dummy_0_0_0.nii"):
        copy_files(gone, str(tmp_path / "out")).count()


@pytest.mark.parametrize("materialize", [False, True])
@pytest.mark.parametrize("events", [False, True])
def test_overflow(spark, tmp_path, materialize, events):
    (tmp_path / "in").mkdir()
    data = images.voxels()
    data[1, 2, 3] = 65535
    images.write(tmp_path / "in", "o_0_0_0.nii", data)
    mode = dict(materialize=materialize, events=events)
    with pytest.raises(Exception, match="overflow"):
        increment_pipeline(spark, str(tmp_path / "in"), str(tmp_path / "a"), 2, **mode)
    increment_pipeline(spark, str(tmp_path / "in"), str(tmp_path / "b"), 2, overflow="wrap", **mode)
    got = images.load(tmp_path / "b" / "inc2-o_0_0_0.nii")
    assert np.array_equal(got, data + np.uint16(2)) and got[1, 2, 3] == 1


WRAP = [
    ("tinyint", "int8"), ("smallint", "uint8"), ("smallint", "int16"), ("int", "uint16"),
    ("int", "int32"), ("bigint", "uint32"), ("bigint", "int64"),
]


@pytest.mark.parametrize("element,dtype", WRAP)
@pytest.mark.parametrize("n", [1, 3, 255, 1000])
def test_integer_steps_wrap_like_arrays_do(spark, element, dtype, n):
    info = np.iinfo(dtype)
    data = np.array([info.min, info.min + 1, 0, info.max - 3, info.max - 1, info.max], dtype)
    want = data.copy()
    for _ in range(n):
        want += np.dtype(dtype).type(1)
    df = spark.createDataFrame([([int(v) for v in data], dtype)], f"voxels array<{element}>, dtype string")
    got = increment_chunks(df, n, overflow="wrap")
    assert got.schema["voxels"].dataType == df.schema["voxels"].dataType
    assert got.first().voxels == [int(v) for v in want]


def test_float_steps_are_single_additions(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=1000).astype("f4")
    want = data.copy()
    for _ in range(10):
        want += np.float32(1)
    assert (want != data + np.float32(10)).any()
    rows = [Row(id=1, voxels=data.tolist()), Row(id=2, voxels=None), Row(id=3, voxels=[])]
    df = spark.createDataFrame(rows, "id int, voxels array<float>").coalesce(1)
    got = {r.id: r.voxels for r in increment_chunks(df, 10).collect()}
    assert np.array_equal(np.array(got[1], "f4"), want) and got[2] is None and got[3] == []
    by_one = df
    for _ in range(10):
        by_one = increment_chunks(by_one, 1)
    assert {r.id: r.voxels for r in by_one.collect()} == got


def test_large_files_are_shared_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(increment, "LARGE_FILE", 700)
    (tmp_path / "in").mkdir()
    small = images.write(tmp_path / "in", "a_0_0_0.nii", images.voxels())
    large = images.write(tmp_path / "in", "b_0_0_0.nii", images.voxels((6, 5, 40)))
    done = increment_pipeline(spark, str(tmp_path / "in"), str(tmp_path / "out"), 2)
    assert done.manifest.count() == 2
    for p in (small, large):
        assert np.array_equal(images.load(tmp_path / "out" / f"inc2-{p.name}"), images.load(p) + np.uint16(2))


def test_manifest_is_of_this_run(spark, tmp_path):
    images.grid(tmp_path / "in", parts=1)
    (tmp_path / "out").mkdir()
    images.write(tmp_path / "out", "inc1-old_0_0_0.nii", images.voxels())
    done = increment_pipeline(spark, str(tmp_path / "in"), str(tmp_path / "out"), 1)
    assert [r.out_path for r in done.manifest.collect()] == [f"{tmp_path}/out/inc1-dummy_0_0_0.nii"]
    with pytest.raises(RuntimeError, match="1 images were saved for 2 inputs"):
        increment._checked(done.manifest, spark.range(2))


def test_user_steps_on_files(spark, tmp_path):
    paths = images.grid(tmp_path / "in", parts=2)

    def clip(block, low, high):
        return np.clip(block, low, high)

    def crossed(block):
        assert block.shape == (4, 4, 4)
        return block[::-1]

    steps_pipeline(spark, str(tmp_path / "in"), str(tmp_path / "out"), Steps().step(clip, low=5, high=300).step(crossed))
    for p in paths:
        want = np.clip(images.load(p), 5, 300)[::-1]
        assert np.array_equal(images.load(tmp_path / "out" / p.name), want)


def test_values_that_do_not_fit_the_file_are_refused(spark, tmp_path):
    images.grid(tmp_path / "in", parts=1)
    with pytest.raises(Exception, match="do not fit"):
        steps_pipeline(spark, str(tmp_path / "in"), str(tmp_path / "out"), Steps().step(lambda b: b - 10_000))


def test_many_steps_keep_one_python_pass(spark):
    df = spark.createDataFrame([([1.0],)], "voxels array<double>")
    done = increment_chunks(df, 500)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert done.first().voxels == [501.0]
    ints = increment_chunks(df.select(F.col("voxels").cast("array<int>").alias("voxels")), 500)
    assert ints._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
