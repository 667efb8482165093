"""Images written by several tasks: the same bytes as one task writes, whatever the order of the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import images
from voxtally.sources import slabs
from voxtally.sources.files import read_images, write_images
from voxtally.sources.slabs import write_slabs


def two_images(folder, dtype="int16"):
    folder.mkdir()
    images.write(folder, "big_0_0_0.nii", images.voxels((6, 5, 23), dtype))
    images.write(folder, "thin_0_0_0.nii", images.voxels((6, 5, 2), dtype))
    return {p.name: p.read_bytes() for p in folder.glob("*.nii")}


@pytest.mark.parametrize("seek", [True, False, None])
@pytest.mark.parametrize("dtype", ["int16", "uint16", "float64"])
def test_same_bytes_as_one_task(spark, tmp_path, seek, dtype):
    want = two_images(tmp_path / "in", dtype)
    blocks = read_images(spark, str(tmp_path / "in"), dtype=dtype, max_block_bytes=6 * 5 * 8 * 2)
    scattered = blocks.repartition(7, F.xxhash64("block"))
    saved = write_slabs(scattered, str(tmp_path / "out"), seek=seek)
    assert {(r.out_path, r.status) for r in saved.collect()} == {(f"{tmp_path}/out/{n}", "SUCCESS") for n in want}
    found = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if p.suffix == ".nii"}
    assert found == want
    assert {p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")} == set(want)


@pytest.mark.parametrize("seek", [True, False])
def test_no_task_holds_more_than_its_slabs(spark, tmp_path, seek):
    data = (np.arange(64 * 64 * 64) % 999).astype("int16").reshape((64, 64, 64), order="F")
    images.write(tmp_path, "one_0_0_0.nii", data)
    layer = 64 * 64 * 2
    blocks = read_images(spark, str(tmp_path), max_block_bytes=2 * layer, max_partition_bytes=8 * layer, split_files=True)
    per_task = blocks.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) >= 4 and max(r["count"] for r in per_task) < 32
    plan = blocks.groupBy().count()  # the job below adds no exchange of voxels to the reading
    assert plan.first()[0] == 32
    write_slabs(blocks, str(tmp_path / "out"), seek=seek)
    assert (tmp_path / "out" / "one_0_0_0.nii").read_bytes() == (tmp_path / "one_0_0_0.nii").read_bytes()


@pytest.mark.parametrize("seek", [True, False])
def test_wrong_blocks_fail_before_any_file_has_its_name(spark, tmp_path, seek):
    two_images(tmp_path / "in")
    blocks = read_images(spark, str(tmp_path / "in"), max_block_bytes=120)
    out = tmp_path / "out"
    for wrong, message in [
        (blocks.where("block <> 2"), "blocks came"),
        (blocks.unionByName(blocks.where("block = 3")), "came twice"),
        (blocks.unionByName(blocks.withColumn("path", F.concat(F.lit("/other"), "path"))), "two images are named"),
        (blocks.withColumn("voxels", F.when(F.col("block") == 1, F.slice("voxels", 1, 7)).otherwise(F.col("voxels"))), "and a header for"),
    ]:
        with pytest.raises(Exception, match=message):
            write_slabs(wrong, str(out), seek=seek)
        assert not list(out.glob("*.nii"))
    assert write_slabs(blocks.limit(0), str(out), seek=seek).collect() == []


def test_a_task_that_runs_again_changes_nothing(tmp_path):
    header = images.build_header((2, 2, 4), "int16")
    data = images.voxels((2, 2, 4), "int16").reshape(-1, order="F")
    for _ in range(2):
        out = slabs.SlabWriter(str(tmp_path), "job", seek=True)
        rows = [r for b in (3, 1, 0, 2) for r in out.add("x.nii", header, [2, 2, 1], b, 4, data[4 * b : 4 * b + 4])]
    assert {r[0] for r in rows} == {"x.nii"} and sum(r[5] for r in rows) == 16
    assert (tmp_path / "._x.nii-job").read_bytes() == header + data.tobytes()


def test_whole_images_too(spark, tmp_path):
    want = two_images(tmp_path / "in")
    whole = read_images(spark, str(tmp_path / "in"), max_block_bytes=None)
    write_slabs(whole, str(tmp_path / "a"))
    write_images(whole, str(tmp_path / "b"))
    for folder in ("a", "b"):
        assert {p.name: p.read_bytes() for p in (tmp_path / folder).glob("*.nii")} == want
