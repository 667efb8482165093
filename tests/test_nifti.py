import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import images
from voxtally.sources import files
from voxtally.operators.chunks import Steps, pad_chunks, split_chunks
from voxtally.session import qualified
from voxtally.sources.nifti import build_header, filesystem, parse_header


def rows_by_name(df):
    return {r.path.rsplit("/", 1)[-1]: r for r in df.collect()}


def test_scan_gives_voxels_names_and_header(spark, tmp_path):
    paths = images.grid(tmp_path / "in", parts=2)
    got = rows_by_name(files.read_images(spark, str(tmp_path / "in")))
    assert len(got) == 8
    for p in paths:
        r = got[p.name]
        assert np.array_equal(np.reshape(r.voxels, (4, 4, 4), order="F"), images.load(p))
        assert (r.image, r.x0, r.y0, r.z0) == ("dummy", *map(int, p.stem.split("_")[1:]))
        assert r.dtype == "uint16" and r.shape == [4, 4, 4] and r.n_blocks == 1
        assert bytes(r.header) == p.read_bytes()[:352]


def test_input_is_a_folder_a_file_or_a_list(spark, tmp_path):
    paths = images.grid(tmp_path, parts=2)
    one = files.read_images(spark, str(paths[0]))
    some = files.read_images(spark, ",".join(map(str, paths[:3])))
    star = files.read_images(spark, f"{tmp_path}/*")
    assert (one.count(), some.count(), star.count()) == (1, 3, 8)
    with pytest.raises(Exception, match="not exist"):
        files.read_images(spark, str(tmp_path / "none.nii"))


@pytest.mark.parametrize("dtype", ["uint8", "int8", "int16", "uint16", "int32", "uint32", "int64", "float32", "float64"])
def test_write_is_the_inverse_of_read(spark, tmp_path, dtype):
    (tmp_path / "in").mkdir()
    data = np.arange(60).reshape(3, 4, 5).astype(dtype)
    data[0, 0, 0] = np.iinfo(dtype).max if np.dtype(dtype).kind in "iu" else np.pi
    p = images.write(tmp_path / "in", "a_0_0_0.nii", data)
    files.write_images(files.read_images(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    assert (tmp_path / "out" / "a_0_0_0.nii").read_bytes() == p.read_bytes()
    assert not [f for f in (tmp_path / "out").iterdir() if f.name.startswith("._")]


def test_large_file_comes_in_slabs_and_goes_back_whole(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = images.voxels((6, 5, 40))
    p = images.write(tmp_path / "in", "b_0_0_100.nii", data)
    df = files.read_images(spark, str(tmp_path / "in"), max_block_bytes=6 * 5 * 2 * 7)
    rows = sorted(df.collect(), key=lambda r: r.block)
    assert [r.shape[2] for r in rows] == [7, 7, 7, 7, 7, 5]
    assert [r.z0 for r in rows] == [100, 107, 114, 121, 128, 135]
    assert np.array_equal(np.concatenate([r.voxels for r in rows]), data.ravel(order="F"))
    files.write_images(df, str(tmp_path / "out"))
    assert (tmp_path / "out" / "b_0_0_100.nii").read_bytes() == p.read_bytes()


def test_one_file_over_several_tasks(spark, tmp_path):
    data = images.voxels((6, 5, 40))
    p = images.write(tmp_path, "b_0_0_0.nii", data)
    options = dict(max_block_bytes=600, max_partition_bytes=500, split_files=True)
    df = files.read_images(spark, str(p), **options)
    assert len({r.part for r in df.select(F.spark_partition_id().alias("part")).collect()}) > 1
    rows = sorted(df.collect(), key=lambda r: r.block)
    assert np.array_equal(np.concatenate([r.voxels for r in rows]), data.ravel(order="F"))
    with pytest.raises(Exception, match="out of order|only .* blocks"):
        files.write_images(df, str(tmp_path / "out"), in_order=True)
    assert not (tmp_path / "out" / "b_0_0_0.nii").exists()
    files.write_images(df, str(tmp_path / "out"))
    assert (tmp_path / "out" / "b_0_0_0.nii").read_bytes() == p.read_bytes()


def test_small_files_spread_over_tasks(spark, tmp_path):
    images.grid(tmp_path, parts=4)
    df = files.read_images(spark, str(tmp_path), min_partitions=32)
    per_task = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) == 32 and max(per_task) == 2


def test_plain_paths_and_uris_mean_the_same(spark, tmp_path):
    p = images.grid(tmp_path, parts=1)[0]
    assert qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    for spec in (str(p), f"file:{p}", f"file://{p}"):
        assert filesystem(spec)[1] == str(p)
        assert files.read_images(spark, spec).count() == 1
    assert filesystem("dbfs:/a/b")[1] == "/dbfs/a/b"


def test_split_images_keep_all_cells(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = images.voxels((8, 8, 8))
    images.write(tmp_path / "in", "b_16_0_8.nii", data)
    parts = split_chunks(files.read_images(spark, str(tmp_path / "in")), (2, 2, 2))
    saved = files.write_images(parts, str(tmp_path / "out")).collect()
    assert len(saved) == 8
    for x, y, z in np.ndindex(2, 2, 2):
        part = images.load(tmp_path / "out" / f"b_{16 + 4 * x}_{4 * y}_{8 + 4 * z}.nii")
        assert np.array_equal(part, data[4 * x : 4 * x + 4, 4 * y : 4 * y + 4, 4 * z : 4 * z + 4])
    back = files.read_images(spark, str(tmp_path / "out"))
    assert {(r.x0, r.y0, r.z0) for r in back.collect()} == {(16 + 4 * x, 4 * y, 8 + 4 * z) for x, y, z in np.ndindex(2, 2, 2)}
    slabs = files.read_images(spark, str(tmp_path / "in"), max_block_bytes=128)
    with pytest.raises(Exception, match="one block"):
        split_chunks(slabs, (2, 2, 2)).collect()


def test_padded_images_can_be_saved(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = images.voxels((3, 4, 5))
    images.write(tmp_path / "in", "b_0_0_0.nii", data)
    padded = pad_chunks(files.read_images(spark, str(tmp_path / "in")), (2, 2, 2))
    files.write_images(padded, str(tmp_path / "out"))
    assert np.array_equal(images.load(tmp_path / "out" / "b_0_0_0.nii"), np.pad(data, [(0, 1), (0, 0), (0, 1)]))


def test_the_writer_refuses_broken_and_doubled_images(spark, tmp_path):
    images.grid(tmp_path / "in", parts=1)
    df = files.read_images(spark, str(tmp_path / "in"))
    half = df.withColumn("voxels", F.slice("voxels", 1, 32))
    with pytest.raises(Exception, match="32 voxels, and a header for 64"):
        files.write_images(half, str(tmp_path / "a"))
    with pytest.raises(Exception, match="two images are named"):
        files.write_images(df.unionByName(df.withColumn("path", F.lit("x/dummy_0_0_0.nii"))), str(tmp_path / "b"))
    with pytest.raises(Exception, match="two images are named"):
        files.write_images(df.unionByName(df), str(tmp_path / "c"), in_order=True)
    assert not [f for f in (tmp_path / "a").iterdir() if f.suffix == ".nii"]


def test_user_steps_see_whole_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = images.voxels((4, 4, 10))
    images.write(tmp_path / "in", "b_0_0_0.nii", data)
    slabs = files.read_images(spark, str(tmp_path / "in"), max_block_bytes=64)
    with pytest.raises(Exception, match="whole image"):
        Steps().step(np.flip, axis=2).apply(slabs).collect()
    whole = files.read_images(spark, str(tmp_path / "in"), max_block_bytes=None)
    got = Steps().step(np.flip, axis=2).apply(whole).first().voxels
    assert np.array_equal(np.reshape(got, data.shape, order="F"), data[:, :, ::-1])
    with pytest.raises(Exception, match="do not fit"):
        Steps().step(lambda b: b / 3).apply(whole).collect()
    with pytest.raises(Exception, match="made 32 voxels"):
        Steps().step(lambda b: b[:2]).apply(slabs.where("false").unionByName(files.read_images(spark, str(images.write(tmp_path, "c_0_0_0.nii", images.voxels()))))).collect()
    thirds = Steps().pointwise(lambda b: b / 3).apply(slabs, element="double")
    files.write_images(thirds, str(tmp_path / "out"))
    assert np.array_equal(images.load(tmp_path / "out" / "b_0_0_0.nii"), data / 3)


def test_big_endian_and_scaled_images(spark, tmp_path):
    data = np.arange(8, dtype=">i2").reshape((2, 2, 2), order="F")
    raw = bytearray(352)
    struct.pack_into(">i", raw, 0, 348)
    struct.pack_into(">8h", raw, 40, 3, 2, 2, 2, 1, 1, 1, 1)
    struct.pack_into(">2h", raw, 70, 4, 16)
    struct.pack_into(">8f", raw, 76, *[1.0] * 8)
    struct.pack_into(">3f", raw, 108, 352, 2.0, -1.0)
    raw[344:348] = b"n+1\0"
    images.write(tmp_path, "c_0_0_0.nii", data, bytes(raw))
    df = files.read_images(spark, str(tmp_path))
    row = df.first()
    assert row.dtype == "float64" and row.voxels == [2.0 * v - 1 for v in range(8)]
    files.write_images(df, str(tmp_path / "out"))
    back = files.read_images(spark, str(tmp_path / "out")).first()
    assert back.voxels == row.voxels


def test_affine_of_both_forms():
    head = bytearray(build_header((2, 2, 2), "int16"))
    struct.pack_into("<12f", head, 280, *range(12))
    assert parse_header(bytes(head)).affine == (*map(float, range(12)), 0, 0, 0, 1)
    struct.pack_into("<2h", head, 252, 1, 0)
    struct.pack_into("<8f", head, 76, 1, 2, 3, 4, 1, 1, 1, 1)
    struct.pack_into("<6f", head, 256, 0, 0, 1, 7, 8, 9)  # half a turn about z
    want = [[-2, 0, 0, 7], [0, -3, 0, 8], [0, 0, 4, 9], [0, 0, 0, 1]]
    assert np.allclose(np.reshape(parse_header(bytes(head)).affine, (4, 4)), want)


def test_bad_files_are_refused(spark, tmp_path):
    (tmp_path / "d_0_0_0.nii").write_bytes(b"x" * 400)
    with pytest.raises(Exception, match="NIfTI"):
        files.read_images(spark, str(tmp_path)).count()
    (tmp_path / "short").mkdir()
    data = images.voxels()
    header = build_header((4, 4, 5), "uint16")
    images.write(tmp_path / "short", "e_0_0_0.nii", data, header)
    with pytest.raises(Exception, match="shorter"):
        files.read_images(spark, str(tmp_path / "short")).collect()


def test_decode_from_binary_scan_equals_data_source(spark, tmp_path):
    images.grid(tmp_path, parts=2)
    scanned = files.scan_binary(spark, str(tmp_path))
    assert "Exchange" not in scanned._jdf.queryExecution().executedPlan().toString()
    a = files.decode_images(scanned, "uint16").select(F.element_at(F.split("path", "/"), -1), "voxels", "shape", "header")
    b = files.read_images(spark, str(tmp_path)).select(F.element_at(F.split("path", "/"), -1), "voxels", "shape", "header")
    assert sorted(a.collect()) == sorted(b.collect())


def test_listing_never_opens_files(spark, tmp_path):
    images.grid(tmp_path, parts=2)
    listed = files.list_files(spark, str(tmp_path))
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    assert sorted(r.idx for r in files.index_files(listed).collect()) == list(range(8))


def test_listing_in_a_task_is_sparks(spark, tmp_path):
    """Folders and patterns are listed as Spark lists them, without a task or a row of the driver for each file."""
    for p in images.grid(tmp_path, parts=2):
        (tmp_path / f"x{p.name}").write_bytes(p.read_bytes())
    for name in ("_hidden.nii", ".hidden.nii", "b._COPYING_"):
        (tmp_path / name).write_bytes(b"1")
    (tmp_path / "empty.nii").write_bytes(b"")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.nii").write_bytes(b"12")
    (tmp_path / "with blank%20").mkdir()
    (tmp_path / "with blank%20" / "ä b.nii").write_bytes(b"123")

    def listed(df):
        return sorted((r.path, r.length) for r in df.collect())

    one = sorted(tmp_path.glob("x*.nii"))[0]
    for spec in ("", "/", "/x*.nii", "/?ub", "/sub", "/with blank%20", f"/{one.name}"):
        try:
            want = listed(files.list_files(spark, qualified(spark, f"{tmp_path}{spec}")))
        except Exception:
            with pytest.raises(Exception):
                files.image_files(spark, f"{tmp_path}{spec}").collect()
            continue
        assert listed(files.image_files(spark, f"{tmp_path}{spec}")) == want, spec
    both = listed(files.image_files(spark, f"{tmp_path}/sub, {one}"))
    assert sorted(n for _, n in both) == [2, one.stat().st_size]
    (tmp_path / "keys" / "k=1").mkdir(parents=True)
    (tmp_path / "keys" / "k=1" / "a.nii").write_bytes(b"1234")
    assert [n for _, n in listed(files.image_files(spark, f"{tmp_path}/keys"))] == [4]
    for missing in ("none", "none*.nii"):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            files.image_files(spark, f"{tmp_path}/{missing}")


def test_many_small_files_make_few_tasks(spark):
    """100 000 files of 400 bytes: opening them is worth 3 125 tasks of 128 MiB, their bytes are worth one."""
    listed = spark.range(100_000).select(F.format_string("/none/%06d.nii", "id").alias("path"), F.lit(400).cast("bigint").alias("length"))
    cores = spark.sparkContext.defaultParallelism
    assert cores <= files.read_files(listed, "uint16").rdd.getNumPartitions() <= files.TASKS_PER_CORE * cores
    # large files make tasks by their bytes
    large = listed.limit(100).withColumn("length", F.lit(128 << 20).cast("bigint"))
    assert files.read_files(large, "uint16").rdd.getNumPartitions() >= 100
