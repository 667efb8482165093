"""Images cut anew against plain numpy."""

import numpy as np
import pytest

import images
from voxtally.operators.chunks import pad_chunks
from voxtally.operators.rechunk import join_images, pieces_of, split_images
from voxtally.sources.files import read_images, write_images
from voxtally.sources.slabs import write_slabs


def cells(data, width):
    """Padded parts of an array, by their offsets."""
    padded = np.pad(data, [(0, -n % w) for n, w in zip(data.shape, width)])
    out = {}
    for cell in np.ndindex(*[n // w for n, w in zip(padded.shape, width)]):
        at = [c * w for c, w in zip(cell, width)]
        out[tuple(at)] = padded[tuple(slice(a, a + w) for a, w in zip(at, width))]
    return out


def test_pieces_cover_a_box_once():
    rng = np.random.default_rng(1)
    for _ in range(50):
        shape, width = rng.integers(1, 7, 3), rng.integers(1, 5, 3)
        origin, extent = rng.integers(0, 6, 3), rng.integers(3, 14, 3)
        block = rng.integers(0, 100, shape)
        seen = np.zeros(shape, dtype=int)
        for cell, at, part in pieces_of(block, origin, extent, width):
            low = [c * w + a - o for c, w, a, o in zip(cell, width, at, origin)]
            box = tuple(slice(s, s + n) for s, n in zip(low, part.shape))
            assert (block[box] == part).all() and all(a + n <= w for a, n, w in zip(at, part.shape, width))
            seen[box] += 1
        inside = np.ones(shape, dtype=int)
        for axis in range(3):
            beyond = [slice(None)] * 3
            beyond[axis] = slice(max(0, int(extent[axis] - origin[axis])), None)
            inside[tuple(beyond)] = 0
        assert (seen == inside).all()


@pytest.mark.parametrize("dtype", ["uint16", "float32", "int16"])
def test_slabs_to_cells_and_back(spark, tmp_path, dtype):
    data = {"big_10_20_30": images.voxels((7, 5, 9), dtype), "plain": images.voxels((4, 6, 8), dtype, 3)}
    (tmp_path / "in").mkdir()
    for name, voxels in data.items():
        images.write(tmp_path / "in", f"{name}.nii", voxels)
    slabs = read_images(spark, str(tmp_path / "in"), dtype=dtype, max_block_bytes=100)
    assert slabs.where("n_blocks = 1").isEmpty()
    parts = split_images(slabs, width=(3, 2, 4))
    write_images(parts, str(tmp_path / "parts"))
    starts = {"big_10_20_30": (10, 20, 30), "plain": (0, 0, 0)}
    want = {
        f"{name.split('_')[0]}_{'_'.join(str(a + s) for a, s in zip(at, starts[name]))}.nii": part
        for name, voxels in data.items() for at, part in cells(voxels, (3, 2, 4)).items()
    }
    found = {p.name: images.load(p) for p in (tmp_path / "parts").glob("*.nii")}
    assert set(found) == set(want)
    assert all((found[n] == want[n]).all() and found[n].shape == (3, 2, 4) for n in want)

    only = read_images(spark, str(tmp_path / "parts"), dtype=dtype).where("image = 'plain'")
    whole = join_images(only, layers=3, extent=(4, 6, 8))
    assert sorted((r.block, r.n_blocks, len(r.voxels)) for r in whole.collect()) == [(0, 3, 72), (1, 3, 72), (2, 3, 48)]
    write_images(whole, str(tmp_path / "whole"))
    assert (tmp_path / "whole" / "plain.nii").read_bytes() == (tmp_path / "in" / "plain.nii").read_bytes()
    padded = join_images(only, layers=100)
    write_images(padded, str(tmp_path / "padded"))
    assert images.load(tmp_path / "padded" / "plain.nii").shape == (6, 6, 8)


def test_grids(spark, tmp_path):
    data = images.voxels((5, 4, 6))
    images.write(tmp_path, "a_0_0_0.nii", data)
    slabs = read_images(spark, str(tmp_path), max_block_bytes=40)
    got = {(r.x0, r.y0, r.z0): (tuple(r.cell), tuple(r.shape), r.voxels) for r in split_images(slabs, (2, 2, 4)).collect()}
    want = cells(data, (3, 2, 2))
    # two layers for each of four cells: the last one lies beyond the image
    assert set(got) == set(want)
    assert all(list(want[at].reshape(-1, order="F")) == v and shape == (3, 2, 2) for at, (_, shape, v) in got.items())
    with pytest.raises(ValueError, match="either"):
        split_images(slabs)
    with pytest.raises(Exception, match="axes"):
        split_images(slabs, (2, 2)).collect()


def test_slabs_are_padded_one_by_one(spark, tmp_path):
    data = {"a_0_0_0": images.voxels((5, 4, 7), "int16"), "b": images.voxels((3, 3, 3), "int16")}
    (tmp_path / "in").mkdir()
    for name, voxels in data.items():
        images.write(tmp_path / "in", f"{name}.nii", voxels)
    for block_bytes in (90, None):
        blocks = read_images(spark, str(tmp_path / "in"), max_block_bytes=block_bytes)
        out = tmp_path / f"out-{block_bytes}"
        write_slabs(pad_chunks(blocks, (3, 2, 4)), str(out))
        for name, voxels in data.items():
            want = np.pad(voxels, [(0, -n % g) for n, g in zip(voxels.shape, (3, 2, 4))])
            assert np.array_equal(images.load(out / f"{name}.nii"), want)
    with pytest.raises(Exception, match="a grid of 2"):
        pad_chunks(blocks, (3, 2)).collect()


def test_missing_and_doubled_parts_fail(spark, tmp_path):
    images.write(tmp_path, "a_0_0_0.nii", images.voxels((4, 4, 4)))
    slabs = read_images(spark, str(tmp_path), max_block_bytes=40)
    with pytest.raises(Exception, match="got 16 of 32 voxels"):
        split_images(slabs.where("block <> 1"), width=(4, 4, 2)).collect()
    with pytest.raises(Exception, match="two parts cover"):
        split_images(slabs.unionByName(slabs), width=(4, 4, 2)).collect()
    assert split_images(slabs.limit(0), width=(4, 4, 2)).collect() == []


def test_an_image_above_the_block_bound(spark, tmp_path):
    data = (np.arange(64 * 64 * 96) % 251).astype("int16").reshape((64, 64, 96), order="F")
    images.write(tmp_path, "large_0_0_0.nii", data)
    slabs = read_images(spark, str(tmp_path), max_block_bytes=64 * 64 * 2 * 5, max_partition_bytes=64 * 64 * 2 * 20, split_files=True)
    assert slabs.rdd.getNumPartitions() > 1
    parts = split_images(slabs, (2, 2, 2)).select("x0", "y0", "z0", "voxels").collect()
    want = cells(data, (32, 32, 48))
    assert {(r.x0, r.y0, r.z0) for r in parts} == set(want)
    assert all(np.array_equal(np.array(r.voxels), want[r.x0, r.y0, r.z0].reshape(-1, order="F")) for r in parts)
