"""Generated images: chunks of a small grid, voxel = x + 10 y + 100 z."""

import struct
from pathlib import Path

import numpy as np

from voxtally.sources.nifti import build_header


def voxels(shape=(4, 4, 4), dtype="uint16", shift=0):
    x, y, z = np.indices(shape)
    return (x + 10 * y + 100 * z + shift).astype(dtype)


def write(folder: Path, name: str, data: np.ndarray, header: bytes | None = None) -> Path:
    header = header or build_header(data.shape, str(data.dtype))
    path = folder / name
    path.write_bytes(header + data.tobytes(order="F"))
    return path


def grid(folder: Path, parts=5, dtype="uint16") -> list[Path]:
    folder.mkdir(parents=True, exist_ok=True)
    out = []
    for i, (x, y, z) in enumerate(np.ndindex(parts, parts, parts)):
        data = voxels(dtype=dtype, shift=i)
        out.append(write(folder, f"dummy_{4 * x}_{4 * y}_{4 * z}.nii", data))
    return out


def load(path: Path) -> np.ndarray:
    """An independent little reader for what the tests compare."""
    raw = Path(path).read_bytes()
    dim = struct.unpack_from("<8h", raw, 40)
    code = struct.unpack_from("<h", raw, 70)[0]
    kind = {4: "<i2", 512: "<u2", 8: "<i4", 16: "<f4", 64: "<f8", 2: "u1"}[code]
    return np.frombuffer(raw[352:], kind).reshape(dim[1 : dim[0] + 1], order="F")
