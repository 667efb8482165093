"""NIfTI-1 image files: headers, blocks of voxels, and putting blocks together.

One row is one block of voxels (``schemas.chunk_schema``). A file is read in
z-slabs of bounded size, or whole, as one row, for user functions. Voxels lie
column-major in the file, so a z-slab is one contiguous byte range.

``sources/files.py`` lists, reads and saves images with Spark; here is what
its tasks do with one file.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs

from voxtally.functions.arrays import to_lists

HEADER_BYTES = 348
DATA_OFFSET = 352
MIB = 1024 * 1024
#: What opening one more file is taken to cost, in bytes.
OPEN_COST = 4 * MIB
#: A row's voxels have to stay below the size of a cell.
CELL_BYTES = (1 << 31) - 64 * MIB

# Fixed values of the format: datatype code -> voxel type.
DATATYPES = {
    2: "uint8",
    4: "int16",
    8: "int32",
    16: "float32",
    64: "float64",
    256: "int8",
    512: "uint16",
    768: "uint32",
    1024: "int64",
}
_CODES = {name: code for code, name in DATATYPES.items()}


@dataclass(frozen=True)
class Header:
    order: str  # "<" or ">"
    shape: tuple[int, ...]
    dtype: str
    offset: int
    slope: float
    inter: float
    affine: tuple[float, ...]

    @property
    def file_dtype(self) -> np.dtype:
        return np.dtype(self.dtype).newbyteorder(self.order)

    @property
    def scaled(self) -> bool:
        usable = np.isfinite(self.slope) and self.slope != 0
        return bool(usable and (self.slope, self.inter) != (1.0, 0.0))


def _affine(raw: bytes, order: str, pixdim: tuple[float, ...]) -> tuple[float, ...]:
    qform, sform = struct.unpack_from(order + "2h", raw, 252)
    if sform > 0:
        return struct.unpack_from(order + "12f", raw, 280) + (0.0, 0.0, 0.0, 1.0)
    if qform > 0:
        b, c, d, *shift = struct.unpack_from(order + "6f", raw, 256)
        a = max(0.0, 1.0 - (b * b + c * c + d * d)) ** 0.5
        turn = np.array(
            [
                [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
                [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
                [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
            ]
        )
        sizes = np.array(pixdim[1:4]) * [1, 1, -1 if pixdim[0] == -1 else 1]
        full = np.eye(4)
        full[:3, :3], full[:3, 3] = turn * sizes, shift
        return tuple(float(v) for v in full.ravel())
    return tuple(float(v) for v in np.diag([*pixdim[1:4], 1.0]).ravel())


def parse_header(raw: bytes) -> Header:
    if len(raw) < HEADER_BYTES or raw[344:348] not in (b"n+1\0", b"n+1"):
        raise ValueError("not a single-file NIfTI-1 image")
    order = "<" if struct.unpack_from("<i", raw, 0)[0] == HEADER_BYTES else ">"
    dim = struct.unpack_from(order + "8h", raw, 40)
    code = struct.unpack_from(order + "h", raw, 70)[0]
    if code not in DATATYPES:
        raise ValueError(f"voxel type code {code} is not supported")
    pixdim = struct.unpack_from(order + "8f", raw, 76)
    offset, slope, inter = struct.unpack_from(order + "3f", raw, 108)
    return Header(
        order, dim[1 : dim[0] + 1], DATATYPES[code], int(offset), slope, inter,
        _affine(raw, order, pixdim),
    )


def build_header(shape: tuple[int, ...], dtype: str, affine: tuple[float, ...] | None = None) -> bytes:
    """A minimal little-endian header for voxels that come from elsewhere."""
    raw = bytearray(DATA_OFFSET)
    struct.pack_into("<i", raw, 0, HEADER_BYTES)
    struct.pack_into("<8h", raw, 40, len(shape), *shape, *[1] * (7 - len(shape)))
    struct.pack_into("<2h", raw, 70, _CODES[dtype], np.dtype(dtype).itemsize * 8)
    struct.pack_into("<8f", raw, 76, *[1.0] * 8)
    struct.pack_into("<3f", raw, 108, float(DATA_OFFSET), 1.0, 0.0)
    struct.pack_into("<2h", raw, 252, 0, 1)
    rows = affine or tuple(np.eye(4).ravel())
    struct.pack_into("<12f", raw, 280, *rows[:12])
    raw[344:348] = b"n+1\0"
    return bytes(raw)


def _unscaled(raw: bytes, order: str) -> bytes:
    """The header of scaled voxels once they are held as float64 values."""
    out = bytearray(raw)
    struct.pack_into(order + "2h", out, 70, _CODES["float64"], 64)
    struct.pack_into(order + "2f", out, 112, 1.0, 0.0)
    return bytes(out)


#: Names that Hadoop has for file systems, and Arrow's.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path for a path as Spark names it."""
    scheme, colon, rest = path.partition(":")
    if not colon or not rest.startswith("/"):
        return pafs.LocalFileSystem(), posixpath.abspath(path)
    if scheme in ("file", "dbfs"):
        local = "/" + rest.lstrip("/")
        return pafs.LocalFileSystem(), f"/dbfs{local}" if scheme == "dbfs" else local
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def resized(header: bytes, shape: Sequence[int], dtype: str | None = None) -> bytes:
    """The header with other dimensions and, if given, another voxel type."""
    order = parse_header(header).order
    out = bytearray(header)
    struct.pack_into(order + "8h", out, 40, len(shape), *shape, *[1] * (7 - len(shape)))
    if dtype:
        struct.pack_into(order + "2h", out, 70, _CODES[dtype], np.dtype(dtype).itemsize * 8)
    return bytes(out)


def _name_parts(path: str) -> tuple[str, list[int | None]]:
    stem = posixpath.basename(path).removesuffix(".nii")
    parts = stem.rsplit("_", 3)
    if len(parts) == 4 and all(p.isdigit() for p in parts[1:]):
        return parts[0], [int(p) for p in parts[1:]]
    return stem, [None, None, None]


def read_blocks(
    file: pa.NativeFile, path: str, size: int, max_bytes: int | None, first: int = 0, last: int | None = None
) -> Iterator[dict]:
    """The blocks of one image whose first byte lies in ``[first, last)``.

    ``max_bytes`` bounds a block's voxels; None gives the image in one block.
    """
    head = parse_header(file.read_at(HEADER_BYTES, 0))
    raw = file.read_at(head.offset, 0)
    dtype, scaled = head.dtype, head.scaled
    header = raw
    if scaled:
        dtype, header = "float64", _unscaled(raw, head.order)
    *plane, depth = head.shape
    per_layer = int(np.prod(plane, dtype=np.int64))
    layer = per_layer * head.file_dtype.itemsize
    if size < head.offset + layer * depth:
        raise ValueError(f"{path} is shorter than its header says")
    per_block = depth if max_bytes is None else max(1, min(depth, max_bytes // max(1, layer)))
    # the array's element is at most twice as wide as an integer voxel
    wide = np.dtype(dtype).itemsize * (2 if dtype.startswith("uint") else 1)
    if per_block * per_layer * wide > CELL_BYTES:
        raise ValueError(f"{path}: {per_block} layers at once are too large for one row")
    n_blocks = max(1, -(-depth // per_block))
    image, start = _name_parts(path)
    for block in range(n_blocks):
        low = block * per_block
        at = head.offset + low * layer
        if at < first or (last is not None and at >= last):
            continue
        layers = min(per_block, depth - low)
        voxels = np.frombuffer(file.read_at(layers * layer, at), head.file_dtype)
        if scaled:
            voxels = voxels.astype("f8") * head.slope + head.inter
        z = low if start[2] is None and n_blocks > 1 else start[2]
        yield {
            "path": path,
            "image": image,
            "x0": start[0],
            "y0": start[1],
            "z0": z if start[2] is None else start[2] + low * (len(head.shape) == 3),
            "shape": [*plane, layers],
            "dtype": dtype,
            "affine": list(head.affine),
            "header": header,
            "block": block,
            "n_blocks": n_blocks,
            "voxels": voxels,
        }


def to_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Blocks as an Arrow batch, their voxels cast without loss."""
    columns = []
    for field in schema:
        values = [row[field.name] for row in rows]
        if field.name == "voxels":
            wanted = field.type.value_type.to_pandas_dtype()
            for row, v in zip(rows, values):
                if not np.can_cast(v.dtype, wanted, "safe"):
                    raise ValueError(f"{row['path']}: {v.dtype} voxels do not fit {field.type}")
            flat = np.concatenate([v.astype(wanted, copy=False) for v in values])
            lists = to_lists(np.array([len(v) for v in values], dtype=np.int64), flat)
            columns.append(lists.cast(field.type))
        else:
            columns.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def in_batches(rows: Iterator[dict], schema: pa.Schema, max_bytes: int = 4 * MIB, max_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small blocks share a batch; a large one is a batch of its own."""
    held: list[dict] = []
    size = 0
    for row in rows:
        if held and (size + row["voxels"].nbytes > max_bytes or len(held) >= max_rows):
            yield to_batch(held, schema)
            held, size = [], 0
        held.append(row)
        size += row["voxels"].nbytes
    if held:
        yield to_batch(held, schema)


def stored_voxels(path: str, head: Header, voxels: np.ndarray) -> np.ndarray:
    """The voxels in the file's type, cast without loss."""
    stored = np.ascontiguousarray(voxels, head.file_dtype)
    if stored.dtype != voxels.dtype and not np.array_equal(stored, voxels, equal_nan=stored.dtype.kind == "f"):
        raise ValueError(f"{path}: voxels do not fit {stored.dtype}")
    return stored


class ImageAssembler:
    """Puts blocks that arrive in order into image files of one folder.

    A file gets its final name in one move, once it has all the voxels that
    its header promises. A second image of a name is refused.
    """

    def __init__(self, folder: str):
        self.fs, self.folder = filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.stream = self.temp = self.path = None
        self.next_block = self.voxels = 0
        self.names: set[str] = set()

    def add(self, path: str, header: bytes, block: int, n_blocks: int, voxels: np.ndarray) -> str | None:
        """Append one block; returns the name of the file that it completes."""
        name = posixpath.basename(path)
        if block == 0:
            self.finish()
            if name in self.names:
                raise ValueError(f"two images are named {name}")
            self.names.add(name)
            self.path, self.next_block, self.voxels = path, 0, 0
            self.temp = f"{self.folder}/._{name}-{uuid.uuid4().hex}"
            self.stream = self.fs.open_output_stream(self.temp)
            self.stream.write(header)
        elif path != self.path or block != self.next_block:
            raise ValueError(f"{path}: block {block} of {n_blocks} came out of order")
        head = parse_header(header)
        stored = stored_voxels(path, head, voxels)
        self.stream.write(stored.tobytes())
        self.next_block = block + 1
        self.voxels += stored.size
        if self.next_block < n_blocks:
            return None
        wanted = int(np.prod(head.shape, dtype=np.int64))
        if self.voxels != wanted:
            raise ValueError(f"{path}: {self.voxels} voxels, and a header for {wanted}")
        self.stream.close()
        self.fs.move(self.temp, f"{self.folder}/{name}")
        self.stream = None
        return name

    def finish(self) -> None:
        if self.stream is not None:
            self.discard()
            raise ValueError(f"{self.path}: only {self.next_block} blocks came to this task")

    def discard(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.fs.delete_file(self.temp)
            self.stream = None
