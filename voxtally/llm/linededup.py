"""Lines that several documents share, dropped everywhere but in the first one.

Each line becomes a 128-bit hash of its key with the document and the
position. These rows are range-partitioned and sorted by (hash, document,
position), so a line that a third of all documents hold is spread over many
partitions. One pass over each partition keeps only the current hash and the
first document that holds it. The first and the last hash of a partition may go
on in its neighbours: their rows are decided afterwards, by the smallest
document that any partition saw first, at most two rows a partition.

The result is a compressed bitmap of kept lines for each document. Texts are
only touched again when a caller applies the bitmaps.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxtally.llm.common import in_arrow, whole_text
from voxtally.session import materialize

MIN_POINTS = 10
ROWS_AT_ONCE = 8192
#: Fixed value: the white space stripped from a line's key, ``[\x20\x09-\x0D]``.
_BLANKS = b" \t\n\x0b\x0c\r"

_LINES = pa.schema([
    ("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32()),
])
# what a row of the sorted pass says
_DOCUMENT, _DROPPED, _OPEN, _FIRST = range(4)
_FOUND = pa.schema([("kind", pa.int8()), *_LINES])
_FOUND_DDL = "kind tinyint, h1 bigint, h2 bigint, id bigint, text_key bigint, pos int"


def line_key(line: bytes) -> bytes:
    """The line without white space at both ends, A-Z in lower case."""
    return line.strip(_BLANKS).lower()


def _points(key: bytes) -> int:
    return len(key) - sum(b & 0xC0 == 0x80 for b in key)


def _long_enough(key: bytes, min_points: int) -> bool:
    return len(key) >= min_points and (len(key) >= 4 * min_points or _points(key) >= min_points)


def _line_rows(rows: DataFrame, min_points: int) -> DataFrame:
    """One row a line whose key is long enough, and one without a hash a document, ``pos`` its number of lines."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at = [], []

        def packed() -> pa.RecordBatch:
            known = np.array([h is not None for h in hashes])
            raw = np.frombuffer(b"".join(h or bytes(16) for h in hashes), dtype="<i8").reshape(-1, 2)
            ids, keys, places = zip(*at)
            return pa.RecordBatch.from_arrays([
                pa.array(raw[:, 0], mask=~known), pa.array(raw[:, 1], mask=~known),
                pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int32()),
            ], schema=_LINES)

        for batch in batches:
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                hashes.append(None)
                at.append((doc, key, len(lines)))
                for i, line in enumerate(lines):
                    plain = line_key(line)
                    if _long_enough(plain, min_points):
                        hashes.append(hashlib.blake2b(plain, digest_size=16).digest())
                        at.append((doc, key, i))
                    if len(at) >= ROWS_AT_ONCE:
                        yield packed()
                        hashes, at = [], []
        if at:
            yield packed()

    return in_arrow(rows, hashed, "h1 bigint, h2 bigint, id bigint, text_key bigint, pos int")


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a sorted partition; state is one hash and its first document.

    Gives the documents' rows, the rows to drop, the rows of the partition's
    first hash (open), and what this partition saw first of its first and its
    last hash.
    """
    now: tuple[int, int] | None = None  # the current hash
    first: tuple[int, bool] = (0, False)  # its first document here, and whether that is known
    head = True  # still in the partition's first hash

    def seen_first() -> pa.RecordBatch:
        doc, known = first
        values = (_FIRST, *now, doc if known else None, None, None)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _FOUND)], schema=_FOUND)

    for batch in batches:
        if not batch.num_rows:
            continue
        has_hash = batch["h1"].is_valid().to_numpy(zero_copy_only=False)
        kind = np.full(batch.num_rows, -1, dtype=np.int8)
        kind[~has_hash] = _DOCUMENT
        at = np.flatnonzero(has_hash)
        if len(at):
            h1, h2 = (batch[c].take(pa.array(at)).to_numpy() for c in ("h1", "h2"))
            ids = batch["id"].take(pa.array(at))
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy()
            new = np.ones(len(at), dtype=bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new[0] = now != (int(h1[0]), int(h2[0]))
            run = np.cumsum(new)  # 0: the hash carried over from the last batch
            starts = np.flatnonzero(new)
            first_doc = np.concatenate([[first[0]], doc[starts]])
            first_known = np.concatenate([[first[1]], known[starts]])
            dropped = (doc != first_doc[run]) | (known != first_known[run])
            # 'run' of the partition's first hash: the carried one while still in the head, or the first new one
            is_head = (run == (0 if now is not None else 1)) if head else np.zeros(len(at), dtype=bool)
            kind[at[dropped & ~is_head]] = _DROPPED
            kind[at[is_head]] = _OPEN
            if head and not is_head[-1]:
                # the first hash ends here; say who held it first
                if now is None:
                    now, first = (int(h1[0]), int(h2[0])), (int(doc[0]), bool(known[0]))
                yield seen_first()
                head = False
            now = (int(h1[-1]), int(h2[-1]))
            first = (int(first_doc[run[-1]]), bool(first_known[run[-1]]))
        keep = np.flatnonzero(kind >= 0)
        if len(keep):
            part = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([pa.array(kind[keep]), *part.columns], schema=_FOUND)
    if now is not None:
        yield seen_first()


def pack_keep(n_lines: int, dropped: Sequence[int]) -> bytes:
    """A compressed bitmap: bit i says whether line i stays."""
    keep = np.ones(n_lines, dtype=bool)
    keep[list(dropped)] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)


def unpack_keep(packed: bytes, n_lines: int) -> np.ndarray:
    bits = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
    return np.unpackbits(bits, count=n_lines, bitorder="little").astype(bool)


def _text_key(text: Column) -> Column:
    # Tells apart the texts of rows that repeat an id; nothing else depends on it.
    return F.xxhash64(text)


def keep_bitmaps(
    docs: DataFrame, min_points: int = MIN_POINTS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, text_key, n_lines, n_dropped, keep)``: one row for each different id and text.

    Lines whose key has ``min_points`` code points or more and is found in two
    documents or more are dropped, except all those of the smallest id that
    holds the key. A null or empty text is one empty line. Rows with equal ids
    are one document, and rows without an id are one document after all
    others; rows that repeat both id and text share a bitmap. Ids are
    integers. Other columns are ignored.
    """
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), _text_key(text).alias("text_key"), text.alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h1"), F.col("h2"), F.col("id").asc_nulls_last(), F.col("pos")]
    lines = materialize(_line_rows(rows, min_points), "lines")
    ranged = lines.repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = materialize(ranged.mapInArrow(_first_occurrences, _FOUND_DDL), "line-places")

    # at most two rows a partition
    firsts = found.where(F.col("kind") == _FIRST).groupBy("h1", "h2").agg(F.min("id").alias("first"))
    undecided = found.where(F.col("kind") == _OPEN).join(F.broadcast(firsts), ["h1", "h2"])
    dropped = undecided.where(~F.col("id").eqNullSafe(F.col("first"))).unionByName(
        found.where(F.col("kind") == _DROPPED), allowMissingColumns=True
    )
    sizes = found.where(F.col("kind") == _DOCUMENT)
    per_line = sizes.select("id", "text_key", F.col("pos").alias("n_lines"), F.lit(None).cast("int").alias("pos"))
    per_line = per_line.unionByName(dropped.select("id", "text_key", F.lit(None).cast("int").alias("n_lines"), "pos"))
    # a set of positions has at most one entry for each line of the text, however often the row repeats
    grouped = per_line.groupBy("id", "text_key").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("dropped"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, places = b["n_lines"].to_pylist(), b["dropped"].to_pylist()
            yield pa.RecordBatch.from_arrays([
                b["id"], b["text_key"], pa.array(sizes, pa.int64()), pa.array(map(len, places), pa.int64()),
                pa.array([pack_keep(n, p) for n, p in zip(sizes, places)], pa.binary()),
            ], names=["id", "text_key", "n_lines", "n_dropped", "keep"])

    return in_arrow(grouped, packed, "id bigint, text_key bigint, n_lines bigint, n_dropped bigint, keep binary")


def with_kept_text(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, n_lines, n_dropped, kept)`` of each row: the text of its kept lines.

    One equi-join of the rows with their bitmaps. A row whose lines are all
    dropped has the empty text.
    """
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("given"), F.col(id_col).cast("bigint").alias("id"), _text_key(text).alias("text_key"), text.alias("text")
    )
    bits = bitmaps.select(F.col("id").alias("id_"), F.col("text_key").alias("key_"), "n_lines", "n_dropped", "keep")
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_"))
    joined = rows.join(bits, same).select("given", "n_lines", "n_dropped", "keep", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for n, dropped, bits, text in zip(*(b[c].to_pylist() for c in ("n_lines", "n_dropped", "keep", "text"))):
                if dropped:
                    lines = text.split("\n")
                    text = "\n".join(lines[i] for i in np.flatnonzero(unpack_keep(bits, n)))
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [b["given"], b["n_lines"], b["n_dropped"], pa.array(kept, pa.string())],
                names=["given", "n_lines", "n_dropped", "kept"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = in_arrow(joined, cut, f"given {kind}, n_lines bigint, n_dropped bigint, kept string")
    return out.select(F.col("given").alias(id_col), "n_lines", "n_dropped", "kept")
