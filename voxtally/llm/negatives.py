"""Hard negatives: for each anchor and positive, the best rows of other labels that score well below the positive.

Anchors and rows are packed into blocks of a fixed number of rows, and each
pair of blocks is one matrix product. A first round finds the positives, a few
of each pair of blocks for every anchor. With these known, a second round
keeps, of each pair of blocks, what the windows below the positives can use.

What is kept is packed into keys (anchor, descending score, positives first,
id), shuffled by anchor and sorted within partitions. One pass over the sorted
keys opens a window at each positive and hands each negative to the windows it
falls into; its state is an anchor's few windows, however many keys it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtally.operators.ordering import with_dense_index
from voxtally.session import materialize

BLOCK_ROWS = 4096
ANCHOR_ROWS = 1024
ROWS_AT_ONCE = 8192
_BLOCK = "dim int, block bigint, number binary, id binary, label binary, vector binary, width int, positive array<bigint>, n_positive binary"
_BIAS = np.uint64(1 << 63)
#: Big-endian, so that bytes sort as the fields do.
_KEY = np.dtype([("number", ">u8"), ("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_POSITIVE, _NEGATIVE = 0, 1
_MINED = pa.schema([
    ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()),
    ("positive_score", pa.int64()), ("negative_score", pa.int64()),
])
_MINED_DDL = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _biased(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64).view(np.uint64) ^ _BIAS


def pack_keys(number: np.ndarray, anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    keys = np.zeros(len(ids), dtype=_KEY)
    keys["number"], keys["anchor"], keys["kind"], keys["id"] = number, _biased(anchor), kind, _biased(ids)
    keys["score"] = ~_biased(score)
    return pa.Array.from_buffers(pa.binary(_KEY.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def unpack_keys(keys: pa.Array) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(b"".join(keys.to_pylist()), dtype=_KEY)

    def plain(x: np.ndarray) -> np.ndarray:
        return (x.astype(np.uint64) ^ _BIAS).view(np.int64)

    return raw["number"].astype(np.int64), plain(raw["anchor"]), plain(~raw["score"].astype(np.uint64)), raw["kind"], plain(raw["id"])


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer products: in double precision where no sum can pass 2**52, in Python's integers where one may not fit a long."""
    def longest(x: np.ndarray) -> float:
        return float(np.sqrt((x.astype(np.float64) ** 2).sum(1)).max(initial=0))

    bound = longest(q) * longest(c)
    if bound < 2.0**52:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    return (q.astype(object) @ c.astype(object).T).astype(np.int64)


def first_of(scores: np.ndarray, ids: np.ndarray, able: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores among the able ones, ties to the smaller id."""
    at = np.flatnonzero(able)
    if len(at) > k:
        value = scores[at]
        kth = np.partition(value, len(at) - k)[len(at) - k]
        at = at[value >= kth]  # all that tie with the k-th stay until the ids decide
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _packed(rows: DataFrame, tag: str) -> DataFrame:
    """One row for each block and number of components, with its rows as arrays of bytes."""

    def pack(t: pa.Table) -> pa.Table:
        width = t["dim"][0].as_py()
        flat = t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        small = next(k for k in (np.int16, np.int32, np.int64) if len(flat) == 0 or (flat.min() >= np.iinfo(k).min and flat.max() <= np.iinfo(k).max))
        positives = t["positive"].to_pylist()
        out = {
            "dim": pa.array([width], pa.int32()), "block": t["block"].slice(0, 1),
            **{c: [t[c].to_numpy().astype(np.int64).tobytes()] for c in ("number", "id", "label")},
            "vector": [flat.astype(small).tobytes()], "width": pa.array([np.dtype(small).itemsize], pa.int32()),
            "positive": pa.array([[p for some in positives for p in some]], pa.list_(pa.int64())),
            "n_positive": [np.array([len(p) for p in positives], dtype=np.int64).tobytes()],
        }
        return pa.table(out)

    return materialize(rows.groupBy("block", "dim").applyInArrow(pack, _BLOCK), tag)


def _unpacked(t: pa.Table) -> tuple[np.ndarray, ...]:
    number, ids, labels = (np.frombuffer(t[c][0].as_py(), dtype=np.int64) for c in ("number", "id", "label"))
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[t["width"][0].as_py()]
    matrix = np.frombuffer(t["vector"][0].as_py(), dtype=kind).reshape(len(ids), t["dim"][0].as_py())
    return number, ids, labels, matrix


def _tiles(anchors: DataFrame, rows: DataFrame, fn, schema: str) -> DataFrame:
    """Run ``fn`` on each pair of an anchor block and a row block of as many components.

    Each block is copied to the pairs it belongs to; a pair's task holds these two.
    """
    pairs = anchors.select("dim", F.col("block").alias("a")).join(rows.select("dim", F.col("block").alias("r")), "dim")
    left = anchors.withColumnRenamed("block", "a").join(pairs, ["dim", "a"])
    right = rows.withColumnRenamed("block", "r").join(pairs, ["dim", "r"])
    return left.groupBy("dim", "a", "r").cogroup(right.groupBy("dim", "a", "r")).applyInArrow(fn, schema)


def _mined(k: int, low: int, high: int):
    """The pass over sorted keys."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows, out = None, [], []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MINED)], schema=_MINED)

        for batch in batches:
            if not batch.num_rows:
                continue
            for number, anchor, score, kind, row in zip(*(x.tolist() for x in unpack_keys(batch["key"]))):
                if number != now:
                    now, windows = number, []
                if kind == _POSITIVE:
                    windows.append([row, score, low * score, high * score, 0])
                    continue
                for w in windows:
                    if w[4] < k and w[2] <= 100 * score <= w[3]:
                        w[4] += 1
                        out.append((anchor, w[0], w[4], row, w[1], score))
                if len(out) >= ROWS_AT_ONCE:
                    yield done()
                    out = []
        if out:
            yield done()

    return mine


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become floor(scale * x); a row's score is its integer inner
    product with the anchor. An anchor's positives are the ``positives`` first
    rows of its label (higher scores first, ties to the smaller id); each has
    the ``negatives`` first rows of other labels with low * its score <= 100 *
    theirs <= high * its score, ranked from 1. All, if there are fewer.

    Rows whose id, label or vector is null, or whose vector has null, NaN or
    infinite components, take no part. Ids and labels are integers. Vectors are
    compared with those of as many components. A row that repeats another is a
    row, and an anchor, of its own; rows with the anchor's id are no partners
    for it. A score that a long cannot hold fails the job. Other columns are
    ignored.
    """
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & finite)
    rows = usable.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
        F.transform(x, lambda v: F.floor(v * scale)).alias("vector"), F.size(x).alias("dim"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )

    def numbered(of: DataFrame, size: int) -> DataFrame:
        indexed = with_dense_index(of.drop("is_anchor"), ["dim", "id", "label"], "number")
        return indexed.withColumn("block", F.floor(F.col("number") / size))

    none = F.array().cast("array<bigint>").alias("positive")
    blocks = _packed(numbered(rows, block_rows).select("*", none), "row-blocks")
    anchors = materialize(numbered(rows.where("is_anchor"), anchor_rows), "anchors")

    def best(a: pa.Table, r: pa.Table) -> pa.Table:
        number, ids, labels, q = _unpacked(a)
        _, c_ids, c_labels, c = _unpacked(r)
        scores = exact_products(q, c)
        found = [first_of(scores[i], c_ids, (c_labels == labels[i]) & (c_ids != ids[i]), positives) for i in range(len(ids))]
        at = np.concatenate(found)
        row = np.repeat(np.arange(len(ids)), [len(f) for f in found])
        return pa.table({"number": number[row], "anchor": ids[row], "id": c_ids[at], "score": scores[row, at]})

    found = _tiles(_packed(anchors.select("*", none), "anchor-blocks"), blocks, best, "number bigint, anchor bigint, id bigint, score bigint")
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("id"))
    chosen = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    chosen = materialize(chosen.drop("place"), "positives")

    def useful(a: pa.Table, r: pa.Table) -> pa.Table:
        number, ids, labels, q = _unpacked(a)
        _, c_ids, c_labels, c = _unpacked(r)
        bounds = np.split(np.array(a["positive"][0].as_py(), dtype=object), np.cumsum(np.frombuffer(a["n_positive"][0].as_py(), dtype=np.int64))[:-1])
        scores = exact_products(q, c)
        found = []
        for i, some in enumerate(bounds):
            other = (c_labels != labels[i]) & (c_ids != ids[i])
            places = [
                first_of(scores[i], c_ids, other & (scores[i] >= -(-low * p // 100)) & (scores[i] <= high * p // 100), negatives)
                for p in set(some.tolist())
            ]
            found.append(np.unique(np.concatenate(places)))
        at = np.concatenate(found)
        row = np.repeat(np.arange(len(ids)), [len(f) for f in found])
        return pa.table({"key": pack_keys(number[row], ids[row], scores[row, at], _NEGATIVE, c_ids[at])})

    def as_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, anchor, row, score = (b[c].to_numpy() for c in ("number", "anchor", "id", "score"))
            yield pa.RecordBatch.from_arrays([pack_keys(number, anchor, score, _POSITIVE, row)], names=["key"])

    # at most ``positives`` scores an anchor
    bounds = chosen.groupBy("number").agg(F.collect_list("score").alias("positive"))
    asked = _packed(anchors.join(bounds, "number").select(*anchors.columns, "positive"), "asking-blocks")
    keys = _tiles(asked, blocks, useful, "key binary").unionByName(chosen.mapInArrow(as_keys, "key binary"))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartition(n, F.substring("key", 1, 8)).sortWithinPartitions("key")
    return dealt.mapInArrow(_mined(negatives, low, high), _MINED_DDL)
