"""Exact largest inner products, by buckets of similar length.

Vectors are ordered by length and cut into buckets; queries are cut into
blocks. The longest bucket gives each query a first lower bound of its k-th
score. A query then visits the buckets where its length times the bucket's
greatest length can reach that bound, and there takes, by its local cosine
threshold (the bound divided by this product), one of two prunings: by length,
the bucket's vectors that are long enough; by coordinate, those whose focus
coordinates lie where a vector within the threshold's angle must have them.
What remains is verified by its integer product. Each pair of block and bucket
gives k rows a query at most.

Buckets and blocks have a fixed number of rows, so each task's memory is
bounded; data grow by more pairs, never by larger ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtally.operators.ordering import with_dense_index
from voxtally.session import materialize

BUCKET_ROWS = 2048
BLOCK_ROWS = 1024
FOCUS = 4
#: From this local cosine on, coordinates prune better than length.
COORDINATE_FROM = 0.8
_SLACK = 1e-9
_OUT = "_q bigint, query_id bigint, vec_id bigint, score bigint"


def integer_vectors(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """``(_id, _v, _n2)`` of the usable rows: floor(scale * x) as bigint, and the squared length."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & finite)
    rows = rows.select(F.col(id_col).cast("bigint").alias("_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("_v"))
    n2 = F.aggregate("_v", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return rows.withColumn("_n2", n2)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def _products(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Integer products, none larger than the bound: in double precision where
    no sum can pass 2**53, in Python's integers where one may not fit a long."""
    if bound < 2.0**52:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**62:
        return q @ c.T
    return (q.astype(object) @ c.astype(object).T).astype(np.int64)


def _near_coordinates(q: np.ndarray, directions: np.ndarray, cosine: float) -> np.ndarray:
    """Which unit vectors can be within the angle of ``q``, by its largest coordinates."""
    keep = np.ones(len(directions), dtype=bool)
    for f in np.argsort(-np.abs(q))[:FOCUS]:
        spread = np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - q[f] * q[f])))
        # unit vectors at cosine 1 may lie beyond the end of the range that the angle gives
        low = -1.0 if -q[f] >= cosine else q[f] * cosine - spread
        high = 1.0 if q[f] >= cosine else q[f] * cosine + spread
        keep &= (directions[:, f] >= low - 1e-6) & (directions[:, f] <= high + 1e-6)
    return keep


def best_of_bucket(
    q_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int,
    coordinate_from: float = COORDINATE_FROM,
) -> list[tuple[int, int, int]]:
    """``(query row, candidate id, score)``: the k best of the bucket that reach the bound.

    ``bounds`` are scores, -inf for none. Candidates are sorted by descending length.
    """
    q_len = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    c_len = np.sqrt((c.astype(np.float64) ** 2).sum(1))
    longest = c_len.max(initial=0)
    most = float(q_len.max(initial=0) * longest)
    product = q_len * longest
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(product > 0, bounds / product, np.where(bounds > 0, np.inf, -np.inf))
    by_coordinate = (cosine >= coordinate_from) & (cosine <= 1 + _SLACK)
    by_length = cosine < coordinate_from
    out: list[tuple[int, int, int]] = []

    def keep_best(row: int, ids: np.ndarray, scores: np.ndarray) -> None:
        able = (ids != q_ids[row]) & (scores >= bounds[row])
        ids, scores = ids[able], scores[able]
        if len(ids) > k:
            # all that tie with the k-th stay until the ids decide
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            ids, scores = ids[scores >= kth], scores[scores >= kth]
        for i in np.lexsort((ids, -scores))[:k]:
            out.append((row, int(ids[i]), int(scores[i])))

    rows = np.flatnonzero(by_length)
    if len(rows):
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where((q_len > 0) & (bounds > 0), bounds / q_len, 0.0)[rows]
        # lengths descend: a query's candidates are the first ones
        reach = np.searchsorted(-c_len, -need * (1 - _SLACK), side="right")
        scores = _products(q[rows], c[: reach.max(initial=0)], most)
        for at, row in enumerate(rows):
            keep_best(row, c_ids[: reach[at]], scores[at, : reach[at]])
    rows = np.flatnonzero(by_coordinate)
    if len(rows):
        directions = c / np.maximum(c_len, 1e-300)[:, None]
        for row in rows:
            near = _near_coordinates(q[row] / q_len[row], directions, min(1.0, cosine[row]) - _SLACK)
            at = np.flatnonzero(near)
            keep_best(row, c_ids[at], _products(q[row : row + 1], c[at], most)[0])
    return out


def _visits(queries: DataFrame, rows: DataFrame, k: int, coordinate_from: float) -> DataFrame:
    """Score queries, one row for each ``_bucket`` they visit, against those buckets."""
    pairs = queries.select("_block", "_bucket", "_dim").distinct().toDF("_b", "_bucket", "_dim")
    candidates = rows.join(pairs, ["_bucket", "_dim"]).select(
        F.col("_b").alias("_c_block"), F.col("_bucket").alias("_c_bucket"), F.col("_dim").alias("_c_dim"), "_id", "_v", "_n2"
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        keys, q_ids = left["_q"].to_numpy(), left["_id"].to_numpy()
        if left.num_rows and right.num_rows:
            right = right.sort_by([("_n2", "descending"), ("_id", "ascending")])
            out = best_of_bucket(
                q_ids, _matrix(left["_v"], left.num_rows), left["_bound"].to_numpy(),
                right["_id"].to_numpy(), _matrix(right["_v"], right.num_rows), k, coordinate_from,
            )
        row, vec, value = (np.array(x, dtype=np.int64) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"_q": keys[row], "query_id": q_ids[row], "vec_id": vec, "score": value})

    left = queries.groupBy("_block", "_bucket", "_dim")
    right = candidates.groupBy("_c_block", "_c_bucket", "_c_dim")
    return left.cogroup(right).applyInArrow(score, _OUT)


def top_products(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0,
    bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS, coordinate_from: float = COORDINATE_FROM,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best rows, all if there are fewer.

    ``is_query`` is a condition on the input's columns. Rows whose id or
    vector is null, or whose vector has null, NaN or infinite components, take
    no part. Vectors are compared with those of as many components. Ties go
    to the smaller id. A row that repeats another's id and vector is a
    candidate, and a query, of its own; rows with the query's id are no
    candidates for it. A score that a long cannot hold fails the job. Other
    columns are ignored.
    """
    marked = vectors.withColumn("_is_query", F.coalesce(is_query, F.lit(False))).select(
        F.col(id_col), F.col(vector_col), "_is_query"
    )
    flagged = integer_vectors(marked, scale, id_col, vector_col)
    asked = integer_vectors(marked.where("_is_query"), scale, id_col, vector_col)
    dim = F.size("_v").alias("_dim")
    rows = with_dense_index(flagged.select("*", dim), [F.col("_dim"), F.col("_n2").desc(), F.col("_id")], "_at")
    rows = materialize(rows.withColumn("_bucket", F.floor(F.col("_at") / bucket_rows)).drop("_at"), "buckets")
    stats = materialize(rows.groupBy("_bucket", "_dim").agg(F.max("_n2").alias("_max2")), "bucket-lengths")
    queries = with_dense_index(asked.select("*", dim), [F.col("_dim"), F.col("_n2").desc(), F.col("_id")], "_q")
    queries = materialize(queries.withColumn("_block", F.floor(F.col("_q") / block_rows)), "queries")

    # the longest bucket of each number of components
    first = stats.groupBy("_dim").agg(F.min("_bucket").alias("_bucket"))
    start = queries.join(first, "_dim").withColumn("_bound", F.lit(float("-inf")))
    found = materialize(_visits(start, rows, k, coordinate_from), "first-scores")
    kth = found.groupBy("_q").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("_bound")
    )
    bounded = queries.join(kth, "_q", "left").withColumn("_bound", F.coalesce("_bound", F.lit(float("-inf"))))
    later = stats.join(first.withColumnRenamed("_bucket", "_first"), "_dim").where("_bucket > _first")
    # every bucket that can hold a better row; an equi-join, as buckets belong to a number of components
    reach = F.sqrt(F.col("_n2")) * F.sqrt(F.col("_max2")) * (1 + _SLACK) >= F.col("_bound")
    visits = bounded.join(later.select("_dim", "_bucket", "_max2"), "_dim").where(reach)
    all_found = found.unionByName(_visits(visits.drop("_max2"), rows, k, coordinate_from))
    order = Window.partitionBy("_q").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = all_found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
