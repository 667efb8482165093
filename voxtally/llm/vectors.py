"""Near duplicates of embeddings by sorted projection passes.

Each pass gives every vector some random hyperplane signs, orders all vectors
of a label by them lexicographically, and compares each vector with the
neighbours in its window of that order. Vectors that are close agree in long
prefixes, so some pass brings them together; pairs with the wanted cosine
are united over all passes.

Windows are bounded, so they find neither all links nor all components; they
only say what lies together. Counting and what the passes have missed are
exact: each label is cut into blocks, those of a large component apart from
the others, and all blocks of the label are compared, but where two blocks lie
so close (or so far) that the angles between their centres and to their
members decide for all pairs, the blocks' sizes are added instead. Tasks give
counts and a few links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtally.llm.components import components
from voxtally.operators.ordering import with_dense_index
from voxtally.session import materialize

PASSES = 12
SIGNS = 48
WINDOW = 256
BLOCK = 512
#: Blocks on each side of what one task compares.
TILE = 4
COSINE = 0.98
_SLACK = 1e-7


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """``(_id, _label, _dim, _v)`` of the vectors that can have links, scaled to length one."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    label = F.col(label_col) if label_col else F.lit("")
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull() & finite)
    rows = rows.select(F.col(id_col).cast("bigint").alias("_id"), label.cast("string").alias("_label"), x.alias("_v"))
    # first by the largest component, so that squares neither overflow nor vanish
    top = F.array_max(F.transform("_v", lambda v: F.abs(v)))
    rows = rows.withColumn("_top", top).where(F.col("_top") > 0)
    rows = rows.withColumn("_v", F.transform("_v", lambda v: v / F.col("_top")))
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, v: a + v * v))
    rows = rows.withColumn("_len", length).withColumn("_v", F.transform("_v", lambda v: v / F.col("_len")))
    return rows.select("_id", "_label", F.size("_v").alias("_dim"), "_v")


def _signs(dim: int, at: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, at, dim]).normal(size=(dim, SIGNS))


def with_hashes(rows: DataFrame, passes: int, seed: int) -> DataFrame:
    """``(_pass, _label, _dim, _hash, _row)``: a row for each vector and pass, without the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        powers = 1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch.column("_dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                x = _matrix(pa.chunked_array([some.column("_v")]), some.num_rows)
                for at in range(passes):
                    plane = planes.setdefault((int(dim), at), _signs(int(dim), at, seed))
                    value = ((x @ plane) > 0) @ powers
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(some.num_rows, at), pa.int32()), some.column("_label"), some.column("_dim"),
                         pa.array(value, pa.int64()), some.column("_row")],
                        names=["_pass", "_label", "_dim", "_hash", "_row"],
                    )

    return rows.mapInArrow(run, "_pass int, _label string, _dim int, _hash bigint, _row bigint")


def _spanning(near: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Fewest links that unite what a matrix of near pairs unites."""
    seen = np.zeros(len(ids), dtype=bool)
    links = []
    for start in range(len(ids)):
        if seen[start]:
            continue
        seen[start] = True
        front = [start]
        while front:
            at = front.pop()
            new = np.flatnonzero(near[at] & ~seen)
            seen[new] = True
            front += new.tolist()
            links += [(int(ids[at]), int(ids[j])) for j in new]
    return links


def window_links(rows: DataFrame, hashed: DataFrame, cosine: float, window: int) -> DataFrame:
    """``(a, b)``: links found between neighbours of each pass, as few as unite them.

    Each order is cut into windows; a window is compared with itself and the
    next one, so every vector meets at least ``window`` neighbours on each
    side. The rows of a window travel twice.
    """
    ordered = with_dense_index(hashed, ["_pass", "_dim", "_label", "_hash", "_row"], "_at")
    at = F.floor(F.col("_at") / window)
    placed = ordered.select("_pass", "_label", "_row", F.explode(F.array(at, at - 1)).alias("_window"))
    full = placed.join(rows.select("_row", "_dim", "_v"), "_row")

    def compare(group: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        dims, labels = group["_dim"].to_numpy(), np.array(group["_label"].to_pylist(), dtype=object)
        keys = {(d, s, p) for d, s, p in zip(dims, labels, group["_pass"].to_numpy())}
        passes = group["_pass"].to_numpy()
        for d, s, p in keys:
            some = group.filter(pa.array((dims == d) & (labels == s) & (passes == p)))
            x, ids = _matrix(some["_v"], some.num_rows), some["_row"].to_numpy()
            order = np.argsort(ids)
            x, ids = x[order], ids[order]
            links += _spanning(x @ x.T >= cosine, ids)
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return full.groupBy("_window").applyInArrow(compare, "a bigint, b bigint").distinct()


def _unite(near: np.ndarray, a: np.ndarray, b: np.ndarray, component: np.ndarray, links: list[tuple[int, int]]) -> None:
    """Unite the components that near pairs of the rows ``a`` and ``b`` tie together, and note the links."""
    apart = near & (component[a][:, None] != component[b][None, :])
    for i in np.flatnonzero(apart.any(1)):
        own = component[a[i]]
        for other in np.unique(component[b[near[i]]]):
            if other != own:
                links.append((int(own), int(other)))
                component[component == other] = own


def exact_links(members: DataFrame, cosine: float, block: int) -> tuple[DataFrame, DataFrame]:
    """``(_row, n_links)`` of every row over all rows of its label, and ``(a, b)``, the components so far that are one.

    ``members`` has ``_row, _dim, _label, _cut, _at, _component, _v``. The rows
    of a label and cut are dealt into blocks along ``_at``; pairs of a label's
    blocks that centre and radius decide are not opened. Opened pairs are
    compared in tiles of neighbouring blocks.
    """
    members = members.withColumn("_slot", F.floor(F.col("_at") / block))
    keys = ["_dim", "_label", "_cut", "_slot"]

    def centre(group: pa.Table) -> pa.Table:
        x = _matrix(group["_v"], group.num_rows)
        mean = x.mean(0)
        length = np.linalg.norm(mean)
        mean = mean / length if length > 0 else x[0]
        return pa.table({
            **{k: group[k][:1] for k in keys}, "_block": pa.array([group["_at"].to_numpy().min()], pa.int64()),
            "_n": pa.array([group.num_rows], pa.int64()),
            "_centre": pa.array([mean.tolist()], pa.list_(pa.float64())),
            "_radius": pa.array([float(np.arccos(np.clip(x @ mean, -1, 1)).max())], pa.float64()),
        })

    kind = "_dim int, _label string, _cut bigint, _slot bigint, _block bigint, _n bigint, _centre array<double>, _radius double"
    centres = materialize(members.groupBy(*keys).applyInArrow(centre, kind), "centres")
    rows = members.join(centres.select(*keys, "_block"), keys)
    rows = materialize(rows.select("_row", "_component", "_block", "_v"), "blocks")

    left = centres.select("_dim", "_label", F.col("_block").alias("_x"), "_n", "_centre", "_radius")
    other = centres.select("_dim", "_label", F.col("_block").alias("_y"), F.col("_n").alias("_n2"),
                           F.col("_centre").alias("_centre2"), F.col("_radius").alias("_radius2"))
    pairs = left.join(other, ["_dim", "_label"]).where(F.col("_x") <= F.col("_y"))
    dot = F.aggregate(F.zip_with("_centre", "_centre2", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    reach = F.col("_radius") + F.col("_radius2")
    limit = float(np.arccos(cosine))
    pairs = pairs.withColumn("_angle", angle).where(F.col("_angle") - reach <= limit + _SLACK)
    pairs = pairs.withColumn("_all", F.col("_angle") + reach < limit - _SLACK)
    pairs = materialize(pairs.select("_dim", "_label", "_x", "_y", "_n", "_n2", "_all"), "block-pairs")

    sure = pairs.where("_all")
    sizes = sure.select(F.col("_x").alias("_block"), F.col("_n2").alias("_add")).unionByName(
        sure.where("_x < _y").select(F.col("_y").alias("_block"), F.col("_n").alias("_add"))
    )
    sizes = materialize(sizes.groupBy("_block").agg(F.sum("_add").alias("_add")), "sure")
    counted = rows.select("_block", "_row").join(sizes, "_block").select("_row", F.col("_add").alias("_n"))
    # all of a block that is sure of another, or of itself, is one component
    owned = rows.select("_block", "_component").join(sizes, "_block").select("_block", "_component").distinct()
    heads = owned.groupBy("_block").agg(F.min("_component").alias("_head"))
    inside = owned.join(heads, "_block").select(F.col("_component").alias("a"), F.col("_head").alias("b"))
    across = sure.where("_x < _y").join(heads.toDF("_x", "a"), "_x").join(heads.toDF("_y", "b"), "_y").select("a", "b")

    tile = lambda c: F.floor(F.col(c) / (block * TILE)).alias(f"_tile{c}")
    opened = pairs.where("not _all").select("_dim", "_label", tile("_x"), tile("_y"), "_x", "_y")
    tiles = ["_dim", "_label", "_tile_x", "_tile_y"]
    sides = opened.select(*tiles, F.col("_x").alias("_block"), F.col("_y").alias("_other")).unionByName(
        opened.where("_x < _y").select(*tiles, F.col("_y").alias("_block"), F.lit(None).cast("bigint").alias("_other"))
    )
    # as many others as a tile has blocks on a side
    sides = materialize(sides.groupBy(*tiles, "_block").agg(F.collect_set("_other").alias("_others")), "tiles")
    dealt = rows.join(sides, "_block")

    def count(group: pa.Table) -> pa.Table:
        x, ids, own = _matrix(group["_v"], group.num_rows), group["_row"].to_numpy(), group["_block"].to_numpy()
        component = group["_component"].to_numpy().copy()
        blocks, first = np.unique(own, return_index=True)
        places = {int(b): np.flatnonzero(own == b) for b in blocks}
        found, links = np.zeros(len(ids), dtype=np.int64), []
        for i, b in zip(first, blocks):
            for other in group["_others"][int(i)].as_py():
                mine, theirs = places[int(b)], places[other]
                near = x[mine] @ x[theirs].T >= cosine
                found[mine] += near.sum(1)
                if other != b:
                    found[theirs] += near.sum(0)
                _unite(near, mine, theirs, component, links)
        a, b = zip(*links) if links else ((), ())
        none = [None] * len(links)
        return pa.table({
            "_row": pa.array([*ids.tolist(), *none], pa.int64()), "_n": pa.array([*found.tolist(), *none], pa.int64()),
            "a": pa.array([*[None] * len(ids), *a], pa.int64()), "b": pa.array([*[None] * len(ids), *b], pa.int64()),
        })

    compared = dealt.groupBy(*tiles).applyInArrow(count, "_row bigint, _n bigint, a bigint, b bigint")
    compared = materialize(compared, "compared")
    # every row has met itself once
    counts = counted.unionByName(compared.where("_row is not null").select("_row", "_n"))
    counts = counts.groupBy("_row").agg((F.sum("_n") - 1).alias("n_links"))
    return counts, compared.where("_row is null").select("a", "b").unionByName(inside).unionByName(across)


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, label_col: str | None = "label", passes: int = PASSES,
    window: int = WINDOW, block: int = BLOCK, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``(id, n_links bigint, component_id bigint, kept boolean)``, one row per input row.

    Vectors link if their labels are equal and not null, they have as many
    components, and their cosine in double precision reaches the bound.
    Vectors that are null, zero or have null, NaN or infinite components, and
    rows without an id, link with nothing; their component is their id. Rows
    that repeat an id and a vector link with each other like any others.
    Other columns are ignored.
    """
    narrow = vectors.select(F.col(id_col), F.col(vector_col), *([F.col(label_col)] if label_col else []))
    rows = with_dense_index(usable(narrow, id_col, vector_col, label_col), ["_id", "_label"], "_row")
    rows = materialize(rows, "vectors")
    hashed = materialize(with_hashes(rows, passes, seed), "hashes")
    found = components(window_links(rows, hashed, cosine, window)).toDF("_row", "_component")
    found = materialize(found, "components")
    large = found.groupBy("_component").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > block)
    large = large.select("_component", F.col("_component").alias("_cut"))
    known = found.join(large, "_component", "left")
    first = hashed.where("_pass = 0").drop("_pass").join(known, "_row", "left")
    first = first.withColumns({"_component": F.coalesce("_component", "_row"), "_cut": F.coalesce("_cut", F.lit(-1).cast("bigint"))})
    first = materialize(with_dense_index(first, ["_dim", "_label", "_cut", "_hash", "_row"], "_at"), "first-pass")
    members = first.drop("_hash").join(rows.select("_row", "_v"), "_row")
    counts, links = exact_links(members, cosine, block)
    united = materialize(components(links), "united").toDF("_component", "_united")
    # the component's name is its smallest id; rows are numbered by id
    names = rows.select(F.col("_row").alias("_united"), F.col("_id").alias("component_id"))
    whole = first.select("_row", "_component").join(united, "_component", "left")
    whole = whole.withColumn("_united", F.coalesce("_united", "_component")).join(names, "_united").join(counts, "_row")
    done = rows.select("_row", "_id").join(whole, "_row").select("_id", "n_links", "component_id")
    kind = vectors.schema[id_col].dataType
    x = F.col(vector_col).cast("array<double>")
    able = F.coalesce(
        x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0),
        F.lit(False),
    ) & F.col(id_col).isNotNull() & (F.col(label_col).isNotNull() if label_col else F.lit(True))
    alone = narrow.where(~able).select(
        F.col(id_col).cast("bigint").alias("_id"), F.lit(0).cast("bigint").alias("n_links"), F.col(id_col).cast("bigint").alias("component_id")
    )
    both = done.unionByName(alone)
    return both.select(
        F.col("_id").cast(kind).alias(id_col), F.col("n_links").cast("bigint").alias("n_links"), "component_id",
        F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
