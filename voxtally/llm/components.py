"""Connected components of a graph of ids, as a series of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxtally.session import materialize

ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each neighbour of a node to the smallest id around the node.

    A large star moves the neighbours above the node, a small star the ones
    below it (and the node itself). The smallest id is a partial aggregate
    and the rest an equi-join that AQE splits, so a node with very many
    neighbours meets in no task.
    """
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = around.join(least, "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(id, component)`` of every id that has a link: the smallest id it reaches.

    Stars are alternated until nothing changes, which takes about the
    logarithm of the longest path. Each round is a written table; one row, the
    number and a sum of the links, comes to the driver. Links with a null end
    and links to itself count for nothing.
    """
    ends = links.select(F.col(left).cast("bigint").alias("x"), F.col(right).cast("bigint").alias("y")).where("x <> y")
    edges = materialize(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
    before = None
    for i in range(ROUNDS):
        # each star is a table of its own: a star names its input four times, and one on another plans it sixteen times
        moved = materialize(_star(edges, True), f"moved-{i}")
        edges = materialize(_star(moved, False), f"links-{i}")
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == (row["n"], row["s"]):
            break
        before = (row["n"], row["s"])
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
