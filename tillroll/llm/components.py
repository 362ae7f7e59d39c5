"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import stored


def _smallest(edges: DataFrame) -> DataFrame:
    """(node, least) with the smallest of a node and its neighbours in directed ``edges`` (a, b)."""
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Tie neighbours to the smallest node around: larger neighbours, or smaller ones and the node.

    ``edges`` is directed; the smallest node comes from an aggregate that runs before
    the shuffle too, and a hub's rows may be split by the join, so no star needs to fit
    one task.
    """
    least = _smallest(edges).select(F.col("node").alias("a"), F.least("node", "least").alias("least"))
    tied = edges.join(least, "a")
    if larger:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint); component is its smallest node.

    Each turn ties nodes to smaller ones (large star, then small star) and is written to
    the shared folder; turns end when the edges no longer change, after a number that
    grows with the logarithm of the longest path.
    """
    edges = stored(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = stored(_star(_star(both, True), False), "edges")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number and checksums of the edges."""
    mixed = F.xxhash64("a", "b")
    return tuple(
        edges.agg(
            F.count("*"),
            F.coalesce(F.bit_xor(mixed), F.lit(0)),
            F.coalesce(F.bit_xor(F.xxhash64(mixed)), F.lit(0)),
        ).first()
    )
