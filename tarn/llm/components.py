"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import Workspace, join_groups


#: Edges a partition of a written state has at least, so that late rounds are not many tiny tasks.
FEW = 50_000


def _least(edges: DataFrame) -> DataFrame:
    """(u, m, n): each node's least neighbour and number of edges."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _stars(ws: Workspace, edges: DataFrame, count: int) -> DataFrame:
    """One large-star and one small-star step; edges (u, v) with u > v, both steps keep components.

    The edges of a node get its least neighbour by a join on the node; nodes
    with a large part of all edges are broadcast with theirs.
    """
    parts = 1 + count // FEW
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("u", "m"))
    large = join_groups(both, least, "u", "n", 2 * count).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = ws.table(large.distinct().coalesce(parts))
    least = _least(large)
    small = join_groups(large, least, "u", "n", count).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionAll(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts)


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge and is not itself the least of its component.

    ``edges`` has long columns ``a`` and ``b``, without nulls; repeated edges and
    edges of a node to itself do no harm, and no edges give no rows.  Each round
    shuffles the edges by node with partial minima; no neighbourhood is
    collected.  Rounds are logarithmic in the longest path, and each is cut from
    the last by a table.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = ws.table(edges.distinct())

    def state(frame: DataFrame) -> tuple:
        mixed = frame.select(F.xxhash64("u", "v").alias("h"))
        return tuple(mixed.agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h") % 1000003)).first())

    now = state(edges)
    while now[0]:
        edges = ws.table(_stars(ws, edges, now[0]))
        before, now = now, state(edges)
        if before == now:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
