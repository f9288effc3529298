"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is a node of
    its component.

    Each round points every node to its least neighbour, follows the pointer
    of that one too, and maps the edges to the pointers. Nodes that keep
    pointing to themselves have only larger neighbours, so every round at least
    halves the nodes that still have edges. Each round is a staged table; only
    the count of open edges reaches the driver.
    """
    open_edges = stage(edges.select("a", "b").filter("a != b").distinct(), "cc-edges")
    roots: DataFrame | None = None
    while not open_edges.isEmpty():
        both = open_edges.unionAll(open_edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("up"))
        up = stage(up, "cc-up")
        over = up.select(F.col("node").alias("up"), F.col("up").alias("root"))
        to = stage(up.join(over, "up").select("node", "root"), "cc-to")
        if roots is None:
            roots = to
        else:
            hop = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = stage(roots.join(hop, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "cc-roots")
        a, b = to.select(F.col("node").alias("a"), F.col("root").alias("x")), to.select(F.col("node").alias("b"), F.col("root").alias("y"))
        moved = open_edges.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        open_edges = stage(moved.filter("a != b").distinct(), "cc-edges")
    return roots if roots is not None else open_edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
