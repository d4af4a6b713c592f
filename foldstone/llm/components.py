"""Connected components of a link table by repeated contraction, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node that is reachable.

    Each round hangs every node below its smallest neighbour, follows that twice, and joins the
    roots' links; a round at least halves the nodes that still have links."""
    spark = edges.sparkSession
    edges = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    assigned = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        for _ in range(2):
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            parent = parent.join(above, "up", "left").select("node", F.coalesce("upper", "up").alias("up"))
        parent = staged(parent, "parents")
        if assigned is None:
            following = parent.select("node", F.col("up").alias("root"))
        else:
            above = parent.select(F.col("node").alias("root"), "up")
            following = assigned.join(above, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            following = staged(following, "roots")
            drop_staged(assigned)
        assigned = following
        up_a = parent.select(F.col("node").alias("a"), F.col("up").alias("x"))
        up_b = parent.select(F.col("node").alias("b"), F.col("up").alias("y"))
        rest = edges.join(up_a, "a").join(up_b, "b").where("x <> y")
        rest = staged(rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        drop_staged(edges)
        edges = rest
    if assigned is None:
        return spark.createDataFrame([], f"node {dict(edges.dtypes)['a']}, root {dict(edges.dtypes)['a']}")
    return assigned
