"""Connected components of an undirected edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import materialise


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the least node of each node's component, for every node with an edge.

    ``edges`` has (src, dst) of one orderable type; direction, loops and repeats don't matter. Each round joins every
    node's larger neighbours to its least one, then every node's smaller ones, until nothing changes; a round halves
    long paths, and each round is written to the shared folder. The least neighbour is found by a partial aggregate,
    so a node that a third of all edges touch isn't gathered in one task.
    """
    current = materialise(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        current = materialise(small.where("u <> v").distinct(), "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components: not settled")
    nodes = edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(current.toDF("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
