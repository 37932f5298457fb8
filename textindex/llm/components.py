"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

MOST_ROUNDS = 60


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): the least node that each node of the edges reaches; roots themselves aren't listed.

    Edges are undirected; loops and repeats don't matter, an edge with a null end is none. Each round is
    written to the shared folder. A node's least neighbour is a table of its own, so that the
    join which hands it to the node's edges can split a node that very many edges meet at.
    Rounds grow with the logarithm of the longest path; no driver and no task holds a component.
    """
    ends = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"), (F.col(u).isNotNull() & F.col(v).isNotNull()).alias("ok"))
    e = shared_table(ends.where("ok and u <> v").select("u", "v").distinct(), "edges")
    seen = None
    for _ in range(MOST_ROUNDS):
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(mark) == seen or not mark["n"]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(mark)
        # large star: every neighbour above a node goes to the least of the node and its neighbours
        both = e.union(e.select("v", "u")).toDF("x", "y")
        least = shared_table(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), F.least("x", "m").alias("m")), "least")
        large = both.where("y > x").join(least, F.col("x") == F.col("k")).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = shared_table(large, "large")
        # small star: every neighbour below a node, and the node, goes to the least of them
        least = shared_table(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), "least")
        moved = large.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = shared_table(moved.union(least.select("k", "m")).distinct(), "edges")
    raise RuntimeError("the components did not settle")
