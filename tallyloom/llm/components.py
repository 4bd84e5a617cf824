"""Connected components of an undirected graph whose edges are a DataFrame.

Alternating large-star and small-star steps (Kiveris et al., Connected
Components in MapReduce and Beyond, 2014).  Minima come from partial
aggregates and go back by joins that Spark may split, so a node that a third
of all edges touch is no single task's work.  Nothing goes to the driver but
two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    edges: two columns of the same ordered type; direction, repeats and loops
    don't matter, rows with a null are left out.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    now = scratch.write(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), f"{name}-0")
    state, k = None, 0
    while True:
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state, k = new, k + 1
        now = scratch.write(_small_star(_large_star(now)), f"{name}-{k}")
        if k > 1:
            scratch.drop(f"{name}-{k - 2}")
    # The graph is now a forest of stars: every node points at its component's least node.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
