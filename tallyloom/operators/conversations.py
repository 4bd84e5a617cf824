"""Conversation trees and their snapshots in several files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def visible_branch(nodes: DataFrame, current: DataFrame) -> DataFrame:
    """Nodes (conv_id, id, parent, ...) on the path from each conversation's current node to its root.

    A conversation's parents are one map, so the walk is one pass and no join a
    level; its length is bounded by the conversation's number of nodes, and a
    cycle ends where it closes.
    """
    maps = nodes.where("parent is not null").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "parent"))).alias("up"))
    walk = current.join(maps, "conv_id", "left").select("conv_id", "current_node", "up")

    def step(path, _):
        above = F.try_element_at(F.col("up"), F.element_at(path, -1))
        return F.when(above.isNull() | F.array_contains(path, above), path).otherwise(F.concat(path, F.array(above)))

    steps = F.sequence(F.lit(0), F.coalesce(F.size("up"), F.lit(0)))
    path = F.aggregate(steps, F.array("current_node"), step)
    kept = walk.select("conv_id", F.explode(F.when(F.col("up").isNull(), F.array("current_node")).otherwise(path)).alias("id"))
    return nodes.join(kept, ["conv_id", "id"])


def best_snapshots(rows: DataFrame, key: str, size: str, file: str) -> DataFrame:
    """Of a conversation's snapshots the one with most messages, whatever the order of files."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(size), file))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
