"""Graphs as tables of edges: components and ranks, by rounds of joins that are written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .joins import spread_join


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of edges (a, b): the smallest node that it reaches.

    Large and small stars in turn: greater neighbours are linked to the smallest neighbour of a node, then smaller ones.
    Each step takes a minimum for each node, summed up before the shuffle, and joins it back without bringing the edges of
    a node together, so a node may have any number of edges. It ends when every component is one star. Edges that repeat,
    loops and nulls change nothing.
    """
    table = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = table.unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = written(spread_join(both.where("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = spread_join(large, least, ["a"]).select("a", "b", "m")
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        table = written(small, "small-star")
        # Stars only: each leaf has one centre, and no centre is a leaf.
        centres = table.select(F.col("b").alias("a")).distinct()
        if table.join(centres, "a", "left_semi").isEmpty() and table.groupBy("a").count().where("count > 1").isEmpty():
            break
    return table.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(table.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
