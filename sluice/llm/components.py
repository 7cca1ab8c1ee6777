"""Connected components of an edge table by rounds of contraction, all in DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); nodes share a root iff a path joins them.

    In each round a node moves to its smallest neighbour if that is smaller, then one step on along such moves;
    edges follow their ends, and those within one node go. At least every non-minimal node of a component moves,
    so the rounds grow with the logarithm of a path's length, and only counts reach the driver. Aggregates
    combine before they shuffle and joins meet one row a node on one side, so a hub's edges are no hot group.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = scratch.keep(both(edges.where("a <> b")).distinct())
    where = None
    while not e.isEmpty():
        step = e.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        step = scratch.keep(step)
        jump = step.alias("s").join(step.select(F.col("a").alias("p"), F.col("p").alias("q")), "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        jump = scratch.keep(jump)
        if where is None:
            where = jump.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            where = where.join(jump.select(F.col("a").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        where = scratch.keep(where)
        moved = e.join(jump, "a").select(F.col("p").alias("a"), "b")
        moved = moved.join(jump.select(F.col("a").alias("b"), F.col("p").alias("q")), "b").select("a", F.col("q").alias("b"))
        e = scratch.keep(moved.where("a <> b").distinct())
    return where if where is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
