"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step replaces the neighbours' edges of a node by edges to the smallest node it knows, so the edges of a component
shrink to a star around its smallest node in a few rounds. Every round is a group-wise minimum (combined before its
shuffle) and a join on the node, written to the shared folder; a node with very many edges is a skewed key of that join,
which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.base import saved


def _step(edges: DataFrame, large: bool) -> DataFrame:
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    known = edges.unionByName(back) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = known.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("low"))
    joined = known.join(smallest, F.col("a") == F.col("node"))
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            smallest.select(F.col("node").alias("a"), F.col("low").alias("b"))
        )
    return out.filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node."""
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = None
    while mark != (found := _mark(now)):
        mark = found
        now = saved(_step(saved(_step(now, True), "cc"), False), "cc")
    low = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        low.select("node", F.col("node").alias("component"))
    )
