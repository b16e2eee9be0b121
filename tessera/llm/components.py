"""Connected components of a table of links, without gathering them anywhere.

Large-star and small-star steps in turn: each joins every node's neighbours to the least node seen, until
the links form stars. Both steps only aggregate minima, at first within the tasks, and join on the node.
The join has a key of its own, so that its sides are exchanged apart from the aggregate and the adaptive
skew join may split a hot node's links; each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed


def _least(links: DataFrame, node: str, least: DataFrame) -> DataFrame:
    """``links`` with the column m of their node's row in ``least``."""
    apart = lambda c: F.col(c).bitwiseXOR(F.lit(1).cast("long"))
    return links.withColumn("__k", apart(node)).join(least.select(apart(node).alias("__k"), "m"), "__k").drop("__k")


def _large(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _least(both.filter("v > u"), "u", least).select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b")


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    moved = _least(e, "b", least).select(F.col("m").alias("x"), F.col("a").alias("y")).filter("x <> y")
    own = least.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return moved.unionByName(own).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every node has one link at most to a lesser one, and that one none."""
    n = e.agg(F.count("*"), F.count_distinct("b")).first()
    return n[0] == n[1] and e.select("a").join(e.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of the links a, b.

    Rounds grow with the logarithm of the longest chain of links. Loops are ignored, no links give no rows.
    """
    e = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    while not _stars(e):
        e = checkpointed(_small(_large(e)))
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
