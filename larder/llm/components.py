"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from larder.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of the links (a, b); a component is named by its smallest node.

    Large-star and small-star steps in turn: each node hands its neighbours, first the larger and then the smaller ones, to
    the smallest of them, until every node is linked with the smallest of its component alone. The number of rounds
    grows with the logarithm of a component's size. Counts decide when nothing changes; no node is collected.
    """
    edges, state = _counted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "at")
        large = both.join(least, F.col("u") == F.col("at")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "at")
        small = large.join(least, F.col("u") == F.col("at"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("at").alias("u"), F.col("m").alias("v")))
        before = state
        edges, state = _counted(small.filter("u > v").distinct())
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, their number and a sum of their hashes, all from the job that writes them."""
    seen = Observation()
    mark = F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))), F.lit(0))
    edges = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), mark.alias("mark")), "links")
    return edges, (seen.get["n"], seen.get["mark"])
