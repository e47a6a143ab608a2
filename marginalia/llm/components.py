"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``links`` (a, b).

    Large and small stars in turn: every node hands its larger, then its smaller neighbours to the smallest node it
    knows, until all links of a component meet in its smallest node.  The number of links never grows.  Each round
    is written to the shared folder.
    """
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    edges = stored(pairs.distinct(), "links")
    mark = _mark(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).filter("a < b")
        edges = stored(small.distinct(), "links")
        now = _mark(edges)
        if now == mark:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())
        mark = now


def _mark(edges: DataFrame):
    """Tells sets of links apart."""
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def chains(parents: DataFrame) -> DataFrame:
    """(node, component) of ``parents`` (a, b), in which each node b has one smaller parent a: the end of its chain.

    Each round doubles the steps, so a chain of length n takes about log2(n) rounds.
    """
    reach = stored(parents.select(F.col("b").alias("node"), F.col("a").alias("component")), "chains")
    while True:
        above = reach.select(F.col("node").alias("component"), F.col("component").alias("far"))
        if reach.join(above, "component", "left_semi").isEmpty():
            break
        further = reach.join(above, "component", "left")
        reach = stored(further.select("node", F.coalesce("far", "component").alias("component")), "chains")
    return reach.union(reach.select("component", "component").distinct())


def connected(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component) with ``links`` (a, b) added: only the components that these touch are worked on."""
    side = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    known = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    between = known.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    joined = stored(components(between), "components").select(F.col("node").alias("component"), F.col("component").alias("least"))
    # A node without a component so far is one by itself.
    single = joined.select(F.col("component").alias("node")).join(found, "node", "left_anti")
    every = found.unionByName(single.select("node", F.col("node").alias("component")))
    return every.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
