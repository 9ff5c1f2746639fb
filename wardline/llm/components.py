"""Connected components of a graph that no single machine has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.sources.storage import written


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u, v) with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # every v > m: m is the least of u and its neighbours
    centre = large.groupBy("u").agg(F.min("v").alias("m"))
    linked = large.join(centre, "u")
    small = linked.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(centre.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(u as decimal(38)))")).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link, the root being the component's least node.

    ``links`` has two bigint columns ``a`` and ``b``; direction, repetition and links of a
    node to itself do not matter, links with a null are left out. Rounds of joins end when
    a round changes nothing, after about the logarithm of the longest path; each is
    written to the checkpoint folder. Only counts reach the driver.
    """
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        edges = written(_stars(edges))
        if (after := _mark(edges)) == mark:
            break
        mark = after
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.union(ends.select(F.col("root").alias("node"), "root").distinct())
