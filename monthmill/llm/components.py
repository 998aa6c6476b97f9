"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from monthmill.llm.common import stored


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Both steps point nodes at a smaller neighbour by a minimum for each node and a join, so that a node with very many
    neighbours is never collected. The minima are stored first: the join then reads plain rows on both sides, and a
    node with many neighbours can be split. Links are rewritten to shared storage after each round; the rounds grow
    with the logarithm of the longest path.
    """
    links = stored(
        links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
        .distinct(), "links"
    )
    before = _mark(links)
    while before[0]:
        both = links.select("a", "b").union(links.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = stored(least, "least")
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter(F.col("a") != F.col("b")).distinct(), "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        links = stored(small.filter(F.col("a") != F.col("b")).distinct(), "links")
        after = _mark(links)
        if after == before:
            break
        before = after
    own = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return own.union(own.select(F.col("component").alias("node"), "component").distinct())
