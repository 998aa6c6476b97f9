"""Scope trees as edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ancestors(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(scope, ancestor) up to `depth` levels; trees here have a fixed, small number of levels."""
    up = start.join(edges, "scope").select("scope", F.col("parent").alias("ancestor"))
    out = up
    for _ in range(depth - 1):
        up = up.join(edges.select(F.col("scope").alias("ancestor"), F.col("parent").alias("next")), "ancestor").select(
            "scope", F.col("next").alias("ancestor")
        )
        out = out.unionByName(up)
    return out


def cycles(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Scopes that are their own ancestor within `depth` levels; must be empty."""
    return ancestors(edges, start, depth).filter(F.col("scope") == F.col("ancestor")).select("scope").distinct()


def leaf_scopes(edges: DataFrame, selected: DataFrame, depth: int) -> DataFrame:
    """Selected scopes that are not an ancestor of another selected scope."""
    parents = ancestors(edges, selected, depth).select(F.col("ancestor").alias("scope")).distinct()
    return selected.join(parents, "scope", "left_anti")
