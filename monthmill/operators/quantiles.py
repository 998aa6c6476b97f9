"""Exact quantiles of groups of any size.

`percentile` keeps every distinct value of a group in one buffer; that is fine for
a group bounded by the calendar, not for a whole chain. Here the rows are counted
per value (map-side combine), two fixed logarithmic histograms find the narrow
cell that holds each wanted rank, and only the values of that cell are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Cells per doubling of the value at the two narrowing levels.
LEVELS = (64.0, 65536.0)


def _cell(value: Column, per_doubling: float) -> Column:
    size = F.floor(F.log2(F.abs(value) + 1.0) * per_doubling)
    return F.when(value < 0, -size).otherwise(size)


def exact_quantiles(
    rows: DataFrame, keys: list[str], value: str, probabilities: list[float], weight: str | None = None
) -> DataFrame:
    """keys, n, quantiles (array in the order of `probabilities`), linear interpolation.

    `weight` names a column of whole counts when rows are already counted per value.
    """
    size = F.sum(weight) if weight else F.count(F.lit(1))
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(size.alias("c"))
    totals = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    position = F.col("p") * (F.col("n") - 1)
    wanted = (
        totals.select("*", F.posexplode(F.array(*[F.lit(p) for p in probabilities])).alias("pos", "p"))
        .select(
            *keys, "n", "pos", (position - F.floor(position)).alias("frac"),
            F.posexplode(F.array(F.floor(position), F.ceil(position))).alias("side", "rank"),
        )
        .withColumn("skip", F.lit(0).cast("bigint"))
    )
    located = counts
    parent: list[str] = []
    for level, per_doubling in enumerate(LEVELS):
        cell = f"cell{level}"
        located = located.withColumn(cell, _cell(F.col(value), per_doubling))
        hist = located.groupBy(*keys, *parent, cell).agg(F.sum("c").alias("c"))
        w = Window.partitionBy(*keys, *parent).orderBy(cell)
        hist = hist.withColumn("before", F.sum("c").over(w) - F.col("c"))
        wanted = (
            wanted.join(hist, [*keys, *parent])
            .filter(
                (F.col("rank") >= F.col("skip") + F.col("before"))
                & (F.col("rank") < F.col("skip") + F.col("before") + F.col("c"))
            )
            .withColumn("skip", F.col("skip") + F.col("before"))
            .drop("before", "c")
        )
        parent = [*parent, cell]
    needed = wanted.select(*keys, *parent).distinct()
    inside = located.join(needed, [*keys, *parent], "left_semi")
    w = Window.partitionBy(*keys, *parent).orderBy(value)
    inside = inside.withColumn("before", F.sum("c").over(w) - F.col("c"))
    picked = wanted.join(inside, [*keys, *parent]).filter(
        (F.col("rank") >= F.col("skip") + F.col("before")) & (F.col("rank") < F.col("skip") + F.col("before") + F.col("c"))
    )
    sides = picked.groupBy(*keys, "n", "pos", "frac").agg(
        F.max(F.when(F.col("side") == 0, F.col(value))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col(value))).alias("hi")
    )
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac")
    return sides.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("pos", at.alias("q")))).alias("q")).select(
        *keys, "n", F.transform("q", lambda x: x["q"]).alias("quantiles")
    )
