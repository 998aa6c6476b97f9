"""Matching months to validity intervals by an equi-join.

A month range is cut into dyadic nodes, at most two a level, each the range of months that agree in all but their last
`level` bits. A month lies in exactly one node of every level and in at most one node of a range, so a join on
(level, node) finds every range that holds a month exactly once, without comparing a month to ranges that do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from monthmill.functions.periods import month_index

LEVELS = 12  # 4,096 months
FIRST_YEAR = 1800


def month_number(day: Column) -> Column:
    """Months since January of FIRST_YEAR."""
    return (month_index(day) - FIRST_YEAR * 12).cast("int")


def cover(start: Column, end: Column) -> Column:
    """The nodes (level, node) of the range from start to end, both months included.

    Null ends are open; an empty range has no nodes. From the lowest level up, an odd first node and an even last one
    cannot be part of a larger node inside the range: they are taken, and the rest is halved.
    """
    last = 2 ** LEVELS - 1
    a = F.greatest(F.lit(0), F.coalesce(month_number(start), F.lit(0)))
    b = F.least(F.lit(last), F.coalesce(month_number(end), F.lit(last)))
    none = F.array().cast("array<struct<level: int, node: int>>")

    def step(s: Column, level: Column) -> Column:
        first, final = s["a"], s["b"]
        left = (first <= final) & (first % 2 == 1)
        moved = F.when(left, first + 1).otherwise(first)
        right = (moved <= final) & (final % 2 == 0)
        rest = F.when(right, final - 1).otherwise(final)
        more = moved <= rest
        node = lambda take, n: F.when(take, F.array(F.struct(level.alias("level"), n.alias("node")))).otherwise(none)
        return F.struct(
            F.when(more, F.shiftright(moved, 1)).otherwise(0).alias("a"), F.when(more, F.shiftright(rest, 1)).otherwise(-1).alias("b"),
            F.concat(s["out"], node(left, first), node(right, final)).alias("out"))

    nodes = F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), F.struct(a.alias("a"), b.alias("b"), none.alias("out")), step, lambda s: s["out"])
    return F.when(a <= b, nodes).otherwise(none)


def places(day: Column) -> Column:
    """The node of every level that holds a month."""
    m = month_number(day)
    return F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright(m, level).alias("node")) for level in range(LEVELS + 1)])


def matches(points: DataFrame, ranges: DataFrame, keys: list[str], period: str, start: str, end: str) -> DataFrame:
    """Distinct (keys, period) of the points with the columns of every range that holds them.

    Only distinct points are spread over the levels, so the work is that of the points, the ranges and the matches.
    """
    spread = points.select(*keys, period).distinct().select("*", F.inline(places(F.col(period))))
    cut = ranges.select("*", F.inline(cover(F.col(start), F.col(end))))
    return spread.join(cut, [*keys, "level", "node"]).drop("level", "node")
