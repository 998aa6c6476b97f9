"""Read-side shapes: labels, dashboards, matrices, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F




def temporal_label(target: Column, created: Column, current_month: Column) -> Column:
    timing = F.when(created.isNull(), "no calculation").when(created >= target, "issued after start").otherwise("issued before month")
    position = F.when(target < current_month, "elapsed").when(target == current_month, "current").otherwise("future")
    return F.concat_ws(" / ", position, timing)


def covered_sum(value: Column, name: str) -> list[Column]:
    """Sum of what is present, how many rows had a value, how many could have had one."""
    return [F.sum(value).alias(name), F.count(value).alias(f"{name}_covered"), F.count(F.lit(1)).alias(f"{name}_eligible")]


def strict_sum(value: Column) -> Column:
    """Null as soon as one member is null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def fill_rate(delivery: Column, order: Column) -> Column:
    return F.when(order > 0, 100 * delivery / order)


def ratio(numerator: Column, denominator: Column) -> Column:
    """100 when both are zero, null when only the denominator is."""
    return F.when(denominator != 0, 100 * numerator / denominator).when(numerator == 0, 100.0)


