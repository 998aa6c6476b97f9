"""Versioned facts: latest version, as-of selection, change logs, validity intervals.

"Latest" is always an aggregate (max_by), which combines on the map side, so a
key that holds a large share of all rows costs no more than any other. Rows are
marked by joining on their unique id, never on the (possibly hot) key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by `order`."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def earliest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def as_of(rows: DataFrame, keys: list[str], row_id: str, available: str, version: str, cutoff: Column) -> DataFrame:
    """Status of every row at the cutoff. The cutoff filters before versions are ranked."""
    known = rows.filter(F.col(available).isNotNull() & (F.col(available) <= cutoff))
    winners = known.groupBy(*keys).agg(
        F.max_by(row_id, F.struct(available, version, row_id)).alias("_winner")
    ).select("_winner")
    status = (
        F.when(F.col(available).isNull(), "availability_unknown")
        .when(F.col(available) > cutoff, "available_after_cutoff")
        .when(F.col("_winner").isNotNull(), "selected")
        .otherwise("superseded_as_of_cutoff")
    )
    return rows.join(winners, F.col(row_id) == F.col("_winner"), "left").withColumn("status", status).drop("_winner")


def timestamp_conflicts(rows: DataFrame, keys: list[str], available: str, value: str) -> DataFrame:
    """Keys with different values at the same instant."""
    return (
        rows.groupBy(*keys, available)
        .agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("rows"))
        .filter(F.col("lo") != F.col("hi"))
    )


def previous_value(rows: DataFrame, keys: list[str], order: str, value: str, chunk: str) -> DataFrame:
    """The value before each row, without pulling a whole key into one task.

    Rows are ordered inside (key, chunk); the value carried into a chunk comes from
    a one-row-per-chunk summary, so a hot key is split over its chunks.
    """
    inner = Window.partitionBy(*keys, chunk).orderBy(order)
    marked = rows.withColumn("_prev", F.lag(value).over(inner)).withColumn("_first", F.row_number().over(inner) == 1)
    summary = rows.groupBy(*keys, chunk).agg(F.max_by(value, order).alias("_last"))
    carried = summary.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(chunk))).drop("_last")
    return (
        marked.join(carried, [*keys, chunk])
        .withColumn("previous", F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")))
        .drop("_prev", "_first", "_carry")
    )


def change_log(rows: DataFrame, keys: list[str], order: str, value: str, chunk: str) -> DataFrame:
    """Only the rows that change the value."""
    return previous_value(rows, keys, order, value, chunk).filter(~F.col(value).eqNullSafe(F.col("previous")))


def validity_intervals(events: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Each entry is valid until the next one starts."""
    w = Window.partitionBy(*keys).orderBy(start)
    return events.withColumn("valid_to", F.lead(start).over(w)).withColumn("active", F.col("valid_to").isNull())
