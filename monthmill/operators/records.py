"""Aligned backtest records: what each series' own model and the pooled models said for the same month at the same time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from monthmill.functions.numbers import rounded, snapped
from monthmill.operators import backtest as bt, kernel

TOTAL = {"chain_id": "ALL", "product_id": "total"}


def total_values(monthly: DataFrame, issue: dt.date, measure: str = "sales") -> DataFrame:
    """All series together as one series; a month without a value of some series counts what the others have."""
    from monthmill.operators.series import observed_values

    known = monthly.filter((F.col("period") <= F.lit(issue)) & F.col(measure).isNotNull())
    sums = known.groupBy("period").agg(F.sum(measure).alias(measure))
    named = sums.select(*[F.lit(v).alias(k) for k, v in TOTAL.items()], "period", measure)
    return observed_values(named, list(TOTAL), measure)


def winner_paths(values: DataFrame, keys: list[str], issue: dt.date) -> DataFrame:
    """keys, issue, model, path: twelve steps of a series' winning model from what was known in each month.

    A series without a winner, or whose history is still too short for it, takes the last value. Months without a
    value see the history up to the last one with a value.
    """
    winners = bt.run_series(values, keys).select(*keys, "winner")
    paths = kernel.every_path(values.join(winners, keys), keys, "winner")
    following = F.try_element_at("months", F.col("origin") + 1)
    last = F.coalesce(F.add_months(following, -1), F.lit(issue))
    months = F.sequence(F.element_at("months", F.col("origin")), last, F.expr("interval 1 month"))
    return paths.select(*keys, F.explode(months).alias("issue"), "model", "path")


def at_step(path: Column, horizon: Column) -> Column:
    """A step of a path as it is published: not negative, two digits."""
    return rounded(F.greatest(F.lit(0.0), F.element_at(path, horizon)), 2)


def beside(pooled: DataFrame, paths: DataFrame, keys: list[str], families: list[str]) -> DataFrame:
    """Joins pooled predictions to the statistical path of the same series and issue month, all with two digits."""
    joined = pooled.join(paths, [*keys, "issue"])
    return joined.select(
        *keys, "issue", "target_period", "horizon", "actual", "model", at_step(F.col("path"), F.col("horizon")).alias("statistical"),
        *[rounded(snapped(F.col(f)), 2).alias(f) for f in families],
    )


def aligned_records(
    pooled: DataFrame, values: DataFrame, total: DataFrame, families: list[str], issue: dt.date
) -> DataFrame:
    """One row per series, issue and target month, and one for all series together.

    `pooled` has chain_id, product_id, issue, target_period, horizon, actual and a column for each family; rows
    without an actual, or of a series unknown at the issue month, are left out. The total's actual and pooled values
    are sums over its rows, its statistical value comes from the winner of the total series.
    """
    keys = list(TOTAL)
    known = pooled.filter(F.col("actual").isNotNull())
    paths = winner_paths(values, keys, issue)
    own = known.join(paths.select(*keys, "issue"), [*keys, "issue"], "left_semi")
    sums = own.groupBy("issue", "target_period", "horizon").agg(F.sum("actual").alias("actual"), *[F.sum(f).alias(f) for f in families])
    whole = sums.select(*[F.lit(v).alias(k) for k, v in TOTAL.items()], *sums.columns)
    return beside(known, paths, keys, families).unionByName(beside(whole, winner_paths(total, keys, issue), keys, families))
