"""Aligned (actual, forecast) pairs of simple direct forecasts, built in one window pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

HORIZONS = tuple(range(1, 13))


def direct_pairs(panel: DataFrame, keys: list[str], measure: str = "sales") -> DataFrame:
    """Per target month and horizon: last value and mean of three months, both as known at the issue."""
    w = Window.partitionBy(*keys).orderBy("idx")
    v = F.col(measure)
    entries = [
        F.struct(
            F.lit(h).alias("horizon"), F.lag(v, h).over(w).alias("last"),
            F.avg(v).over(w.rowsBetween(-(h + 2), -h)).alias("mean3"),
        )
        for h in HORIZONS
    ]
    wide = panel.withColumn("entries", F.array(*entries)).filter(v.isNotNull())
    kept = [c for c in panel.columns if c not in ("sales", "orders", "delivery")]
    return wide.select(*kept, v.alias("actual"), F.inline("entries")).filter(
        F.col("last").isNotNull() & F.col("mean3").isNotNull()
    )


def long_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.unpivot(
        [c for c in pairs.columns if c not in ("last", "mean3")], ["last", "mean3"], "model", "forecast"
    )
