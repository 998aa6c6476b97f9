"""Monthly closure: service, drift, rolling accuracy, challenger checks, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from monthmill.functions.numbers import rounded
from monthmill.operators.metrics import error_metrics

# Closure policy.
MINIMUM_IMPROVEMENT = 0.25
REQUIRED_PERIODS = 3
MAX_ABS_BIAS = 20.0
MAX_CHALLENGER_SPREAD = 8.0
CRITICAL_HORIZONS = (1, 2, 3)
MAX_CRITICAL_DEGRADATION = 2.0
DRIFT_CHANGE = 0.35
RETRAIN_POINTS = 5.0
BIAS_PERIODS = 4


def observed_service(wide: DataFrame, keys: list[str], target: float) -> DataFrame:
    """Fill rate over matched product-months; not measurable while any pair is incomplete."""
    o, d = F.col("orders"), F.col("delivery")
    both = o.isNotNull() & d.isNotNull()
    totals = wide.groupBy(*keys).agg(
        F.count_if(both).alias("matched"), F.count_if(o.isNull() != d.isNull()).alias("incomplete"),
        F.count_if((o == 0) & (d > 0)).alias("undefined_pairs"),
        F.coalesce(F.sum(F.when(both, o)), F.lit(0.0)).alias("order_total"),
        F.coalesce(F.sum(F.when(both, d)), F.lit(0.0)).alias("delivery_total"),
    )
    bad = (F.col("matched") == 0) | (F.col("incomplete") > 0) | (F.col("undefined_pairs") > 0)
    rate = F.when(~bad & (F.col("order_total") == 0), 100.0).when(~bad, 100 * F.col("delivery_total") / F.col("order_total"))
    return totals.withColumn("fill_rate", rounded(rate)).withColumn(
        "status", F.when(bad, "NOT_MEASURABLE").when(rate >= target, "TARGET_MET").otherwise("TARGET_NOT_MET")
    )


def level_drift(panel: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Last three months against the nine before, in standard deviations."""
    monthly = panel.groupBy(*keys, "period").agg(F.coalesce(F.sum(measure), F.lit(0.0)).alias("s"))
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("period")))
    recent = monthly.withColumn("back", back).filter(F.col("back") <= 12)
    s, new = F.col("s"), F.col("back") <= 3
    stats = recent.groupBy(*keys).agg(
        F.avg(F.when(new, s)).alias("recent"), F.avg(F.when(~new, s)).alias("base"), F.stddev_pop(F.when(~new, s)).alias("sd")
    )
    score = rounded(F.abs(F.col("recent") - F.col("base")) / F.when(F.col("sd") != 0, F.col("sd")).otherwise(1.0), 2)
    return stats.select(*keys, score.alias("score"), F.when(score >= 2, "alert").otherwise("stable").alias("status"))


def point_drift(rows: DataFrame, keys: list[str], order: str, measure: str) -> DataFrame:
    """Months far from the mean of the six before them (at least three known)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-6, -1)
    based = rows.withColumn("base", F.avg(measure).over(w)).withColumn("known", F.count(measure).over(w))
    rel = F.abs(F.col(measure) - F.col("base")) / F.greatest(F.abs("base"), F.lit(1.0))
    return (
        based.filter(F.col("known") >= 3)
        .withColumn("rel", rel)
        .filter(F.col("rel") >= DRIFT_CHANGE)
        .withColumn("severity", F.when(F.col("rel") >= DRIFT_CHANGE * 1.5, "significant").otherwise("warning"))
        .withColumn("relative_change", rounded(F.col("rel")))
        .withColumn("baseline", rounded(F.col("base")))
    )


def lowest_horizon(forecasts: DataFrame, keys: list[str], value: str = "forecast") -> DataFrame:
    """The freshest frozen forecast per key: the one with the smallest horizon."""
    return forecasts.groupBy(*keys).agg(F.min("horizon").alias("horizon"), F.min_by(value, "horizon").alias(value))


def engine_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    out = rows.groupBy(*keys).agg(
        *error_metrics(F.col("actual"), F.col("forecast"), "closure"),
        rounded(F.sum("actual")).alias("actual_total"), rounded(F.sum("forecast")).alias("forecast_total"),
    )
    bias = F.col("bias")
    return out.withColumn(
        "bias_direction", F.when(bias > 0, "overforecast").when(bias < 0, "underforecast").otherwise("neutral")
    )


def rolling_accuracy(metrics: DataFrame, keys: list[str], period: str = "period") -> DataFrame:
    """Means of the monthly metrics over the last 1, 3, 6, 12 and all closures."""
    w = Window.partitionBy(*keys).orderBy(period)


    def mean(name: str, frame) -> Column:
        # published rates have four decimals: whole units sum exactly
        return rounded(F.avg(F.floor(F.col(name) * 1e4 + 0.5).cast("double")).over(frame) / 1e4)

    out = metrics
    for size in (3, 6, 12):
        frame = w.rowsBetween(-(size - 1), 0)
        out = out.withColumn(f"wape_{size}", mean("wape", frame)).withColumn(f"bias_{size}", mean("bias", frame))
    all_rows = w.rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("wape_all", mean("wape", all_rows)).withColumn("closures", F.count("wape").over(all_rows))


def persistent_bias(metrics: DataFrame, keys: list[str], period: str = "period") -> DataFrame:
    """Closures whose last four biases have one sign."""
    w = Window.partitionBy(*keys).orderBy(period).rowsBetween(-(BIAS_PERIODS - 1), 0)
    sign = F.signum("bias")
    out = metrics.withColumns(
        {"n4": F.count("bias").over(w), "lo": F.min(sign).over(w), "hi": F.max(sign).over(w)}
    ).filter((F.col("n4") == BIAS_PERIODS) & (F.col("lo") == F.col("hi")) & (F.col("lo") != 0))
    return out.withColumn("direction", F.when(F.col("lo") > 0, "overforecast").otherwise("underforecast")).drop("n4", "lo", "hi")


def challenger_history(pairs: DataFrame, keys: list[str], period: str = "period") -> DataFrame:
    """Consecutive wins ending at each closure and stability of the last three challenger rates.

    `pairs` has champion_wape, challenger_wape and challenger_bias per closure.
    """
    win = (F.col("challenger_wape") + MINIMUM_IMPROVEMENT <= F.col("champion_wape")) & (
        F.abs("challenger_bias") <= MAX_ABS_BIAS
    )
    w = Window.partitionBy(*keys).orderBy(period)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    recent = w.rowsBetween(-(REQUIRED_PERIODS - 1), 0)
    pos = F.row_number().over(w)
    marked = pairs.withColumn("win", win).withColumn("pos", pos)
    last_loss = F.max(F.when(~F.col("win"), F.col("pos"))).over(upto)
    return marked.withColumn("consecutive_wins", F.col("pos") - F.coalesce(last_loss, F.lit(0))).withColumn(
        "stable",
        (F.count("challenger_wape").over(recent) >= REQUIRED_PERIODS)
        & (F.stddev_pop("challenger_wape").over(recent) <= MAX_CHALLENGER_SPREAD),
    )


def challenger_state(history: DataFrame, critical: Column) -> DataFrame:
    """candidate_for_promotion / not_consistent / in_validation. `critical` flags a degraded critical horizon."""
    enough = (F.col("consecutive_wins") >= REQUIRED_PERIODS) & F.col("stable") & ~critical
    return history.withColumn(
        "state",
        F.when(enough, "candidate_for_promotion")
        .when((F.col("pos") >= REQUIRED_PERIODS) & (F.col("consecutive_wins") == 0), "not_consistent")
        .otherwise("in_validation"),
    )
