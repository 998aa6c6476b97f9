"""Human adjustments of a forecast: application, rules, and value added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from monthmill.functions.numbers import rounded
from monthmill.operators.metrics import error_metrics

SIGNIFICANT_PERCENT = 20.0
NEUTRAL_POINTS = 0.25
METHODS = ["none", "absolute", "percentage", "final_value"]
# Reasons a proposal may give.
REASONS = ["no_adjustment", "promotion", "stock_correction", "market_signal", "other"]


def adjusted_value(base: Column, method: Column, value: Column) -> Column:
    return (
        F.when(method == "absolute", base + value).when(method == "percentage", base * (1.0 + value / 100.0))
        .when(method == "final_value", value).otherwise(base)
    )


# Roles that may leave the band.
BAND_ROLES = ["manager"]


def decide(points: DataFrame, proposals: DataFrame, keys: list[str], role: str | None = None) -> DataFrame:
    """Points with their proposal (default: none), deltas, band flags, governance alerts and blockers.

    `role` names the column with the role of the author; only some roles may propose values outside the band.
    """
    rows = points.join(proposals, keys, "left").withColumns(
        {
            "method": F.coalesce("method", F.lit("none")), "proposed": F.coalesce("proposed", F.lit(0.0)),
            "reason": F.coalesce("reason", F.lit("no_adjustment")), "explanation": F.coalesce("explanation", F.lit("reviewed")),
        }
    )
    base = F.col("base")
    adjusted = adjusted_value(base, F.col("method"), F.col("proposed"))
    out = rows.withColumn("adjusted", adjusted).withColumn("delta", F.col("adjusted") - base)
    percent = F.when((base == 0) & (F.col("delta") == 0), 0.0).when(base != 0, F.col("delta") / F.when(base != 0, base) * 100)
    out = out.withColumn("percent", percent)
    significant = (F.col("percent").isNull() | (F.abs("percent") >= SIGNIFICANT_PERCENT)) & (F.col("delta") != 0)
    outside = F.coalesce(F.col("adjusted") > F.col("p95"), F.lit(False)) | F.coalesce(F.col("adjusted") < F.col("p10"), F.lit(False))
    alerts = F.array_compact(F.array(F.when(outside, "outside_probability_range"), F.when(significant, "significant_adjustment")))
    unauthorised = outside & ~F.coalesce(F.col(role).isin(*BAND_ROLES), F.lit(False)) if role else F.lit(False)
    blockers = F.array_compact(
        F.array(
            F.when(~F.col("method").isin(*METHODS), "invalid_method"), F.when(~F.col("reason").isin(*REASONS), "invalid_reason"),
            F.when((F.col("method") != "none") & (F.trim("explanation") == ""), "explanation_required"),
            F.when((F.col("method") == "none") & (F.col("reason") != "no_adjustment"), "no_adjustment_reason_required"),
            F.when(F.col("adjusted") < 0, "negative_adjusted_forecast"), F.when(unauthorised, "outside_band_authorization_required"),
        )
    )
    return out.withColumns(
        {
            "within_p90": F.coalesce((F.col("adjusted") >= F.coalesce("p10", F.lit(0.0))) & (F.col("adjusted") <= F.col("p90")), F.lit(False)),
            "outside_p95": F.coalesce(F.col("adjusted") > F.col("p95"), F.lit(False)),
            "below_p10": F.coalesce(F.col("adjusted") < F.col("p10"), F.lit(False)),
            "significant": significant, "alerts": F.array_join(alerts, ","), "blockers": F.array_join(blockers, ","),
        }
    )


def version_chain(decisions: DataFrame, scope: list[str], order: list[str], prefix: str, period: str) -> DataFrame:
    """Adds revision, version and previous_version: decisions on one scope, in order, each a revision of the one before."""
    w = Window.partitionBy(*scope).orderBy(*order)
    name = F.concat(F.lit(prefix), F.date_format(period, "yyyy-MM"), F.lit("-V"), F.lpad(F.col("revision").cast("string"), 2, "0"))
    rows = decisions.withColumn("revision", F.row_number().over(w)).withColumn("version", name)
    return rows.withColumn("previous_version", F.lag("version").over(w))


def value_class(points: Column, intervened: Column, tolerance: float = NEUTRAL_POINTS) -> Column:
    return (
        F.when(~intervened, "no_intervention").when(points > tolerance, "positive")
        .when(points < -tolerance, "negative").otherwise("neutral")
    )


def value_added(rows: DataFrame, keys: list[str]) -> DataFrame:
    """WAPE of the system forecast minus WAPE of the approved one."""
    g = rows.groupBy(*keys).agg(
        *error_metrics(F.col("actual"), F.col("base"), "closure", "system_"),
        *error_metrics(F.col("actual"), F.col("approved"), "closure", "approved_"),
        F.max(F.abs("delta")).alias("largest"), F.sum(F.abs("actual")).alias("volume"),
    )
    points = rounded(F.col("system_wape") - F.col("approved_wape"))
    return g.withColumn("fva_points", points).withColumn(
        "classification", value_class(F.col("fva_points"), F.col("largest") != 0)
    )


def value_details(rows: DataFrame) -> DataFrame:
    gain = F.abs(F.col("actual") - F.col("base")) - F.abs(F.col("actual") - F.col("approved"))
    return rows.withColumn("fva_absolute", gain).withColumn(
        "outcome", F.when(gain > 0, "positive").when(gain < 0, "negative").otherwise("neutral")
    )
