"""Scoring of frozen calculations against late-arriving sales, and what is learned from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from monthmill.functions.numbers import rounded

CANDIDATES = ["STATISTICAL", "ML", "ENSEMBLE"]
SELECTED = "SELECTED"


def eligible(calculations: DataFrame, sales: DataFrame, keys: list[str]) -> DataFrame:
    """Frozen horizons joined to the sale of their target month.

    A calculation counts only when it was made before the month began and before
    any version of the sale was known. `sales` carries first_available_at.
    """
    joined = calculations.join(sales, keys + ["target_period"])
    return joined.filter(
        (F.col("created_at") < F.col("target_period").cast("timestamp_ntz"))
        & (F.col("created_at") < F.col("first_available_at"))
    )


def choice_in_force(rows: DataFrame, selections: DataFrame) -> DataFrame:
    """The last selection made before the month and not after the first sale was known."""
    pairs = (
        rows.select("calculation_id", "horizon", "target_period", "first_available_at")
        .join(selections, "calculation_id")
        .filter(
            (F.col("selected_at") < F.col("target_period").cast("timestamp_ntz"))
            & (F.col("selected_at") <= F.col("first_available_at"))
        )
        .groupBy("calculation_id", "horizon", "target_period")
        .agg(F.max_by("selected_candidate", F.struct("selected_at", "selection_id")).alias("selected_candidate"))
    )
    return rows.join(pairs, ["calculation_id", "horizon", "target_period"], "left")


def live_rows(rows: DataFrame) -> DataFrame:
    """One row per candidate curve, plus the selected curve as its own candidate."""
    values = {c: F.col(f"{c.lower()}_value") for c in CANDIDATES}
    chosen = F.when(F.col("selected_candidate") == "STATISTICAL", values["STATISTICAL"])
    for c in CANDIDATES[1:]:
        chosen = chosen.when(F.col("selected_candidate") == c, values[c])
    entries = F.array(
        *[F.struct(F.lit(c).alias("candidate"), v.alias("forecast")) for c, v in values.items()],
        F.struct(F.lit(SELECTED).alias("candidate"), chosen.alias("forecast")),
    )
    long = rows.select(*rows.columns, F.inline(entries)).filter(F.col("forecast").isNotNull())
    error = F.col("actual") - F.col("forecast")
    return long.withColumns(
        {
            "absolute_error": F.abs(error), "signed_error": error,
            "ape": F.when(F.col("actual") > 0, 100 * F.abs(error) / F.col("actual")),
        }
    )


def live_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ratios of sums over the latest sale version of every evaluated point."""
    fields = F.struct("actual", "absolute_error", "signed_error", "orders", "delivery")
    identity = ["calculation_id", "candidate", "horizon", "target_period"]
    carried = [k for k in keys if k not in identity]
    latest = rows.groupBy(*identity, *carried).agg(F.max_by(fields, "sale_version").alias("v")).select(*identity, *carried, "v.*")
    both = F.col("orders").isNotNull() & F.col("delivery").isNotNull()
    actual = F.sum("actual")
    orders = F.sum(F.when(both, F.col("orders")))
    return latest.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluations"),
        rounded(F.when(actual != 0, 100 * F.sum("absolute_error") / actual)).alias("wape"),
        rounded(F.when(actual != 0, 100 * F.sum("signed_error") / actual)).alias("bias"),
        rounded(F.when(orders != 0, 100 * F.sum(F.when(both, F.col("delivery"))) / orders)).alias("fill_rate"),
    )


def learning_events(rows: DataFrame) -> DataFrame:
    """Best candidate, regret, value added and signals per calculation and horizon."""
    key = ["calculation_id", "chain_id", "product_id", "horizon", "target_period", "sale_version"]
    is_candidate = F.col("candidate") != SELECTED
    err = F.col("absolute_error")

    def of(condition: Column) -> Column:
        return F.max(F.when(condition, err))

    g = rows.groupBy(*key).agg(
        F.min_by(F.when(is_candidate, F.col("candidate")), F.when(is_candidate, F.struct(err, F.col("candidate")))).alias("best_candidate"),
        F.min(F.when(is_candidate, err)).alias("best_error"),
        of(F.col("candidate") == SELECTED).alias("selected_error"),
        of(is_candidate & (F.col("candidate") == F.col("suggested_candidate"))).alias("suggested_error"),
        F.first("suggested_candidate").alias("suggested_candidate"), F.first("selected_candidate").alias("selected_candidate"),
        F.first("actual").alias("actual"), F.first("orders").alias("orders"), F.first("delivery").alias("delivery"),
    )
    o, d = F.col("orders"), F.col("delivery")
    differs = ~F.col("selected_candidate").eqNullSafe(F.col("suggested_candidate"))
    judged = differs & F.col("selected_error").isNotNull() & F.col("suggested_error").isNotNull()
    added = F.when(judged, F.col("suggested_error") - F.col("selected_error"))
    signals = F.array_compact(
        F.array(
            F.when(F.col("selected_error") > 0, "DEMAND_FORECAST_ERROR"), F.when(o != F.col("actual"), "ORDER_DEVIATION"),
            F.when(d > F.col("actual"), "SELL_THROUGH_GAP"), F.when(d < o, "SUPPLY_SHORTFALL"),
            F.when((o > 0) & (d / F.when(o > 0, o) < 0.95), "LOW_FILL_RATE"),
            F.when(added > 0, "DECISION_OUTPERFORMED_RECOMMENDATION").when(judged, "DECISION_UNDERPERFORMED_RECOMMENDATION"),
        )
    )
    return g.select(
        *key, "best_candidate", "suggested_candidate", "selected_candidate",
        rounded(F.col("selected_error") - F.col("best_error")).alias("regret"), rounded(added).alias("value_added"),
        F.array_join(signals, ",").alias("signals"),
    )


def selection_curves(horizons: DataFrame, selections: DataFrame) -> DataFrame:
    """The chosen candidate's twelve points in one array per selection (twelve is the horizon count)."""
    joined = horizons.join(selections, "calculation_id")
    value = (
        F.when(F.col("selected_candidate") == "STATISTICAL", F.col("statistical_value"))
        .when(F.col("selected_candidate") == "ML", F.col("ml_value"))
        .when(F.col("selected_candidate") == "ENSEMBLE", F.col("ensemble_value"))
    )
    return joined.groupBy("calculation_id", "chain_id", "product_id", "selection_id", "selected_candidate", "selected_at").agg(
        F.array_sort(F.collect_list(F.struct("horizon", "target_period", value.alias("value")))).alias("curve")
    ).withColumn("complete", (F.size("curve") == 12) & ~F.exists("curve", lambda p: p["value"].isNull()))
