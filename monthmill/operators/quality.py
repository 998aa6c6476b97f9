"""Row rules, duplicate guards and completeness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def violations(rows: DataFrame, rules: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """One row per broken rule and input row."""
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    columns = keep if keep is not None else rows.columns
    return rows.select(*columns, F.explode(broken).alias("rule"))


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with an `errors` list)."""
    marked = rows.withColumn("errors", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])))
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


class RuleViolation(ValueError):
    """Raised by `require_none` when a guard finds rows."""


def require_none(bad: DataFrame, message: str) -> None:
    """Fail the job when any row breaks a guard; looks at one row only."""
    if not bad.isEmpty():
        raise RuleViolation(message)


def horizon_completeness(horizons: DataFrame, keys: list[str], expected: int = 12) -> DataFrame:
    """Every curve needs each horizon once, from 1 to the expected number."""
    return horizons.groupBy(*keys).agg(
        F.count_distinct("horizon").alias("distinct_horizons"), F.count(F.lit(1)).alias("rows"),
        F.min("horizon").alias("first"), F.max("horizon").alias("last"),
    ).withColumn(
        "complete",
        (F.col("distinct_horizons") == expected) & (F.col("rows") == expected) & (F.col("first") == 1) & (F.col("last") == expected),
    )


def band_order(p10: Column, p50: Column, p90: Column, p95: Column) -> Column:
    return (p10 <= p50) & (p50 <= p90) & (p90 <= p95)


def normalisation_guard(rows: DataFrame, keys: list[str], cutoff: Column) -> DataFrame:
    """Violations of fact input: identity, period, availability, value, conflicting duplicates.

    rows: keys, period, value, available_at. Returns rule and the key of each violation.
    """
    missing_key = F.lit(False)
    for k in keys:
        missing_key = missing_key | F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
    rules = {
        "identity_required": missing_key,
        "period_after_cutoff": F.col("period") > cutoff,
        "availability_required": F.col("available_at").isNull(),
        "available_after_month_end": F.to_date("available_at") > F.last_day(cutoff),
        "invalid_value": F.isnan("value") | (F.col("value") < 0) | (F.abs("value") == F.lit(float("inf"))),
    }
    row_level = violations(rows, rules, [*keys, "period"])
    conflicts = rows.groupBy(*keys, "period").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter("lo <> hi")
    return row_level.unionByName(conflicts.select(*keys, "period", F.lit("duplicate_observation_conflict").alias("rule")))
