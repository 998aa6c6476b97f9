"""Residual bands and their evidence level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from monthmill.functions.numbers import rounded, snapped
from monthmill.operators.quantiles import exact_quantiles

PROBABILITIES = [0.1, 0.9, 0.95]
MIN_RESIDUALS = 3


def ordered_bands(value: Column, quantiles: Column, digits: int = 2, scale: Column | float = 1.0) -> dict[str, Column]:
    """p10 <= p50 <= p90 <= p95 around the point forecast, p10 not negative."""
    q10, q90, q95 = (quantiles[i] * scale for i in range(3))
    p10 = F.least(value, F.greatest(F.lit(0.0), value + q10))
    p90 = F.greatest(value, value + q90)
    p95 = F.greatest(p90, value + q95)
    return {
        n: rounded(snapped(c), digits) for n, c in (("p10", p10), ("p50", value), ("p90", p90), ("p95", p95))
    }


def evidence_quantiles(residuals: DataFrame, product: list[str], category: list[str], chain: list[str], horizon: str = "horizon"):
    """Quantiles per level. Product groups are bounded by the calendar; the wider ones use the counted form."""
    own = residuals.groupBy(*product, horizon).agg(
        F.count("residual").alias("n_product"),
        F.percentile("residual", F.array(*[F.lit(p) for p in PROBABILITIES])).alias("q_product"),
    )
    wide = []
    for name, keys in (("category", category), ("chain", chain)):
        q = exact_quantiles(residuals, [*keys, horizon], "residual", PROBABILITIES)
        wide.append(q.withColumnsRenamed({"n": f"n_{name}", "quantiles": f"q_{name}"}))
    return own, wide[0], wide[1]


def select_evidence(points: DataFrame, residuals: DataFrame, product: list[str], category: list[str], chain: list[str]) -> DataFrame:
    """First level with at least three residuals at the same horizon: product, category, chain."""
    own, by_category, by_chain = evidence_quantiles(residuals, product, category, chain)
    joined = (
        points.join(own, [*product, "horizon"], "left")
        .join(by_category, [*category, "horizon"], "left")
        .join(by_chain, [*chain, "horizon"], "left")
    )
    levels = ["product", "category", "chain"]

    def first_of(pick) -> Column:
        return F.coalesce(*[F.when(F.col(f"n_{n}") >= MIN_RESIDUALS, pick(n)) for n in levels])

    return joined.withColumns(
        {
            "band_basis": F.coalesce(first_of(lambda n: F.lit(n.upper())), F.lit("INSUFFICIENT")),
            "band_observations": F.coalesce(first_of(lambda n: F.col(f"n_{n}")), F.lit(0).cast("bigint")),
            "quantiles": first_of(lambda n: F.col(f"q_{n}")),
        }
    ).drop(*[f"n_{n}" for n in levels], *[f"q_{n}" for n in levels])


def interval_coverage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A tie with a bound counts as inside; values are compared without the noise of the last bits."""
    rows = rows.withColumns({c: snapped(F.col(c)) for c in ("actual", "p10", "p50", "p90", "p95")})
    a, lower = F.col("actual"), F.coalesce(F.col("p10"), F.lit(0.0))
    share = lambda c: rounded(100 * F.sum(F.when(c, 1).otherwise(0)) / F.count(F.lit(1)))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"),
        share((a >= lower) & (a <= F.col("p90"))).alias("coverage_p90"),
        share((a >= lower) & (a <= F.col("p95"))).alias("coverage_p95"),
        F.count_if(F.col("p10").isNotNull() & (a < F.col("p10"))).alias("below_p10"),
        F.count_if(a <= F.col("p50")).alias("at_or_below_p50"),
        F.count_if((a < lower) | (a > F.col("p95"))).alias("outside_p95"),
    )


def coverage_bucket(actual: Column, p10: Column, p50: Column, p90: Column, p95: Column) -> Column:
    actual, p10, p50, p90, p95 = (snapped(c) for c in (actual, p10, p50, p90, p95))
    return (
        F.when(actual < p10, "below_p10").when(actual < p50, "p10_p50").when(actual < p90, "p50_p90")
        .when(actual < p95, "p90_p95").otherwise("above_p95")
    )
