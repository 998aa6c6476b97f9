"""Blending, weight search, strategy states, certification and recommendation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from monthmill.functions.numbers import rounded
from monthmill.functions.periods import month_index
from monthmill.operators.metrics import error_metrics, metrics_from_windows

# Ensemble and selection policy.
BIAS_PENALTY, STABILITY_PENALTY, DETERIORATION_PENALTY = 0.18, 0.10, 0.12
MIN_IMPROVEMENT = 0.25
REFERENCE_WAPE = 24.0
MAX_BIAS_DETERIORATION = 5.0
MAX_STABILITY_DETERIORATION = 10.0
MAX_RECENT_DETERIORATION = 10.0
MIN_OBSERVATIONS, MIN_WINDOWS = 24, 3
PRODUCT_OBSERVATIONS = 6
MAX_CRITICAL_DETERIORATION = 2.0
GRID = 40  # weights 0, 1/40, ... 1


def blend(statistical: Column, ml: Column, weight: Column) -> Column:
    """Weighted value, never negative; statistical alone when there is no ml value."""
    return F.greatest(F.lit(0.0), F.when(ml.isNull(), statistical).otherwise(statistical * weight + ml * (1 - weight)))


def divergence(statistical: Column, ml: Column) -> Column:
    return F.when(ml.isNull(), 0.0).otherwise(100 * F.abs(statistical - ml) / F.greatest(F.abs(statistical), F.lit(1.0)))


def confidence(wape: Column, stability: Column, spread: Column, observations: Column) -> Column:
    def points(c: Column, two: float, one: float) -> Column:
        return F.when(c <= two, 2).when(c <= one, 1).otherwise(0)

    n = F.when(observations >= 120, 2).when(observations >= 48, 1).otherwise(0)
    total = points(wape, 20, 35) + points(stability, 8, 18) + points(spread, 15, 30) + n
    # Published confidence labels.
    return F.when(total >= 7, "Alta").when(total >= 4, "Media").otherwise("Baja")


def weight_search(records: DataFrame, keys: list[str], window: str = "period") -> DataFrame:
    """Metrics and score of every weight on the coarse grid and around its best point.

    All 41 weights are summed in one pass per window; only those tiny sums are
    expanded, so no record is copied per weight.
    """
    a, s, m = F.col("actual"), F.col("statistical"), F.col("ml")

    def sums(step: int) -> Column:
        error = a - blend(s, m, F.lit(step / GRID))
        return F.struct(F.lit(step).alias("step"), F.sum(F.abs(error)).alias("abs_e"), F.sum(error).alias("e"))

    per = records.groupBy(*keys, window).agg(
        F.sum(a).alias("a"), F.count(a).alias("n"), F.array(*[sums(i) for i in range(GRID + 1)]).alias("w")
    )
    scored = metrics_from_windows(per.select(*keys, window, "a", "n", F.inline("w")), [*keys, "step"], window)
    score = rounded(
        F.col("wape") + F.abs("bias") * BIAS_PENALTY + F.col("stability") * STABILITY_PENALTY
        + F.col("deterioration") * DETERIORATION_PENALTY
    )
    scored = scored.withColumn("score", score).withColumn("statistical_weight", F.col("step") / float(GRID))
    coarse = F.col("step") % 4 == 0
    best = F.min(F.when(coarse, F.struct(F.col("score"), -F.col("step")))).over(Window.partitionBy(*keys))
    center = -best["col2"]
    return (
        scored.withColumn("center", center)
        .filter(coarse | (F.abs(F.col("step") - F.col("center")) <= 4))
        .withColumn(
            "strategy",
            F.when(F.col("step") == GRID, "statistical").when(F.col("step") == 0, "ml").otherwise("ensemble"),
        )
        .drop("center", "step")
    )


def strategy_states(candidates: DataFrame, keys: list[str], reference_wape: float = REFERENCE_WAPE) -> DataFrame:
    """champion / challenger / rejected per candidate; the incumbent is the statistical strategy."""
    w = Window.partitionBy(*keys)
    order = F.struct(F.col("score"), F.col("wape"), -F.col("statistical_weight"))
    fields = F.struct("strategy", "score", "wape", "bias", "stability", "observations", "windows", "statistical_weight")
    best = F.min_by(fields, order).over(w)
    incumbent = F.max(F.when(F.col("strategy") == "statistical", fields)).over(w)
    c = candidates.withColumn("best", best).withColumn("inc", incumbent)
    benchmark = F.least(F.col("inc.wape"), F.lit(reference_wape))
    eligible = (
        (F.col("best.strategy") != F.col("inc.strategy"))
        & (benchmark - F.col("best.wape") >= MIN_IMPROVEMENT)
        & (F.col("best.observations") >= MIN_OBSERVATIONS)
        & (F.col("best.windows") >= MIN_WINDOWS)
        & (F.abs("best.bias") <= F.abs("inc.bias") + MAX_BIAS_DETERIORATION)
        & (F.col("best.stability") <= F.col("inc.stability") + MAX_STABILITY_DETERIORATION)
        & (F.col("best.score") < F.col("inc.score"))
    )
    is_incumbent = F.col("strategy") == "statistical"
    return c.withColumns(
        {
            "no_degradation_pass": is_incumbent | (F.col("wape") <= benchmark),
            "minimum_improvement_pass": benchmark - F.col("wape") >= MIN_IMPROVEMENT,
            "state": F.when(eligible & (F.col("statistical_weight") == F.col("best.statistical_weight")), "challenger")
            .when(is_incumbent, "champion").otherwise("rejected"),
        }
    ).drop("best", "inc")


# Split by target month ------------------------------------------------------------

def split_plan(panel: DataFrame, keys: list[str], issue: dt.date) -> DataFrame:
    """Train end, first target, and the last three targets that certify."""
    first = panel.filter(F.col("sales").isNotNull()).groupBy(*keys).agg(F.min("period").alias("start"))
    n = month_index(F.lit(issue)) - month_index(F.col("start")) + 1
    length = F.least(n, F.greatest(F.lit(18), F.least(F.lit(30), n - 12 - 6 - 3)))
    plan = first.withColumn("months", n).withColumn("train_end", F.add_months("start", length - 1))
    targets = F.greatest(F.lit(0), month_index(F.lit(issue)) - month_index(F.col("train_end")) - 12)
    return plan.withColumns(
        {
            "first_target": F.add_months("train_end", 13), "targets": targets,
            "certification_start": F.add_months(F.lit(issue), -F.least(F.lit(3), targets) + 1),
        }
    )


def labelled_split(pairs: DataFrame, plan: DataFrame, keys: list[str], period: str = "period") -> DataFrame:
    joined = pairs.join(plan.select(*keys, "first_target", "certification_start"), keys)
    return joined.filter(F.col(period) >= F.col("first_target")).withColumn(
        "split", F.when(F.col(period) >= F.col("certification_start"), "certification").otherwise("validation")
    )


def certified(pairs: DataFrame, keys: list[str], period: str = "period") -> DataFrame:
    """Holdout metrics plus deterioration from the first to the last certified month."""
    held = pairs.filter(F.col("split") == "certification")
    overall = held.groupBy(*keys).agg(*error_metrics(F.col("actual"), F.col("forecast"), "generic", "certified_"))
    monthly = held.groupBy(*keys, period).agg(*error_metrics(F.col("actual"), F.col("forecast"), "generic")).filter("wape IS NOT NULL")
    trend = monthly.groupBy(*keys).agg(
        F.min_by("wape", period).alias("first"), F.max_by("wape", period).alias("last"), F.count(F.lit(1)).alias("n")
    )
    worse = F.when(F.col("n") >= 2, rounded(F.greatest(F.lit(0.0), F.col("last") - F.col("first"))))
    return overall.join(trend.select(*keys, worse.alias("certified_deterioration")), keys, "left")


def pooled_winner(rows: DataFrame) -> DataFrame:
    """Best model of every chain (product ALL) and of every product with six observations, by WAPE, then |bias|, then name."""
    sets = [[F.col("chain_id"), F.col("product_id"), F.col("model")], [F.col("chain_id"), F.col("model")]]
    scored = (
        rows.groupingSets(sets, F.col("chain_id"), F.col("product_id"), F.col("model"))
        .agg(*error_metrics(F.col("actual"), F.col("forecast"), "generic"))
        .withColumn("product_id", F.coalesce("product_id", F.lit("ALL")))
        .filter((F.col("product_id") == "ALL") | (F.col("observations") >= PRODUCT_OBSERVATIONS)).filter(F.col("wape").isNotNull())
    )
    order = F.struct(F.col("wape"), F.abs("bias"), F.col("model"))
    return scored.groupBy("chain_id", "product_id").agg(F.min_by(F.struct("model", "wape", "observations"), order).alias("w")).select(
        "chain_id", "product_id", "w.*")


# Recommendation ---------------------------------------------------------------------

def recommend(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One suggestion per product among candidates with identical evidence.

    Columns: family, model, wape, bias, mae, rmse, stability, observations, windows,
    horizons (complete values), signature, h1, h2, h3 (WAPE at critical horizons).
    """
    reason = (
        F.when(F.col("observations") < PRODUCT_OBSERVATIONS, "INSUFFICIENT_PRODUCT_OBSERVATIONS")
        .when(F.col("wape").isNull() | (F.col("wape") < 0) | F.col("mae").isNull() | F.col("bias").isNull(), "INVALID_METRICS")
        .when(F.col("horizons") != 12, "INCOMPLETE_H1_H12")
        .when((F.col("family") == "ensemble") & ((F.col("observations") < 24) | (F.col("windows") < 3)), "ENSEMBLE_NOT_COMPARABLE")
        .when(F.col("signature").isNull(), "NOT_COMPARABLE")
    )
    w = Window.partitionBy(*keys)
    ok = candidates.filter(reason.isNull())
    family = F.when(F.col("family") == "statistical", 0).when(F.col("family") == "ensemble", 1).otherwise(2)
    ok = ok.withColumn("rank_family", family)
    baseline = F.min(
        F.when(F.col("family") == "statistical", F.struct("wape", "model", "bias", "stability", "h1", "h2", "h3", "signature"))
    ).over(w)
    based = ok.withColumn("b", baseline).filter(F.col("b").isNull() | (F.col("signature") == F.col("b.signature")))
    critical = [
        F.coalesce(F.col(h) > F.col(f"b.{h}") + MAX_CRITICAL_DETERIORATION, F.lit(False)) for h in ("h1", "h2", "h3")
    ]
    unsafe = (F.abs("bias") > F.abs("b.bias") + MAX_BIAS_DETERIORATION) | critical[0] | critical[1] | critical[2] | (
        F.coalesce(F.col("stability") > F.col("b.stability") + MAX_STABILITY_DETERIORATION, F.lit(False))
    )
    is_base = (F.col("family") == "statistical") & (F.col("model") == F.col("b.model"))
    compared = based.withColumn("n_comparable", F.count(F.lit(1)).over(w))
    safe = compared.filter(F.col("b").isNull() | is_base | ~unsafe)
    fields = F.struct("family", "model", "wape", "bias", "observations", "windows")
    order = F.struct(F.col("wape"), F.abs("bias"), F.col("stability"), F.col("rank_family"))
    best = safe.groupBy(*keys).agg(
        F.min_by(fields, order).alias("top"),
        F.min_by(F.when(F.col("family") == "statistical", fields), F.when(F.col("family") == "statistical", order)).alias("base"),
        F.count(F.lit(1)).alias("n_safe"), F.max("n_comparable").alias("n_comparable"),
    )
    tie = (F.col("base.wape") - F.col("top.wape") < MIN_IMPROVEMENT) & (F.col("top.family") != "statistical")
    winner = F.when(F.col("base").isNotNull() & tie, F.col("base")).otherwise(F.col("top"))
    out = best.withColumn("w", winner)
    level = (
        F.when((F.col("w.observations") >= 24) & (F.col("w.windows") >= 3) & (F.col("n_comparable") > 1), "Alta")
        .when((F.col("w.observations") >= 12) & (F.col("n_comparable") > 1), "Media")
        .otherwise("Baja")
    )
    return out.select(
        *keys, F.col("w.family").alias("family"), F.col("w.model").alias("model"), F.col("w.wape").alias("wape"),
        level.alias("confidence"),
        F.when(F.col("n_safe") == 1, "SUGGESTED_ONLY_ELIGIBLE").otherwise("SUGGESTED_RETROSPECTIVE").alias("status"),
        F.when(F.col("n_comparable") > 1, "COMPARABLE").otherwise("ONLY_ELIGIBLE_CANDIDATE").alias("comparison_status"),
        (F.col("base").isNotNull() & tie).alias("practical_tie"),
    )


def quality_gate(candidate: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Scope gate: candidate against the matched statistical baseline, critical horizons 1-3."""
    c = candidate.select(*keys, F.col("wape").alias("cw"), F.col("bias").alias("cb"), "horizon_rates")
    b = baseline.select(*keys, F.col("wape").alias("bw"), F.col("bias").alias("bb"), F.col("horizon_rates").alias("base_rates"))
    worst = F.array_max(F.zip_with("horizon_rates", "base_rates", lambda x, y: x - y))
    joined = c.join(b, keys, "left").withColumn("degradation", worst)
    status = (
        F.when(F.col("bw").isNull() | F.col("cw").isNull(), "INSUFFICIENT_EVIDENCE")
        .when(
            (F.abs("cb") > MAX_BIAS_DETERIORATION + F.abs("bb")) | (F.col("cw") > F.col("bw") - MIN_IMPROVEMENT),
            "FORECAST_QUALITY_BLOCKED",
        )
        .when(F.col("degradation") > MAX_CRITICAL_DETERIORATION, "FORECAST_QUALITY_WARNING")
        .otherwise("FORECAST_QUALITY_READY")
    )
    return joined.withColumn("status", status)


def rollup_levels(forecast: DataFrame, value: str) -> DataFrame:
    """Category and chain totals per horizon from one grouping-sets pass."""
    sets = [[F.col("chain_id"), F.col("category_id"), F.col("horizon")], [F.col("chain_id"), F.col("horizon")]]
    return (
        forecast.groupingSets(sets, F.col("chain_id"), F.col("category_id"), F.col("horizon"))
        .agg(F.sum(F.col(value).cast("decimal(18,3)")).alias("total"), F.count(F.lit(1)).alias("members"))
        .select(
            F.when(F.col("category_id").isNull(), "CHAIN").otherwise("CATEGORY").alias("level"),
            F.coalesce("category_id", "chain_id").alias("key"), "chain_id", "horizon",
            F.col("total").cast("double").alias("total"), "members",
        )
    )
