"""Rolling-origin backtests, per-series selection and retrospective evaluation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from monthmill.functions.numbers import hundredths, rounded
from monthmill.operators import kernel
from monthmill.operators.metrics import error_metrics
from monthmill.operators.models import INTERMITTENT_MODELS, MODEL_NAMES, classify, forecast_paths, model_paths, prefix_states

HORIZONS = (1, 3, 6, 12)


def backtest_steps(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Every forecast step that has an actual: clamped and rounded before scoring."""
    return paths.filter((F.col("origin") >= 6) & (F.col("origin") < F.col("n"))).select(
        *keys, "model", "origin", "n", "origin_period",
        F.inline(
            F.expr(
                "transform(ahead, (a, i) -> named_struct('step', i + 1, 'actual', a, "
                "'pred', floor(greatest(0D, path[i]) * 100D + 0.5D) / 100D))"
            )
        ),
    )


def rolling_backtest(steps: DataFrame, keys: list[str], full: bool = False) -> DataFrame:
    """One row per series, model and horizon; all steps up to the horizon count.

    The four horizons are conditional aggregates over one pass, so no step row is
    copied per horizon and the map side reduces to one row per series and model.
    """
    def inside(h: int) -> Column:
        return (
            (F.col("step") <= h) & (F.col("origin") + h <= F.col("n")) & (F.col("origin") >= (12 if h >= 6 else 6))
        )

    wide = steps.groupBy(*keys, "model").agg(
        *[
            c
            for h in HORIZONS
            for c in (
                F.count(F.when(inside(h) & (F.col("step") == 1), 1)).alias(f"h{h}_origins"),
                *error_metrics(F.col("actual"), F.col("pred"), "statistical", f"h{h}_", inside(h)),
            )
        ]
    )
    names = ["origins", "wape", "bias", "stability", *(["mae", "rmse", "observations"] if full else [])]
    per_horizon = F.array(
        *[F.struct(F.lit(h).alias("horizon"), *[F.col(f"h{h}_{n}").alias(n) for n in names]) for h in HORIZONS]
    )
    return wide.select(*keys, "model", F.inline(per_horizon)).filter(F.col("origins") > 0)


def weighted_score(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Origin-weighted averages of the horizon metrics and the controlled score."""
    o = F.col("origins")

    def average(name: str) -> Column:
        total = F.sum(hundredths(F.col(name)) * o) / F.sum(o)
        return (F.floor(total + 0.5) / 100.0).alias(name)

    averaged = windows.groupBy(*keys, "model").agg(
        average("wape"), average("bias"), average("stability"), F.sum("origins").alias("origins")
    )
    score = rounded(F.col("wape") + F.abs("bias") * 0.25 + F.col("stability") * 0.15, 2)
    return averaged.withColumn("score", score)


def allowed(demand_class: Column) -> Column:
    return F.when(
        F.contains(F.lower(demand_class), F.lit("intermitente")), F.array(*[F.lit(m) for m in INTERMITTENT_MODELS])
    ).otherwise(F.array(*[F.lit(m) for m in MODEL_NAMES]))


def series_results(series: DataFrame, keys: list[str]) -> DataFrame:
    """Classify, backtest the allowed models, pick the winner; one row per series with its periods.

    comparisons holds every model that could be tested, forecast the winner's next twelve months, history its one-step
    forecasts from the seventh month on. Seven months always give the first origin, fewer never do.
    """
    still = F.forall(F.slice("values", -3, 3), lambda x: x == 0) & (F.size("values") >= 3)
    tagged = series.withColumn("still", F.when(F.size("values") >= 3, still).otherwise(False))
    long_enough = classify(tagged.filter(F.size("values") > 6), [*keys, "periods", "still"])
    labelled = long_enough.withColumn("sparse", F.contains(F.lower("demand_class"), F.lit("intermitente")))
    ran = kernel.run(labelled, [*keys, "periods", "demand_class", "still"], "sparse")
    alerts = F.array_join(
        F.array_compact(
            F.array(F.when(F.col("wape") >= 50, "accuracy"), F.when(F.abs("bias") >= 25, "bias"), F.when(F.col("still"), "no_movement"))
        ),
        ",",
    )
    evaluated = ran.withColumn("alerts", alerts).withColumn(
        "status", F.when(F.col("alerts") != "", "completed_with_alerts").otherwise("completed")).drop("still")
    short = classify(series.filter(F.size("values") <= 6), [*keys, "periods"]).select(
        *keys, "periods", "demand_class", F.lit("").alias("alerts"), F.lit("insufficient").alias("status")
    )
    return evaluated.unionByName(short, allowMissingColumns=True)


def run_series(series: DataFrame, keys: list[str]) -> DataFrame:
    """Class, winner with its metrics, and alerts of every series."""
    return series_results(series, keys).select(*keys, "demand_class", "winner", "wape", "bias", "stability", "score", "alerts", "status")


# Retrospective evaluation -------------------------------------------------

MAX_FOLDS = 12


def fold_origins(runs: DataFrame, chain_keys: list[str], issue: dt.date) -> DataFrame:
    """Per chain the last twelve months before the issue in which some series had six months of history."""
    months = runs.filter(F.size("values") >= 6).select(
        *chain_keys, F.explode(F.expr("slice(periods, 6, size(periods))")).alias("period")
    )
    return (
        months.filter(F.col("period") < F.lit(issue))
        .groupBy(*chain_keys)
        .agg(F.array_sort(F.collect_set("period")).alias("p"))
        .select(*chain_keys, F.expr(f"slice(p, -least(size(p), {MAX_FOLDS}), {MAX_FOLDS})").alias("folds"))
    )


def retrospective_rows(
    runs: DataFrame, panel: DataFrame, keys: list[str], chain_keys: list[str], issue: dt.date, measure: str = "sales"
) -> DataFrame:
    """Endpoint predictions of every allowed model at each fold origin with the realised value.

    `runs` are contiguous histories (keys + island); a prefix of a run is exactly
    what was known at that origin.
    """
    folds = fold_origins(runs, chain_keys, issue)
    with_folds = runs.join(folds, chain_keys).withColumn(
        "positions",
        F.expr("filter(transform(folds, f -> cast(array_position(periods, f) as int)), i -> i >= 6)"),
    ).filter(F.size("positions") > 0)
    id_cols = [*keys, "island"]
    states = prefix_states(with_folds, id_cols, "positions", extra=["positions", "values"])
    paths = model_paths()
    candidates = states.select(
        *id_cols, "origin", "origin_period",
        F.expr("slice(values, 1, origin)").alias("values"),
        F.array(*[F.struct(F.lit(m).alias("model"), paths[m].alias("path")) for m in MODEL_NAMES]).alias("candidates"),
    )
    labelled = classify(candidates, [*id_cols, "origin", "origin_period", "candidates"])
    kept = labelled.select(
        *keys, "origin", "origin_period", "demand_class",
        F.inline(
            F.filter(
                "candidates", lambda c: c["path"].isNotNull() & F.array_contains(allowed(F.col("demand_class")), c["model"])
            )
        ),
    )
    endpoints = kept.select(
        *keys, "origin_period", "demand_class", "model",
        F.inline(
            F.expr(
                "transform(filter(array(1, 3, 6, 12), h -> origin >= if(h >= 6, 12, 6)), h -> named_struct("
                "'horizon', h, 'target_period', add_months(origin_period, h), 'pred', greatest(0D, path[h - 1])))"
            )
        ),
    ).filter(F.col("target_period") <= F.lit(issue))
    actuals = panel.select(*keys, F.col("period").alias("target_period"), F.col(measure).alias("actual")).filter(
        F.col("actual").isNotNull()
    )
    return endpoints.join(actuals, [*keys, "target_period"])


def common_support(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Only the (origin, horizon) rows that every evaluated model of the series covers.

    A series has at most folds x horizons x models rows, so both counts are windows
    over one partitioning by series; the winner's aggregation reuses it.
    """
    evaluated = F.size(F.collect_set("model").over(Window.partitionBy(*keys)))
    covered = F.count(F.lit(1)).over(Window.partitionBy(*keys, "origin_period", "horizon"))
    return rows.withColumn("evaluated", evaluated).withColumn("covered", covered).filter("covered = evaluated").drop("covered", "evaluated")


def series_winner(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest WAPE, then |bias|, then name, on rows shared by every candidate."""
    scored = rows.groupBy(*keys, "model").agg(
        *error_metrics(F.col("actual"), F.col("pred"), "generic"), F.count_distinct("origin_period").alias("origins")
    ).filter(F.col("wape").isNotNull())
    best = scored.groupBy(*keys).agg(
        F.min_by(F.struct("model", "wape", "bias", "observations", "origins"), F.struct(F.col("wape"), F.abs("bias"), F.col("model"))).alias("w")
    )
    return best.select(*keys, "w.*")


def allowed_at_issue(rows: DataFrame, runs: DataFrame, keys: list[str], issue: dt.date) -> DataFrame:
    """Rows of the models that the class at the issue month still allows."""
    current = runs.filter(F.element_at("periods", -1) == F.lit(issue))
    classes = classify(current, keys).select(*keys, F.col("demand_class").alias("issue_class"))
    return rows.join(classes, keys).filter(F.array_contains(allowed(F.col("issue_class")), F.col("model"))).drop("issue_class")
