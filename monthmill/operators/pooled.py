"""Pooled regression over all series: samples, preprocessing, MLlib models, folds.

One row per (series, issue month, horizon); every feature comes from window
expressions, the model fits are distributed, and only small fold lists and
preprocessing constants (one per feature) reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from monthmill.operators.quantiles import exact_quantiles
from monthmill.operators.series import growth_features, lag_features, movement_features
from monthmill.session import cut_lineage

HORIZONS = tuple(range(1, 13))
RIDGE = 0.35
SEED = 20260919
MIN_TRAIN = 18
# Complexity penalties added to a model's score.
COMPLEXITY = {"linear": 0.0, "forest": 0.25, "boosting": 0.35}
FEATURES = [
    "year", "month", "quarter", "sin_month", "cos_month", "position", "horizon", "age",
    *[f"lag_{k}" for k in (1, 2, 3, 6, 12)],
    *[f"{s}_{w}" for w in (3, 6, 12) for s in ("mean", "std", "min", "max")],
    "mom", "yoy", "slope", "acceleration", "months_since_sale", "zero_months", "movement_share", "mean_interval",
]


def issue_features(panel: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Everything known at each issue month; one window partitioning serves all features."""
    out = movement_features(growth_features(lag_features(panel, keys, measure), keys, measure), keys, measure)
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("age", F.count(measure).over(w)).withColumn("position", F.col("idx") - 1)


def samples(panel: DataFrame, keys: list[str], measure: str, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Direct multi-horizon rows (issue, target, horizon) with an observed target."""
    w = Window.partitionBy(*keys).orderBy("idx")
    base = issue_features(panel, keys, measure)
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead(measure, h).over(w).alias("label")) for h in horizons])
    rows = base.withColumn("ahead", ahead).withColumnRenamed("period", "issue").select(
        *keys, "issue", "idx", *[c for c in FEATURES if c in base.columns], F.inline("ahead")
    )
    return with_target_calendar(rows.filter(F.col("label").isNotNull() & (F.col("idx") >= 2)))


def with_target_calendar(rows: DataFrame) -> DataFrame:
    target = F.add_months("issue", F.col("horizon"))
    month = F.month(target)
    angle = month * (2 * math.pi / 12)
    return rows.withColumns(
        {
            "target_period": target, "year": F.year(target), "month": month, "quarter": F.quarter(target),
            "sin_month": F.sin(angle), "cos_month": F.cos(angle),
        }
    )


@dataclass(frozen=True)
class Preprocessor:
    """Median, mean and deviation per feature, from the training rows only."""

    stats: dict[str, tuple[float, float, float]]

    def apply(self, rows: DataFrame) -> DataFrame:
        columns: dict[str, Column] = {}
        for name, (median, mean, std) in self.stats.items():
            value = F.col(name).cast("double")
            columns[f"z_{name}"] = (F.coalesce(value, F.lit(median)) - mean) / std
            columns[f"m_{name}"] = value.isNull().cast("double")
        return rows.withColumns(columns)

    @property
    def columns(self) -> list[str]:
        return [f"z_{n}" for n in self.stats] + [f"m_{n}" for n in self.stats]


def value_counts(rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """keys, feature, v, c: how often each feature value occurs; combined on the map side."""
    long = rows.select(
        *keys, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    )
    return long.groupBy(*keys, "feature", "v").agg(F.count(F.lit(1)).alias("c"))


def preprocessing_from_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, median, mean, std of the imputed column; missing values count as the median."""
    median = exact_quantiles(counts, keys, "v", [0.5], weight="c").select(*keys, F.col("quantiles")[0].alias("median"))
    known = F.when(F.col("v").isNotNull(), F.col("c"))
    first = counts.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.coalesce(F.sum(known), F.lit(0)).alias("k"), F.sum(F.col("v") * F.col("c")).alias("s")
    )
    level = first.join(median, keys, "left").select(
        *keys, F.coalesce("median", F.lit(0.0)).alias("median"), "n", "k",
        ((F.coalesce("s", F.lit(0.0)) + (F.col("n") - F.col("k")) * F.coalesce("median", F.lit(0.0))) / F.col("n")).alias("mean"),
    )
    gap = F.coalesce("v", "median") - F.col("mean")
    spread = counts.join(level, keys).groupBy(*keys, "median", "mean", "n").agg(F.sum(gap * gap * F.col("c")).alias("ss"))
    std = F.sqrt(F.col("ss") / F.col("n"))
    return spread.select(*keys, "median", "mean", F.when(std < 1e-9, 1.0).otherwise(std).alias("std"))


def preprocessing_table(train: DataFrame, features: list[str]) -> DataFrame:
    return preprocessing_from_counts(value_counts(train, features, []), ["feature"])


def _preprocessor(rows: list, features: list[str]) -> Preprocessor:
    ordered = sorted(rows, key=lambda r: features.index(r["feature"]))
    return Preprocessor({r["feature"]: (r["median"], r["mean"], r["std"]) for r in ordered})


def fit_preprocessor(train: DataFrame, features: list[str]) -> Preprocessor:
    return _preprocessor(preprocessing_table(train, features).collect(), features)  # one row per feature


def fit_preprocessors(rows: DataFrame, features: list[str], folds: list[tuple]) -> dict[int, Preprocessor]:
    """Constants of every fold (horizon, first excluded target) from one pass over the samples.

    Values are counted per target month first; only those counts are repeated per fold.
    """
    counts = value_counts(rows, features, ["horizon", "target_period"])
    member = F.array_compact(
        F.array(
            *[F.when((F.col("horizon") == h) & (F.col("target_period") < F.lit(target)), F.lit(i)) for i, (h, target) in enumerate(folds)]
        )
    )
    per_fold = counts.withColumn("fold", F.explode(member)).groupBy("fold", "feature", "v").agg(F.sum("c").alias("c"))
    table = preprocessing_from_counts(cut_lineage(per_fold), ["fold", "feature"]).collect()  # folds x features rows
    grouped: dict[int, list] = {}
    for r in table:
        grouped.setdefault(r["fold"], []).append(r)
    return {i: _preprocessor(rs, features) for i, rs in grouped.items()}


def encode_products(rows: DataFrame, key: str, keep_index: bool = False) -> tuple[DataFrame, str]:
    """Sparse one-hot of the series identity; its position stays as series_ix if asked for."""
    indexed = StringIndexer(inputCol=key, outputCol="series_ix", handleInvalid="keep").fit(rows).transform(rows)
    out = OneHotEncoder(inputCol="series_ix", outputCol="series_vec", dropLast=False).fit(indexed).transform(indexed)
    return (out if keep_index else out.drop("series_ix")), "series_vec"


def assemble(rows: DataFrame, prep: Preprocessor, extra: list[str]) -> DataFrame:
    prepared = prep.apply(rows)
    out = VectorAssembler(inputCols=[*prep.columns, *extra], outputCol="features", handleInvalid="error").transform(prepared)
    return out.drop(*prep.columns)


NORMAL_WIDTH = 4096  # the normal-equation solver of the estimator takes no more columns


def linear(train: DataFrame):
    """Ridge with a free intercept; the penalty is rescaled to the estimator's own objective.

    Beyond NORMAL_WIDTH columns, thousands of one-hot series, the same objective is minimised iteratively.
    """
    first = train.select("features").first()
    wide = first is not None and first["features"].size > NORMAL_WIDTH
    stats = train.agg(F.count("label").alias("n"), F.stddev_pop("label").alias("s")).first()
    reg = RIDGE / stats["n"] * (stats["s"] or 1.0)
    return LinearRegression(
        solver="l-bfgs" if wide else "normal", standardization=False, regParam=reg, elasticNetParam=0.0, maxIter=200
    ).fit(train)


def forest(train: DataFrame):
    return RandomForestRegressor(
        numTrees=12, maxDepth=3, minInstancesPerNode=5, featureSubsetStrategy="0.45", seed=SEED
    ).fit(train)


def boosting(train: DataFrame):
    return GBTRegressor(maxIter=16, maxDepth=1, stepSize=0.12, minInstancesPerNode=7, seed=SEED).fit(train)


MODELS = {"linear": linear, "forest": forest, "boosting": boosting}


def column_names(rows: DataFrame, features: list[str], key: str) -> DataFrame:
    """(position, feature) of the assembled columns that have a name: the features, and the products after the missing flags."""
    own = rows.sparkSession.createDataFrame(list(enumerate(features)), "position int, feature string")
    at = F.lit(2 * len(features)) + F.col("series_ix").cast("int")
    return own.unionByName(rows.select(at.alias("position"), F.concat(F.lit("product:"), F.col(key)).alias("feature")).distinct())


def importance(model, names: DataFrame) -> DataFrame:
    """(feature, importance): |coefficient| or impurity gain of every named column, as a share of all columns."""
    raw = model.coefficients if hasattr(model, "coefficients") else model.featureImportances
    vector = names.sparkSession.createDataFrame([(raw,)], ["v"])
    weights = vector.select(F.posexplode(vector_to_array("v")).alias("position", "w")).withColumn("w", F.abs("w"))
    total = weights.agg(F.sum("w")).first()[0] or 1.0
    return names.join(weights, "position").select("feature", (F.col("w") / F.lit(total)).alias("importance"))


def predictions(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("pred", F.greatest(F.lit(0.0), F.col("prediction")))


def fold_targets(rows: DataFrame, horizons: tuple[int, ...], last: int) -> list[tuple]:
    """The last target months per horizon with enough earlier rows; four or fewer months are all used."""
    months = rows.filter(F.col("horizon").isin(*horizons)).groupBy("horizon", "target_period").agg(F.count(F.lit(1)).alias("n"))
    by_horizon: dict[int, list] = {}
    for r in months.orderBy("horizon", "target_period").collect():  # calendar x horizons rows
        by_horizon.setdefault(r["horizon"], []).append((r["target_period"], r["n"]))
    folds = []
    for h, entries in by_horizon.items():
        take = min(last, max(0, len(entries) - 4)) or len(entries)
        earlier = 0
        for i, (target, n) in enumerate(entries):
            if i >= len(entries) - take and earlier >= MIN_TRAIN:
                folds.append((h, target))
            earlier += n
    return folds


def fold_predictions(rows: DataFrame, model_name: str, fold: tuple, prep: Preprocessor) -> DataFrame:
    """Fit on targets strictly before the fold month, predict the fold month."""
    horizon, target = fold
    at_h = rows.filter(F.col("horizon") == horizon)
    train, test = at_h.filter(F.col("target_period") < F.lit(target)), at_h.filter(F.col("target_period") == F.lit(target))
    model = MODELS[model_name](assemble(train, prep, ["series_vec"]))
    return predictions(model, assemble(test, prep, ["series_vec"]))


def temporal_backtest(
    rows: DataFrame, model_name: str, keys: list[str], last: int = 2, horizons: tuple[int, ...] = HORIZONS, features: list[str] = FEATURES
) -> DataFrame:
    """Endpoint predictions of the last folds of every horizon."""
    folds = fold_targets(rows, horizons, last)
    if not folds:
        raise ValueError("no temporal window has enough training rows")
    preps = fit_preprocessors(rows, features, folds)
    out = None
    for i, fold in enumerate(folds):
        part = fold_predictions(rows, model_name, fold, preps[i]).select(
            *keys, "horizon", "target_period", F.col("label").alias("actual"), "pred"
        )
        out = part if out is None else out.unionByName(part)
    return out
