"""Calendar-complete series, contiguity, lifecycle and window features.

A series is one row per key set with an array of months. The array is bounded
by the calendar, never by the number of source rows: facts are summed per month
(with partial aggregation on the map side) before anything is collected.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from monthmill.functions.periods import spine


def dense_series(monthly: DataFrame, keys: list[str], measures: list[str], issue: dt.date) -> DataFrame:
    known = monthly.filter(F.col("period") <= F.lit(issue))
    grouped = known.groupBy(*keys).agg(
        F.min("period").alias("first_period"),
        F.map_from_entries(F.collect_list(F.struct("period", F.struct(*measures)))).alias("by_period"),
    )
    months = F.transform(
        spine(F.col("first_period"), F.lit(issue)),
        lambda p: F.struct(
            p.alias("period"), *[F.try_element_at("by_period", p)[m].alias(m) for m in measures]
        ),
    )
    return grouped.select(*keys, months.alias("months"))


def spread(series: DataFrame, keys: list[str]) -> DataFrame:
    """Even out series over all tasks before per-series scans.

    A series row is small but costs much CPU, so size-based partition coalescing
    would leave it to very few tasks; an explicit count is kept as given.
    """
    spark = series.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return series.repartition(tasks, *keys)


def explode_series(series: DataFrame, keys: list[str]) -> DataFrame:
    """Long dense form with a 1-based month position; keeps the key partitioning."""
    return series.select(*keys, F.posexplode("months").alias("pos", "m")).select(
        *keys, (F.col("pos") + 1).alias("idx"), "m.*"
    )


def observed_values(rows: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Ordered observed values per key, from the first positive month on."""
    points = rows.filter(F.col(measure).isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("period", F.col(measure).alias("value")))).alias("points")
    )
    return drop_leading_zeros(points, keys)


def drop_leading_zeros(points: DataFrame, keys: list[str]) -> DataFrame:
    """Months before the first sale are not demand; zeros after it are."""
    first = F.expr("array_position(transform(points, p -> p.value > 0), true)")
    trimmed = points.withColumn("first", first).withColumn(
        "points", F.when(F.col("first") > 0, F.expr("slice(points, cast(greatest(first, 1) as int), size(points))"))
        .otherwise(F.col("points"))
    )
    return trimmed.select(
        *keys,
        F.expr("transform(points, p -> p.period)").alias("periods"),
        F.expr("transform(points, p -> p.value)").alias("values"),
        (F.greatest(F.col("first"), F.lit(1)) - 1).cast("int").alias("excluded"),
    )


def islands(panel: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Contiguous runs of known months: rows get the number of gaps before them."""
    w = Window.partitionBy(*keys).orderBy("idx")
    gaps = panel.withColumn("island", F.sum(F.when(F.col(measure).isNull(), 1).otherwise(0)).over(w))
    return gaps.filter(F.col(measure).isNotNull())


def island_values(panel: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Each contiguous run as its own series, leading zeros dropped.

    The issue-anchored history of any month is a prefix of the run holding it; a
    run without any sale is no history.
    """
    runs = islands(panel, keys, measure)
    return observed_values(runs, [*keys, "island"], measure).filter(F.exists("values", lambda x: x > 0))


def launch_history(panel: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Launch-anchored history: from the first positive month to the first gap."""
    w = Window.partitionBy(*keys).orderBy("idx")
    start = F.min(F.when(F.col(measure) > 0, F.col("idx"))).over(Window.partitionBy(*keys))
    after = panel.withColumn("start", start).filter(F.col("idx") >= F.col("start"))
    broken = F.sum(F.when(F.col(measure).isNull(), 1).otherwise(0)).over(w)
    return after.withColumn("broken", broken).filter(F.col("broken") == 0).drop("start", "broken")


def lag_features(panel: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Issue-month features; lag 1 is the issue month itself."""
    w = Window.partitionBy(*keys).orderBy("idx")
    v = F.col(measure)
    out = panel
    for k in (1, 2, 3, 6, 12):
        out = out.withColumn(f"lag_{k}", F.lag(v, k - 1).over(w))
    for width in (3, 6, 12):
        frame = w.rowsBetween(-(width - 1), 0)
        out = (
            out.withColumn(f"mean_{width}", F.avg(v).over(frame))
            .withColumn(f"std_{width}", F.stddev_pop(v).over(frame))
            .withColumn(f"min_{width}", F.min(v).over(frame))
            .withColumn(f"max_{width}", F.max(v).over(frame))
        )
    return out


def growth_features(panel: DataFrame, keys: list[str], measure: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("idx")
    v = F.col(measure)
    recent, prior = w.rowsBetween(-2, 0), w.rowsBetween(-5, -3)

    def slope(frame):
        n = F.count(v).over(frame)
        first, last = F.first(v, ignorenulls=True).over(frame), F.last(v, ignorenulls=True).over(frame)
        return F.when(n > 1, (last - first) / F.greatest(F.lit(1), n - 1))

    return (
        panel.withColumn("mom", F.try_divide(v, F.lag(v, 1).over(w)) - 1)
        .withColumn("yoy", F.try_divide(v, F.lag(v, 11).over(w)) - 1)
        .withColumn("slope", slope(recent))
        .withColumn("acceleration", slope(recent) - slope(prior))
    )


def movement_features(panel: DataFrame, keys: list[str], measure: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(measure)
    hit = F.when(v > 0, F.col("idx"))
    n_hit, n_obs = F.count(hit).over(w), F.count(v).over(w)
    first, last = F.min(hit).over(w), F.max(hit).over(w)
    return (
        panel.withColumn("months_since_sale", F.coalesce(F.col("idx") - last, F.col("idx")))
        .withColumn("zero_months", F.count(F.when(v == 0, 1)).over(w))
        .withColumn("movement_share", F.coalesce(F.try_divide(n_hit, n_obs), F.lit(0.0)))
        .withColumn("mean_interval", F.when(n_hit > 1, (last - first) / (n_hit - 1)))
    )


def lifecycle_label(history: Column, min_train: int = 18) -> Column:
    """PRE-LAUNCH / COLD_START / INACTIVE / ACTIVE from a history array."""
    n = F.size(history)
    tail_zero = F.forall(F.slice(history, F.greatest(n - 5, F.lit(1)), F.lit(6)), lambda x: x == 0)
    return (
        F.when(history.isNull() | (n == 0), "PRE-LAUNCH")
        .when(n < min_train, "COLD_START")
        .when(tail_zero, "INACTIVE")
        .otherwise("ACTIVE")
    )
