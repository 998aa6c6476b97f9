"""As-of replays over many cutoffs in one job, readiness and data quality."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from monthmill.functions.numbers import rounded
from monthmill.functions.periods import month_index
from monthmill.operators.backtest import series_results
from monthmill.session import cut_lineage


def replay_totals(versions: DataFrame, keys: list[str], cutoff: str, order: list[str], value: str) -> DataFrame:
    """Per cutoff: known facts and the total of the versions in force.

    A version counts from its cutoff until the next version of the same key, so
    each one contributes +value at its start and -value at its end; the running
    sum over the (few) cutoffs gives every replay without copying rows per cutoff.
    """
    per_day = versions.groupBy(*keys, cutoff).agg(F.max_by(value, F.struct(*order)).alias("v"))
    w = Window.partitionBy(*keys).orderBy(cutoff)
    spans = per_day.withColumn("ends", F.lead(cutoff).over(w))
    moves = spans.select(
        F.inline(
            F.array(
                F.struct(F.col(cutoff).alias("cutoff"), F.lit(1).alias("dn"), F.col("v").cast("decimal(28,6)").alias("dv")),
                F.struct(F.col("ends").alias("cutoff"), F.lit(-1).alias("dn"), (-F.col("v")).cast("decimal(28,6)").alias("dv")),
            )
        )
    ).filter(F.col("cutoff").isNotNull())
    daily = moves.groupBy("cutoff").agg(F.sum("dn").alias("dn"), F.sum("dv").alias("dv"))
    upto = Window.orderBy("cutoff").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(
        "cutoff", F.sum("dn").over(upto).alias("known_facts"), F.sum("dv").over(upto).cast("double").alias("total")
    )


def known_totals(versions: DataFrame, scope: list[str], fact: list[str], period: str, available: str, order: list[str], value: str) -> DataFrame:
    """scope, period, cutoff, known: the total of a month's facts in force, at each cutoff at which it changes.

    A version adds what it differs by from the one before it at the month in which it becomes available; of versions
    that become available together the last in `order` counts.
    """
    keys = [*scope, *fact, period]
    each = versions.groupBy(*keys, F.col(available).alias("cutoff")).agg(F.max_by(F.col(value), F.struct(*order)).cast("decimal(28,6)").alias("v"))
    before = F.lag("v").over(Window.partitionBy(*keys).orderBy("cutoff"))
    moved = each.withColumn("dv", F.col("v") - F.coalesce(before, F.lit(0))).groupBy(*scope, period, "cutoff").agg(F.sum("dv").alias("dv"))
    upto = Window.partitionBy(*scope, period).orderBy("cutoff").rowsBetween(Window.unboundedPreceding, 0)
    return moved.select(*scope, F.col(period).alias("period"), "cutoff", F.sum("dv").over(upto).cast("double").alias("known"))


def prefixes(known: DataFrame, scope: list[str], end: dt.date) -> DataFrame:
    """One row for each scope and cutoff up to `end`: cutoff, run_cutoff, n, and the history if it differs from the last one.

    run_cutoff is the cutoff at which the history that holds was first known: equal to cutoff where something changed,
    earlier where the history, and so the forecast, is carried forward. A scope's changes are bounded by the calendar.
    """
    moves = known.groupBy(*scope).agg(F.collect_list(F.struct("cutoff", "period", "known")).alias("moves"))
    names = [*scope, "cutoff", "run_cutoff", "n", "periods", "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = sorted((m["cutoff"], m["period"], m["known"]) for m in row["moves"])
                at, now, held, since = 0, {}, None, None
                for cutoff in months_between(own[0][0], end):
                    while at < len(own) and own[at][0] <= cutoff:
                        now[own[at][1]] = own[at][2]
                        at += 1
                    history = [(p, now[p]) for p in sorted(now) if p <= cutoff]
                    while history and history[0][1] <= 0:
                        history = history[1:]  # before the first sale
                    changed = history != held
                    if changed:
                        held, since = history, cutoff
                    shown = history if changed else None
                    out.append({**{k: row[k] for k in scope}, "cutoff": cutoff, "run_cutoff": since, "n": len(history),
                                "periods": [p for p, _ in shown] if changed else None, "values": [v for _, v in shown] if changed else None})
            kinds = [batch.schema.field(k) for k in scope] + [
                pa.field("cutoff", pa.date32()), pa.field("run_cutoff", pa.date32()), pa.field("n", pa.int32()),
                pa.field("periods", pa.list_(pa.date32())), pa.field("values", pa.list_(pa.float64()))]
            yield from pa.Table.from_pylist(out, pa.schema(kinds)).to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.select(*scope).schema)
    return moves.mapInArrow(run, f"{kinds}, cutoff date, run_cutoff date, n int, periods array<date>, values array<double>").select(*names)


def months_between(first: dt.date, last: dt.date) -> Iterator[dt.date]:
    for k in range(first.year * 12 + first.month - 1, last.year * 12 + last.month):
        yield dt.date(k // 12, k % 12 + 1, 1)


def replay(known: DataFrame, scope: list[str], end: dt.date) -> DataFrame:
    """What a run at each cutoff gives: status, whether it is carried forward, winner, last known month and the forecast.

    COMPLETED; SKIPPED_INSUFFICIENT_HISTORY below seven months; BLOCKED without any. Only histories that changed are
    run, each once; the others take the run of the cutoff that they equal. residuals are those of the winner's one-step
    history, from the seventh month on.
    """
    every = cut_lineage(prefixes(known, scope, end))
    changed = every.filter(F.size("values") > 0).withColumn("at", F.col("cutoff")).select(*scope, "at", "periods", "values")
    results = series_results(changed, [*scope, "at"]).select(
        *[F.col(c).alias(f"_{c}") for c in scope], F.col("at").alias("_at"), "winner", "forecast", "history", F.element_at("periods", -1).alias("last_month"))
    amounts = changed.select(*[F.col(c).alias(f"_{c}") for c in scope], F.col("at").alias("_at"), F.col("values").alias("amounts"))
    residuals = F.zip_with(F.slice("amounts", 7, 10 ** 6), "history", lambda a, p: a - p)
    results = results.join(amounts, [*[f"_{c}" for c in scope], "_at"]).withColumn("residuals", residuals)
    met = F.col("run_cutoff") == F.col("_at")
    for c in scope:
        met &= F.col(c) == F.col(f"_{c}")
    status = F.when(F.col("n") == 0, "BLOCKED").when(F.col("n") < 7, "SKIPPED_INSUFFICIENT_HISTORY").otherwise("COMPLETED")
    return every.join(results, met, "left").select(
        *scope, "cutoff", "run_cutoff", "n", status.alias("status"), (F.col("cutoff") != F.col("run_cutoff")).alias("carried"),
        "winner", "last_month", "forecast", "residuals",
    )


def readiness(panel: DataFrame, keys: list[str], measure: str, minimum: int = 7) -> DataFrame:
    """Per series and month: launch-anchored consecutive months and whether a backtest is possible."""
    w = Window.partitionBy(*keys).orderBy("idx")
    start = F.min(F.when(F.col(measure) > 0, F.col("idx"))).over(w)
    base = panel.withColumn("start", start)
    broken = F.sum(F.when((F.col("idx") >= F.col("start")) & F.col(measure).isNull(), 1).otherwise(0)).over(w)
    run = F.sum(F.when((F.col("idx") >= F.col("start")) & (F.col("broken") == 0), 1).otherwise(0)).over(w)
    out = base.withColumn("broken", broken).withColumn("consecutive", run)
    latest = F.col("start") + F.col("consecutive") - 1
    near = latest >= F.col("idx") - 1
    status = (
        F.when(F.col("start").isNull(), "NO_DATA").when((F.col("consecutive") < minimum) | ~near, "INSUFFICIENT_HISTORY").otherwise("READY")
    )
    return out.withColumn("status", status).drop("start", "broken")


def data_quality(rows: DataFrame, keys: list[str], issue, minimum: int = 18, warning: float = 0.85, ready: float = 0.95) -> DataFrame:
    """Observed against expected months, duplicates, invalid and unknown-availability values."""
    per_month = rows.filter(F.col("period") <= F.lit(issue)).groupBy(*keys, "period").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull() | (F.col("value") < 0)).alias("bad"),
        F.count_if(F.col("available_at").isNull()).alias("unknown"),
    )
    g = per_month.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observed"), F.min("period").alias("earliest"), F.max("period").alias("latest"),
        F.max("n").alias("most"), F.sum("bad").alias("invalid"), F.sum("unknown").alias("unknown_available_at"),
    )
    expected = month_index(F.lit(issue)) - month_index(F.col("earliest")) + 1
    g = g.withColumn("expected", expected).withColumn("missing", F.greatest(F.lit(0), F.col("expected") - F.col("observed")))
    rate = F.col("observed") / F.col("expected")
    status = (
        F.when(F.col("most") > 1, "IDENTITY_CONFLICT").when(F.col("invalid") > 0, "BLOCKED")
        .when((F.col("missing") > 0) & (rate < warning), "HISTORICAL_INCOMPLETE").when(F.col("observed") < minimum, "INSUFFICIENT_HISTORY")
        .when((F.col("missing") > 0) | (rate < ready) | (F.col("unknown_available_at") > 0), "DATA_QUALITY_WARNING").otherwise("DATA_QUALITY_READY")
    )
    return g.withColumn("continuity", rounded(rate, 6)).withColumn("status", status)


