"""Structured Streaming jobs: arriving monthly files, late corrections, running totals, lag monitoring."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DateType, StringType, StructType, TimestampNTZType, TimestampType

from monthmill.sources.monthly_files import append_versions, parse_monthly


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def ingest_monthly(stream: DataFrame, profile: dict[str, str], facts_path: str, rejects_path: str, keys: list[str], order: list[str], period: str = "period") -> DataStreamWriter:
    """Validate each micro-batch and append its rows as the next versions of their keys. A replayed batch adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        accepted, rejected = parse_monthly(batch, profile)
        append_versions(accepted, facts_path, batch_id, keys, order, period)
        # rejects carry the batch id, so a retried batch overwrites its own folder
        rejected.write.mode("overwrite").parquet(f"{rejects_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write)


# State of a bucket of facts, as Arrow tables: the version in force of each, and the ids of all versions seen, by the
# number of their fact, so that a repeated file changes nothing.
IN_FORCE = "facts binary, seen binary"
BUCKETS = 64


def packed(table: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    columns = pa.Table.from_pandas(table, preserve_index=False)
    with pa.ipc.new_stream(sink, columns.schema) as out:
        out.write_table(columns)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_pandas()


def take_versions(facts: pd.DataFrame, seen: pd.DataFrame, arrived: pd.DataFrame, keys: list[str]) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """The facts of a bucket and the ids seen after versions arrived, and keys, old, new and added of the facts they touch."""
    every = pd.concat([facts[keys], arrived[keys]], ignore_index=True)
    numbers = every.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()  # held facts keep their numbers
    arrived = arrived.assign(_fact=numbers[len(facts):])
    ids = pd.concat([seen, arrived[["_fact", "_id"]]], ignore_index=True)
    fresh = ~ids.duplicated().to_numpy()
    arrived = arrived[fresh[len(seen):]]
    # of the versions of a fact the latest, then the one of the largest id, stands last
    latest = arrived.sort_values(["_fact", "_at", "_id"], na_position="first").drop_duplicates("_fact", keep="last").set_index("_fact")
    added = arrived["_fact"].value_counts().reindex(latest.index).to_numpy()
    known = latest.index < len(facts)
    held = facts.loc[latest.index[known]]
    old = pd.Series(pd.NA, index=latest.index, dtype="Int64")
    old[held.index] = held["_value"].to_numpy()
    mine = latest.loc[held.index]
    later = (mine["_at"] > held["_at"]) | ((mine["_at"] == held["_at"]) & (mine["_id"] > held["_id"]))
    facts = pd.concat([facts, latest[~known][facts.columns]]).sort_index()  # new facts are numbered in order of arrival
    facts.loc[later.index[later], ["_at", "_id", "_value"]] = mine.loc[later, ["_at", "_id", "_value"]]
    now = facts.loc[latest.index]
    return facts, ids[fresh], now[keys].assign(old=old, new=now["_value"], added=added)


def changes(stream: DataFrame, keys: list[str], at: str, version: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    """keys, old, new, added: how each micro-batch changes the version in force of a fact.

    The version with the latest time, then the largest id, is in force, in whatever order versions arrive. `value` is a
    whole number (hundredths, say), so sums of it are exact. `old` is null for a fact seen for the first time; old and
    new are equal if only older versions arrived; a version that arrives again is not counted. State is kept for each
    fact, so neither the facts nor earlier batches are read again.

    Facts are dealt into `buckets` by the hash of their key, and one call takes all versions of a bucket at once; a call
    for each fact would cost more than its versions. Some ten thousand versions to a bucket are right. The number of buckets
    belongs to the checkpoint and must not change.
    """
    types = {f.name: f.dataType for f in stream.select(*keys).schema}
    # numbers and flags as text, which keeps them exact beside nulls in pandas
    exact = {k: F.col(k) if isinstance(kind, (StringType, TimestampType, TimestampNTZType, DateType)) else F.col(k).cast("string") for k, kind in types.items()}
    bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(frames), ignore_index=True).drop(columns="_bucket")
        if state.exists:
            facts, seen = [unpacked(part) for part in state.get]
        else:
            facts, seen = arrived.head(0), pd.DataFrame({"_fact": pd.Series(dtype="int64"), "_id": pd.Series(dtype="int64")})
        facts, seen, touched = take_versions(facts, seen, arrived, keys)
        if len(touched):
            state.update((packed(facts), packed(seen)))
            yield touched

    rows = stream.select(bucket.alias("_bucket"), *[c.alias(k) for k, c in exact.items()], F.col(at).alias("_at"), F.col(version).alias("_id"), F.col(value).alias("_value"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    touched = rows.groupBy("_bucket").applyInPandasWithState(
        update, f"{kinds}, old long, new long, added long", IN_FORCE, "update", GroupStateTimeout.NoTimeout)
    return touched.select(*[F.col(k).cast(kind).alias(k) for k, kind in types.items()], "old", "new", "added")


def retractions(changed: DataFrame, forecasts: DataFrame, scope: list[str], forecast: str) -> DataFrame:
    """scope and what its sums change by: the old version's share is taken back, the new one's is added.

    `forecasts` are frozen, one for each scope; facts without one are not scored.
    """
    joined = changed.join(forecasts, scope)

    def share(value: Column, of: Column) -> Column:
        return F.sum(F.when(value.isNotNull(), of).otherwise(0))

    old, new, f = F.col("old"), F.col("new"), F.col(forecast)
    return joined.groupBy(*scope).agg(
        F.sum(F.when(old.isNull(), 1).otherwise(0)).alias("facts"), F.sum("added").alias("versions"),
        (F.sum(new) - share(old, old)).alias("actual"), (F.sum(F.abs(new - f)) - share(old, F.abs(old - f))).alias("error"),
        (F.sum(new - f) - share(old, old - f)).alias("bias"),
    )


def rescore(
    stream: DataFrame, keys: list[str], at: str, version: str, value: str, forecasts: DataFrame, scope: list[str], forecast: str, path: str,
    buckets: int = BUCKETS,
) -> DataStreamWriter:
    """Keeps the error sums of frozen forecasts up to date as facts and corrections arrive, late ones included.

    Each micro-batch writes what it changes, one row for each scope it touches, to a folder of its own; a batch that is
    repeated overwrites it. `scores` adds them up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        retractions(batch, forecasts, scope, forecast).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return changes(stream, keys, at, version, value, buckets).writeStream.outputMode("update").foreachBatch(write)


def scores(spark: SparkSession, path: str, scope: list[str]) -> DataFrame:
    """The error sums of each scope over all batches so far."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.groupBy(*scope).agg(*[F.sum(c).alias(c) for c in ("facts", "versions", "actual", "error", "bias")])


def running_totals(stream: DataFrame, event_time: str, value: str, keys: list[str], window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Totals per key and window, maintained as facts arrive."""
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, window).alias("w"), *keys)
        .agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n_facts"))
        .select(F.col("w.start").alias("window_start"), *keys, "total", "n_facts")
    )


def availability_lag(stream: DataFrame, event_time: str, period_end: str, keys: list[str], window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """How long after the end of its period a fact became known, per arrival window."""
    lag = F.unix_micros(F.col(event_time).cast("timestamp")) - F.unix_micros(F.col(period_end).cast("timestamp"))
    return (
        stream.withWatermark(event_time, delay)
        .withColumn("lag_hours", F.floor(lag / 3.6e9))
        .groupBy(F.window(event_time, window).alias("w"), *keys)
        .agg(F.max("lag_hours").alias("max_lag_hours"), F.min("lag_hours").alias("min_lag_hours"), F.count(F.lit(1)).alias("n_facts"))
        .select(F.col("w.start").alias("window_start"), *keys, "min_lag_hours", "max_lag_hours", "n_facts")
    )
