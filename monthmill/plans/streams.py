"""The streaming jobs run over the event files to completion (availableNow)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from monthmill.plans.registry import query
from monthmill.session import checkpoint_dir, cut_lineage
from monthmill.sources.tables import Tables
from monthmill.streaming import jobs


def event_stream(t: Tables) -> DataFrame:
    """The events file as a stream."""
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.root)


def work_dir(t: Tables, name: str) -> str:
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, t: Tables, name: str, keys: list[str]) -> DataFrame:
    """Run an aggregation stream to the end of its input; the last update of each key counts."""
    folder = work_dir(t, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    rows = t.spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out").drop("batch")
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


@query("x03_running_totals", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n_facts FROM events GROUP BY ALL""")
def running_totals(t: Tables):
    stream = event_stream(t).withColumn("value", F.col("value").cast("decimal(18,2)"))
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    totals = jobs.running_totals(stream, "ts", "value", ["event_type"])
    out = drain(totals, t, "totals", ["window_start", "event_type"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", F.col("total").cast("double").alias("total"), "n_facts")


@query("x04_availability_lag", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, min(CAST(floor(epoch(ts - date_trunc('week', ts)) / 3600) AS BIGINT)) AS min_lag_hours, max(CAST(floor(epoch(ts - date_trunc('week', ts)) / 3600) AS BIGINT)) AS max_lag_hours, count(*) AS n_facts FROM events GROUP BY ALL""")
def availability_lag(t: Tables):
    stream = event_stream(t).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("period_end", F.date_trunc("week", "ts"))
    lag = jobs.availability_lag(stream, "ts", "period_end", ["event_type"])
    out = drain(lag, t, "lag", ["window_start", "event_type"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "min_lag_hours", "max_lag_hours", "n_facts")


@query("x01_arriving_files", """
SELECT strftime(ts, '%Y-%m') AS period, 'P' || user_id AS product_code, count(*) AS stored, count(*) AS last_version, arg_max(CAST(value AS DOUBLE), (ts, event_id)) AS latest FROM events WHERE event_type <> 'error' GROUP BY ALL""")
def arriving_files(t: Tables):
    folder = work_dir(t, "ingest")
    kind = F.col("event_type")
    stream = event_stream(t).select(
        F.col("event_id").cast("string").alias("event_id"), F.when(kind == "error", "total").otherwise(F.concat(F.lit("P"), F.col("user_id").cast("string"))).alias("SKU"),
        kind.alias("TEXT"), F.date_format("ts", "yyyy-MM").alias("MONTH"), F.col("value").cast("string").alias("SOLD"), F.col("ts"),
    )
    profile = {"product_code": "SKU", "description": "TEXT", "period": "MONTH", "sales": "SOLD"}
    writer = jobs.ingest_monthly(stream, profile, f"{folder}/facts", f"{folder}/rejects", ["product_code", "period"], ["ts", F.col("event_id").cast("long")])
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    stored = t.spark.read.option("basePath", f"{folder}/facts").parquet(f"{folder}/facts")
    return stored.groupBy(F.col("period").cast("string").alias("period"), "product_code").agg(
        F.count(F.lit(1)).alias("stored"), F.max("version_no").alias("last_version"), F.max_by(F.col("sales").cast("double"), "version_no").alias("latest")
    )


# A fact is the value of a user and kind in a week; each event is a version of it, the latest is in force. The frozen
# forecast of a kind and week is the mean of the kind's events in the week before.
WEEK_SQL = """
WITH v AS (SELECT event_type, user_id, date_trunc('week', ts) AS week, ts, event_id, CAST(floor(value * 100 + 0.5e0) AS BIGINT) AS cents FROM events),
f AS (SELECT event_type, week + INTERVAL 7 DAY AS week, CAST(floor(CAST(sum(cents) AS DOUBLE) / count(*) + 0.5e0) AS BIGINT) AS forecast FROM v GROUP BY ALL),
cur AS (SELECT event_type, user_id, week, count(*) AS versions, arg_max(cents, (ts, event_id)) AS cents FROM v GROUP BY ALL)
"""


def weekly_versions(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return t.events.select(
        "event_id", "user_id", "event_type", ts.alias("ts"), F.date_trunc("week", ts).alias("week"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"))


def frozen_forecasts(versions: DataFrame) -> DataFrame:
    mean = F.floor(F.sum("cents").cast("double") / F.count(F.lit(1)) + 0.5).cast("long")
    following = (F.col("week") + F.expr("interval 7 days")).alias("week")
    return versions.groupBy("event_type", following).agg(mean.alias("forecast"))


PER_BUCKET = 20_000  # versions whose state is kept together


@query("x02_late_corrections", WEEK_SQL + """
SELECT event_type, strftime(week, '%Y-%m-%d') AS week, CAST(sum(versions) AS BIGINT) AS versions, count(*) AS facts, CAST(sum(cents) AS BIGINT) AS actual,
  CAST(sum(abs(cents - forecast)) AS BIGINT) AS error, CAST(sum(cents - forecast) AS BIGINT) AS bias FROM cur JOIN f USING (event_type, week) GROUP BY event_type, week""")
def late_corrections(t: Tables):
    """Every event arrives in one of three loads, of which the last holds the oldest versions; the first load comes twice."""
    folder = work_dir(t, "rescore")
    versions = weekly_versions(t)
    third = F.col("event_id") % 3
    arrivals = versions.withColumn("load", F.when(F.dayofmonth("ts") <= 10, 2).otherwise((third == 0).cast("int")))
    forecasts = cut_lineage(frozen_forecasts(versions))
    buckets = t.events.count() // PER_BUCKET + 1
    for load in (1, 0, 2, 1):
        arrivals.filter(F.col("load") == load).drop("load").write.mode("append").parquet(f"{folder}/in")
        # the stream goes on from its checkpoint and takes the files of this load as one micro-batch
        stream = jobs.file_stream(t.spark, f"{folder}/in", versions.schema)
        writer = jobs.rescore(
            stream, ["event_type", "user_id", "week"], "ts", "event_id", "cents", forecasts, ["event_type", "week"], "forecast", f"{folder}/out", buckets)
        writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return jobs.scores(t.spark, f"{folder}/out", ["event_type", "week"]).withColumn("week", F.date_format("week", "yyyy-MM-dd"))
