"""Comparing two states of a table by a hash tree, so that only what differs is joined.

A snapshot is written once, its rows dealt into buckets by the hash of their key, and buckets into parts. Every bucket
has a digest that does not depend on the order of rows, every part one of its buckets. Parts whose digests agree are
not looked at further; of the others only the buckets that differ are read again and joined.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from monthmill.session import checkpoint_dir

PARTS, PER_PART = 64, 64


@dataclass
class Snapshot:
    rows: DataFrame  # with _part and _bucket
    digests: DataFrame  # _part, _bucket, n, a, b: at most PARTS * PER_PART rows
    keys: list[str]
    value: str


def row_digest(columns: list[str], salt: int):
    every = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(F.lit(salt), *every, F.concat(*[c.isNull().cast("string") for c in every])).cast("decimal(38,0)")


def snapshot(rows: DataFrame, keys: list[str], value: str) -> Snapshot:
    """Writes keys and value of all rows, in parts that can be read alone. Repeated rows count as often as they stand there."""
    spark, path = rows.sparkSession, f"{checkpoint_dir(rows.sparkSession)}/snapshot-{uuid.uuid4().hex}"
    bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(PARTS * PER_PART)).cast("int")
    placed = rows.select(*keys, value).withColumn("_bucket", bucket).withColumn("_part", F.floor(F.col("_bucket") / PER_PART).cast("int"))
    # by bucket, so that a part is a few files and a hot part is not one task
    placed.repartition("_bucket").write.partitionBy("_part").parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path)
    columns = [*keys, value]
    digests = stored.groupBy("_part", "_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(row_digest(columns, 1)).alias("a"), F.sum(row_digest(columns, 2)).alias("b"))
    return Snapshot(stored, digests, keys, value)


def combined(digests: DataFrame, keys: list[str]) -> DataFrame:
    """The level above: sums over the hashed digests below."""
    return digests.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(row_digest(["_bucket", "n", "a", "b"], 3)).alias("a"), F.sum(row_digest(["_bucket", "n", "a", "b"], 4)).alias("b"))


def differing(left: Snapshot, right: Snapshot) -> tuple[list[int], list[int]]:
    """Parts, and within them buckets, whose digests differ; bounded lists."""

    def unlike(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        met = a.toDF(*keys, "n1", "a1", "b1").join(b.toDF(*keys, "n2", "a2", "b2"), keys, "full")
        same = F.col("n1").eqNullSafe(F.col("n2")) & F.col("a1").eqNullSafe(F.col("a2")) & F.col("b1").eqNullSafe(F.col("b2"))
        return met.filter(~same).select(*keys)

    parts = [r["_part"] for r in unlike(combined(left.digests, ["_part"]), combined(right.digests, ["_part"]), ["_part"]).collect()]
    if not parts:
        return [], []
    own = [s.digests.filter(F.col("_part").isin(parts)).select("_part", "_bucket", "n", "a", "b") for s in (left, right)]
    return sorted(parts), sorted(r["_bucket"] for r in unlike(*own, ["_part", "_bucket"]).collect())


def differences(left: Snapshot, right: Snapshot) -> DataFrame:
    """keys, status (changed, missing on the right, new on the right), old and new; rows of keys that agree are left out.

    A key that stands several times counts as changed if its values, taken as a multiset, differ.
    """
    parts, buckets = differing(left, right)

    def side(s: Snapshot, name: str) -> DataFrame:
        rows = s.rows.filter(F.col("_part").isin(parts) & F.col("_bucket").isin(buckets)) if buckets else s.rows.limit(0)
        return rows.groupBy(*s.keys).agg(F.sort_array(F.collect_list(F.struct(F.col(s.value).alias("v")))).alias(name))

    old, new = side(left, "_old"), side(right, "_new")
    other = {k: f"_{k}" for k in right.keys}
    met = None
    for k in left.keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        met = same if met is None else met & same
    joined = old.join(new.withColumnsRenamed(other), met, "full")
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "missing").when(F.col("_old") != F.col("_new"), "changed")
    first = lambda c: F.col(c)[0]["v"]
    return joined.select(
        *[F.when(F.col("_old").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in left.keys], status.alias("status"),
        first("_old").alias("old"), first("_new").alias("new"),
    ).filter("status is not null")


def summary(left: Snapshot, right: Snapshot, by: list[str], found: DataFrame | None = None) -> DataFrame:
    """by, status, n: differing keys by status, and the keys that are equal, which were never joined."""
    found = differences(left, right) if found is None else found
    counts = found.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))
    keys = left.rows.select(*left.keys).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    gone = found.filter("status <> 'new'").groupBy(*by).agg(F.count(F.lit(1)).alias("other"))
    met = None
    for k in by:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        met = same if met is None else met & same
    equal = keys.join(gone.withColumnsRenamed({k: f"_{k}" for k in by}), met, "left").select(
        *by, F.lit("equal").alias("status"), (F.col("n") - F.coalesce("other", F.lit(0))).alias("n")).filter("n > 0")
    return counts.unionByName(equal)
