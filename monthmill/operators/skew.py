"""Joins and rankings that survive one key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 16


def hot_keys(rows: DataFrame, keys: list[str], salts: int = SALTS) -> DataFrame:
    """Keys that hold more than 1 / (2 salts) of all rows: fewer than 2 salts of them."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") * (2 * salts) > total).select(*keys)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join many rows to a table with few rows per key.

    The rows of a hot key, found by counting, are spread over `salts` tasks by a hash of their content, and only its
    rows of the table are repeated that many times. The result equals the plain join on `keys`.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    hot = F.broadcast(hot_keys(rows, keys, salts).withColumn("_hot", F.lit(True)))  # fewer than 2 salts rows
    place = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts)).cast("int")
    spread = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), place).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = table.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")
