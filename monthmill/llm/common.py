"""Column helpers, shared storage and the query registry of the subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from monthmill.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only doc_id, text (null becomes empty) and the named columns: whatever else the input holds cannot clash."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def lean(run):
    """Wraps the function of a task: at its end, freed memory goes back to the system instead of staying with the worker."""

    @wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return task


def values(column: pa.Array) -> Iterator:
    """The values of a column one after the other, so that a batch of long texts is not held twice."""
    return (v.as_py() for v in column)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one struct, so that working columns cannot clash with them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(None)).alias("rest"))


def unpacked(docs: DataFrame, *added: str) -> list[Column]:
    """The columns of `docs` from its packed form; those named like an added column give way to it."""
    return [
        F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns if c not in added
    ]


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, other letters untouched."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fold(text: str) -> str:
    """A-Z to a-z; in UTF-8 no other character has these bytes."""
    return text.encode().translate(_FOLD).decode()


_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def remainder(doc_id: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that all executors reach."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """Write rows once to shared storage; later steps read them and survive lost executors."""
    path = folder(df.sparkSession, name)
    writer = df.write.partitionBy(partition) if partition else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


