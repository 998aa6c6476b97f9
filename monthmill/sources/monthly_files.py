"""Fact files: explicit schemas, profile mapping, versions, manifests and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from monthmill.functions import text as tx
from monthmill.operators.quality import split_valid

FACT_SCHEMA = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("canonical_product_id", "description", "objective", "period", "value", "is_missing", "source_file", "source_row")
    ]
)


def read_fact_csv(spark: SparkSession, path: str, schema: T.StructType = FACT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def normalise_facts(rows: DataFrame, objective: Column, keys: list[str], order: list[str]) -> DataFrame:
    """One objective; missing or blank becomes null (never zero); the last row per key wins."""
    value = F.when(
        (F.lower("is_missing") == "true") | (F.trim(F.coalesce("value", F.lit(""))) == ""), F.lit(None)
    ).otherwise(F.col("value").try_cast("double"))
    kept = rows.filter(F.lower("objective") == F.lower(objective)).withColumn("value", value)
    # a struct keeps a null value of the winning row instead of skipping it
    return kept.groupBy(*keys).agg(F.max_by(F.struct("value"), F.struct(*order)).alias("r")).select(*keys, "r.value")


def apply_profile(rows: DataFrame, profile: dict[str, str]) -> DataFrame:
    """Rename file columns to field names; fields without a column are null."""
    fields = ["product_code", "variant_code", "description", "category", "period", "sales", "order", "delivery"]
    carried = [c for c in rows.columns if c not in profile.values()]
    return rows.select(
        *carried, *[(F.col(profile[f]) if profile.get(f) else F.lit(None).cast("string")).alias(f) for f in fields]
    )


def parse_monthly(rows: DataFrame, profile: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with typed metrics, rejected rows with every error)."""
    mapped = apply_profile(rows, profile)
    code = tx.clean_code(F.lit(None).cast("double"), F.col("product_code"))
    metrics = [m for m in ("sales", "order", "delivery") if profile.get(m)]
    rules: dict[str, Column] = {
        "invalid_product_code": (code == "") | ~code.rlike("[0-9]"),
        "unverified_identity_formula": tx.is_formula(F.col("product_code")) | tx.is_formula(F.col("description")) | tx.is_formula(F.col("period")),
        "description_required": F.trim(F.coalesce("description", F.lit(""))) == "",
        "invalid_period": ~F.coalesce(F.trim("period"), F.lit("")).rlike("^20[0-9]{2}-(0[1-9]|1[0-2])$"),
    }
    valid = []
    for m in metrics:
        formula = tx.is_formula(F.trim(m))
        status = tx.literal_class(F.col(m))
        rules[f"unverified_formula:{m}"] = formula
        rules[f"invalid_metric:{m}"] = ~formula & (status == "INVALID")
        valid.append(~formula & (status == "VALUE"))
    none = ~valid[0]
    for v in valid[1:]:
        none = none & ~v
    rules["no_valid_metric"] = none
    accepted, rejected = split_valid(mapped, rules)
    typed = {m: F.when(tx.literal_class(F.col(m)) == "VALUE", tx.literal_value(F.col(m))) for m in metrics}
    return accepted.withColumns({**typed, "product_code": code, "category": F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("UNCLASSIFIED"))}), rejected


def next_versions(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """version_no = how often the key was already stored, plus one."""
    stored = existing.groupBy(*keys).agg(F.count(F.lit(1)).alias("stored"))
    return incoming.join(stored, keys, "left").withColumn("version_no", F.coalesce("stored", F.lit(0)) + 1).drop("stored")


def upsert_products(catalogue: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """First and last seen month per product over the old catalogue and the new rows."""
    new = incoming.groupBy(*keys).agg(F.min("period").alias("first_seen"), F.max("period").alias("last_seen"))
    return catalogue.select(*keys, "first_seen", "last_seen").unionByName(new).groupBy(*keys).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def distinct_files(files: DataFrame, content: str, name: str) -> DataFrame:
    """One representative per identical content, with the number of copies."""
    return files.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)).groupBy("sha256").agg(
        F.min(name).alias("representative"), F.count(F.lit(1)).alias("copies")
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def unseen(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet: what an append-only sink may write."""
    return rows.join(stored.select(*keys), keys, "left_anti")


def append_new(rows: DataFrame, path: str, keys: list[str], partition_by: list[str]) -> None:
    """Append rows with new keys; earlier files are never rewritten.

    Rows inside one call are deduplicated by key first, so a retried batch adds nothing.
    """
    spark = rows.sparkSession
    batch = rows.dropDuplicates(keys)
    if path_exists(spark, path):
        batch = unseen(batch, spark.read.schema(rows.schema).parquet(path), keys)
    batch.write.mode("append").partitionBy(*partition_by).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def append_versions(rows: DataFrame, path: str, batch_id: int, keys: list[str], order: list[str], period: str) -> None:
    """Append every row as the next version of its key; late corrections become new versions.

    A batch owns the folder `batch=<id>` and overwrites it, so a repeated batch changes nothing. Only earlier batches
    and the periods that the batch touches are read for the numbers. Rows of one batch are numbered in `order`.
    """
    spark = rows.sparkSession
    own = Window.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumn("_nth", F.row_number().over(own))
    if batch_id > 0 and path_exists(spark, path):
        touched = rows.select(period).distinct()
        schema = T.StructType([*rows.schema.fields, T.StructField("version_no", T.LongType()), T.StructField("batch", T.LongType())])
        earlier = spark.read.schema(schema).option("basePath", path).parquet(path)
        earlier = earlier.filter(F.col("batch") < batch_id).join(touched, period, "left_semi")
        counts = earlier.groupBy(*keys).agg(F.max("version_no").alias("_stored"))
        numbered = numbered.join(counts, keys, "left")
    else:
        numbered = numbered.withColumn("_stored", F.lit(0))
    out = numbered.withColumn("version_no", F.coalesce("_stored", F.lit(0)).cast("long") + F.col("_nth"))
    out.select(*rows.columns, "version_no").write.mode("overwrite").partitionBy(period).parquet(f"{path}/batch={batch_id}")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def explode_document(documents: DataFrame, column: str, schema: str, item: str, keys: list[str]) -> DataFrame:
    """Nested JSON documents to one row per element of `item`."""
    parsed = documents.select(*keys, F.from_json(F.col(column), schema).alias("doc"))
    return parsed.select(*keys, F.inline(f"doc.{item}"))
