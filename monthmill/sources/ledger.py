"""Append-only tables with manifests: what is not in a committed manifest is not there.

A batch is written to a folder of its own first; then its manifest, which names the folder and the hash of the batch's
content, appears by one rename. Readers take the folders of committed manifests only, so a batch that broke off stays
invisible, and a batch of equal content, in whatever order or number of files, is not added twice.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def content_id(rows: DataFrame) -> str:
    """The same for the same rows, whatever their order: sums of two hashes of every row, and their number."""
    every = [F.col(f"`{c}`") for c in sorted(rows.columns)]
    mixed = lambda *salt: F.sum(F.xxhash64(*salt, *every).cast("decimal(38,0)"))
    # a null hashes like nothing, so which columns are null is hashed too
    empty = F.concat(*[c.isNull().cast("string") for c in every])
    s = rows.agg(F.count(F.lit(1)).alias("n"), mixed(F.lit(1), empty).alias("a"), mixed(F.lit("b"), empty).alias("b")).first()
    return f"{s['n']}-{format(int(s['a'] or 0) % (1 << 64), '016x')}{format(int(s['b'] or 0) % (1 << 64), '016x')}"


class Ledger:
    """One table below `root`, a folder that driver and executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifests(self) -> list[dict]:
        """The committed batches in their order; one small entry each."""
        if not self._files().exists(self._path("manifests")):
            return []
        lines = self.spark.read.text(f"{self.root}/manifests/*.json").collect()
        return sorted((json.loads(r["value"]) for r in lines), key=lambda m: m["batch"])

    def commit(self, rows: DataFrame) -> dict:
        """Adds a batch and returns its manifest; a batch whose content is there already gives the manifest it has."""
        content, known = content_id(rows), self.manifests()
        same = [m for m in known if m["content"] == content]
        return same[0] if same else self.publish(self.stage(rows), content, len(known) + 1)

    def stage(self, rows: DataFrame) -> str:
        """Writes the rows to a new folder; nobody reads it before it is published."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        return folder

    def publish(self, folder: str, content: str, batch: int) -> dict:
        """The manifest appears whole, by a rename; of two writers of one batch number the second fails."""
        manifest = {"batch": batch, "content": content, "folder": folder}
        files, temporary, final = self._files(), self._path(f"staged/{uuid.uuid4().hex}"), self._path(f"manifests/{batch:08d}.json")
        files.mkdirs(final.getParent())
        out = files.create(temporary)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        if files.exists(final) or not files.rename(temporary, final):
            raise RuntimeError(f"batch {batch} was committed by another writer")
        return manifest

    def read(self, schema) -> DataFrame:
        """All committed rows with their batch number."""
        known = self.manifests()
        if not known:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
        folders = self.spark.createDataFrame([(m["folder"], m["batch"]) for m in known], "_folder string, batch int")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{m['folder']}" for m in known])
        folder = F.regexp_extract("_metadata.file_path", "(data/[0-9a-f]{32})/[^/]*$", 1)
        return rows.withColumn("_folder", folder).join(F.broadcast(folders), "_folder").drop("_folder")  # one row a batch

    def append_new(self, rows: DataFrame, keys: list[str], order: list[str]) -> dict:
        """Commits the rows whose key is not there yet; of several rows of a key the first in `order`."""
        first = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")
        return self.commit(first.join(self.read(rows.schema).select(*keys), keys, "left_anti").select(*rows.columns))

    def append_versions(self, rows: DataFrame, keys: list[str], order: list[str], at: str) -> dict:
        """Commits every row as the next version of its key: version_no goes on from what is there, available_at is `at`.

        Whether the batch is there already is decided by the content of `rows`, before they get numbers.
        """
        content, known = content_id(rows), self.manifests()
        same = [m for m in known if m["content"] == content]
        if same:
            return same[0]
        numbered = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        there = self.read(versioned(rows)).groupBy(*keys).agg(F.max("version_no").alias("_last"))
        out = numbered.join(there, keys, "left").select(
            *rows.columns, (F.coalesce("_last", F.lit(0)) + F.col("_nth")).cast("long").alias("version_no"), F.lit(at).cast("timestamp").alias("available_at"))
        return self.publish(self.stage(out), content, len(known) + 1)


def versioned(rows: DataFrame):
    return rows.withColumn("version_no", F.lit(None).cast("long")).withColumn("available_at", F.lit(None).cast("timestamp")).schema
