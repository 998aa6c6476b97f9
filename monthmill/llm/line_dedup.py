"""Line dedup on levelled sorted runs of line hashes.

Documents are taken in batches of falling doc_id. The runs hold, for each line key seen so far, how many documents
have it and which document keeps it. A batch is anti-joined with the runs: keys the runs lack belong to the batch's
largest doc_id, others only add to the count. The batch then becomes a run of level 0; `fanout` runs of a level are
merged into one of the next, so a key is rewritten once per level. Runs are written sorted by key. Everything here is
DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from monthmill.llm.common import SPACES, folder, lower_ascii, packed, query, stored, table, texts, unpacked

KEY = ["h1", "h2"]
RUN = "h1 long, h2 long, n long, keeper long"
BATCHES, FANOUT, MIN_CHARS, MIN_DOCS = 6, 3, 20, 3


class LineRuns:
    """Levelled runs; the driver keeps folder names only, a logarithmic number of them."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    def rows(self) -> DataFrame:
        """All live runs side by side; a key may stand in several of them."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        """Anti-join a batch of (h1, h2, n, doc_id), one row for each key, with the runs and add it as a run."""
        known = self.rows()
        fresh = batch.join(known, KEY, "left_anti").withColumn("keeper", F.col("doc_id"))
        seen = batch.join(known, KEY, "left_semi").withColumn("keeper", F.lit(None).cast("long"))
        self.write(fresh.unionByName(seen).select(*KEY, "n", "keeper"), 0)

    def write(self, rows: DataFrame, level: int) -> None:
        path = folder(self.spark, f"run-{level}")
        rows.sortWithinPartitions(*KEY).write.parquet(path)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self.write(self.merged(self.spark.read.schema(RUN).parquet(*full)), level + 1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(SPACES)))


def row_key() -> Column:
    """Tells rows apart that share a doc_id; equal rows have equal keys."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per document and line key of `min_chars` or more: 128 bits of hash, and the places of its lines."""
    lines = docs.select("doc_id", row_key().alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.filter(F.length(F.trim("line", F.lit(SPACES))) >= min_chars).withColumn("key", line_key(F.col("line")))
    return (
        keys.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
        .groupBy("doc_id", *KEY).agg(F.collect_list(F.struct("row", "pos")).alias("places"))
    )


def line_dedup(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """All input columns, with text deduplicated, plus _n_lines and _n_dropped, which replace input columns so named.

    A key of at least `min_chars` code points found in `min_docs` documents or more loses all its lines except those
    in the largest doc_id that holds it. A null or empty text is one empty line and never loses it; a null text comes
    back as it is. Rows that repeat a doc_id are one document: its lines are counted once, and if it is the largest
    all its rows keep them. Rows with a null id are not counted and lose nothing. An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = texts(docs).filter(F.col("doc_id").isNotNull())
    cuts = F.percentile_approx("doc_id", F.array(*[F.lit(i / batches) for i in range(1, batches)]), 1000)
    bounds = (base.agg(cuts.alias("cuts")).first().cuts or []) if batches > 1 else []
    number = sum((F.when(F.col("doc_id") <= F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0))
    lines = stored(keyed_lines(base, min_chars).withColumn("batch", number), "lines", "batch")

    runs = LineRuns(spark, fanout)
    for i in range(len(bounds) + 1):
        batch = lines.filter(F.col("batch") == i)
        runs.add(batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("doc_id")))
    # stored, so that the join below reads plain rows on both sides and a hot line can be split
    doomed = stored(runs.merged(runs.rows()).filter(F.col("n") >= min_docs), "doomed")
    drop = (
        lines.join(doomed, KEY).filter(F.col("doc_id") != F.col("keeper"))
        .select("doc_id", F.inline("places"))
        .groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_list("pos").alias("_gone"))
    )
    held = packed(docs).join(drop, (F.col("doc_id") == F.col("_id")) & (row_key() == F.col("_row")), "left")
    parts = F.split("text", "\n", -1)
    every = F.sequence(F.lit(0), F.size(parts) - 1)
    gone = F.array_intersect(every, "_gone")  # equal rows give each place twice
    marks = F.array_sort(F.concat(
        F.transform(gone, lambda p: F.struct(p.alias("p"), F.lit(False).alias("keep"))),
        F.transform(F.array_except(every, "_gone"), lambda p: F.struct(p.alias("p"), F.lit(True).alias("keep"))),
    ))
    kept = F.array_join(F.zip_with(parts, marks, lambda line, mark: F.when(mark["keep"], line)), "\n")
    hit = F.col("_gone").isNotNull()
    out = held.select(
        "doc_id", F.when(hit, kept).otherwise(F.col("text")).alias("text"), "rest",
        F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("_n_lines"),
        F.when(hit, F.size(gone)).otherwise(0).cast("long").alias("_n_dropped"),
    )
    return out.select(*unpacked(docs, "_n_lines", "_n_dropped"), "_n_lines", "_n_dropped")


SQL = f"""
with base as (select doc_id, coalesce(text, '') as text from documents),
lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line,
         unnest(range(len(string_split(text, chr(10))))) as pos
  from base
), keys as (
  select doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), bad as (
  select key, max(doc_id) as keeper from keys where length(key) >= {MIN_CHARS}
  group by key having count(distinct doc_id) >= {MIN_DOCS}
), marked as (
  select k.*, b.keeper is not null and b.keeper <> k.doc_id as gone from keys k left join bad b using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


@query("op3_line_dedup", SQL)
def op3_line_dedup(spark, root):
    out = line_dedup(table(spark, root, "documents"))
    return out.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
