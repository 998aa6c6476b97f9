"""A corpus pipeline of five stages; each takes and returns documents, the last returns their subword ids.

Every stage works on all rows its predecessor kept and its decisions take effect. A stage gives no row twice and
never invents one. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from monthmill.llm import decontaminate, line_dedup, quality, sentencepieces, simhash
from monthmill.llm.common import stored, table

# Five-word shingles, 256 bits. A similarity of 0.8 is about 39 differing bits, at most 52 in 99 of 100 pairs.
NEAR = {"width": 5, "radius": 52}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts more likely poor than sound, by the ordinal model of all rated documents."""
    ratings = quality.graded(table(spark, sf_dir, "labels"))
    return quality.select(docs, quality.train(docs, ratings, 3), grade=1, least=0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in the largest doc_id; n_chars is counted anew."""
    out = line_dedup.line_dedup(docs)
    counted = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return out.withColumns(counted).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, with a shingle similarity of 0.8 or more, the smallest doc_id stays; rows without an id stay."""
    groups = simhash.similar_groups(docs, **NEAR)
    return without(docs, groups.filter(F.col("doc_id") != F.col("component_id")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows without an id stay."""
    return without(docs, decontaminate.find_items(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, number of tokens and checks of every text; fewer words are held, as earlier stages have filled the executors."""
    return sentencepieces.encode(docs, cache=200_000)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    ids = stored(gone.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct(), "gone")
    return docs.join(ids, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]
ORACLE_SQL = None  # the first stage is a fitted model


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; the output of each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
