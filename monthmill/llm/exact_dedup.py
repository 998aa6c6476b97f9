"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary of every partition finds digests that may be frequent; they are counted exactly, and their
winners, at most `counters` + 1 rows, are broadcast so that rows of frequent texts never shuffle. All other digests
are grouped and joined by ordinary shuffles.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from monthmill.llm.common import SPACES, query, stored, table, texts

COUNTERS = 512


class MisraGries:
    """At most `k` counters; each is short of the true count by at most rows / (k + 1)."""

    def __init__(self, k: int):
        self.k, self.counts = k, Counter()

    def add(self, counts: Counter) -> None:
        self.counts.update(counts)
        if len(self.counts) > self.k:
            cut = sorted(self.counts.values(), reverse=True)[self.k]
            self.counts = Counter({x: n - cut for x, n in self.counts.items() if n > cut})


def candidates(rows: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """Values of `key` that may be frequent, from one summary for each task.

    The summed counters of a value are at least its count less rows / (counters + 1), and all counters together are
    at most rows. Values whose sum reaches rows / (counters + 1) are therefore at most counters + 1 in number and
    hold every value that occurs 2 * rows / (counters + 1) times or more.
    """

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = MisraGries(counters)
        for frame in frames:
            sketch.add(Counter(frame[key].value_counts().to_dict()))
        if sketch.counts:
            yield pd.DataFrame({key: list(sketch.counts), "n": list(sketch.counts.values())})

    sums = rows.select(key).mapInPandas(summarise, f"{key} string, n long").groupBy(key).agg(F.sum("n").alias("n"))
    return sums.filter(F.col("n") * (counters + 1) >= rows.count()).select(key)


def normal(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are one group. The row with the most code points stays, then the one
    with the smallest doc_id; a null id loses against any other and stays only if its group has no other. Rows that
    repeat the doc_id and text of the row that stays are that document and are marked kept too. An empty table
    gives no rows.
    """
    rows = stored(
        texts(docs).select(
            "doc_id", F.sha2(normal(F.col("text")).cast("binary"), 256).alias("digest"), F.length("text").alias("size")
        ),
        "digests",
    )
    # the smaller key wins: longest text first, then smallest id, null ids last
    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best")
    group = [F.count(F.lit(1)).alias("group_size"), best]
    frequent = stored(candidates(rows, "digest", counters), "frequent")
    winners = stored(
        rows.join(F.broadcast(frequent), "digest").groupBy("digest").agg(*group), "winners"
    )
    split = rows.join(F.broadcast(winners), "digest", "left")
    heavy = split.filter(F.col("group_size").isNotNull())
    light = split.filter(F.col("group_size").isNull()).select(*rows.columns)
    light = light.join(light.groupBy("digest").agg(*group), "digest").select(*heavy.columns)
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("size") == -F.col("best.size"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


SQL = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256,
         length(coalesce(text, '')) as size
  from documents
), g as (
  select *, first_value(doc_id) over (partition by text_sha256 order by size desc, doc_id
                                      rows between unbounded preceding and unbounded following) as keep_id,
         count(*) over (partition by text_sha256) as group_size
  from d
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""


@query("op2_exact_dedup", SQL)
def op2_exact_dedup(spark, root):
    return exact_dedup(table(spark, root, "documents"))
