"""Mixing sources to target weights by weighted fair queueing.

Each source offers its documents in a shuffled order, several times over. A document's virtual finish time is the
number of words its source has offered up to its end, divided by the source's target, so all sources reach their
target at time one. All offers are put into one order by finish time and taken until the total budget is spent.

Nothing is summed along one long window: a source's order is cut into buckets of its shuffle key, the global order
into slices of virtual time, and words are counted within a bucket or slice first and carried over by the small table
of their sums. As offers are even in virtual time, slices of equal width hold about equally many words; no slice or
bucket boundary depends on a sample. Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from monthmill.llm.common import WORD, query, stored, table, texts

WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
SLICES = 4096


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shuffled(doc_id: Column) -> Column:
    """The place of a document in its source's order: a digest, the same in every run."""
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, source_size, target, budget) from one row (source, source_size) for each source.

    Sources in order of their code points, null last, take the weights in turn. Shares of `share` times all words stop
    at `passes` times the source, and what is above is shared again by weight. With the sources sorted by limit over
    weight, f(k) = (budget - limits before k) / (weights from k on) rises while sources stop and falls after, so its
    largest value is the level at which the remaining sources share. One row for each source passes through one task.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy("limit_per_weight", F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = (F.col("source_size") * passes).cast("double")
    return (
        sizes.withColumn("weight", F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(named) - 1) % len(weights) + 1))
        .withColumn("limit_per_weight", cap / F.col("weight"))
        .withColumn("budget", F.lit(share) * F.sum("source_size").over(every).cast("double"))
        .withColumn("before", F.coalesce(F.sum(cap).over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.col("budget") - F.col("before")) / F.col("rest")).over(every))
        .select("source", "source_size", F.least(cap, F.col("level") * F.col("weight")).alias("target"), "budget")
    )


def offered(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES
) -> DataFrame:
    """One row for each distinct (source, doc_id, size): n rows, key, words of the source before it, source_size, target, budget."""
    counted = stored(texts(docs, "source").select("source", "doc_id", words(F.col("text")).alias("size")), "sizes")
    key = shuffled(F.col("doc_id"))
    rows = counted.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"key": key, "bucket": F.substring(key, 1, 3)})
    buckets = stored(
        counted.groupBy("source", F.substring(key, 1, 3).alias("bucket")).agg(F.sum("size").alias("words")), "buckets")
    sources = stored(
        targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, passes), "targets")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = buckets.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    at = at.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "start", "source_size", "target", "budget")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0))
    met = F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket"))
    out = rows.join(at, met).select(
        "source", "doc_id", "size", "n", "key", before.alias("before"), "source_size", "target", "budget")
    return stored(out, "offered")


def queue(rows: DataFrame, passes: int = PASSES) -> DataFrame:
    """What the mix takes of the `offered` rows: source, doc_id, size, pass, copy, finish, and the words ahead of each document.

    The mix ends before the first document that would exceed the budget; documents are never cut.
    """
    passed, copy = F.col("pass"), F.col("copy")
    packets = (
        rows.filter(F.col("size") > 0)
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .withColumn("finish", (passed * F.col("source_size") + F.col("before") + copy * F.col("size")) / F.col("target"))
        .withColumn("slice", F.when(F.col("finish") < 1, F.floor(F.col("finish") * SLICES))
                    .otherwise(SLICES + F.floor((1 - 1 / F.col("finish")) * SLICES)))
    )
    sums = packets.groupBy("slice").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    # at most 2 * SLICES + 1 rows
    start = F.coalesce(F.sum("words").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = sums.withColumn("start", start).filter(F.col("start") < F.col("budget")).select("slice", "start")
    inside = Window.partitionBy("slice").orderBy(
        "finish", F.col("source").asc_nulls_last(), "key", "doc_id", "size", "pass", "copy"
    ).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return (
        packets.join(F.broadcast(stored(open_, "slices")), "slice").withColumn("ahead", ahead)
        .filter(F.col("ahead") + F.col("size") <= F.col("budget"))
        .select("source", "doc_id", "size", "pass", "copy", "finish", "ahead")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """The mix in its order, ready to be written as sorted shards: one row for each time a document is taken.

    Null texts are empty; empty texts take no words and are not in the mix. Rows that repeat a doc_id each take part,
    one after the other. A null doc_id or source is a value like any other. An empty table gives an empty mix.
    """
    return queue(offered(docs, weights, share, passes), passes).repartitionByRange("ahead").sortWithinPartitions("ahead")


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, taken (words that the mix takes of it).

    Each source's words are within one document of its target, and all within one document of the budget. Repeated
    rows share what the mix takes of them as evenly as whole documents allow. Cases as for `mix`; rows not in it have 0.
    """
    rows = offered(docs, weights, share, passes)
    keys = ["source", "doc_id", "size"]
    times = queue(rows, passes).groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    times = times.select(*[F.col(k).alias(f"_{k}") for k in keys], "times")
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("size") == F.col("_size"))
    each = rows.join(times, same, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    turns = F.greatest(F.lit(0), F.floor((F.coalesce("times", F.lit(0)) - F.col("copy")) / F.col("n")) + 1)
    return each.select(
        "doc_id", "size", "source", "source_size", "target", (turns * F.col("size")).cast("long").alias("taken"))


SQL = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, '')) as key
  from documents
), s as (
  select source, sum(size)::bigint as source_size,
         [{', '.join(f'{w}.0::double' for w in WEIGHTS)}][(row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1] as weight
  from d group by source
), f as (
  select *, {SHARE}::double * (sum(source_size) over ())::double as budget,
         (coalesce(sum({PASSES} * source_size) over (o rows between unbounded preceding and 1 preceding), 0))::double as before,
         sum(weight) over (o rows between current row and unbounded following) as rest
  from s window o as (order by ({PASSES} * source_size)::double / weight, source nulls last)
), t as (
  select source, source_size, budget,
         least(({PASSES} * source_size)::double, (max((budget - before) / rest) over ()) * weight) as target
  from f
), r as (
  select d.*, t.source_size, t.target, t.budget,
         sum(size) over (partition by d.source order by key, doc_id, size rows unbounded preceding) as upto,
         row_number() over () as row
  from d join t on d.source is not distinct from t.source
), p as (
  select r.*, pass, (pass * source_size + upto)::double / target as finish
  from r, range({PASSES}) as passes(pass) where size > 0
), q as (
  select row, size, budget, sum(size) over (
           order by finish, source nulls last, key, doc_id, size, pass rows unbounded preceding) as words
  from p
), k as (select row, sum(size) as taken from q where words <= budget group by row)
select r.doc_id, r.size, r.source, r.source_size, r.target, coalesce(k.taken, 0)::bigint as taken
from r left join k using (row)
"""


@query("op11_mixing", SQL)
def op11_mixing(spark, root):
    return taken(table(spark, root, "documents"))
