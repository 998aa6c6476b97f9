"""Merkle manifest of a dataset with incremental witnesses.

Nodes are appended one after the other. Every appended node starts with an empty witness; when its run of `FAN`
siblings is complete, each leaf below a sibling gets the digests of the others, and the run's digest is appended one
level up. So a witness grows as later siblings arrive, and only open subtrees (one unfinished run a level) are held.

Distributed, each source is cut into aligned blocks of FAN ** STEPS nodes. A task appends the nodes of a block and
returns their partial witnesses and the block's root; the roots of a source's blocks are appended in the same way, and
so on until one is left. The roots of all sources are the leaves of the last tree. Witnesses are put together from the
top down by joins in which a key has at most one block of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from monthmill.llm.common import lean, query, stored, table

FAN, STEPS = 3, 6
BLOCK = FAN ** STEPS


def digest(nodes: list[bytes]) -> bytes:
    """sha256 over the digests as hexadecimal text."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def height(n: int) -> int:
    """Levels above n nodes."""
    steps = 0
    while n > 1:
        n, steps = -(-n // FAN), steps + 1
    return steps


class Appender:
    """Open subtrees of a sequence of nodes, and the witnesses of all nodes appended so far."""

    def __init__(self):
        self.open: list[list[tuple[bytes, int, int]]] = [[]]
        self.witness: list[bytearray] = []

    def append(self, node: bytes) -> None:
        at = len(self.witness)
        self.witness.append(bytearray())
        self._add(0, (node, at, at + 1))

    def _add(self, level: int, node: tuple[bytes, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == FAN:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for i, (_, first, last) in enumerate(run):
            others = b"".join(node for j, (node, _, _) in enumerate(run) if j != i)
            for leaf in range(first, last):
                self.witness[leaf] += others
        self._add(level + 1, (digest([node for node, _, _ in run]), run[0][1], run[-1][2]))

    def finish(self, steps: int) -> bytes:
        """Closes what is open on the lowest `steps` levels; the one node left above them."""
        for level in range(steps):
            if self.open[level]:
                self._close(level)
        return self.open[steps][0][0]


def fold(leaf: bytes, rank: int, n: int, witness: bytes) -> bytes:
    """The root that a node, at place `rank` of n, and its witness lead to."""
    at = 0
    while n > 1:
        first = rank // FAN * FAN
        others = min(FAN, n - first) - 1
        run = [witness[at + 32 * i:at + 32 * i + 32] for i in range(others)]
        run.insert(rank - first, leaf)
        leaf, at = digest(run), at + 32 * others
        rank, n = rank // FAN, -(-n // FAN)
    return leaf


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds rank, the place of a row in its `tree` by `order`, and n, the rows of the tree.

    Rows are sorted into ranges of (tree, order), counted a range at a time, and numbered inside a range; the counts
    are carried over. So a tree with very many rows is spread over tasks.
    """
    ranges = stored(
        nodes.repartitionByRange("tree", *order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = stored(ranges.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("rows")), "counts")
    earlier = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("tree").alias("_tree"), F.col("range").alias("_range"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    own = F.row_number().over(Window.partitionBy("tree", "range").orderBy(*order)) - 1
    met = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("range") == F.col("_range"))
    return ranges.join(starts, met).withColumn("rank", F.col("start") + own).select(*nodes.columns, "rank", "n")


def appended(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds witness, inside a node's block, and top, the block's root on its first row, to (tree, rank, n, node)."""
    schema = nodes.schema
    names = schema.names
    rank, n, node = (names.index(c) for c in ("rank", "n", "node"))
    steps_ = height(block)

    def finished(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        grow = Appender()
        for x in rows.column(node).to_pylist():
            grow.append(x)
        top = grow.finish(min(steps_, height(rows.column(n)[0].as_py())))
        more = [pa.array([bytes(w) for w in grow.witness], pa.binary()), pa.array([top] + [None] * (len(rows) - 1), pa.binary())]
        return pa.RecordBatch.from_arrays([*rows.columns, *more], [*names, "witness", "top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # the batches of one block at most
        for batch in batches:
            start = 0
            for i, r in enumerate(batch.column(rank).to_pylist()):
                if r % block == 0:  # a block begins
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield finished(held)
                    held, start = [], i
            if start < len(batch):
                held.append(batch.slice(start))
        if held:
            yield finished(held)

    at = F.floor(F.col("rank") / block)
    sorted_ = nodes.withColumn("_block", at).repartition("tree", "_block").sortWithinPartitions("tree", "_block", "rank")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return sorted_.drop("_block").mapInArrow(lean(run), f"{kinds}, witness binary, top binary")


def grown(nodes: DataFrame, order: list[str], block: int = BLOCK) -> DataFrame:
    """Adds rank, n, the whole witness and the root of its tree to nodes (tree, node, and the columns of `order`)."""
    at = F.floor(F.col("rank") / block)
    levels = [stored(appended(ranked(nodes, order), block), "blocks")]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > block:
        tops = levels[-1].filter(F.col("top").isNotNull()).select(
            "tree", at.alias("rank"), F.ceil(F.col("n") / block).alias("n"), F.col("top").alias("node"))
        levels.append(stored(appended(tops, block), "blocks"))
    top = levels.pop()
    above = top.filter(F.col("top").isNotNull()).select(F.col("tree").alias("_tree"), F.col("top").alias("root"))
    done = top.join(above, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree", "top")
    while levels:
        upper = done.select(F.col("tree").alias("_tree"), F.col("rank").alias("_rank"), F.col("witness").alias("_witness"), "root")
        low = levels.pop().drop("top")
        met = F.col("tree").eqNullSafe(F.col("_tree")) & (at == F.col("_rank"))
        done = low.join(upper, met).withColumn("witness", F.concat("witness", "_witness")).drop("_tree", "_rank", "_witness")
    return done


def part(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """The leaf of a row, its text given: every field behind its length, or a dash for a null."""
    fields = [part(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.unhex(F.sha2(F.concat(*fields, part(text)).cast("binary"), 256))


def manifest(docs: DataFrame, other: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, tree (its source), node (its leaf), rank, n, witness, subroot, source_rank, sources, source_witness, root.

    Digests are binary. Leaves of a source ascend by doc_id, a null id first; rows that repeat an id by their digest, so
    the roots depend on the rows only, not on their order. A null source is a source of its own and comes first. Null
    and empty texts have different leaves. Columns beyond doc_id, source, lang, n_chars and text play no part; `other`
    is carried along under that name. An empty table gives no rows.
    """
    fields = docs.select("doc_id", F.col("source").alias("tree"), leaf(F.col("text")).alias("node"),
                         (F.lit(None).cast("binary") if other is None else other).alias("other"))
    leaves = grown(stored(fields, "leaves"), ["doc_id", "node"], block).withColumnRenamed("root", "subroot")
    # a source's first leaf stands for it
    sources = leaves.filter(F.col("rank") == 0).select(F.lit(0).alias("tree"), F.col("tree").alias("source"), F.col("subroot").alias("node"))
    tops = stored(grown(stored(sources, "sources"), ["source"], block), "tops").select(
        F.col("source").alias("_source"), F.col("rank").alias("source_rank"), F.col("n").alias("sources"),
        F.col("witness").alias("source_witness"), "root")
    return leaves.join(tops, F.col("tree").eqNullSafe(F.col("_source"))).drop("_source")


def verified(rows: DataFrame) -> DataFrame:
    """Adds folded: the root that `other`, or the leaf where that is null, leads to with the row's witnesses."""
    names = rows.columns
    wanted = [names.index(c) for c in ("node", "other", "rank", "n", "witness", "source_rank", "sources", "source_witness")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, other, rank, n, witness, at, m, above in zip(*[batch.column(i).to_pylist() for i in wanted]):
                out.append(fold(fold(other or node, rank, n, witness), at, m, above))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "folded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(lean(run), f"{kinds}, folded binary")


SQL = r"""
with recursive bytes as (
  select doc_id, list_concat([4294967295::bigint], flatten(list_transform(
           range(1, length(doc_id::varchar) + 1), lambda i: list_concat([ascii(substr(doc_id::varchar, i, 1))::bigint], [-1::bigint for _ in range(8)])))) as steps
  from (select distinct doc_id from documents where doc_id is not null)
), crc as (
  select doc_id, xor(list_reduce(steps, lambda acc, x: case when x >= 0 then xor(acc, x)
           when acc & 1 = 1 then xor(acc >> 1, 3988292384) else acc >> 1 end), 4294967295) as crc
  from bytes
), shown as (
  select d.*, coalesce(c.crc % 2 = 0, false) as odd,
         coalesce(octet_length(encode(d.doc_id::varchar)) || ':' || d.doc_id, '-')
         || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
         || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') as head
  from documents d left join crc c using (doc_id)
), leaves as (
  select doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
         sha256(head || coalesce(octet_length(encode(t)) || ':' || t, '-')) as given
  from (select *, case when odd then replace(text, chr(10), '') else text end as t from shown)
), placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i,
         count(*) over (partition by source) as n
  from leaves
), tree(source, level, i, n, h) as (
  select source, 0, i, n, leaf from placed
  union all
  select source, level + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' order by i))
  from tree where n > 1 group by source, level, i // 3
), subs as (
  select source, h, row_number() over (order by source nulls first) - 1 as i, count(*) over () as n from tree where n = 1
), crown(level, i, n, h) as (
  select 0, i, n, h from subs
  union all
  select level + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' order by i))
  from crown where n > 1 group by level, i // 3
), runs as (
  select p.source, p.i as pos, t.level, p.i // (3 ** t.level)::bigint as own, list(t.i order by t.i) as spots, list(t.h order by t.i) as hs
  from placed p join tree t on p.source is not distinct from t.source and t.n > 1
   and t.i // 3 = (p.i // (3 ** t.level)::bigint) // 3
  group by p.source, p.i, t.level
  union all
  select p.source, p.i, 1000 + c.level, s.i // (3 ** c.level)::bigint, list(c.i order by c.i), list(c.h order by c.i)
  from placed p join subs s on p.source is not distinct from s.source
  join crown c on c.n > 1 and c.i // 3 = (s.i // (3 ** c.level)::bigint) // 3
  group by p.source, p.i, s.i, c.level
), paths as (
  select source, pos, level, own, spots, hs,
         row_number() over (partition by source, pos order by level) as step,
         [hs[k] for k in range(1, len(hs) + 1) if spots[k] <> own] as others
  from runs
), proofs as (
  select source, pos, sha256(string_agg(array_to_string(others, ''), '' order by step)) as proof_sha256 from paths group by source, pos
), folds(source, pos, step, h) as (
  select source, i, 1, given from placed
  union all
  select f.source, f.pos, f.step + 1,
         sha256(array_to_string([case when p.spots[k] = p.own then f.h else p.hs[k] end for k in range(1, len(p.hs) + 1)], ''))
  from folds f join paths p on f.source is not distinct from p.source and f.pos = p.pos and f.step = p.step
), folded as (
  select source, pos, max_by(h, step) as h from folds group by source, pos
)
select p.doc_id, p.leaf, s.h as subroot, r.h as root, coalesce(q.proof_sha256, sha256('')) as proof_sha256,
       f.h as folded_root, f.h = r.h as verified
from placed p join subs s on p.source is not distinct from s.source
join crown r on r.n = 1
left join proofs q on p.source is not distinct from q.source and p.i = q.pos
join folded f on p.source is not distinct from f.source and p.i = f.pos
"""


def tampered() -> Column:
    """The leaf of a text without its line feeds, for every second id by its crc32; null for others."""
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(odd & F.contains("text", F.lit("\n")), leaf(F.translate("text", "\n", "")))


@query("op13_merkle", SQL)
def op13_merkle(spark, root):
    rows = verified(manifest(table(spark, root, "documents"), tampered()))
    text = lambda c: F.lower(F.hex(c))
    proof = F.sha2(text(F.concat("witness", "source_witness")).cast("binary"), 256)
    return rows.select(
        "doc_id", text("node").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        proof.alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
