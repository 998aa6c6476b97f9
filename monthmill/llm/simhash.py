"""SimHash fingerprints and near-duplicate groups by the generalised pigeonhole principle.

Bits that go together are put into one partition. If the thresholds t_i of m partitions add up to radius - m + 1, two
fingerprints within the radius are within t_i in at least one partition i (t_i = -1 leaves a partition out). Dynamic
programming picks the thresholds, and the number of partitions, with the fewest estimated probes and candidates over
all fingerprints. Each fingerprint is entered under every value within t_i of its own; entries that meet are compared
in full. Large buckets are cut into blocks and every pair of blocks is one unit of work, so no task holds more than
two blocks, and only links of a spanning forest leave a unit.

Groups of similar texts are verified on the shingles. A similarity of 0.8 is about 39 of 256 differing bits, and no
partition of the bits is selective at that distance. So the pigeonhole covers the closest pairs, and those further
apart meet under a few least hashes of their shingles, as they share at least four fifths of these; all that meet are
compared in Hamming distance, and by the parities of their shingles' places, which bound the similarity from above. A first pass verifies the links of a spanning forest of close pairs that share a least hash, further ones
the nearest neighbours in other groups, the last one all pairs between what is not joined by then.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from monthmill.llm.common import WORD, fold, lean, query, stored, table, texts, values
from monthmill.llm.components import components

SEED = 42
BLOCK = 4096
NEAREST = (8,)  # neighbours of each text that are verified before all pairs
PARITY = 64  # bytes
PROBE_COST = 20.0  # one entry costs about as much as this many comparisons
_WORDS = re.compile(WORD)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; the whole sequence if there are fewer words."""
    words = [w.encode() for w in _WORDS.findall(fold(text))]
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends + 1).tolist()]
    stops = ends[min(width, len(words)) - 1:].tolist()
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops)), dtype=np.uint64, count=len(stops))


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash derived from h (splitmix64); k = 0 is h itself."""
    if k == 0:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str, width: int, words: int = 1) -> bytes:
    return majority(shingle_hashes(text, width), words)


def majority(hashes: np.ndarray, words: int) -> bytes:
    """`words` big-endian 64-bit fingerprints; a bit is 1 if it is set in over half of the hashes."""
    out = b""
    for k in range(words):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 1 << 15):
            part = mixed(hashes[at:at + (1 << 15)], k).astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        out += np.packbits(2 * ones > len(hashes)).tobytes()
    return out


def fingerprints(docs: DataFrame, width: int, words: int = 1) -> DataFrame:
    """(doc_id, fp) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, width, words) for t in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return texts(docs).mapInArrow(lean(run), "doc_id long, fp binary")


def _matrix(column: pd.Series, size: int) -> np.ndarray:
    """The first `size` bytes of each value; all values are equally long."""
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, len(column.iloc[0]) if len(column) else size)[:, :size]


def bit_counts(fps: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, in how many both are set; over all of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((bits, bits))
        for frame in frames:
            x = np.unpackbits(_matrix(frame.fp, bits // 8), axis=1).astype(np.float32)
            total += x.T @ x
        i, j = np.triu_indices(bits)
        yield pd.DataFrame({"at": i * bits + j, "n": total[i, j].astype(np.int64)})

    # a fixed number of rows: one for each pair of bits
    rows = fps.mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(bits * bits)
    for r in rows:
        out[r.at] = r.n
    out = out.reshape(bits, bits)
    return fps.count(), np.triu(out) + np.triu(out, 1).T


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits, each grown from a free bit by the free bit most correlated with the group."""
    bits, p = len(both), np.diag(both) / max(n, 1)
    spread_ = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread_, spread_)
    free, groups = list(range(bits)), []
    for k in range(m):
        size = bits * (k + 1) // m - bits * k // m
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: corr[b, group].sum())
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def within(n: int, same: float, differ: np.ndarray, most: int) -> list[float]:
    """Estimated ordered pairs within 0..most bits, from the pairs that agree and each bit's chance to differ."""
    odds = differ / np.maximum(1 - differ, 1e-9)
    ways = np.zeros(most + 1)
    ways[0] = 1.0
    for o in odds:
        ways[1:] += o * ways[:-1]
    return [min(float(n) * n, same * w) for w in np.cumsum(ways)]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 on that add up to `total` at the least cost; costs[i][t + 1] is partition i's at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, extra in enumerate(row, start=-1):
                if s + t not in step or c + extra < step[s + t][0]:
                    step[s + t] = (c + extra, [*chosen, t])
        best = step
    return best[total]


def plan(fps: DataFrame, bits: int, radius: int, choices: tuple[int, ...]) -> tuple[list[list[int]], list[int]]:
    """Partitions of the bits and their thresholds, from statistics over all fingerprints."""
    n, both = bit_counts(fps, bits)
    p = np.diag(both) / max(n, 1)
    options = {m: group_bits(n, both, m) for m in choices}
    tried = [group for groups in options.values() for group in groups]

    def entered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.unpackbits(_matrix(frame.fp, bits // 8), axis=1)
            for i, group in enumerate(tried):
                yield pd.DataFrame({"i": i, "value": packed(x[:, group])})

    # one row for each tried partition comes back
    counts = fps.mapInPandas(entered, "i int, value long").groupBy("i", "value").count()
    same = {r.i: float(r.s) for r in counts.groupBy("i").agg(F.sum(F.col("count") * F.col("count")).alias("s")).collect()}
    best, at = None, 0
    for m, groups in options.items():
        total, costs = radius - m + 1, []
        for group in groups:
            most = min(max(0, total + m - 1), 2)
            pairs = within(n, same.get(at, 0.0), 2 * p[group] * (1 - p[group]), most)
            probes = np.cumsum([comb(len(group), t) for t in range(most + 1)])
            costs.append([0.0, *(PROBE_COST * n * probes[t] + pairs[t] for t in range(most + 1))])
            at += 1
        try:
            cost, thresholds = allocate(costs, total)
        except KeyError:
            continue
        if best is None or cost < best[0]:
            best = (cost, groups, thresholds)
    if best is None:
        raise ValueError("no allocation of thresholds reaches the radius")
    return best[1], best[2]


def packed(x: np.ndarray) -> np.ndarray:
    """Rows of at most 63 bits as integers."""
    return x.astype(np.int64) @ (np.int64(1) << np.arange(x.shape[1], dtype=np.int64))


def entries(fps: DataFrame, bits: int, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(part, value, home, fp): each fingerprint under all values within the threshold of its own, home if its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.unpackbits(_matrix(frame.fp, bits // 8), axis=1)
            for i, (group, t) in enumerate(zip(groups, thresholds)):
                own = packed(x[:, group]) if t >= 0 else None
                for k in range(t + 1):
                    for flips in combinations(range(len(group)), k):
                        mask = sum(1 << f for f in flips)
                        yield pd.DataFrame({"part": i, "value": own ^ mask, "home": mask == 0, "fp": frame.fp})

    return fps.mapInPandas(run, "part int, value long, home boolean, fp binary")


def units(rows: DataFrame, block: int) -> DataFrame:
    """Adds the unit of work: one for a bucket of up to `block` entries, else one for each pair of its blocks."""
    key = ["part", "value"]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    blocks = F.ceil(F.col("_n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    others = F.sequence(F.lit(0), blocks - 1)
    return (
        rows.join(sizes, key)
        .select(*rows.columns, F.explode(F.transform(others, lambda o: F.struct(
            F.least(o, own).alias("lo"), F.greatest(o, own).alias("hi")))).alias("_unit"))
        .select(*rows.columns, F.col("_unit.lo").alias("lo"), F.col("_unit.hi").alias("hi"))
    )


class Members:
    """The rows of some units: fingerprints and, if `least` is given, what bounds the similarity of their sets."""

    def __init__(self, fp: pd.Series, words: int, least: float | None):
        self.fp, at, self.least = fp.to_numpy(), 8 * words, least
        self.whole = _matrix(fp, len(fp.iloc[0]))
        self.x = self.whole[:, :at].copy().view(np.uint64)
        if least is not None:
            self.parity = self.whole[:, at:at + PARITY].copy().view(np.uint64)
            self.n = self.whole[:, at + PARITY:at + PARITY + 4].copy().view("<u4")[:, 0].astype(np.int64)

    def bits(self, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        return np.bitwise_count(self.x[a] ^ self.x[b]).sum(axis=1)

    def possible(self, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        """Whether two sets can be as similar as `least`: at that, (1 - least) / (1 + least) of all their elements may
        be in one of them only, and there are at least as many such elements as places in which their parities differ."""
        if self.least is None:
            return np.ones(len(a), dtype=bool)
        apart = np.bitwise_count(self.parity[a] ^ self.parity[b]).sum(axis=1)
        return apart <= (self.n[a] + self.n[b]) * (1 - self.least) / (1 + self.least) + 1e-9


def forest(rows: Members, first: int, n: int, home: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning-forest links of one unit: members are reached breadth first, each compared once as a centre."""
    free, links = np.arange(first, first + n), []
    while len(free):
        queue, free = [free[0]], free[1:]
        while queue and len(free):
            c = queue.pop()
            near = rows.bits(free, c) <= radius
            near &= (home[free] | home[c]) & rows.possible(free, c)
            hits = free[near]
            links += [(c, h) for h in hits]
            queue += list(hits)
            free = free[~near]
    return links


def unit_links(frame: pd.DataFrame, words: int, radius: int, least: float | None = None) -> pd.DataFrame:
    """Links of whole units that lie one after the other in the frame."""
    rows, home = Members(frame.fp, words, least), frame.home.to_numpy()
    ids = frame[["part", "value", "lo", "hi"]].to_numpy()
    first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
    size = np.diff(np.r_[first, len(home)])
    unit = np.repeat(np.arange(len(first)), size)
    a, b = [], []
    small = size[unit] <= 48
    at = np.flatnonzero(small)
    for d in range(1, int(size[size <= 48].max(initial=0))):
        i = at[at + d < len(home)]
        i = i[unit[i] == unit[i + d]]
        i = i[home[i] | home[i + d]]
        i = i[(rows.bits(i, i + d) <= radius) & rows.possible(i, i + d)]
        a.append(i)
        b.append(i + d)
    for f, n in zip(first[size > 48], size[size > 48]):
        pairs = np.array(forest(rows, f, n, home, radius), dtype=np.int64).reshape(-1, 2)
        a.append(pairs[:, 0])
        b.append(pairs[:, 1])
    none = np.zeros(0, dtype=np.int64)
    return pd.DataFrame({"a": rows.fp[np.concatenate([none, *a])], "b": rows.fp[np.concatenate([none, *b])]})


def pairs_within(size: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same unit, a few arrays at a time: small units by their distance, others row by row."""
    unit = np.repeat(np.arange(len(size)), size)
    small = size <= 48
    at = np.flatnonzero(small[unit])
    for d in range(1, int(size[small].max(initial=0))):
        i = at[at + d < len(unit)]
        i = i[unit[i] == unit[i + d]]
        yield i, i + d
    for f, n in zip(first[~small], size[~small]):
        for a in range(f, f + n - 1):
            b = np.arange(a + 1, f + n)
            yield np.full(len(b), a), b


def unit_pairs(frame: pd.DataFrame, words: int, radius: int, least: float | None = None, nearest: int | None = None) -> Iterator[pd.DataFrame]:
    """Pairs of whole units within the radius whose labels, the last 16 bytes, differ: all of them, or in large units
    those of each row and the `nearest` rows below it."""
    rows, home = Members(frame.fp, words, least), frame.home.to_numpy()
    label = rows.whole[:, -16:].copy().view(np.uint64)
    ids = frame[["part", "value", "lo", "hi"]].to_numpy()
    first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
    for a, b in pairs_within(np.diff(np.r_[first, len(home)]), first):
        other = (home[a] | home[b]) & (label[a] != label[b]).any(axis=1)
        a, b = a[other], b[other]
        bits = rows.bits(a, b)
        near = np.flatnonzero((bits <= radius) & rows.possible(a, b))
        if nearest is not None and len(near) > nearest and a[0] == a[-1]:
            near = near[np.argsort(bits[near], kind="stable")[:nearest]]
        if len(near):
            yield pd.DataFrame({"a": rows.fp[a[near]], "b": rows.fp[b[near]]})


LINK = "a binary, b binary"
ENTRY = "part int, value long, home boolean, fp binary"


def links(
    rows: DataFrame, words: int, radius: int, block: int = BLOCK, labelled: bool = False, nearest: int | None = None, least: float | None = None
) -> DataFrame:
    """Links (a, b) that connect what the buckets connect, or the pairs with different labels (see `unit_pairs`). With
    `least`, fingerprints are followed by the parities and the size of their sets, and pairs that cannot be as similar
    are left out.

    Entries are shuffled once, by bucket. What lies in a bucket of over `block` entries is handed on and cut into
    blocks; a unit, and so a task, holds at most two of them.
    """
    bucket, key = ["part", "value"], ["part", "value", "lo", "hi"]

    def of(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        return unit_pairs(frame, words, radius, least, nearest) if labelled else iter([unit_links(frame, words, radius, least)])

    def spread_out(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Whole buckets: links of the small ones, the entries of the large ones."""
        if not len(frame):
            return
        ids = frame[bucket].to_numpy()
        first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
        size = np.repeat(np.diff(np.r_[first, len(frame)]), np.diff(np.r_[first, len(frame)]))
        small = frame[(size > 1) & (size <= block)]
        if len(small):
            for found in of(small.assign(lo=0, hi=0).reset_index(drop=True)):
                yield found.assign(part=None, value=None, home=None, fp=None)
        if (size > block).any():
            yield frame[size > block].assign(a=None, b=None)[["a", "b", *bucket, "home", "fp"]]

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, large = None, None
        for frame in frames:
            if large is not None:  # the rest of a bucket that is handed on
                rest = (frame[bucket] == large).all(axis=1).to_numpy()
                if rest.any():
                    yield frame[rest].assign(a=None, b=None)[["a", "b", *bucket, "home", "fp"]]
                frame = frame[~rest]
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(held):
                continue
            last = held[bucket].iloc[-1]
            cut = int(np.argmax((held[bucket] == last).all(axis=1).to_numpy()))
            yield from spread_out(held.iloc[:cut])
            held = held.iloc[cut:]
            if len(held) > block:
                yield held.assign(a=None, b=None)[["a", "b", *bucket, "home", "fp"]]
                held, large = None, last
        if held is not None:
            yield from spread_out(held)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = (held[key] == held[key].iloc[-1]).all(axis=1).to_numpy()
            cut = int(np.argmax(last))
            if cut:
                yield from of(held.iloc[:cut].reset_index(drop=True))
                held = held.iloc[cut:]
        if held is not None and len(held):
            yield from of(held.reset_index(drop=True))

    # in the order of the fingerprints, so that a group has the same centre in all buckets that it fills
    met = rows.repartition(*bucket).sortWithinPartitions(*bucket, "fp").mapInPandas(lean(meet), f"{LINK}, {ENTRY}")
    met = stored(met, "met")
    large = units(met.filter(F.col("fp").isNotNull()).select(*bucket, "home", "fp"), block)
    return met.filter(F.col("a").isNotNull()).select("a", "b").union(
        large.repartition(*key).sortWithinPartitions(*key, "fp").mapInPandas(lean(run), LINK))


def near_groups(
    docs: DataFrame, width: int, radius: int, words: int = 1, reach: int | None = None,
    choices: tuple[int, ...] = (2, 3, 4), block: int = BLOCK,
) -> DataFrame:
    """One row per input row: doc_id, fp (binary), component_id (smallest doc_id reachable, itself included).

    Fingerprints within `radius` bits are linked; all links within `reach` bits (the radius by default) are found,
    those beyond it when they share a partition. Equal fingerprints are one node. Null texts count as empty, and all
    texts without words have fingerprint zero. A null doc_id counts last, so it is the component only of a component
    without any other id. Repeated rows belong to one component. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, width, words), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    if nodes.isEmpty():
        return rows.withColumn("component_id", F.col("doc_id"))
    bits = 64 * words
    groups, thresholds = plan(nodes.select("fp"), bits, radius if reach is None else reach, choices)
    found = links(entries(nodes.select("fp"), bits, groups, thresholds), words, radius, block)
    parts = components(found).withColumnRenamed("node", "fp")
    nodes = nodes.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    nodes = stored(nodes, "components")
    # stored, so that the members of a large component can be split in the join
    heads = stored(nodes.groupBy("component").agg(F.min("least").alias("component_id")), "heads")
    named = nodes.join(heads, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str, width: int) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, width)).view(np.int64)


def set_digest(distinct: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(distinct.tobytes(), SEED)


def parities(distinct: np.ndarray) -> bytes:
    """Whether an odd number of elements falls into each of 8 * PARITY places, and the number of elements."""
    places = (mixed(distinct.view(np.uint64), 99) & np.uint64(8 * PARITY - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=8 * PARITY) & 1).tobytes() + len(distinct).to_bytes(4, "little")


def least_hashes(distinct: np.ndarray, keys: int) -> list[int]:
    """The least of the shingles' hashes under each of `keys` independent hash functions; two sets agree in each with
    the probability of their similarity."""
    own = distinct.view(np.uint64)
    return [int(mixed(own, 64 + k).min().view(np.int64)) if len(own) else 0 for k in range(keys)]


def key_entries(nodes: DataFrame) -> DataFrame:
    """Entries like those of the partitions, under the least hashes of a node's shingles."""
    return nodes.select("fp", F.posexplode("mins").alias("k", "value")).select(
        (F.lit(1000) + F.col("k")).cast("int").alias("part"), "value", F.lit(True).alias("home"), "fp")


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """The links (a, b) whose texts have shingle sets of a Jaccard similarity of at least `least`; ids end in the sets' digests.

    One text of each node in question is read again. Of a pair, the shingles of the node with fewer pairs travel to
    the other, so those of a hub do not travel with each of its pairs.
    """
    pairs = stored(pairs.select("a", "b").distinct(), "candidates")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    degree = stored(degree.join(nodes.select("fp", "key"), "fp"), "degrees")
    digest = lambda c: F.substring(c, -16, 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(values(batch.column(1))):  # one text at a time: sets of long texts are large
                x = shingle_set(text, width)
                yield pa.RecordBatch.from_arrays([pa.array([set_digest(x)], pa.binary()), pa.array([x], pa.list_(pa.int64()))], ["digest", "shingles"])

    wanted = docs.withColumn("_key", text_key()).join(degree.select(F.col("key").alias("_key")).distinct(), "_key", "left_semi")
    every = texts(wanted).mapInArrow(lean(run), "digest binary, shingles array<long>")
    sets = stored(every.groupBy("digest").agg(F.first("shingles").alias("shingles")), "sets")
    n = degree.select("fp", "n")
    oriented = (
        pairs.join(n.withColumnsRenamed({"fp": "a", "n": "na"}), "a").join(n.withColumnsRenamed({"fp": "b", "n": "nb"}), "b")
        .select(F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("few"),
                F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("many"))
    )
    joined = (
        stored(oriented, "oriented").withColumn("_few", digest(F.col("few"))).join(sets.toDF("_few", "x"), "_few")
        .withColumn("_many", digest(F.col("many"))).join(sets.toDF("_many", "y"), "_many")
    )
    both = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - both
    similar_ = (F.size("x") == 0) & (F.size("y") == 0) | (both >= least * union)
    return stored(joined.filter(similar_).select(F.col("few").alias("a"), F.col("many").alias("b")), "verified")


def similar_groups(
    docs: DataFrame, width: int, radius: int, words: int = 4, reach: int = 12, choices: tuple[int, ...] = (13,), block: int = BLOCK,
    least: float = 0.8, near: int = 30, keys: int = 4,
) -> DataFrame:
    """One row per input row: doc_id, component_id (smallest doc_id reachable by links, itself included).

    Two texts are linked if the sets of their shingles have a Jaccard similarity of at least `least` (0.8) and their
    fingerprints differ in at most `radius` bits, and they meet: within `reach` bits they always do, beyond it if one
    of `keys` least hashes agrees, which at a similarity of 0.8 fails in 0.2 ** keys of the pairs. What is found does
    not depend on the size of the corpus. Null texts count as empty; texts without words are one group. Rows with equal
    shingle sets are one node. A null doc_id counts last, so it is the component only of a group without any other id;
    repeated rows belong to one group. An empty table gives no rows. Links of at most `near` bits that span what the least
    hashes bring together are verified first, then each text's nearest ones in other groups, at last all pairs between
    the groups that these leave, so a large group of copies is joined before its pairs are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, mins = [], []
            for text in values(batch.column(1)):
                hashes = shingle_hashes(text, width)
                own = np.unique(hashes).view(np.int64)
                ids.append(majority(hashes, words) + parities(own) + set_digest(own))
                mins.append(least_hashes(own, keys))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(mins, pa.list_(pa.int64()))], ["doc_id", "key", "fp", "mins"])

    read = texts(docs.withColumn("_key", text_key()), "_key")
    rows = stored(read.mapInArrow(lean(run), "doc_id long, key long, fp binary, mins array<long>"), "fingerprints")
    # equal sets of shingles with different repeats have different fingerprints: the least one stands for the set
    own = F.substring("fp", -16, 16)
    nodes = stored(rows.groupBy(own.alias("digest")).agg(
        F.min("doc_id").alias("least"), F.min(F.struct("fp", "key", "mins")).alias("n")).select("digest", "least", "n.*"), "nodes")
    if nodes.isEmpty():
        return rows.select("doc_id", F.col("doc_id").alias("component_id"))
    bits, size = 64 * words, 8 * words + PARITY + 4 + 16
    plan_ = plan(nodes.select("fp"), bits, reach, choices)

    kept = similar(links(key_entries(nodes), words, near, block, least=least), nodes, docs, width, least)
    for nearest in (*NEAREST, None):
        parts = components(kept).withColumnRenamed("node", "fp")
        labelled = stored(nodes.select("fp", "mins").join(parts, "fp", "left").select(
            F.concat("fp", F.unhex(F.md5(F.coalesce("component", "fp")))).alias("fp"), "mins"), "labelled")
        met = key_entries(labelled)
        if nearest is None:
            met = met.unionByName(entries(labelled.select("fp"), bits, *plan_))
        more = links(met, words, radius, block, True, nearest, least).select(*[F.substring(c, 1, size).alias(c) for c in ("a", "b")])
        kept = stored(kept.union(similar(more, nodes, docs, width, least)), "kept")
    parts = components(kept).withColumnRenamed("node", "fp")
    nodes = stored(nodes.join(parts, "fp", "left").select("digest", "fp", "least", F.coalesce("component", "fp").alias("component")), "components")
    heads = stored(nodes.groupBy("component").agg(F.min("least").alias("component_id")), "heads")
    named = nodes.join(heads, "component").select("digest", "component_id")
    return rows.select("doc_id", own.alias("digest")).join(named, "digest").select("doc_id", "component_id")


@query("op8_simhash")
def op8_simhash(spark: SparkSession, root: str) -> DataFrame:
    out = near_groups(table(spark, root, "documents"), width=3, radius=3)
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
