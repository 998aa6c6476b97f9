"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

The CGK walk reads a text with a pointer that moves on or stays by a random bit of the step and the symbol, and turns
a small edit distance into a small Hamming distance. Windows start at anchors: places whose eight bytes are those at an
anchor of some item, up to `anchors` words of it, so all words of an ordinary item; in scripts without blanks every
character begins a word. Each table samples a few places of the walk; a document window that shares a table's key with
an item window is a candidate. Candidates of an item that lie close together are one stretch; a stretch that holds two
thirds of the runs of five characters that so many random edits leave is searched with the exact edit distance. Tables
are added until copies of the items with as many edits as the search allows are found, runs counted, with the target
recall, else it is an error. Short items
are found through pieces of which one must be intact. The benchmark is the query set: it is taken in blocks, and all
documents are read for each block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from monthmill.llm.common import fold, lean, query, table, texts

SHORT, MAX_EDITS, RECALL = 40, 0.2, 0.95
BLOCK_ITEMS, ANCHORS, SAMPLED, CHUNK, MOST_TABLES = 2000, 64, 4, 200_000, 64
GRAM, LEFT = 5, 0.65
STEPS = (128, 32)  # lengths of the long and the short walk; a walk reads about half as many symbols
LUT_BITS = 20


def normal(text: str) -> str:
    """A-Z lower-cased, white space as single blanks."""
    return " ".join(fold(text).split())


def starts(data: np.ndarray) -> np.ndarray:
    """Positions of the first byte of each word, and of each character of the scripts that take three bytes or four."""
    word = data > 32
    return np.flatnonzero(word & ~np.r_[False, word[:-1]] | (data >= 0xE0))


def prefixes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the eight bytes from each position."""
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    return (eight[at] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - LUT_BITS)).astype(np.int64)


def padded(data: bytes) -> np.ndarray:
    return np.frombuffer(data + bytes(8), dtype=np.uint8)


class Embedding:
    """The random bits of the walk and the sampled places of each table; the same for items and documents."""

    def __init__(self, tables: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(0, 2, (max(STEPS), 256), dtype=np.uint8)
        self.moves[:, 0] = 0  # the zero byte ends a text
        self.places = [[np.sort(rng.choice(steps, SAMPLED, replace=False)) for steps in STEPS] for _ in range(tables)]
        self.needed = np.unique(np.concatenate([p for pair in self.places for p in pair]))

    def walk(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and pointers at the needed steps, one row for each."""
        at, row = at.copy(), {int(s): i for i, s in enumerate(self.needed)}
        symbols = np.zeros((len(self.needed), len(at)), dtype=np.uint8)
        pointers = np.zeros((len(self.needed), len(at)), dtype=np.int32)
        for step in range(int(self.needed[-1]) + 1):
            symbol = data[at]
            if step in row:
                symbols[row[step]], pointers[row[step]] = symbol, at
            at += self.moves[step][symbol]
        return symbols, pointers

    def keys(self, symbols: np.ndarray, prefix: np.ndarray, kind: int) -> np.ndarray:
        """One row of keys for each table."""
        rows = [np.searchsorted(self.needed, pair[kind]) for pair in self.places]
        out = []
        for r in rows:
            key = prefix.copy()
            for s in r:  # the prefix and SAMPLED symbols fit into 52 bits
                key = (key << 8) | symbols[s]
            out.append(key)
        return np.array(out)

    def ends(self, pointers: np.ndarray, kind: int) -> np.ndarray:
        """Last position read for each table."""
        return np.array([pointers[np.searchsorted(self.needed, pair[kind][-1])] for pair in self.places])


class ItemTables:
    """Keys of the items' windows, table by table."""

    def __init__(self, items: list[tuple[int, str]], anchors: int, recall: float, max_edits: float):
        self.items, self.max_edits = items, max_edits
        self.runs = [grams(text) for _, text in items]
        self.data = [padded(t.encode()) for _, t in items]
        every = [(starts(d), d) for d in self.data]
        seen = Counter(h for at, d in every for h in set(prefixes(d, at).tolist()))
        self.windows = []  # (item, byte offset)
        for i, (at, d) in enumerate(every):
            hashes = prefixes(d, at).tolist()
            sizes = np.diff(np.r_[at, len(d) - 7])
            # one in each stretch of the item, so that few edits do not hit all: the rarest word, then the longest
            for part in np.array_split(np.arange(len(at)), min(anchors, len(at))):
                self.windows.append((i, int(at[min(part, key=lambda j: (seen[hashes[j]], -sizes[j]))])))
        self.tables, found = 0, 0.0
        while items and found < recall:
            if self.tables == MOST_TABLES:
                raise ValueError(f"{MOST_TABLES} tables find {found:.2f} of the edited items, {recall} are wanted: allow fewer edits or more anchors")
            self.tables += 4
            self.embedding = Embedding(self.tables)
            self.build()
            found = self.simulated()
        self.expected_recall = found

    def build(self) -> None:
        self.lut = np.zeros(1 << LUT_BITS, dtype=bool)
        rows: list[list] = [[[] for _ in STEPS] for _ in range(self.tables)]
        for w, (i, offset) in enumerate(self.windows):
            d, at = self.data[i], np.array([offset])
            prefix = prefixes(d, at)
            self.lut[prefix] = True
            symbols, pointers = self.embedding.walk(d, at)
            for kind in range(len(STEPS)):
                keys, ends = self.embedding.keys(symbols, prefix, kind), self.embedding.ends(pointers, kind)
                for t in range(self.tables):
                    if ends[t, 0] < len(d) - 8:  # a walk past the end of the item says nothing about a document
                        rows[t][kind].append((int(keys[t, 0]), w))
        self.sorted = [[sorted(r) for r in pair] for pair in rows]
        self.lookup = [[(np.array([k for k, _ in r], dtype=np.int64), np.array([w for _, w in r], dtype=np.int64))
                        for r in pair] for pair in self.sorted]

    def candidates(self, data: np.ndarray) -> set[tuple[int, int]]:
        """(position, window) of the candidates in zero-separated texts."""
        at, out = starts(data[:-8]), set()
        at = at[self.lut[prefixes(data, at)]]
        for c in range(0, len(at), CHUNK):
            part = at[c:c + CHUNK]
            prefix = prefixes(data, part)
            symbols, _ = self.embedding.walk(data, part)
            for kind in range(len(STEPS)):
                for keys, (known, window) in zip(self.embedding.keys(symbols, prefix, kind), (p[kind] for p in self.lookup)):
                    low, high = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
                    for j in np.flatnonzero(low < high):
                        out.update((int(part[j]), int(w)) for w in window[low[j]:high[j]])
        return out

    def simulated(self) -> float:
        """Share of items found in a copy with max_edits random edits."""
        rng, hit = np.random.default_rng(5), 0
        sample = range(0, len(self.items), max(1, len(self.items) // 200))
        for i in sample:
            text = list(self.items[i][1])
            for _ in range(int(self.max_edits * len(text))):
                p, kind = int(rng.integers(len(text))), int(rng.integers(3))
                text[p:p + (kind != 1)] = [] if kind == 2 else ["abcdefghijklmnopqrstuvwxyz "[int(rng.integers(27))]]
            copy = normal("".join(text))
            found = self.candidates(padded(copy.encode()))
            hit += any(self.windows[w][0] == i for _, w in found) and self.alike(i, copy)
        return hit / max(1, len(sample))

    def alike(self, i: int, part: str) -> bool:
        """Whether a part of a text holds enough of an item's runs for an edited copy."""
        runs = self.runs[i]
        return len(runs & grams(part)) >= LEFT * (1 - self.max_edits) ** GRAM * len(runs)


def edits_within(item: str, text: str, most: int) -> int | None:
    """Least edit distance of the item to any part of the text, if at most `most` (bit-parallel columns)."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (full & ~(xh | plus)), plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1, mh << 1  # a match may begin anywhere, so the first row stays zero
        plus, minus = (mh | (full & ~(xv | ph))) & full, ph & xv & full
        best = min(best, score)
    return best if best <= most else None


def grams(text: str) -> set[str]:
    return {text[i:i + GRAM] for i in range(len(text) - GRAM + 1)}


class Pieces:
    """Short items, found by pieces: of one more pieces than edits, one is intact."""

    def __init__(self, items: list[tuple[int, str]], max_edits: float):
        self.items, self.automaton = items, ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(items):
            parts = int(max_edits * len(text)) + 1
            for k in range(parts):
                first = k * len(text) // parts
                at.setdefault(text[first:(k + 1) * len(text) // parts], []).append((i, first))
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def places(self, text: str) -> Iterator[tuple[int, int]]:
        """(item, where it would begin)."""
        for last, (size, places) in self.automaton.iter(text) if self.items else ():
            for i, first in places:
                yield i, last + 1 - size - first


def find_items(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, anchors: int = ANCHORS,
               recall: float = RECALL, block: int = BLOCK_ITEMS, short: int = SHORT) -> DataFrame:
    """(doc_id, item_id, edits): items that a document holds with at most max_edits edits per code point of the item.

    Texts are compared with A-Z lower-cased and white space as single blanks; an item may lie anywhere in a whole
    text. Items of fewer than `short` code points are all found, longer ones with `recall` or more at the largest
    number of random edits; a ValueError says that this cannot be reached. Null and empty items are held by no text,
    null and empty texts hold nothing. Repeated rows of a document or an item count once; null ids come back as null.
    Without items, or documents, there are no rows.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, edits int"
    found = spark.createDataFrame([], schema)
    rows = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct().toLocalIterator()
    usable = ((r.item_id, t) for r in rows if (t := normal(r.text)))
    base = texts(docs)
    while items := list(islice(usable, block)):
        long = ItemTables([x for x in items if len(x[1]) >= short], anchors, recall, max_edits)
        found = found.union(base.mapInArrow(lean(search(long, [x for x in items if len(x[1]) < short], max_edits)), schema))
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def stretches(begins: list[int], size: int, most: int) -> Iterator[tuple[int, int]]:
    """Parts of a text in which an item may lie, from where it would begin; those that overlap are one."""
    first, last = None, 0
    for begin in sorted(set(begins)):
        low, high = max(0, begin - most), max(0, begin + size + most)
        if first is not None and low <= last:
            last = high
            continue
        if first is not None:
            yield first, last
        first, last = low, high
    if first is not None:
        yield first, last


def search(tables: ItemTables, short: list[tuple[int, str]], max_edits: float):
    def least(text: str, item: str, begins: list[int], long: int | None = None) -> int | None:
        most, best = int(max_edits * len(item)), None
        for low, high in stretches(begins, len(item), most):
            part = text[low:high]
            if long is not None and not tables.alike(long, part):
                continue
            edits = edits_within(item, part, most if best is None else best)
            if edits is not None:
                best = edits if best is None else min(best, edits)
            if best == 0:
                break
        return best

    def long_items(text: str, raw: bytes, at: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        begins: dict[int, list[int]] = {}
        for position, w in at:
            i, offset = tables.windows[w]
            before = len(bytes(tables.data[i][:offset]).decode())
            begins.setdefault(i, []).append(len(raw[:position].decode()) - before)
        for i, places in begins.items():
            edits = least(text, tables.items[i][1], places, i)
            if edits is not None:
                yield tables.items[i][0], edits

    def short_items(pieces: Pieces, text: str) -> Iterator[tuple[int, int]]:
        begins: dict[int, list[int]] = {}
        for i, begin in pieces.places(text):
            begins.setdefault(i, []).append(begin)
        for i, places in begins.items():
            edits = least(text, short[i][1], places)
            if edits is not None:
                yield short[i][0], edits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(short, max_edits)
        for batch in batches:
            ids, whole = batch.column(0).to_pylist(), batch.column(1)
            for first, part in groups(whole):
                clean = [normal(t) for t in part]
                raw = [t.encode() for t in clean]
                bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
                hits: dict[int, list] = {}
                for position, w in sorted(tables.candidates(padded(b"\0".join(raw) + b"\0"))) if tables.items else ():
                    d = int(np.searchsorted(bounds, position, "right")) - 1
                    hits.setdefault(d, []).append((position - int(bounds[d]), w))
                out = [(ids[first + d], item, e) for d, at in hits.items() for item, e in long_items(clean[d], raw[d], at)]
                if short:
                    out += [(ids[first + d], item, e) for d, text in enumerate(clean) for item, e in short_items(pieces, text)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32()))],
                        ["doc_id", "item_id", "edits"],
                    )

    return run


def groups(column: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of about `size` characters with the number of their first row."""
    first, out, held = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py()
        if out and held + len(text) > size:
            yield first, out
            first, out, held = i, [], 0
        out.append(text)
        held += len(text)
    if out:
        yield first, out


@query("op6_decontaminate")
def op6_decontaminate(spark: SparkSession, root: str) -> DataFrame:
    return find_items(table(spark, root, "documents"), table(spark, root, "benchmark"))
