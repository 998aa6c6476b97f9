"""Language-model scores: a word unigram base and a causal self-attention model on subword ids.

Counts come from all training texts. Base: words frequent enough to be few (at most `1 / share` of them) are looked up
in a broadcast table where the text is read; the other words of a text meet their counts in a join. Model: one layer of
masked attention in numpy predicts the class of the next subword; within a class, corpus frequencies decide. It is
trained on the windows of all training texts, the same windows as in scoring, each in one of the rounds: each task trains
on its windows, weights are averaged over the windows, and the next round starts from the average. Texts are scored in
overlapping windows that score each token once.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from monthmill.llm.common import lean, query, remainder, stored, table, texts, values

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# GPT-2's published pre-tokenisation, a fixed pattern
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
WIDTH, OVERLAP, DIM, INPUTS, CLASSES = 16, 4, 16, 1024, 64
RATE, ROUNDS, BATCH, STEP = 1, 4, 64, 0.01
SHARE, CACHE, WINDOWS = 1e-6, 500_000, 64
# characters of the texts taken together: by a model, and to be split into words, of which more are then met before
CHARS, TEXT = 1 << 20, 1 << 21
# columns behind a table of queries
GAP = 16
WORDS = pa.large_list(pa.large_binary())


class Subwords:
    """Ids of lists of words, each encoded with a blank before it; a bounded cache of words with their base values."""

    def __init__(self, ranks: dict[bytes, int], frequent: dict[bytes | None, float] | None = None):
        self.encode = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.opens = np.zeros(END + 1, dtype=bool)
        self.opens[[i for piece, i in ranks.items() if piece.startswith(b" ")]] = True
        self.frequent = frequent or {}
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes | None, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])
        self.units, self.rare = array("d"), array("b")

    def pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in one go, and the end of each word in them: only a word's first piece opens with a blank."""
        ids = np.array(self.encode("".join(" " + w.decode() for w in words)), dtype=np.int32)
        return ids, np.r_[np.flatnonzero(self.opens[ids])[1:], len(ids)] if words else ids

    def learn(self, words: list[bytes | None]) -> None:
        some = [w for w in words if w is not None]
        ids, ends = self.pieces(some)
        if len(some) < len(words):
            ids, ends, some = np.r_[ids, END].astype(np.int32), np.r_[ends, len(ids) + 1], [*some, None]
        self.known.update(zip(some, range(len(self.ends) - 1, len(self.ends) - 1 + len(some))))
        start = self.ends[-1]
        self.ids.frombytes(ids.tobytes())
        self.ends.frombytes((ends + start).astype(np.int64).tobytes())
        found = list(map(self.frequent.get, some))
        self.units.extend(0.0 if v is None else v for v in found)
        self.rare.extend(v is None for v in found)

    def places(self, words: list[bytes | None]) -> np.ndarray:
        """Places of different words in the cache; those not yet in it are learned."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(at < 0)
        if len(self.known) + len(missing) > CACHE:
            self.clear()
            missing = np.arange(len(words))
        if len(missing):
            fresh = [words[i] for i in missing]
            self.learn(fresh)
            at[missing] = np.fromiter(map(self.known.__getitem__, fresh), dtype=np.int64, count=len(fresh))
        return at

    def place(self, docs: pa.Array | list[list[bytes]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All words; the places in the cache of these and of a None that closes each text; and the end of each text."""
        docs = pa.array(docs, WORDS) if isinstance(docs, list) else docs
        stops = docs.offsets.to_numpy()[1:]
        coded = docs.values.dictionary_encode()
        spots = self.places([*coded.dictionary.to_numpy(zero_copy_only=False), None])
        return docs.values, np.insert(spots[coded.indices.to_numpy()], stops, spots[-1]), stops + np.arange(1, len(stops) + 1)

    def flat(self, at: np.ndarray, texts_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the placed words one after the other, and the end of each text in them."""
        ids, ends = np.array(self.ids, dtype=np.int32), np.array(self.ends, dtype=np.int64)
        size = ends[at + 1] - ends[at]
        stops = np.cumsum(size)
        flat = ids[np.repeat(ends[at] - stops + size, size) + np.arange(stops[-1] if len(stops) else 0)]
        return flat, stops[texts_end - 1]


def windows(ids: np.ndarray, stops: np.ndarray, inputs: np.ndarray | None = None, targets: np.ndarray | None = None):
    """Inputs, targets, which positions to score, and the text of each window; every token is scored in one window.

    Tokens in use come in the order of the texts. With tables of `inputs` and `targets`, ids are looked up in these.
    """
    starts = np.r_[0, stops[:-1]]
    step = WIDTH - OVERLAP
    count = np.maximum(1, -(-(stops - starts - OVERLAP) // step))
    owner = np.repeat(np.arange(len(stops)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = starts[owner] + nth * step
    use = np.arange(WIDTH) < (stops[owner] - at)[:, None]
    use[:, :OVERLAP] &= (nth == 0)[:, None]
    before = np.r_[ids[:1], ids[:-1]]
    before[starts] = END  # a text begins after an end
    before, ids = (v if t is None else t[v] for v, t in ((before, inputs), (ids, targets)))
    # a window at the end may reach beyond the last text, with positions out of use
    return *(np.lib.stride_tricks.sliding_window_view(np.r_[v, v[-1:].repeat(WIDTH)], WIDTH)[at] for v in (before, ids)), use, owner


class Vocabulary:
    """Input slot, class, and probability within the class of every subword id, from its count in the training texts."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), dtype=np.int64)
        rank[order] = np.arange(len(counts))
        own = INPUTS // 2
        self.slot = np.where(rank < own, rank, own + rank % (INPUTS - own)).astype(np.int32)
        alone = CLASSES * 3 // 4
        # frequent ids are classes of their own; the others share the rest in bands of about equal counts
        mass = np.cumsum(counts[order][alone:] + 0.5)
        band = np.minimum((mass / mass[-1] * (CLASSES - alone)).astype(np.int64), CLASSES - alone - 1)
        self.kind = np.empty(len(counts), dtype=np.int32)
        self.kind[order[:alone]] = np.arange(alone)
        self.kind[order[alone:]] = alone + band
        total = np.bincount(self.kind, weights=counts + 0.5, minlength=CLASSES)
        self.within = np.log((counts + 0.5) / total[self.kind]).astype(np.float32)
        self.bias = np.log(total / total.sum()).astype(np.float32)


class Room:
    """Arrays of steps over `n` windows, used again by each of them: their memory stays near the processor."""

    def __init__(self, n: int, kind: np.dtype):
        cells = n * WIDTH
        self.x, self.c, self.dx = (np.empty((cells, DIM), dtype=kind) for _ in range(3))
        self.dh = np.zeros((cells + 1, DIM), dtype=kind)
        self.back, self.order = np.empty(cells, dtype=np.int64), np.arange(cells)
        # logits, and once these are used up, gradients of queries and values
        self.p = np.empty(cells * max(CLASSES, 2 * DIM), dtype=kind)
        self.qv, self.dqv = np.empty((cells, 2 * DIM), dtype=kind), self.p[:cells * 2 * DIM].reshape(cells, 2 * DIM)
        self.q, self.v = self.qv.reshape(n, WIDTH, 2, DIM).transpose(2, 0, 1, 3)
        self.dq, self.dv = self.dqv.reshape(n, WIDTH, 2, DIM).transpose(2, 0, 1, 3)
        self.t, self.a, self.mask, self.ds = (rows(k, cells, kind) for k in (DIM, WIDTH, WIDTH, WIDTH))
        each(self.mask, n)[:] = np.triu(np.ones((WIDTH, WIDTH)))
        self.te, self.ae, self.dse = (each(r, n) for r in (self.t, self.a, self.ds))
        self.xe, self.ce, self.dxe = (r.reshape(n, WIDTH, DIM) for r in (self.x, self.c, self.dx))
        self.sums, self.ones = np.zeros(cells + GAP, dtype=kind), np.ones(max(cells, CLASSES), dtype=kind)
        self.cells = np.empty((cells, DIM), dtype=np.int64)


def rows(count: int, cells: int, kind: np.dtype) -> np.ndarray:
    """A row for each key or dimension, a column for each query; behind them a gap, as rows of 2^n bytes evict one another."""
    return np.ones((count, cells + GAP), dtype=kind)


def each(table_: np.ndarray, n: int) -> np.ndarray:
    """The part of every window, without the gap."""
    return table_[:, :table_.shape[1] - GAP].reshape(len(table_), n, -1).transpose(1, 0, 2)


class Attention:
    """Embedding, one masked self-attention layer, one hidden layer, class logits; weights in one flat vector."""

    SHAPES = {"e": (INPUTS, DIM), "p": (WIDTH, DIM), "qkv": (DIM, 3 * DIM), "o": (DIM, DIM), "w1": (DIM, DIM),
              "w2": (DIM, DIM), "u": (DIM, CLASSES), "b": (CLASSES,)}
    CELLS = np.arange(INPUTS * DIM).reshape(INPUTS, DIM)

    def __init__(self, flat: np.ndarray):
        self.flat, self.rooms, at = flat, {}, 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, flat[at:at + size].reshape(shape))
            at += size
        self.q, self.k, self.v = (self.qkv[:, i:i + DIM] for i in range(0, 3 * DIM, DIM))

    @classmethod
    def initial(cls, bias: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(1)
        parts = [rng.normal(0, 0.5 / np.sqrt(s[0] if n not in "ep" else DIM), s).ravel() for n, s in cls.SHAPES.items()]
        parts[-1] = bias
        return np.concatenate(parts).astype(np.float32)

    def room(self, n: int) -> Room:
        if n not in self.rooms:
            if len(self.rooms) > 1:
                self.rooms.clear()
            self.rooms[n] = Room(n, self.flat.dtype)
        return self.rooms[n]

    def products(self) -> np.ndarray:
        """Queries by keys, and values by `o`: matrices that meet with nothing between them, as one each."""
        w = np.empty((DIM, 2 * DIM), dtype=self.flat.dtype)
        np.matmul(self.q * DIM ** -0.5, self.k.T, out=w[:, :DIM])
        np.matmul(self.v, self.o, out=w[:, DIM:])
        return w

    def forward(self, slots: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """Attention over whole windows; what follows it only for the flat positions `at`, the ones to be scored.

        Attention is left in the room of so many windows, where the next pass overwrites it.
        """
        r, w = self.room(len(slots)), self.products()
        # indices are within the table; only a mode other than "raise" writes to `out` without a copy
        self.e.take(slots.ravel(), axis=0, out=r.x, mode="clip")
        r.xe += self.p
        np.matmul(r.x, w, out=r.qv)
        np.matmul(w[:, :DIM].T, r.x.T, out=r.t[:, :len(r.x)])
        attend(r.xe, r.te, r.a, r.mask, r.sums)
        np.matmul(r.ae.transpose(0, 2, 1), r.v, out=r.ce)
        h = r.c.take(at, axis=0)
        h += r.x.take(at, axis=0)
        z = h @ self.w1
        np.maximum(z, 0, out=z)
        y = z @ self.w2
        y += h
        return {"w": w, "h": h, "z": z, "y": y}

    def class_logs(self, slots: np.ndarray, kinds: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Log probability of the class of each target in use, in one row."""
        frozen, out, whole = Frozen(self), np.empty(use.shape, dtype=self.flat.dtype), use[:, :OVERLAP].any(axis=1)
        for since, which in ((0, np.flatnonzero(whole)), (OVERLAP, np.flatnonzero(~whole))):
            for i in range(0, len(which), WINDOWS):
                some = which[i:i + WINDOWS]
                out[some, since:] = frozen.logs(slots.take(some, axis=0), kinds.take(some, axis=0)[:, since:])
        return out[use]

    def gradient(self, slots: np.ndarray, kinds: np.ndarray, use: np.ndarray, into: Attention | None = None) -> tuple[float, np.ndarray]:
        """Mean loss and its gradient; one that goes `into` the weights of another comes without the loss."""
        at, r = np.flatnonzero(use), self.room(len(slots))
        f, g, count, n = self.forward(slots, at), into or Attention(np.empty_like(self.flat)), len(at), max(1, len(at))
        w, h, z, y = f.values()
        p = r.p[:count * CLASSES].reshape(CLASSES, count)
        np.matmul(self.u.T, y.T, out=p)
        p += self.b[:, None]
        np.exp(p.clip(-40, 40, out=p), out=p)
        sums = r.ones[:CLASSES] @ p
        cells, every = kinds.take(at) * count + r.order[:count], p.reshape(-1)
        picked = every.take(cells)
        loss = -np.log(picked / sums + 1e-12).sum() / n if into is None else np.nan
        every[cells] = picked - sums
        sums *= n
        p *= np.divide(1, sums, out=sums)
        np.matmul(y.T, p.T, out=g.u)
        np.matmul(p, r.ones[:count], out=g.b)
        dh = np.matmul(p.T, self.u.T, out=r.dh[:count])
        np.matmul(z.T, dh, out=g.w2)
        dz = dh @ self.w2.T.copy()
        dz *= np.sign(z)
        np.matmul(h.T, dz, out=g.w1)
        dh += dz @ self.w1.T.copy()
        # at positions not in use the gradient is the row of zeros behind the others
        r.dh[count] = 0
        r.back.fill(count)
        r.back[at] = r.order[:count]
        dx = r.dh.take(r.back, axis=0, out=r.dx, mode="clip")
        r.t[:, :len(dx)] = dx.T
        np.matmul(r.v, r.te, out=r.dse)
        # what the softmax takes off: the sum of a * ds of a query is that of c * dc
        np.matmul(np.multiply(r.c, dx, out=r.c), r.ones[:DIM], out=r.sums[:len(dx)])
        r.ds -= r.sums
        r.ds *= r.a
        np.matmul(r.dse.transpose(0, 2, 1), r.xe, out=r.dq)
        np.matmul(r.ae, r.dxe, out=r.dv)
        np.matmul(r.dse, r.q, out=r.ce)
        dx += r.c
        dw = r.x.T @ r.dqv
        dqk, dvo = dw[:, :DIM] * DIM ** -0.5, dw[:, DIM:]
        np.matmul(dqk, self.k, out=g.q)
        np.matmul(dqk.T, self.q, out=g.k)
        np.matmul(dvo, self.o.T, out=g.v)
        np.matmul(self.v.T, dvo, out=g.o)
        dx += np.matmul(r.dqv, w.T.copy(), out=r.x)
        np.matmul(r.ones[:len(slots)], dx.reshape(len(slots), -1), out=g.p.reshape(-1))
        self.CELLS.take(slots.ravel(), axis=0, out=r.cells, mode="clip")
        g.e.fill(0)
        np.add.at(g.e.reshape(-1), r.cells.ravel(), dx.ravel())
        return float(loss), g.flat


def attend(keys: np.ndarray, queries: np.ndarray, a: np.ndarray, mask: np.ndarray, sums: np.ndarray) -> None:
    """Into `a` the weight of every key for every query."""
    np.matmul(keys, queries, out=each(a, len(keys)))
    a.clip(-30, 30, out=a)
    np.exp(a, out=a)
    a *= mask
    np.add.reduce(a, axis=0, out=sums)
    a *= np.divide(1, sums, out=sums)


class Frozen:
    """A model whose weights stay, for queries of the last positions of windows."""

    def __init__(self, net: Attention):
        # the bias of a class as a factor
        self.net, self.w, self.share, self.rooms = net, net.products(), np.exp(net.b), {}

    def room(self, n: int, queries: int) -> SimpleNamespace:
        if (n, queries) not in self.rooms:
            r, cells, size, kind = SimpleNamespace(), n * WIDTH, n * queries, self.w.dtype
            r.x, r.v = (np.empty((cells, DIM), dtype=kind) for _ in range(2))
            r.h, r.z, r.y = (np.empty((size, DIM), dtype=kind) for _ in range(3))
            r.xe, r.ve, r.he = r.x.reshape(n, WIDTH, DIM), r.v.reshape(n, WIDTH, DIM), r.h.reshape(n, queries, DIM)
            r.t, r.a, r.mask = rows(DIM, cells, kind), rows(WIDTH, size, kind), rows(WIDTH, size, kind)
            r.te, r.ae = each(r.t, n)[..., -queries:], each(r.a, n)
            each(r.mask, n)[:] = np.triu(np.ones((WIDTH, WIDTH)))[:, -queries:]
            r.p, r.sums, r.order = np.empty((CLASSES, size), dtype=kind), r.a[0].copy(), np.arange(size)
            self.rooms[n, queries] = r
        return self.rooms[n, queries]

    def logs(self, slots: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Log probabilities of the classes of targets at the last positions of windows."""
        n, queries = kinds.shape
        r, net = self.room(n, queries), self.net
        net.e.take(slots.ravel(), axis=0, out=r.x, mode="clip")
        r.xe += net.p
        np.matmul(r.x, self.w[:, DIM:], out=r.v)
        np.matmul(self.w[:, :DIM].T, r.x.T, out=r.t[:, :len(r.x)])
        attend(r.xe, r.te, r.a, r.mask, r.sums)
        np.matmul(r.ae.transpose(0, 2, 1), r.ve, out=r.he)
        r.he += r.xe[:, -queries:]
        np.matmul(r.h, net.w1, out=r.z)
        np.maximum(r.z, 0, out=r.z)
        np.matmul(r.z, net.w2, out=r.y)
        r.y += r.h
        p = np.matmul(net.u.T, r.y.T, out=r.p)
        p.clip(-40, 40, out=p)
        own = kinds.ravel()
        picked = p.ravel().take(own * len(r.h) + r.order) + net.b.take(own)
        return (picked - np.log(self.share @ np.exp(p, out=p))).reshape(n, queries)


def descend(flat: np.ndarray, slots: np.ndarray, kinds: np.ndarray, use: np.ndarray, order: np.random.Generator) -> np.ndarray:
    """One pass of Adam over the windows; the moments are kept without their factors of 0.1 and 0.01."""
    flat, m, v = flat.copy(), np.zeros_like(flat), np.zeros_like(flat)
    net, into = Attention(flat), Attention(np.empty_like(flat))
    for t, batch in enumerate(np.array_split(order.permutation(len(slots)), max(1, len(slots) // BATCH)), start=1):
        _, g = net.gradient(*(part.take(batch, axis=0) for part in (slots, kinds, use)), into)
        m *= 0.9
        m += g
        g *= g
        v *= 0.99
        v += g
        scale = float(np.sqrt(0.01 / (1 - 0.99 ** t)))
        np.sqrt(v, out=g)
        g += 1e-8 / scale
        np.divide(m, g, out=g)
        g *= STEP * 0.1 / (1 - 0.9 ** t) / scale
        flat -= g
    return flat


class Words:
    """Counts of the words of the training texts: total and kinds of tokens, ends of texts, frequent words, and a table of all."""

    def __init__(self, ranks, total, kinds, ends, frequent, counts):
        self.ranks, self.total, self.kinds, self.ends, self.frequent, self.counts = ranks, total, kinds, ends, frequent, counts

    def unit(self, count: float) -> float:
        """Base log10 probability of a token with this count."""
        return float(np.log10((count + 0.5) / (self.total + 0.5 * (self.kinds + 1))))


class Model:
    """What scoring needs: the words, the vocabulary of subwords, and the trained attention model."""

    def __init__(self, words: Words, vocabulary: Vocabulary, flat: np.ndarray):
        self.words, self.vocabulary, self.flat = words, vocabulary, flat


def split_words(texts_: list[str]) -> pa.Array:
    """For each text its words between ASCII white space, A-Z lower-cased, in UTF-8."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts_, pa.large_string())))
    # white space at either end of a text leaves an empty word there
    kept = pc.greater(pc.binary_length(split.values), 0)
    stops = np.r_[0, np.cumsum(kept.to_numpy(zero_copy_only=False))][split.offsets.to_numpy()]
    return pa.LargeListArray.from_arrays(pa.array(stops), split.values.filter(kept).cast(pa.large_binary()))


def chunks(texts_: Iterable, limit: int = CHARS, size: Callable = len) -> Iterator[list]:
    out, held = [], 0
    for v in texts_:
        if out and held + size(v) > limit:
            yield out
            out, held = [], 0
        out.append(v)
        held += size(v)
    if out:
        yield out


def train(docs: DataFrame, held_out, path: str = RANKS, rate: int = RATE, rounds: int = ROUNDS, share: float = SHARE) -> Model:
    """Counts and model from all rows for which `held_out` is false; with a rate over 1 the model sees one text in `rate`."""
    words = counted(docs, held_out, path, share)
    return fitted(coded(docs.filter(~held_out), words, F.lit(True)), words, rate, rounds)


def counted(docs: DataFrame, held_out, path: str = RANKS, share: float = SHARE) -> Words:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    learn = texts(docs.filter(~held_out).select("doc_id", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = [], 0

        def merged() -> pa.Table:
            every = pa.table({"word": pa.concat_arrays([w for w, _ in seen]), "c": pa.concat_arrays([c for _, c in seen])})
            return every.group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"]).combine_chunks()

        for batch in batches:
            for part in chunks(values(batch.column(1)), TEXT):
                found = split_words(part).values.cast(pa.binary()).value_counts()
                seen.append((found.field("values"), found.field("counts")))
                rows += len(found)
                if rows > CACHE:
                    table_, seen, rows = merged(), [], 0
                    if len(table_) > CACHE // 2:
                        yield from table_.to_batches()
                    else:
                        seen, rows = [tuple(table_.column(c).chunk(0) for c in ("word", "c"))], len(table_)
        if seen:
            yield from merged().to_batches()

    counts = learn.mapInArrow(lean(count), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = stored(counts, "counts")
    ends = learn.count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, kinds = sums.n + ends, sums.v + (ends > 0)
    # words with at least this share of all tokens: at most 1 / share of them
    frequent = {r.word: r.c for r in counts.filter(F.col("c") >= max(1.0, share * total)).collect()}
    return Words(ranks, total, kinds, ends, frequent, counts)


def coded(docs: DataFrame, words: Words, learn) -> DataFrame:
    """Every text split once, stored: subword ids, base over its frequent words, its other words; `learn` marks texts to train on."""
    frequent = docs.sparkSession.sparkContext.broadcast(
        {w: words.unit(c) for w, c in words.frequent.items()} | {None: words.unit(words.ends)}
    )
    ranks, closed = words.ranks, int(words.ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(ranks, frequent.value)
        for batch in batches:
            at = 0
            for part in chunks(values(batch.column("text")), TEXT):
                found, place, ends = subwords.place(split_words(part))
                ids, stops = subwords.flat(place, ends)
                n, tokens = len(part), np.diff(np.r_[0, ends])
                of = np.repeat(np.arange(n), tokens)
                rare = np.flatnonzero(np.array(subwords.rare, dtype=bool)[place])
                offsets = np.searchsorted(of[rare], np.arange(n + 1)).astype(np.int32)
                lists = pa.py_buffer((np.r_[0, stops] * 2).astype(np.int64)), pa.py_buffer(ids.astype(np.uint16))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(at, n) for c in ("doc_id", "row", "mark", "learn")),
                    pa.array(list(map(len, part)), pa.int64()), pa.array(tokens, pa.int64()),
                    pa.array(tokens - np.diff(offsets) - 1 + closed, pa.int64()),
                    pa.array(np.bincount(of, np.array(subwords.units)[place], n), pa.float64()),
                    pa.Array.from_buffers(pa.large_binary(), n, [None, *lists]).cast(pa.binary()),
                    # before a place in text k come the ends of k texts
                    pa.ListArray.from_arrays(pa.array(offsets), found.take(pa.array(rare - of[rare])).cast(pa.binary())),
                ], ["doc_id", "row", "mark", "learn", "size", "n_tokens", "hits", "base", "ids", "words"])
                at += n

    rows = texts(docs, F.coalesce(learn, F.lit(False)).alias("learn")).select(
        "*", F.monotonically_increasing_id().alias("row"), mark().alias("mark")
    )
    return stored(rows.mapInArrow(lean(run), "doc_id long, row long, mark long, learn boolean, size long, n_tokens long, "
                                             "hits long, base double, ids binary, words array<binary>"), "coded")


def fitted(rows: DataFrame, words: Words, rate: int = RATE, rounds: int = ROUNDS) -> Model:
    """The model trained on the coded texts that are marked for it."""
    learn = rows.filter("learn").select("mark", "size", "ids")

    def subword_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(END + 1, dtype=np.int64)
        for batch in batches:
            for _, ids, _ in opened(batch, CHARS):
                out += np.bincount(ids, minlength=END + 1)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["id", "n"])

    counts = np.zeros(END + 1)
    # at most one row for each id of the vocabulary
    for r in learn.mapInArrow(lean(subword_counts), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    vocabulary = Vocabulary(counts)
    flat = Attention.initial(vocabulary.bias)
    for k in range(rounds):
        flat = averaged(part_of(learn, k, rounds, rate), vocabulary, flat, k)
    return Model(words, vocabulary, flat)


def mark():
    return F.xxhash64("doc_id", "text")


def part_of(learn: DataFrame, number: int, rounds: int, rate: int) -> DataFrame:
    """The training texts of one round: with rate 1, every text is in exactly one of the rounds."""
    return learn.filter(F.pmod(F.col("mark") if "mark" in learn.columns else mark(), F.lit(rate * rounds)) == number)


def opened(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of a batch with texts of up to `limit` characters together: which they are, their ids, the end of each text in these."""
    for part in chunks(range(len(batch)), limit, batch.column("size").to_pylist().__getitem__):
        coded_ = batch.column("ids").slice(part[0], len(part)).cast(pa.large_binary())
        ends = np.frombuffer(coded_.buffers()[1], dtype=np.int64)[coded_.offset:coded_.offset + len(part) + 1] // 2
        yield slice(part[0], part[-1] + 1), np.frombuffer(coded_.buffers()[2], dtype=np.uint16)[ends[0]:ends[-1]], ends[1:] - ends[0]


def averaged(learn: DataFrame, vocabulary: Vocabulary, flat: np.ndarray, number: int) -> np.ndarray:
    """One round: each task trains on all windows of its texts from the same weights; the mean of theirs, by number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, i = flat, 0, 0
        for batch in batches:
            for _, ids, stops in opened(batch, CHARS):
                slots, wanted, use, _ = windows(ids, stops, vocabulary.slot, vocabulary.kind)
                now = descend(now, slots, wanted, use, np.random.default_rng(1000 * number + i))
                seen, i = seen + len(use), i + 1
        if seen:
            weights = [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(now.astype(np.float64) * seen)]
            yield pa.RecordBatch.from_arrays([*weights, pa.array(np.full(len(flat), seen))], ["at", "w", "n"])

    # as many rows as the model has weights
    trained = learn.mapInArrow(lean(run), "at int, w double, n long")
    rows = trained.groupBy("at").agg((F.sum("w") / F.sum("n")).alias("w")).toPandas()
    out = flat.copy()
    out[rows["at"].to_numpy()] = rows["w"].to_numpy()
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    A null text counts as empty and is one end. Rows that repeat a doc_id and text get the same scores; null ids are
    scored like others. Without training rows every token is unknown and the model is the untrained one. An empty
    table gives no rows.
    """
    return rated(coded(docs, model.words, F.lit(False)), model)


def rated(rows: DataFrame, model: Model) -> DataFrame:
    """Scores of coded texts, as `score` gives them."""
    vocabulary, flat, total, kinds = model.vocabulary, model.flat, model.words.total, model.words.kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Attention(flat)
        for batch in batches:
            for rows_, ids, stops in opened(batch, CHARS):
                logs = net.class_logs(*windows(ids, stops, vocabulary.slot, vocabulary.kind)[:3]) + vocabulary.within[ids].astype(np.float64)
                sums = np.add.reduceat(logs, np.r_[0, stops[:-1]])
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(rows_.start, len(stops)) for c in ("doc_id", "row", "n_tokens", "hits", "base")),
                    pa.array(sums / np.log(10), pa.float64()),
                ], ["doc_id", "row", "n_tokens", "hits", "base", "score"])

    scored = rows.select("doc_id", "row", "n_tokens", "hits", "base", "size", "ids").mapInArrow(
        lean(run), "doc_id long, row long, n_tokens long, hits long, base double, score double"
    )
    scored = stored(scored, "scored")
    c = F.coalesce("c", F.lit(0))
    unit = F.log10((c + 0.5) / F.lit(total + 0.5 * (kinds + 1)))
    rest = rows.select("row", F.explode("words").alias("word")).join(model.words.counts, "word", "left").groupBy("row").agg(
        F.sum(unit).alias("more"), F.sum((c > 0).cast("long")).alias("found")
    )
    return scored.join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("hits") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


@query("op4_lm_score")
def op4_lm_score(spark: SparkSession, root: str) -> DataFrame:
    docs, held = table(spark, root, "documents"), remainder(F.col("doc_id")) == 1
    words = counted(docs, held)
    rows = coded(docs, words, ~held)
    out = rated(rows, fitted(rows, words))
    return out.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")
