"""SentencePiece encoding and decoding with the tokenizers library.

The model file is a protobuf of pieces with scores and two specifications. It is parsed here and rebuilt as a
tokenizer: normaliser from the character map and white-space rules, the metaspace marker, unigram scores (or, for a
BPE model, merges in the order of the scores) and byte fallback. If no piece continues past the start of a word, a text
is the sequence of its words: each distinct word of a batch is encoded once, in multithreaded batches, and checked
against the sentencepiece library, so that every token of every text is covered by the check.
"""

from __future__ import annotations

import operator
import os
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from monthmill.llm.common import lean, query, table, texts, values

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE, CHUNK, THREADS = 600_000, 1 << 19, 2
LEARNED = 20_000  # new words that are encoded, checked and decoded together
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at:at + size]
            at += size


class Model:
    """What the file says: pieces, scores, kinds, and the two specifications."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normal = {}, {}
        for field, value in fields(data):
            if field == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(fields(value))
            elif field == 3:
                normal = dict(fields(value))
        self.bpe = {1: False, 2: True}[trainer.get(3, 1)]
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unk = trainer.get(40, 0)
        self.charsmap = normal.get(2, b"")
        self.prefix, self.squeeze, self.escape = (bool(normal.get(k, 1)) for k in (3, 4, 5))
        if not self.escape or trainer.get(24, 0):
            raise ValueError("models without the marker, or with the marker at the end of words, are not supported")
        # no piece has the marker after another character, so none spans two words
        self.by_words = self.prefix and not any(MARK in p.lstrip(MARK) for p in self.pieces)


def rebuild(model: Model) -> Tokenizer:
    unk = model.pieces[model.unk]
    if model.bpe:
        ids = {p: i for i, p in enumerate(model.pieces)}
        usable = {p for p, k in zip(model.pieces, model.kinds) if k in (NORMAL, USER)}
        merges = [
            (-model.scores[ids[p]], ids[p], c, p[:c], p[c:])
            for p in usable for c in range(1, len(p)) if p[:c] in usable and p[c:] in usable
        ]
        body = models.BPE(
            vocab=ids, merges=[(a, b) for *_, a, b in sorted(merges)], unk_token=unk, fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    else:
        body = models.Unigram(list(zip(model.pieces, model.scores)), model.unk, model.byte_fallback)
    out = Tokenizer(body)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.prefix:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    strip = [decoders.Strip(" ", 1, 0)] if model.prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return out


class Encoder:
    """Encodes lists of texts inside a task; the cache of words is emptied when full."""

    def __init__(self, data: bytes, cache: int = CACHE, threads: int = THREADS):
        # read by the library when it first encodes in this process
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = Model(data)
        self.tokenizer = rebuild(self.model)
        self.checker = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.size, self.split = cache, re.compile(" +[^ ]*").findall
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])
        self.same, self.back = array("b"), array("b")

    def pieces(self, text: str) -> list[str]:
        """Parts that are encoded on their own: words with the blanks before them, or the whole text."""
        if self.model.by_words:
            clean = self.tokenizer.normalizer.normalize_str(text)[1:] if self.model.charsmap or self.model.squeeze else text
            return self.split(" " + clean.replace(MARK, " ")) if clean else []
        return [text] if text else []

    def learn(self, parts: list[str]) -> None:
        """Encode new parts with the rebuilt tokenizer and decode them again; parts are marked where the sentencepiece
        library has other ids, and where the text does not come back."""
        words = self.model.by_words
        plain = [p[1:] for p in parts] if words else parts
        wants = self.checker.encode(plain, num_threads=1)
        made = [m.ids for m in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)]
        for i in [i for i, text in enumerate(plain) if words and not text]:
            # a lone blank ends the text or stands for itself; alone, both libraries take it for an empty text
            wants[i] = made[i] = [self.checker.piece_to_id(MARK)]
        self.known.update(zip(parts, range(len(self.same), len(self.same) + len(parts))))
        self.same.extend(map(operator.eq, made, wants))
        self.ids.extend(chain.from_iterable(made))
        self.ends.extend(accumulate(map(len, made), initial=self.ends.pop()))
        # no piece spans two parts, so a text comes back if all its parts do
        self.back.extend(map(operator.eq, self.tokenizer.decode_batch(made, skip_special_tokens=False), plain))

    def places(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, end of each text in them, whether the two libraries agree, whether the text decodes to itself)."""
        parts = [self.pieces(t) for t in batch]
        every = list(chain.from_iterable(parts))
        at = self.places(every)
        fresh = list({every[i] for i in np.flatnonzero(at < 0)})
        if fresh and len(self.known) + len(fresh) > self.size:
            self.clear()
            fresh = list(set(every))
        for i in range(0, len(fresh), LEARNED):
            self.learn(fresh[i:i + LEARNED])
        if fresh:
            missing = np.flatnonzero(at < 0) if len(fresh) < len(self.known) else np.arange(len(every))
            at[missing] = self.places([every[i] for i in missing])
        ids, ends = np.array(self.ids, dtype=np.int32), np.array(self.ends, dtype=np.int64)
        size = ends[at + 1] - ends[at]
        stops = np.cumsum(size)
        flat = ids[np.repeat(ends[at] - stops + size, size) + np.arange(stops[-1] if len(stops) else 0)]
        count = np.cumsum([len(ps) for ps in parts])

        def all_of(flags: array) -> np.ndarray:
            wrong = np.r_[0, np.cumsum(np.array(flags, dtype=bool)[at] ^ True)]
            return np.diff(wrong[np.r_[0, count]]) == 0

        literal = np.array([MARK in t for t in batch])
        return flat, np.r_[0, stops][count], all_of(self.same), all_of(self.back) & ~literal

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of id lists; special ids have no text."""
        return self.tokenizer.decode_batch(ids, skip_special_tokens=True)


def chunks(texts_: Iterable[str], size: int = CHUNK) -> Iterator[list[str]]:
    """Consecutive texts of about `size` characters together, at least one."""
    out, held = [], 0
    for v in texts_:
        if out and held + len(v) > size:
            yield out
            out, held = [], 0
        out.append(v)
        held += len(v)
    if out:
        yield out


def encode(docs: DataFrame, model: str = MODEL, cache: int = CACHE) -> DataFrame:
    """One row per input row: doc_id, ids (array of int), n_tokens, parity, round_trip.

    The ids are those of the rebuilt tokenizer. `parity` says that the sentencepiece library gives the same for the
    whole text. `round_trip` says that its decoder gives the text back; the marker character itself comes back as a
    blank. `cache` is the number of words that a task holds, memory against repeated encoding. Null and
    empty texts have no ids. Repeated rows and null ids are rows like any other; an empty table gives no rows.
    """
    with open(model, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(data, cache)
        for batch in batches:
            at = 0
            for part in chunks(values(batch.column(1))):
                flat, ends, same, back = encoder.encode(part)
                offsets = np.r_[0, ends]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(part)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())),
                    pa.array(np.diff(offsets), pa.int64()), pa.array(same, pa.bool_()),
                    pa.array(back, pa.bool_()),
                ], ["doc_id", "ids", "n_tokens", "parity", "round_trip"])
                at += len(part)

    return texts(docs).mapInArrow(lean(run), "doc_id long, ids array<int>, n_tokens long, parity boolean, round_trip boolean")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): null ids give null, no ids an empty text. Repeated rows and null doc_ids are
    rows like any other, other columns play no part; an empty table gives no rows."""
    with open(model, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(data)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            back = iter(encoder.decode([i for i in ids if i is not None]))
            out = [None if i is None else next(back) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


@query("op10_sentencepieces")
def op10_sentencepieces(spark: SparkSession, root: str) -> DataFrame:
    return encode(table(spark, root, "documents"))
