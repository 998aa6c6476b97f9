"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on the toxic passages, the words that
occur in clearly more toxic than ordinary documents. Every window of a text is compressed with the ordinary dictionary
and with both; the bytes that the toxic one saves are the window's distance. Counts of windows beyond fixed distances
are calibrated into a probability, and 0.5 is put where the F1 measure on the training rows is highest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from monthmill.llm.common import lean, query, remainder, table, texts, values

WINDOW, LEVEL = 48, 6
ORDINARY_BYTES, TOXIC_BYTES = 8192, 2048
PER_CLASS, PER_TEXT = 2500, 128  # bound of the training sample: texts of each class, windows of each text
SIGNIFICANT, TIMES, LEAST = 4.5, 4, 4
CUTS = (2, 3, 4, 5, 6, 8)
LETTERS = re.compile(r"[^\W\d_]+")


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The whole text in windows of about `size` bytes, cut at blanks; one empty window for an empty text."""
    data, out, at = text.lower().encode(), [], 0
    while at < len(data):
        end = min(len(data), at + size)
        if end < len(data):
            blank = data.find(b" ", end, end + size // 2)
            end = blank if blank > 0 else end
        out.append(data[at:end])
        at = end
    return out or [b""]


def evenly(items: list, most: int) -> list:
    return items if len(items) <= most else [items[i * len(items) // most] for i in range(most)]


def passages(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Words that follow clearly more different words in toxic than in ordinary texts, as often as they occur.

    Counting a word once for each word before it keeps the words of a text with many copies out.
    """

    def words(parts):
        return LETTERS.findall(b"".join(parts).decode(errors="ignore"))

    told = [words(t) for t in toxic]
    pairs = {p for t in told for p in zip(t, t[1:])}
    others = {p for t in ordinary for w in [words(t)] for p in zip(w, w[1:])}
    a, b = Counter(w for _, w in pairs), Counter(w for _, w in others)
    n, m = max(1, len(pairs)), max(1, len(others))

    def toxic_word(w):
        p = (a[w] + b[w] + 1) / (n + m + 2)
        deviations = (a[w] / n - b[w] / m) / np.sqrt(p * (1 - p) * (1 / n + 1 / m))
        return a[w] >= LEAST and a[w] * m >= TIMES * b[w] * n and deviations >= SIGNIFICANT

    keep = {w for w in a if toxic_word(w)}
    out = [f" {w} ".encode() for t in told for w in t if w in keep]
    return [out[i] for i in np.random.default_rng(0).permutation(len(out))]


def dictionary(samples: list[bytes], size: int, segments: tuple[int, ...], match: int = 6) -> bytes:
    """Content of the trained dictionary, of those with the given segment sizes, that compresses the samples best.

    If the samples are too few to train on, their end is the dictionary.
    """
    best, test = None, evenly(samples, 4000)
    for segment in segments:
        for joined in (1, 4):
            parts = [b"".join(samples[i:i + joined]) for i in range(0, len(samples), joined)]
            try:
                content = zstandard.train_dictionary(size, parts, k=segment, d=match).as_bytes()[-size:]
            except zstandard.ZstdError:
                continue
            pack = compressor(content)
            cost = sum(len(pack(t)) for t in test)
            if best is None or cost < best[0]:
                best = (cost, content)
    return best[1] if best else b"".join(samples)[-size:]


def compressor(content: bytes):
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, dict_size=len(content), source_size=WINDOW, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    held = zstandard.ZstdCompressionDict(content or b"        ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress


class Distances:
    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.both = compressor(ordinary), compressor(ordinary + toxic)

    def features(self, parts: list[bytes]) -> list[float]:
        d = np.array([len(self.ordinary(w)) - len(self.both(w)) for w in parts])
        over = np.array([(d >= c).sum() for c in CUTS])
        return [min(d.max(), 20) / 5, *np.log1p(over), *(10 * over[:4] / len(d)), np.log(len(d))]


class ToxicityModel:
    """Two dictionaries and a calibrated logistic score; a constant score if a class is missing."""

    def __init__(self, toxic: list[list[bytes]], ordinary: list[list[bytes]], share: float):
        self.constant = share if not toxic or not ordinary else None
        if self.constant is not None:
            return
        found = passages(toxic, ordinary)
        self.toxic = dictionary(found, TOXIC_BYTES, (8, 12, 16, 24, 40))
        self.ordinary = dictionary([w for t in ordinary for w in evenly(t, 10)], ORDINARY_BYTES, (48, 64), 8)
        measure = Distances(self.ordinary, self.toxic)
        x = np.array([measure.features(t) for t in [*toxic, *ordinary]])
        y = np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
        weight = np.where(y == 1, share / len(toxic), (1 - share) / len(ordinary))
        balanced = np.where(y == 1, 0.5 / len(toxic), 0.5 / len(ordinary))
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = (x - self.mean) / self.scale
        self.w, self.b = np.zeros(z.shape[1]), 0.0
        for _ in range(3000):
            g = balanced * (1 / (1 + np.exp(-(z @ self.w + self.b))) - y)
            self.w -= 0.5 * (z.T @ g + 1e-3 * self.w)
            self.b -= 0.5 * g.sum()
        # the cut with the best F1 at the true share of toxic rows becomes 0.5
        s = z @ self.w + self.b
        order = np.argsort(-s)
        hit, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
        best = int(np.argmax(2 * hit / (all_ + share)))
        low = s[order][best + 1] if best + 1 < len(s) else s[order][best] - 1
        self.b -= (s[order][best] + low) / 2

    def scores(self, texts_: list[str], measure: Distances | None = None) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts_)
        measure = measure or Distances(self.ordinary, self.toxic)
        x = np.array([measure.features(windows(t)) for t in texts_]).reshape(-1, len(self.mean))
        return (1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.w + self.b, -50, 50)))).tolist()


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, per_text: int = PER_TEXT) -> ToxicityModel:
    """Fit on at most `per_class` labelled texts of each class, by hash of the id, and `per_text` windows of each.

    Rows with a null id or label, and those with crc32(doc_id) mod 5 = 0, are not learned from.
    """
    rated = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0))
    rated = rated.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    counts = {r.toxic: r["count"] for r in rated.groupBy("toxic").count().collect()}
    picks = [rated.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({
                "doc_id": frame.doc_id, "toxic": frame.toxic, "parts": [evenly(windows(t), per_text) for t in frame.text]
            })

    # the picked ids are at most two times per_class
    sample = texts(docs).join(F.broadcast(picks[0].union(picks[1])), "doc_id").select("doc_id", "toxic", "text")
    rows = sample.mapInPandas(cut, "doc_id long, toxic int, parts array<binary>").toPandas().sort_values("doc_id")
    sides = [[list(p) for p in rows.parts[rows.toxic == c]] for c in (1, 0)]
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return ToxicityModel(*sides, share)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for each input row.

    A null text counts as empty; an empty text is one empty window. Repeated rows and null ids are scored like any
    other row, and an empty table gives no rows. The score depends on the text alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = None if model.constant is not None else Distances(model.ordinary, model.toxic)
        for batch in batches:
            found = [model.scores([t], measure)[0] for t in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(lean(run), "doc_id long, score double")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    out = score(docs, train(docs, table(spark, root, "labels")))
    return out.select(
        "doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
