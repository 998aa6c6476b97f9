"""Ordinal quality classifier: one score from hashed-text weights, ordered thresholds between the grades.

P(grade > k) = sigmoid(score - threshold k). The score is the mean over a text's tokens of a weight for the word and
one for its shape, plus weights for repetition; weights and thresholds are fitted together on graded texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from monthmill.llm.common import WORD, lean, query, remainder, table, texts, values

DIMS = 1 << 16
PER_GRADE = 3000  # bound of the training sample: texts of each grade
RIDGE, STEPS, RATE = 2e-6, 300, 0.3
CACHE = 300_000
_WORDS = re.compile(WORD)
_SHAPES = [(re.compile(r"[^\W\d_]+"), lambda m: "X" if m[0].isupper() and len(m[0]) > 1 else "x"),
           (re.compile(r"\d+"), "9"), (re.compile(r"([^\w\s])\1+"), r"\1\1")]


def slots(word: str) -> tuple[int, int]:
    """Places of a word's shape and of the word itself in the weights."""
    shape = word
    for pattern, to in _SHAPES:
        shape = pattern.sub(to, shape)
    return zlib.crc32(b"s" + shape[:24].encode()) % DIMS, zlib.crc32(b"w" + word.lower().encode()) % DIMS


def repetition(words: list[str]) -> list[tuple[int, float]]:
    """Features of the whole text: repeated neighbours, share of distinct words, and length, as hashed places."""
    n = len(words)
    if not n:
        return [(zlib.crc32(b"empty") % DIMS, 1.0)]
    distinct = len(set(words)) / n
    return [
        (zlib.crc32(b"again") % DIMS, sum(map(eq, words, words[1:])) / n),
        (zlib.crc32(b"distinct%d" % int(distinct * 10)) % DIMS, 0.3),
        (zlib.crc32(b"length%d" % min(12, n.bit_length())) % DIMS, 0.3),
    ]


def features(text: str) -> dict[int, float]:
    words = _WORDS.findall(text)
    out: Counter = Counter()
    for w, c in Counter(words).items():
        for s in slots(w):
            out[s] += c / len(words)
    for s, v in repetition(words):
        out[s] += v
    return dict(out)


class OrdinalModel:
    """Weights and ordered thresholds for grades 0 .. len(thresholds)."""

    def __init__(self, places: list[np.ndarray], weights: list[np.ndarray], grade: list[int], grades: int):
        """Feature places and values of each text, and its grade."""
        y, n = np.array(grade, dtype=np.int64), len(grade)
        owner = np.repeat(np.arange(n), [len(p) for p in places])
        at = np.concatenate([np.zeros(0, dtype=np.int32), *places]).astype(np.int64)
        value = np.concatenate([np.zeros(0), *weights])
        self.weights = np.zeros(DIMS)
        # start from the shares of the grades; a grade without rows keeps a narrow band
        share = np.cumsum(np.bincount(y, minlength=grades) + 0.5)[:-1] / (len(y) + 0.5 * grades)
        self.thresholds = np.log(share / (1 - share))
        first, gaps = self.thresholds[0], np.log(np.maximum(np.diff(self.thresholds), 1e-3))
        state = np.r_[self.weights, first, gaps]
        m, v = np.zeros_like(state), np.zeros_like(state)
        for step in range(1, STEPS * bool(n) + 1):
            w, first, gaps = state[:DIMS], state[DIMS], state[DIMS + 1:]
            cuts = first + np.r_[0.0, np.cumsum(np.exp(gaps))]
            low, high = np.r_[-np.inf, cuts], np.r_[cuts, np.inf]
            s = np.bincount(owner, weights=w[at] * value, minlength=n)
            a, b = 1 / (1 + np.exp(np.clip(s - high[y], -40, 40))), 1 / (1 + np.exp(np.clip(s - low[y], -40, 40)))
            p = np.maximum(a - b, 1e-12)
            da, db = a * (1 - a) / p, b * (1 - b) / p  # change of log p with the upper and lower threshold
            gs = (da - db) / n
            gc = (np.bincount(y, weights=-da, minlength=grades)[:-1] + np.bincount(y, weights=db, minlength=grades)[1:]) / n
            gg = np.array([gc[k + 1:].sum() * np.exp(gaps[k]) for k in range(len(gaps))])
            g = np.r_[np.bincount(at, weights=gs[owner] * value, minlength=DIMS) + RIDGE * w, gc.sum(), gg]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state = state - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.weights = state[:DIMS]
        self.thresholds = state[DIMS] + np.r_[0.0, np.cumsum(np.exp(state[DIMS + 1:]))]

    def scorer(self):
        """A function from texts to scores with a bounded cache of word weights."""
        known: dict[str, float] = {}

        def one(text: str) -> float:
            words = _WORDS.findall(text)
            fresh = {w for w in words if w not in known}
            if len(known) + len(fresh) > CACHE:
                known.clear()
                fresh = set(words)
            for w in fresh:
                known[w] = float(self.weights[list(slots(w))].sum())
            rest = sum(self.weights[s] * v for s, v in repetition(words))
            return (sum(map(known.__getitem__, words)) / len(words) if words else 0.0) + float(rest)

        return one

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def train(docs: DataFrame, ratings: DataFrame, grades: int, per_grade: int = PER_GRADE, held_out: Column | None = None) -> OrdinalModel:
    """Fit on at most `per_grade` rated texts of each grade, by hash of the id; ratings are (doc_id, grade).

    Null ids and grades, and rows for which `held_out` is true, are not learned from; of several ratings of a document
    the lowest counts.
    """
    rated = ratings.filter(F.col("doc_id").isNotNull() & F.col("grade").isNotNull())
    if held_out is not None:
        rated = rated.filter(~held_out)
    rated = rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    picks = rated.filter(F.lit(False))
    for g in range(grades):
        picks = picks.union(rated.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade))

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [features(t) for t in frame.text]
            yield pd.DataFrame({"doc_id": frame.doc_id, "grade": frame.grade, "at": [list(r) for r in rows],
                                "value": [list(r.values()) for r in rows]})

    # at most per_grade ids of each grade, and at most DIMS features of each text
    sample = texts(docs).join(F.broadcast(picks), "doc_id").select("doc_id", "grade", "text")
    rows = sample.mapInPandas(extract, "doc_id long, grade int, at array<int>, value array<double>").toPandas()
    rows = rows.sort_values("doc_id")
    return OrdinalModel(list(rows["at"]), list(rows["value"]), list(rows.grade), grades)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, expected_grade, tails) for each input row; tails[k] is P(grade > k).

    A null text counts as empty and has the weight of an empty text. Repeated rows and null ids are scored like any
    other row, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = model.scorer()
        for batch in batches:
            tails = model.tails(np.array([one(t) for t in values(batch.column(1))]).reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tails.sum(axis=1), pa.float64()), pa.array(tails.tolist(), pa.list_(pa.float64()))],
                ["doc_id", "expected_grade", "tails"],
            )

    return texts(docs).mapInArrow(lean(run), "doc_id long, expected_grade double, tails array<double>")


def select(docs: DataFrame, model: OrdinalModel, grade: int, least: float) -> DataFrame:
    """Whole rows, all columns as they are, of the texts with P(grade >= `grade`) of at least `least`."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = model.scorer()
        for batch in batches:
            scores = np.array([one(t or "") for t in values(batch.column(place))]).reshape(-1)
            yield batch.filter(pa.array(model.tails(scores)[:, grade - 1] >= least, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def graded(labels: DataFrame) -> DataFrame:
    """Grades from the two labels: 0 poor, 1 sound but toxic, 2 sound and clean; an unknown toxic label counts as clean."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1)
                         .when(F.col("quality") == 1, 2).cast("int").alias("grade"))


@query("op5_quality")
def op5_quality(spark: SparkSession, root: str) -> DataFrame:
    docs, held = table(spark, root, "documents"), remainder(F.col("doc_id")) == 0
    out = score(docs, train(docs, graded(table(spark, root, "labels")), 3, held_out=held))
    return out.select(
        "doc_id", held.alias("held_out"), "expected_grade", F.col("tails")[0].alias("p_sound"), F.col("tails")[1].alias("p_clean"),
        (F.col("tails")[0] >= 0.5).alias("selected"),
    )
