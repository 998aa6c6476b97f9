"""Pooled ridge regression for many folds at once, from sums of products.

Training sets of the folds of a horizon are nested in time, so each is a running sum of one matrix of products for
each stretch of target months. Imputing, standardising and flagging missing values are linear in the raw values and
their missing flags; they are applied to the summed matrices, not to the rows. The effect of a series, a penalised
column of its own, is eliminated from the sums of that series, so the system keeps 67 columns however many series
there are; a series' effect is worked out where its rows lie. Two passes over the stored samples serve all folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from monthmill.functions.periods import month_index
from monthmill.operators.pooled import FEATURES, MIN_TRAIN, RIDGE, issue_features, samples, with_target_calendar
from monthmill.operators.quantiles import exact_quantiles
from monthmill.session import cut_lineage

WIDTH = 1 + 2 * len(FEATURES)  # intercept, values, missing flags
Fold = tuple[int, int]  # horizon, target month as a number; trained on the targets before it


def future_rows(panel: DataFrame, keys: list[str], measure: str, issue, horizons: tuple[int, ...]) -> DataFrame:
    """The rows to be forecast from the issue month: no label yet."""
    base = issue_features(panel, keys, measure).filter(F.col("period") == F.lit(issue)).withColumnRenamed("period", "issue")
    ahead = F.explode(F.array(*[F.lit(h) for h in horizons]))
    return with_target_calendar(base.withColumn("horizon", ahead).withColumn("label", F.lit(None).cast("double")))


def design(panel: DataFrame, keys: list[str], measure: str, issue=None, horizons: tuple[int, ...] = tuple(range(1, 13))) -> DataFrame:
    """keys, sid, issue, target_period, horizon, t, x (the features), label; all rows of a series lie in one partition.

    Written once; with an issue month the unlabelled rows of the months after it are added. A series has at most
    calendar x horizons rows.
    """
    names = [*keys, "issue", "target_period", "label", *FEATURES]  # the horizon is a feature
    rows = samples(panel, keys, measure, horizons).select(*names)
    if issue is not None:
        rows = rows.unionByName(future_rows(panel, keys, measure, issue, horizons).select(*names))
    out = rows.select(
        *keys, F.to_json(F.struct(*keys)).alias("sid"), "issue", "target_period", "horizon", month_index(F.col("target_period")).alias("t"),
        F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("x"), F.col("label").cast("double").alias("label"),
    )
    return cut_lineage(out.repartition(*keys).sortWithinPartitions(*keys, "horizon", "t"))


def month_counts(rows: DataFrame) -> dict[int, list[tuple[int, int]]]:
    """Labelled rows of each horizon and target month; as many entries as the calendar has months."""
    counts = rows.filter(F.col("label").isNotNull()).groupBy("horizon", "t").agg(F.count(F.lit(1)).alias("n"))
    out: dict[int, list[tuple[int, int]]] = {}
    for r in counts.orderBy("horizon", "t").collect():
        out.setdefault(r["horizon"], []).append((r["t"], r["n"]))
    return out


def earlier(counts: dict[int, list[tuple[int, int]]], fold: Fold) -> int:
    return sum(n for t, n in counts.get(fold[0], []) if t < fold[1])


def last_folds(counts: dict[int, list[tuple[int, int]]], last: int, spare: int = 4) -> list[Fold]:
    """The last target months of each horizon, sparing the first four; four or fewer are all used. Enough rows must precede."""
    folds = []
    for h, entries in counts.items():
        take = min(last, max(0, len(entries) - spare)) or len(entries)
        folds += [(h, t) for t, _ in entries[-take:] if earlier(counts, (h, t)) >= MIN_TRAIN]
    return folds


def valid_folds(counts: dict[int, list[tuple[int, int]]], last: int) -> list[Fold]:
    """The last target months of each horizon among those that enough rows precede."""
    return [f for h, entries in counts.items() for f in [(h, t) for t, _ in entries if earlier(counts, (h, t)) >= MIN_TRAIN][-last:]]


def medians(rows: DataFrame, folds: list[Fold]) -> np.ndarray:
    """Median of every feature over the training rows of each fold; zero where there is none."""
    long = rows.filter(F.col("label").isNotNull()).select("horizon", "t", F.posexplode("x").alias("j", "v")).filter(F.col("v").isNotNull())
    counts = long.groupBy("horizon", "t", "j", "v").agg(F.count(F.lit(1)).alias("c"))
    table = rows.sparkSession.createDataFrame([(i, h, t) for i, (h, t) in enumerate(folds)], "fold int, horizon int, until int")
    member = counts.join(table, "horizon").filter(F.col("t") < F.col("until")).groupBy("fold", "j", "v").agg(F.sum("c").alias("c"))
    out = np.zeros((len(folds), len(FEATURES)))
    for r in exact_quantiles(cut_lineage(member), ["fold", "j"], "v", [0.5], weight="c").collect():  # folds x features
        out[r["fold"], r["j"]] = r["quantiles"][0]
    return out


def whole_series(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows cut where a series ends."""
    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        if not len(held):
            continue
        codes = held.column("sid").combine_chunks().dictionary_encode()
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
        cut = int(np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])[-1])
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and len(held):
        yield held


class Chunk:
    """Some whole series as arrays."""

    def __init__(self, table: pa.Table, centre: np.ndarray):
        get = lambda c: table.column(c).combine_chunks()
        x = get("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(table), len(FEATURES))
        missing = np.isnan(x)
        y = get("label").to_numpy(zero_copy_only=False).astype(float)
        self.known = ~np.isnan(y)
        self.r = np.column_stack([np.ones(len(x)), np.where(missing, 0.0, x - centre), missing.astype(float), np.where(self.known, y, 0.0)])
        self.h, self.t = get("horizon").to_numpy(), get("t").to_numpy()
        codes = get("sid").dictionary_encode().indices.to_numpy()
        self.starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        self.series = np.cumsum(np.r_[False, codes[1:] != codes[:-1]])

    def train(self, fold: Fold) -> np.ndarray:
        return self.known & (self.h == fold[0]) & (self.t < fold[1])

    def sums(self, fold: Fold) -> np.ndarray:
        """Training sums of each series: its rows, values, flags and label."""
        return np.add.reduceat(self.r * self.train(fold)[:, None], self.starts, axis=0)


def shrink(n: np.ndarray, total: int) -> np.ndarray:
    """1 / (rows + penalty) of a series' column; the penalty is that of the standardised column. Constant columns have no effect."""
    q = n / max(total, 1)
    penalty = RIDGE * q * (1 - q)
    return np.where(penalty > 1e-18, 1.0 / np.maximum(n + penalty, 1e-300), 0.0)


@dataclass
class Ridge:
    """All folds of one design; `weights` apply to (1, value - centre, missing flag)."""

    folds: list[Fold]
    sizes: list[int]
    centre: np.ndarray
    median: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    beta: np.ndarray
    weights: np.ndarray


def products(rows: DataFrame, folds: list[Fold], sizes: list[int], centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fold the summed products of its training rows, and the part of them that the series' effects take away."""
    width = WIDTH + 1
    stretches = {h: sorted({t for x, t in folds if x == h}) for h in {x for x, _ in folds}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(folds), width, width))
        for table in whole_series(batches):
            chunk = Chunk(table, centre)
            for i, fold in enumerate(folds):
                ends = stretches[fold[0]]
                before = ends[ends.index(fold[1]) - 1] if ends.index(fold[1]) else -1
                new = chunk.r[chunk.train(fold) & (chunk.t >= before)]  # what earlier folds of the horizon lack
                total[0, i] += new.T @ new
                own = chunk.sums(fold)
                total[1, i] += (own * shrink(own[:, 0], sizes[i])[:, None]).T @ own
        key = np.arange(2 * len(folds), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(list(total.reshape(2 * len(folds), -1)))], ["key", "s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            for k, v in zip(batch.column(0).to_pylist(), values):
                sums[k] = sums.get(k, 0.0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["key", "s"])

    schema = "key int, s array<double>"
    parts = rows.select("sid", "horizon", "t", "x", "label").mapInArrow(run, schema)
    out = np.zeros((2 * len(folds), width * width))
    for r in parts.repartition("key").mapInArrow(add, schema).collect():  # two matrices a fold
        out[r["key"]] = r["s"]
    gram, taken = out.reshape(2, len(folds), width, width)
    for h, ends in stretches.items():
        at = {t: i for i, (x, t) in enumerate(folds) if x == h}
        for a, b in zip(ends, ends[1:]):
            gram[at[b]] += gram[at[a]]
    return gram, taken


def fit(rows: DataFrame, folds: list[Fold], counts: dict[int, list[tuple[int, int]]]) -> Ridge:
    """Ridge with a free intercept on standardised values, missing flags and standardised series columns."""
    k = len(FEATURES)
    sizes = [earlier(counts, f) for f in folds]
    first = rows.agg(*[F.avg(F.col("x")[j]).alias(f"c{j}") for j in range(k)]).first()
    centre = np.array([c if c is not None else 0.0 for c in first])
    median = medians(rows, folds)
    gram, taken = products(rows, folds, sizes, centre)
    mean, std = np.zeros((len(folds), k)), np.ones((len(folds), k))
    beta, weights = np.zeros((len(folds), WIDTH)), np.zeros((len(folds), WIDTH))
    values, flags = np.arange(1, k + 1), np.arange(k + 1, WIDTH)
    for i in range(len(folds)):
        n, g = max(sizes[i], 1), gram[i]
        fill = median[i] - centre
        m = (g[0, values] + fill * g[0, flags]) / n
        square = (g[values, values] + fill ** 2 * g[0, flags]) / n
        spread = square - m ** 2
        flat = spread <= 1e-13 * np.maximum(square + centre ** 2, 1e-300)
        mean[i], std[i] = m + centre, np.where(flat | (spread < 1e-18), 1.0, np.sqrt(np.maximum(spread, 0.0)))
        # rows (1, value - centre, flag) to the columns (1, standardised value, flag)
        to = np.zeros((WIDTH, WIDTH))
        to[0, 0] = 1.0
        to[values, 0] = -m / std[i]
        to[values, values] = 1.0 / std[i]
        to[values, flags] = fill / std[i]
        to[flags, flags] = 1.0
        penalty = np.diag(np.r_[0.0, np.full(WIDTH - 1, RIDGE)])
        left = to @ (g - taken[i])[:WIDTH, :WIDTH] @ to.T + penalty
        right = to @ (g - taken[i])[:WIDTH, WIDTH]
        beta[i] = np.linalg.lstsq(left, right, rcond=None)[0]
        weights[i] = to.T @ beta[i]
    return Ridge(folds, sizes, centre, median, mean, std, beta, weights)


def effects(chunk: Chunk, model: Ridge, i: int) -> np.ndarray:
    """The effect of each series of a chunk in fold i; zero for a series without training rows."""
    own = chunk.sums(model.folds[i])
    return (own[:, WIDTH] - own[:, :WIDTH] @ model.weights[i]) * shrink(own[:, 0], model.sizes[i])


def predict(rows: DataFrame, model: Ridge, keys: list[str]) -> DataFrame:
    """keys, issue, target_period, horizon, actual (null if not yet known), pred: the rows of each fold's own month."""
    names = [*keys, "issue", "target_period", "horizon", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_series(batches):
            chunk = Chunk(table, model.centre)
            for i, fold in enumerate(model.folds):
                at = np.flatnonzero((chunk.h == fold[0]) & (chunk.t == fold[1]))
                if len(at):
                    value = chunk.r[at, :WIDTH] @ model.weights[i] + effects(chunk, model, i)[chunk.series[at]]
                    out = table.select(names).take(pa.array(at)).append_column("pred", pa.array(np.maximum(0.0, value)))
                    yield from out.combine_chunks().to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return rows.select("sid", "t", "x", *names).mapInArrow(run, f"{kinds}, pred double").withColumnRenamed("label", "actual")


def importance(rows: DataFrame, model: Ridge, keys: list[str]) -> DataFrame:
    """horizon, feature, importance: absolute standardised coefficients of features and series as shares of all columns."""
    k = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_series(batches):
            chunk = Chunk(table, model.centre)
            first = table.select(keys).take(pa.array(chunk.starts))
            for i, (h, _) in enumerate(model.folds):
                q = chunk.sums(model.folds[i])[:, 0] / max(model.sizes[i], 1)
                size = np.abs(effects(chunk, model, i)) * np.sqrt(np.maximum(q * (1 - q), 0.0))
                out = first.append_column("horizon", pa.array(np.full(len(size), h, dtype=np.int32))).append_column("w", pa.array(size))
                yield from out.combine_chunks().to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    series = rows.select("sid", "horizon", "t", "x", "label", *keys).mapInArrow(run, f"{kinds}, horizon int, w double")
    series = series.select("horizon", F.concat_ws("|", F.lit("product"), *keys).alias("feature"), "w")
    own = [(h, name, float(abs(model.beta[i, at]))) for i, (h, _) in enumerate(model.folds)
           for at, name in enumerate([*FEATURES, *[f"missing:{f}" for f in FEATURES]], start=1)]
    every = rows.sparkSession.createDataFrame(own, "horizon int, feature string, w double").unionByName(series)
    total = every.groupBy("horizon").agg(F.sum("w").alias("total"))
    shares = every.join(total, "horizon").select("horizon", "feature", F.coalesce(F.try_divide("w", "total"), F.lit(0.0)).alias("importance"))
    return shares.filter(~F.col("feature").startswith("missing:"))
