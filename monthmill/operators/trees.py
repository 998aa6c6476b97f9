"""Pooled random forest and boosted stumps for many folds at once.

All trees of all folds grow together, one level or boosting round a pass. In a pass every task bins its rows and adds
up counts and label sums for each open node, feature and bin; the sums of a node meet in one task, which picks its
split, and only the chosen splits reach the driver. A series is a column of its own: as all its rows lie in one task,
a task sends the best series of a node and not one column each. Bin edges come from the rows before a horizon's first
fold, so nothing that a fold predicts reaches its trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from monthmill.operators.pooled import FEATURES, SEED
from monthmill.operators.ridge import Chunk, Fold, earlier, medians, whole_series

K = len(FEATURES)
COLUMNS = 2 * K  # values, then missing flags
BINS = 16
FOREST, BOOSTING = 0, 1
# Trees, depth, smallest leaf and share of columns tried, for the forest and for the stumps.
TREES, DEPTH, LEAF, TRIED = (12, 16), (3, 1), (5, 7), (0.45, 0.55)
RATE = 0.12
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(12)])
Key = tuple[int, int, int]  # family, fold, tree


@dataclass
class Node:
    n: float
    total: float
    column: int = -1  # -1: a leaf, COLUMNS: one series against the others
    cut: int = 0
    series: str | None = None
    gain: float = 0.0

    @property
    def value(self) -> float:
        return self.total / self.n if self.n else 0.0


@dataclass
class Trees:
    folds: list[Fold]
    median: np.ndarray
    cuts: dict[int, list[np.ndarray]]
    base: np.ndarray
    nodes: dict[Key, dict[int, Node]] = field(default_factory=dict)


def mixed(u: np.ndarray, k: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from row hashes and a number."""
    x = u + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def tried(key: Key, node: int) -> np.ndarray:
    """The columns a node may split on."""
    rng = np.random.default_rng([SEED, *key, node])
    return np.sort(rng.choice(COLUMNS, max(1, int(COLUMNS * TRIED[key[0]])), replace=False))


class Rows:
    """A chunk of whole series seen by one fold."""

    def __init__(self, chunk: Chunk, names: list[str], u: np.ndarray, model: Trees, i: int, at: np.ndarray):
        values, flags = chunk.r[at, 1:K + 1], chunk.r[at, K + 1:COLUMNS + 1]
        values = values + flags * model.median[i]
        cuts = model.cuts[model.folds[i][0]]
        self.bins = np.column_stack([np.searchsorted(c, values[:, j]) for j, c in enumerate(cuts)] + [flags.astype(int)]).astype(np.int64)
        self.y, self.u, self.series, self.names = chunk.r[at, -1], u[at], chunk.series[at], names
        self.model, self.fold = model, i

    def weights(self, key: Key) -> np.ndarray:
        """How often a row is drawn: a bootstrap for a tree of the forest, once for a stump."""
        return np.searchsorted(_POISSON, mixed(self.u, key[2]), side="right").astype(float) if key[0] == FOREST else np.ones(len(self.y))

    def reached(self, key: Key) -> np.ndarray:
        """The node each row falls into; children of node k are 2k and 2k + 1."""
        node = np.ones(len(self.y), dtype=np.int64)
        for k in sorted(self.model.nodes.get(key, {})):
            split = self.model.nodes[key][k]
            if split.column >= 0:
                at = np.flatnonzero(node == k)
                if split.column == COLUMNS:
                    own = self.names.index(split.series) if split.series in self.names else -1
                    right = self.series[at] == own
                else:
                    right = self.bins[at, split.column] > split.cut
                node[at] = 2 * k + right
        return node

    def values(self, key: Key) -> np.ndarray:
        node = self.reached(key)
        out = np.zeros(len(node))
        for k, split in self.model.nodes.get(key, {}).items():
            if split.column < 0:
                out[node == k] = split.value
        return out

    def predicted(self, family: int) -> np.ndarray:
        keys = [key for key in self.model.nodes if key[:2] == (family, self.fold)]
        if family == FOREST:
            return np.mean([self.values(key) for key in keys], axis=0) if keys else np.zeros(len(self.y))
        return self.model.base[self.fold] + RATE * sum((self.values(key) for key in keys), np.zeros(len(self.y)))


def open_nodes(model: Trees, step: int) -> dict[Key, list[int]]:
    """What grows in a pass: a level of every tree of the forest, and the next stump."""
    out: dict[Key, list[int]] = {}
    for key, nodes in model.nodes.items():
        family, _, tree = key
        if family == FOREST and step < DEPTH[FOREST]:
            level = [k for k in nodes if 2 ** step <= k < 2 ** (step + 1)]
        else:
            level = [1] if family == BOOSTING and tree == step else []
        level = [k for k in level if nodes[k].n >= 2 * LEAF[family]]
        if level:
            out[key] = level
    return out


COLUMNS_READ = ["sid", "horizon", "t", "x", "label"]


def read(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*COLUMNS_READ, F.xxhash64("sid", "horizon", "t").alias("u"), *more)


def seen(table: pa.Table) -> tuple[Chunk, list[str], np.ndarray]:
    chunk = Chunk(table, np.zeros(K))
    names = table.column("sid").combine_chunks().take(pa.array(chunk.starts)).to_pylist()
    return chunk, names, table.column("u").combine_chunks().to_numpy().view(np.uint64)


def totals(rows: DataFrame, model: Trees) -> dict[Key, tuple[float, float]]:
    """Rows and label sum of the root of every tree of the forest, and of each fold (as a stump's)."""
    keys = [(FOREST, i, k) for i in range(len(model.folds)) for k in range(TREES[FOREST])] + [(BOOSTING, i, 0) for i in range(len(model.folds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(keys)), np.zeros(len(keys))
        for table in whole_series(batches):
            chunk, _, u = seen(table)
            for at, (family, i, k) in enumerate(keys):
                own = chunk.train(model.folds[i])
                w = np.searchsorted(_POISSON, mixed(u[own], k), side="right") if family == FOREST else np.ones(own.sum())
                n[at] += w.sum()
                total[at] += (w * chunk.r[own, -1]).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys))), pa.array(n), pa.array(total)], ["at", "n", "total"])

    sums = read(rows).mapInArrow(run, "at long, n double, total double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return {keys[r["at"]]: (r["n"], r["total"]) for r in sums.collect()}  # one row for each tree


def gains(left_n, left_s, n: float, s: float, leaf: int):
    """What a split takes off the squared error; -1 where a side is too small."""
    right_n, right_s = n - left_n, s - left_s
    fits = (left_n >= leaf) & (right_n >= leaf)
    gain = left_s ** 2 / np.maximum(left_n, 1) + right_s ** 2 / np.maximum(right_n, 1) - s ** 2 / max(n, 1)
    return np.where(fits, gain, -1.0)


def splits(rows: DataFrame, model: Trees, step: int) -> list:
    """The best split of every node that is open in this pass."""
    jobs = [(key, k) for key, nodes in sorted(open_nodes(model, step).items()) for k in nodes]
    columns = {job: tried(*job) for job in jobs}
    schema = "job int, n array<double>, s array<double>, series string, gain double, series_n double, series_s double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {job: np.zeros((2, len(columns[job]) * BINS)) for job in jobs}
        best: dict = {}
        for table in whole_series(batches):
            chunk, names, u = seen(table)
            for i, fold in enumerate(model.folds):
                at = np.flatnonzero(chunk.train(fold))
                if not len(at):
                    continue
                part = Rows(chunk, names, u, model, i, at)
                residual = part.y - part.predicted(BOOSTING)
                for key in dict.fromkeys(key for key, _ in jobs if key[1] == i):
                    label = part.y if key[0] == FOREST else residual
                    weight, node = part.weights(key), part.reached(key)
                    for job in [(x, k) for x, k in jobs if x == key]:
                        here = np.flatnonzero((node == job[1]) & (weight > 0))
                        w, y, own = weight[here], label[here], columns[job]
                        place = (part.bins[np.ix_(here, own)] + np.arange(len(own)) * BINS).ravel()
                        sums[job][0] += np.bincount(place, np.repeat(w, len(own)), len(own) * BINS)
                        sums[job][1] += np.bincount(place, np.repeat(w * y, len(own)), len(own) * BINS)
                        n_series = np.bincount(part.series[here], w, len(names))
                        s_series = np.bincount(part.series[here], w * y, len(names))
                        root = model.nodes[key][job[1]]
                        gain = gains(n_series, s_series, root.n, root.total, LEAF[key[0]])
                        top = int(gain.argmax())
                        if gain[top] > best.get(job, (0.0,))[0]:
                            best[job] = (float(gain[top]), names[top], float(n_series[top]), float(s_series[top]))
        for at, job in enumerate(jobs):
            g, name, n, s = best.get(job, (0.0, None, 0.0, 0.0))
            yield pa.RecordBatch.from_arrays([
                pa.array([at], pa.int32()), pa.array([sums[job][0]]), pa.array([sums[job][1]]), pa.array([name], pa.string()),
                pa.array([g]), pa.array([n]), pa.array([s])], ["job", "n", "s", "series", "gain", "series_n", "series_s"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                held = sums.setdefault(r["job"], [0.0, 0.0, (0.0, "", 0.0, 0.0)])
                held[0], held[1] = held[0] + np.array(r["n"]), held[1] + np.array(r["s"])
                if r["series"] is not None and (-r["gain"], r["series"]) < (-held[2][0], held[2][1] or "~"):
                    held[2] = (r["gain"], r["series"], r["series_n"], r["series_s"])
        out = []
        for at, (n, s, series) in sums.items():
            key, k = jobs[at]
            root, own = model.nodes[key][k], columns[jobs[at]]
            left_n, left_s = (np.cumsum(v.reshape(len(own), BINS), axis=1)[:, :-1] for v in (n, s))
            gain = gains(left_n, left_s, root.n, root.total, LEAF[key[0]])
            j, cut = np.unravel_index(int(gain.argmax()), gain.shape)
            chosen = (float(gain[j, cut]), int(own[j]), int(cut), None, float(left_n[j, cut]), float(left_s[j, cut]))
            if series[0] > chosen[0]:
                chosen = (series[0], COLUMNS, 0, series[1], root.n - series[2], root.total - series[3])
            out.append({"job": at, **dict(zip(("gain", "column", "cut", "series", "left_n", "left_s"), chosen))})
        kinds = pa.schema([("job", pa.int32()), ("gain", pa.float64()), ("column", pa.int32()), ("cut", pa.int32()), ("series", pa.string()),
                           ("left_n", pa.float64()), ("left_s", pa.float64())])
        yield from pa.Table.from_pylist(out, kinds).to_batches()

    if not jobs:
        return []
    found = read(rows).mapInArrow(run, schema).repartition("job").mapInArrow(
        choose, "job int, gain double, column int, cut int, series string, left_n double, left_s double")
    return [(jobs[r["job"]], r) for r in found.collect()]  # one row for each open node


def edges(rows: DataFrame, folds: list[Fold]) -> dict[int, list[np.ndarray]]:
    """Bin edges of every feature and horizon; approximate quantiles of the rows before the horizon's first fold."""
    first = {h: min(t for x, t in folds if x == h) for h, _ in folds}
    table = rows.sparkSession.createDataFrame(sorted(first.items()), "horizon int, until int")
    shares = F.array(*[F.lit((i + 1) / BINS) for i in range(BINS - 1)])
    known = rows.filter(F.col("label").isNotNull()).join(F.broadcast(table), "horizon").filter(F.col("t") < F.col("until"))
    cuts = known.groupBy("horizon").agg(*[F.percentile_approx(F.col("x")[j], shares, 1000).alias(f"q{j}") for j in range(K)])
    out = {h: [np.zeros(0)] * K for h in first}
    for r in cuts.collect():
        out[r["horizon"]] = [np.unique(r[f"q{j}"]) if r[f"q{j}"] else np.zeros(0) for j in range(K)]
    return out


def fit(rows: DataFrame, folds: list[Fold], counts: dict, families: tuple[int, ...] = (FOREST, BOOSTING), median: np.ndarray | None = None) -> Trees:
    """Forest and stumps of every fold. `rows` is a `ridge.design`; folds without earlier rows predict zero."""
    folds = [f for f in folds if earlier(counts, f)]
    model = Trees(folds, medians(rows, folds) if median is None else median, edges(rows, folds), np.zeros(len(folds)))
    for (family, i, k), (n, total) in totals(rows, model).items():
        if family == FOREST and FOREST in families:
            model.nodes[FOREST, i, k] = {1: Node(n, total)}
        elif family == BOOSTING:
            model.base[i] = total / n if n else 0.0
            for stump in range(TREES[BOOSTING] if BOOSTING in families else 0):
                model.nodes[BOOSTING, i, stump] = {1: Node(n, 0.0)}  # residuals add up to zero after every round
    for step in range(max([DEPTH[FOREST]] * (FOREST in families) + [TREES[BOOSTING]] * (BOOSTING in families))):
        for (key, k), r in splits(rows, model, step):
            node = model.nodes[key][k]
            if r["gain"] > 1e-9:
                node.column, node.cut, node.series, node.gain = r["column"], r["cut"], r["series"], r["gain"]
                model.nodes[key][2 * k] = Node(r["left_n"], r["left_s"])
                model.nodes[key][2 * k + 1] = Node(node.n - r["left_n"], node.total - r["left_s"])
    return model


def predict(rows: DataFrame, model: Trees, keys: list[str], families: tuple[int, ...] = (FOREST, BOOSTING)) -> DataFrame:
    """keys, issue, target_period, horizon, actual, and forest and boosting: the rows of each fold's own month."""
    names = [*keys, "issue", "target_period", "horizon", "label"]
    wanted = [("forest", FOREST), ("boosting", BOOSTING)]
    wanted = [(n, f) for n, f in wanted if f in families]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_series(batches):
            chunk, series, u = seen(table)
            for i, fold in enumerate(model.folds):
                at = np.flatnonzero((chunk.h == fold[0]) & (chunk.t == fold[1]))
                if len(at):
                    part, out = Rows(chunk, series, u, model, i, at), table.select(names).take(pa.array(at))
                    for name, family in wanted:
                        out = out.append_column(name, pa.array(np.maximum(0.0, part.predicted(family))))
                    yield from out.combine_chunks().to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    more = [c for c in names if c not in COLUMNS_READ]
    return read(rows, *more).mapInArrow(run, f"{kinds}, {', '.join(f'{n} double' for n, _ in wanted)}").withColumnRenamed("label", "actual")


def importance(model: Trees, family: int) -> list[tuple[int, str, float]]:
    """(horizon, feature, share of all gains) of every column a fold's trees split on; missing flags are left out."""
    names = [*FEATURES, *[None] * K]
    out = []
    for i, (h, _) in enumerate(model.folds):
        gain: dict[str | None, float] = {}
        for key, nodes in model.nodes.items():
            for node in nodes.values() if key[:2] == (family, i) else ():
                if node.column >= 0:
                    name = f"series:{node.series}" if node.column == COLUMNS else names[node.column]
                    gain[name] = gain.get(name, 0.0) + node.gain
        whole = sum(gain.values())
        out += [(h, name, value / whole) for name, value in gain.items() if name is not None]
    return out
