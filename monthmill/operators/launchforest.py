"""Cold-start forests: one small fit for each set of peers, scored with the other methods by leaving one peer out.

Groups of targets that have the same peers and age share a fit, at most twelve peers by twelve months. All fits of a
set run in the task that holds it; its forest travels as rows to the targets.
"""

from __future__ import annotations

import json
import statistics
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from monthmill.functions.numbers import rounded
from monthmill.operators.coldstart import MAX_AGE, MAX_BIAS_DETERIORATION, SCOPE, STEPS, select_peers, target_groups

# Trees, depth, least leaf, share of columns a node tries, quantiles it tries as cuts, seed.
TREES, DEPTH, LEAF, TRIED, CUTS, SEED = 12, 3, 5, 0.45, (0.33, 0.66), 20260919
METHODS = ("baseline", "analog", "ml_random_forest")
SHOWN = (1, 3, 6, 12)


def level(values: list[float]) -> float:
    return max(1.0, statistics.fmean(values[-3:]))


def features(prefix: list[float], age: int) -> np.ndarray:
    """One row for each month ahead: the month, the age, the last value and the move so far on the level of the prefix."""
    base = level(prefix) if prefix else 1.0
    last, move = (prefix[-1] / base if prefix else 0.0), ((prefix[-1] - prefix[0]) / base if len(prefix) > 1 else 0.0)
    return np.array([[h / 12, age / 5, last, move] for h in range(1, STEPS + 1)])


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = 0) -> list:
    """A tree as [value], or [column, cut, left, right]."""
    if depth == DEPTH or len(y) < 2 * LEAF or y.var() < 1e-9:
        return [float(y.mean())]
    best = None
    for column in rng.choice(x.shape[1], max(1, int(x.shape[1] * TRIED)), replace=False):
        for cut in np.unique(np.quantile(x[:, column], CUTS)):
            left = x[:, column] <= cut
            n = int(left.sum())
            if min(n, len(y) - n) >= LEAF:
                fit = y[left].sum() ** 2 / n + y[~left].sum() ** 2 / (len(y) - n)
                if best is None or fit > best[0]:
                    best = (fit, int(column), float(cut), left)
    if best is None:
        return [float(y.mean())]
    _, column, cut, left = best
    return [column, cut, grow(x[left], y[left], rng, depth + 1), grow(x[~left], y[~left], rng, depth + 1)]


def walk(tree: list, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    left = x[:, tree[0]] <= tree[1]
    return np.where(left, walk(tree[2], x), walk(tree[3], x))


def forest(peers: list[list[float]], age: int) -> list[list]:
    x = np.concatenate([features(p[:age], age) for p in peers])
    y = np.concatenate([np.array(p[age:age + STEPS]) / level(p[:age] if age else p[:3]) for p in peers])
    rng = np.random.default_rng(SEED)
    return [grow(x[at], y[at], rng) for at in (rng.integers(0, len(y), len(y)) for _ in range(TREES))]


def scale(peers: list[list[float]], prefix: list[float]) -> float:
    return level(prefix) if prefix else statistics.median(level(p[:3]) for p in peers)


def forest_paths(trees: list[list], prefixes: list[list[float]], age: int, on: list[float]) -> np.ndarray:
    """The paths of many targets of one age by one forest: every tree is walked once for all their months."""
    x = np.concatenate([features(p, age) for p in prefixes])
    mean = np.mean([walk(t, x) for t in trees], axis=0).reshape(len(prefixes), STEPS)
    return np.maximum(0.0, np.maximum(0.0, mean) * np.array(on)[:, None])


def predict(trees: list[list], prefix: list[float], age: int, on: float) -> np.ndarray:
    mean = np.mean([walk(t, features(prefix, age)) for t in trees], axis=0)
    return np.maximum(0.0, np.maximum(0.0, mean) * on)


def simple(peers: list[list[float]], prefix: list[float], method: str) -> np.ndarray:
    age = len(prefix)
    if not age:
        months = np.median([p[:STEPS] for p in peers], axis=0)
        return months if method == "analog" else np.full(STEPS, np.median([p[0] for p in peers]))
    ratios = np.mean([np.array(p[age:age + STEPS]) / level(p[:age]) for p in peers], axis=0)
    return level(prefix) * (ratios if method == "analog" else np.ones(STEPS))


def left_out(peers: list[list[float]], age: int, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Actual and predicted months of each peer, from the others."""
    actual, guess = [], []
    for i, held in enumerate(peers):
        others, prefix = peers[:i] + peers[i + 1:], held[:age]
        actual.append(held[age:age + STEPS])
        guess.append(simple(others, prefix, method) if method != METHODS[2] else predict(forest(others, age), prefix, age, scale(others, prefix)))
    return np.array(actual), np.array(guess)


def rates(actual: np.ndarray, guess: np.ndarray) -> tuple[float | None, float | None]:
    total = actual.sum()
    return (100 * np.abs(actual - guess).sum() / total, 100 * (guess - actual).sum() / total) if total > 0 else (None, None)


def peer_sets(targets: DataFrame, peers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups with the id of their set of peers, and the sets, each once: set_id, age, peers in order of their ids."""
    grouped = target_groups(targets.filter(F.size("values") <= MAX_AGE))
    picked = select_peers(grouped, peers)
    each = picked.groupBy("group_id", *SCOPE, "age").agg(F.sort_array(F.collect_list(F.struct("peer_id", "history"))).alias("peers")).filter(F.size("peers") >= 3)
    named = each.withColumn("set_id", F.sha2(F.concat_ws("|", *SCOPE, F.col("age").cast("string"), F.array_join(F.col("peers.peer_id"), ",")), 256))
    return named.select("group_id", "set_id"), named.groupBy("set_id").agg(F.first("age").alias("age"), F.first("peers").alias("peers"))


def scored(sets: DataFrame) -> DataFrame:
    """set_id, method, horizon (0 for all), wape, bias, and on the rows of horizon 0 of the forest its trees and the scale of new targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                peers = [p["history"] for p in row["peers"]]
                for method in METHODS:
                    actual, guess = left_out(peers, row["age"], method)
                    for h in (0, *SHOWN):
                        at = slice(None) if h == 0 else slice(h - 1, h)
                        wape, bias = rates(actual[:, at], guess[:, at])
                        own = h == 0 and method == METHODS[2]
                        out.append({
                            "set_id": row["set_id"], "method": method, "horizon": h, "wape": wape, "bias": bias,
                            "trees": json.dumps(forest(peers, row["age"])) if own else None, "new_scale": scale(peers, []) if own else None,
                            "curve": simple(peers, [1.0] * row["age"], method).tolist() if h == 0 and method != METHODS[2] else None,
                        })
            yield from pa.Table.from_pylist(out, KIND).to_batches()

    return sets.select("set_id", "age", "peers").mapInArrow(
        run, "set_id string, method string, horizon int, wape double, bias double, trees string, new_scale double, curve array<double>")


KIND = pa.schema([("set_id", pa.string()), ("method", pa.string()), ("horizon", pa.int32()), ("wape", pa.float64()), ("bias", pa.float64()),
                  ("trees", pa.string()), ("new_scale", pa.float64()), ("curve", pa.list_(pa.float64()))])


def choose(scores: DataFrame) -> DataFrame:
    """One row for each set: wape and bias of the three methods and the chosen one.

    A method is in the choice if its bias is at most five points worse than that of the flat level, and wins only with a
    lower error than the flat level.
    """
    whole = scores.filter("horizon = 0").groupBy("set_id").agg(
        *[F.max(F.when(F.col("method") == name, rounded(F.col(c), 2))).alias(f"{short}_{c}")
          for name, short in zip(METHODS, ("baseline", "analog", "ml")) for c in ("wape", "bias")],
        F.max("trees").alias("trees"), F.max("new_scale").alias("new_scale"),
        F.max(F.when(F.col("method") == "analog", F.col("curve"))).alias("analog_curve"), F.max(F.when(F.col("method") == "baseline", F.col("curve"))).alias("baseline_curve"),
    )
    fits = lambda m: F.abs(f"{m}_bias") <= F.abs("baseline_bias") + MAX_BIAS_DETERIORATION
    tried = F.array_min(F.array_compact(F.array(*[
        F.when(fits(m), F.struct(F.col(f"{m}_wape").alias("wape"), F.lit(i).alias("i"), F.lit(name).alias("name"))) for i, (m, name) in enumerate((("analog", METHODS[1]), ("ml", METHODS[2])))])))
    return whole.withColumn("_best", tried).withColumn(
        "model", F.when(F.col("_best.wape") < F.col("baseline_wape"), F.col("_best.name")).otherwise(METHODS[0])).drop("_best")


def launch(targets: DataFrame, peers: DataFrame, chosen: DataFrame, groups: DataFrame) -> DataFrame:
    """Twelve months of every target by the method chosen for its peers, on the target's own level.

    The targets of a set stand together, so that its forest is read and walked once for a batch of them.
    """
    rows = target_groups(targets.filter(F.size("values") <= MAX_AGE)).join(groups, "group_id")
    names = [*SCOPE, "part_id", "age", "model"]
    # a merge join leaves the targets of a set in one run, and only rows without forests are sorted
    wanted = rows.join(chosen.hint("merge"), "set_id").select(*names, "set_id", "values", "trees", "new_scale", "analog_curve", "baseline_curve")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = batch.select(names), [None] * batch.num_rows
            ids = batch.column("set_id").to_pylist()
            starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(ids)]):
                # what belongs to the set is read from its first row
                one = batch.slice(start, 1).select(["age", "model", "trees", "new_scale", "analog_curve", "baseline_curve"]).to_pylist()[0]
                prefixes = batch.column("values").slice(start, end - start).to_pylist()
                if one["model"] == METHODS[2]:
                    on = [level(p) if p else one["new_scale"] for p in prefixes]
                    out[start:end] = forest_paths(json.loads(one["trees"]), prefixes, one["age"], on).tolist()
                else:  # the curves are on a level of one
                    curve, on = np.array(one[f"{one['model']}_curve"]), np.array([level(p) if p else 1.0 for p in prefixes])
                    out[start:end] = (curve[None, :] * on[:, None]).tolist()
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(out, pa.list_(pa.float64()))], [*names, "path"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.select(*names).schema)
    return wanted.mapInArrow(run, f"{kinds}, path array<double>").select(*names, F.posexplode("path").alias("p", "forecast")).select(
        *names, (F.col("p") + 1).alias("step"), "forecast")
