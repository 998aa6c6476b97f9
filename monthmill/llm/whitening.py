"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

X holds the distinct vectors, centred. Each step multiplies it with a right vector (u = X v) and its transpose with
the result (X'u) in one pass over the stored rows; left vectors stay distributed, as each is X times a vector of the
length of a row, which the driver keeps. Both sides are orthogonalised against all earlier vectors. The singular
values and vectors of the small bidiagonal matrix give deviations and components. A pass sends back a few arrays as
long as a row, summed by tasks first; nothing that grows with the rows reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from monthmill.llm.common import lean, query, stored, table

SCALE, COMPONENTS, SUMS, SEED = 256, 4, 2, 20
TINY = float(np.finfo(np.float64).eps)


def scaled(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(key, x): floor(scale * entry) as longs; rows whose vector is null or holds null or non-finite entries go.

    Entries beyond the range of a long end at its bounds. Shorter vectors are filled up with zeros to the longest.
    """
    v = F.col(vector)
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    kept = rows.filter(v.isNotNull()).filter(~F.coalesce(odd, F.lit(False)))
    longs = stored(kept.select(
        F.col(key).alias("key"), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x")), "scaled")
    length = longs.agg(F.max(F.size("x"))).first()[0] or 0
    fill = F.array_repeat(F.lit(0).cast("long"), length - F.size("x"))
    return longs.withColumn("x", F.when(F.size("x") < length, F.concat("x", fill)).otherwise(F.col("x")))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def summed(rows: DataFrame, size: int, add: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The sum over all rows of `add`, which takes the vectors of a batch: once for each task, then in a few tasks."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += add(matrix(batch.column(0), d))
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["s"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += matrix(batch.column(0), size).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["s"])

    sums = rows.select("x").mapInArrow(part, "s array<double>").repartition(SUMS).mapInArrow(again, "s array<double>")
    return np.sum([np.zeros(size), *(np.array(r.s) for r in sums.collect())], axis=0)


def against(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """v without its parts along the others, twice."""
    for _ in range(2 if others else 0):
        basis = np.array(others)
        v = v - basis.T @ (basis @ v)
    return v


def fresh(rng: np.random.Generator, others: list[np.ndarray], d: int) -> np.ndarray:
    v = against(rng.standard_normal(d), others)
    return v / np.linalg.norm(v)


def bidiagonalise(
    product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]], d: int, total: float, want: int
) -> tuple[np.ndarray, np.ndarray]:
    """The `want` largest singular values of X and their right vectors, as columns.

    `product(c, v)` gives (Xc)'Xv, |Xv|^2 and X'Xv. Steps end after d of them, or as soon as the wanted triplets have
    converged and what is left of the total, the sum of all squared singular values, cannot hide a larger one. If a
    step breaks down, a new vector orthogonal to all earlier ones goes on; equal singular values are found so.
    """
    rng = np.random.default_rng(SEED)
    right, left, images = [], [], []  # v; u = X c by its c; X'u
    alpha, beta = [], []
    v = fresh(rng, [], d)
    while True:
        right.append(v)
        c = np.array(left).T.reshape(d, len(left))
        h, norm2, image = product(c, v)
        a2 = norm2 - h @ h
        a = np.sqrt(a2) if a2 > d * TINY * total else 0.0
        alpha.append(a)
        b = 0.0
        if a:
            left.append((v - c @ h) / a)
            images.append((image - (np.array(images).T @ h if images else 0.0)) / a)
            v = against(images[-1], right)
            b = float(np.linalg.norm(v))
        k = len(right)
        small = np.diag(alpha) + np.diag(beta, 1)
        p, s, qt = np.linalg.svd(small)
        if k == d:
            break
        broken = b <= d * TINY * np.sqrt(total)
        sure = k >= want and total - (s ** 2).sum() < s[want - 1] ** 2
        if sure and (broken or (b * np.abs(p[-1, :want]) <= 4 * TINY * s[0]).all()):
            break
        if broken:
            beta.append(0.0)
            v = fresh(rng, right, d)
        else:
            beta.append(b)
            v = v / b
    return s[:want], (np.array(right).T @ qt.T)[:, :want]


class Whitening:
    """Means, components, eigenvalues of the covariance and shares of its trace, from distinct vectors `x`."""

    def __init__(self, fit: DataFrame, components: int = COMPONENTS):
        sums = fit.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"))
        self.sums = [int(r.s) for r in sorted(sums.collect(), key=lambda r: r.at)]  # one for each dimension
        facts = fit.agg(F.count(F.lit(1)), F.max(F.array_max("x")), F.min(F.array_min("x"))).first()
        self.n, self.d, bounds = facts[0], len(self.sums), [int(facts[1] or 0), int(facts[2] or 0)]
        self.widest = max([0, *(abs(self.n * b - s) for b in bounds for s in self.sums)])
        n, d = self.n, self.d
        mean = self.mean = np.array([s / n for s in self.sums])
        self.components, self.e, self.explained, self.error = np.zeros((d, 0)), np.zeros(0), np.zeros(0), None
        if not n or not d:
            return
        total = float(summed(fit, 1, lambda x: np.array([((x - mean) ** 2).sum()]), d)[0])
        if not total:
            return

        def product(c: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
            k = c.shape[1]

            def add(x: np.ndarray) -> np.ndarray:
                x = x - mean
                u = x @ v
                return np.concatenate([(x @ c).T @ u, [u @ u], x.T @ u])

            out = summed(fit, k + 1 + d, add, d)
            return out[:k], float(out[k]), out[k + 1:]

        s, vectors = bidiagonalise(product, d, total, min(components, d))
        real = s ** 2 > n * d * TINY * s[0] ** 2
        s, vectors = s[real], vectors[:, real]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(s))])
        self.components, self.e, self.explained = vectors, s ** 2 / n, s ** 2 / total
        self.error = self.identity_error(fit)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.e)

    def identity_error(self, fit: DataFrame) -> float:
        """The largest absolute entry of the whitened vectors' covariance minus the identity."""
        k = len(self.e)

        def add(x: np.ndarray) -> np.ndarray:
            z = self.project(x)
            return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

        out = summed(fit, k + k * k, add, self.d)
        mean = out[:k] / self.n
        return float(np.abs(out[k:].reshape(k, k) / self.n - np.outer(mean, mean) - np.eye(k)).max())

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly; null beyond a long."""
        if self.d * self.widest ** 2 < 2 ** 63:
            return ((self.n * x - np.array(self.sums)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]
        return [t if t < 2 ** 63 else None for t in exact]


def whitened(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """One row per remaining input row and component, as the contract of op12 names them; `key` comes back as vec_id.

    Fitted on the distinct vectors, so copies do not weigh more. Rows that repeat a key, or have none, are rows of
    their own. Components whose eigenvalue is zero are left out: a table with one distinct vector, or none, gives no
    rows. Other input columns play no part.
    """
    all_ = stored(scaled(rows, key, vector, scale), "vectors")
    model = Whitening(stored(all_.select("x").distinct(), "fit"), components)
    k = len(model.e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch) or not k:
                continue
            x, each = matrix(batch.column(1), model.d), np.repeat(np.arange(len(batch)), k)
            many = len(each)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))),
                pa.array(np.full(many, model.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                pa.array(model.project(x).ravel()), pa.array(np.tile(model.explained, len(batch))),
                pa.array(np.full(many, model.error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = all_.schema["key"].dataType.simpleString()
    return all_.select("key", "x").mapInArrow(
        lean(run), f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


@query("op12_whitening")
def op12_whitening(spark, root):
    return whitened(table(spark, root, "embeddings"))
