"""The fourteen models on whole batches of series.

A batch is a matrix with one row per series and one column per month; a model's recurrence is one step over all rows
per month, and the forecasts of every origin are kept side by side. Backtest errors are added up where they arise, so
no row for a forecast step ever leaves a task: one row per series goes in, one comes out. The operations are those of
`models`, in the same order, so both give the same digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from monthmill.operators.models import INTERMITTENT_MODELS, MODEL_NAMES, REQUIREMENTS, STEPS

SLICE = 256  # series handled at a time: their paths stay within a few megabytes
HORIZONS = (1, 3, 6, 12)
FIRST = {1: 6, 3: 6, 6: 12, 12: 12}  # months of history before the first origin


def half_up(x: np.ndarray, digits: int = 2) -> np.ndarray:
    return np.floor(x * 10.0 ** digits + 0.5) / 10.0 ** digits


class Series:
    """Histories of different lengths, padded with zeros behind their end."""

    def __init__(self, values: pa.ListArray):
        self.n = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
        self.length = int(self.n.max(initial=1))
        self.v = np.zeros((len(self.n), self.length))
        self.v[np.arange(self.length) < self.n[:, None]] = flat
        self.origin = np.arange(1, self.length + 1)

    @cached_property
    def level(self) -> np.ndarray:
        out = self.v.copy()
        for t in range(1, self.length):
            out[:, t] = 0.35 * self.v[:, t] + (1 - 0.35) * out[:, t - 1]
        return out

    @cached_property
    def holt(self) -> tuple[np.ndarray, np.ndarray]:
        level, trend = self.v.copy(), np.zeros_like(self.v)
        if self.length > 1:
            trend[:, 0] = self.v[:, 1] - self.v[:, 0]
        for t in range(1, self.length):
            level[:, t] = 0.35 * self.v[:, t] + (1 - 0.35) * (level[:, t - 1] + trend[:, t - 1])
            trend[:, t] = 0.15 * (level[:, t] - level[:, t - 1]) + (1 - 0.15) * trend[:, t - 1]
        return level, trend

    @cached_property
    def seasonal(self) -> np.ndarray:
        """Additive Holt-Winters paths of all origins; missing below two full years."""
        out = np.full((len(self.n), self.length, STEPS), np.nan)
        if self.length < 24:
            return out
        first, second = (running(self.v[:, a:a + 12]) / 12 for a in (0, 12))
        level, trend, season = first.copy(), (second - first) / 12, self.v[:, :12] - first[:, None]
        for t in range(self.length):
            x, slot = self.v[:, t], t % 12
            new = 0.3 * (x - season[:, slot]) + (1 - 0.3) * (level + trend)
            trend = 0.1 * (new - level) + (1 - 0.1) * trend
            season[:, slot] = 0.2 * (x - new) + (1 - 0.2) * season[:, slot]
            level = new
            if t >= 23:
                for h in range(1, STEPS + 1):
                    out[:, t, h - 1] = level + trend * h + season[:, (t + h) % 12]
        out[self.n < 24] = np.nan
        return out

    @cached_property
    def demand(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether demand was seen, its size, interval and probability after each month."""
        shape = self.v.shape
        seen, size, interval, p = np.zeros(shape, dtype=bool), np.zeros(shape), np.zeros(shape), np.zeros(shape)
        s, z, i, g, q = np.zeros(shape[0], dtype=bool), np.zeros(shape[0]), np.zeros(shape[0]), np.ones(shape[0]), np.zeros(shape[0])
        for t in range(self.length):
            x, hit, at = self.v[:, t], self.v[:, t] > 0, float(t + 1)
            z = np.where(~s, np.where(hit, x, 0.0), np.where(hit, 0.1 * x + (1 - 0.1) * z, z))
            i = np.where(~s, np.where(hit, at, 0.0), np.where(hit, 0.1 * g + (1 - 0.1) * i, i))
            q = np.where(~s, np.where(hit, 1 / at, 0.0), 0.1 * hit + (1 - 0.1) * q)
            g = np.where(~s | hit, 1.0, g + 1)
            s = s | hit
            seen[:, t], size[:, t], interval[:, t], p[:, t] = s, z, i, q
        return seen, size, interval, p

    @cached_property
    def rate(self) -> np.ndarray:
        seen, size, interval, _ = self.demand
        return np.where(seen, size / np.maximum(interval, 1e-9), 0.0)

    @cached_property
    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.arange(self.length, dtype=float)
        return np.cumsum(self.v, axis=1), np.cumsum(x * self.v, axis=1), np.cumsum(x * x * self.v, axis=1)

    def flat(self, value: np.ndarray) -> np.ndarray:
        return np.repeat(value[:, :, None], STEPS, axis=2)

    def moving(self, width: int, step: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
        """Each forecast joins the window of the next one."""
        window = []
        for back in range(width - 1, -1, -1):
            lagged = np.zeros_like(self.v)
            lagged[:, back:] = self.v[:, :max(0, self.length - back)]
            window.append(lagged)
        out = []
        for _ in range(STEPS):
            out.append(step(window))
            window = [*window[1:], out[-1]]
        return np.stack(out, axis=2)

    def steps(self) -> np.ndarray:
        return np.arange(1, STEPS + 1, dtype=float)

    def linear(self) -> np.ndarray:
        sy, sxy, _ = self.sums
        n = self.origin.astype(float)
        sx, sxx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = (n * sxy - sx * sy) / (n * sxx - sx * sx)
        return ((sy - slope * sx) / n)[:, :, None] + slope[:, :, None] * (n[:, None] + self.steps() - 1)

    def quadratic(self) -> np.ndarray:
        sy, sxy, sxxy = self.sums
        n = self.origin.astype(float)
        s1, s2 = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
        s3 = s1 * s1
        s4 = (n - 1) * n * (2 * n - 1) * (3 * n * n - 3 * n - 1) / 30
        with np.errstate(divide="ignore", invalid="ignore"):
            det = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)
            a = (sy * (s2 * s4 - s3 * s3) - s1 * (sxy * s4 - s3 * sxxy) + s2 * (sxy * s3 - s2 * sxxy)) / det
            b = (n * (sxy * s4 - s3 * sxxy) - sy * (s1 * s4 - s3 * s2) + s2 * (s1 * sxxy - sxy * s2)) / det
            c = (n * (s2 * sxxy - sxy * s3) - s1 * (s1 * sxxy - sxy * s2) + sy * (s1 * s3 - s2 * s2)) / det
        x = n[:, None] + self.steps() - 1
        return a[:, :, None] + b[:, :, None] * x + c[:, :, None] * x * x

    def yearly(self) -> np.ndarray:
        out = np.full((len(self.n), self.length, STEPS), np.nan)
        for h in range(1, STEPS + 1):
            back = 12 - h  # the same month a year before
            out[:, back:, h - 1] = self.v[:, :max(0, self.length - back)]
        return out

    def paths(self, model: str) -> np.ndarray:
        """Twelve raw steps from every origin, (series, origin - 1, step - 1); missing where the history is too short."""
        mean = lambda w: running(np.stack(w, axis=1)) / float(len(w))
        out = {
            "Naive": lambda: self.flat(self.v), "Naive estacional": self.yearly,
            "Media móvil 3": lambda: self.moving(3, mean), "Media móvil 6": lambda: self.moving(6, mean),
            "Media móvil 12": lambda: self.moving(12, mean),
            "Media móvil ponderada": lambda: self.moving(3, lambda w: 0.2 * w[0] + 0.3 * w[1] + 0.5 * w[2]),
            "SES": lambda: self.flat(self.level),
            "Holt": lambda: self.holt[0][:, :, None] + self.holt[1][:, :, None] * self.steps(),
            "Holt-Winters": lambda: self.seasonal.copy(),
            "Tendencia lineal": self.linear, "Tendencia polinómica": self.quadratic,
            "Croston": lambda: self.flat(self.rate), "SBA": lambda: self.flat(self.rate * 0.95),
            "TSB": lambda: self.flat(np.where(self.demand[0], self.demand[3] * self.demand[1], 0.0)),
        }[model]()
        out[:, self.origin < REQUIREMENTS[model]] = np.nan
        out[self.origin > self.n[:, None]] = np.nan
        return out

    @cached_property
    def ahead(self) -> np.ndarray:
        """The months after each origin; missing behind the end."""
        out = np.full((len(self.n), self.length, STEPS), np.nan)
        for h in range(1, STEPS + 1):
            out[:, :max(0, self.length - h), h - 1] = self.v[:, h:]
        out[self.origin[:, None] + np.arange(1, STEPS + 1) > self.n[:, None, None]] = np.nan
        return out

    def backtest(self, paths: np.ndarray) -> dict[int, dict[str, np.ndarray]]:
        """Error metrics of every horizon; all steps up to it count, from the origins that have them all."""
        known = ~np.isnan(self.ahead) & ~np.isnan(paths)
        pred = half_up(np.maximum(0.0, np.where(known, paths, 0.0)))
        actual = np.where(known, self.ahead, 0.0)
        error = actual - pred
        cell, size = np.floor(error * 1e4 + 0.5), np.abs(error)
        out = {}
        for h in HORIZONS:
            use = (self.origin >= FIRST[h]) & (self.origin + h <= self.n[:, None]) & ~np.isnan(paths[:, :, 0])
            k = use[:, :, None]
            total = lambda x: np.where(k, x[:, :, :h], 0.0).sum(axis=(1, 2))  # noqa: B023, E731
            origins = use.sum(axis=1)
            count = np.maximum(origins * h, 1)
            a = total(actual)
            with np.errstate(divide="ignore", invalid="ignore"):
                wape = np.where(a != 0, 100 * (total(np.abs(cell)) / 1e4) / a, np.where(total(np.abs(pred)) == 0, 0.0, 999.0))
                bias = np.where(a != 0, 100 * (total(cell) / 1e4) / a, 0.0)
            mean = total(size) / count
            spread = np.sqrt(total((size - mean[:, None, None]) ** 2) / count)
            base = np.where(a != 0, a / count, 1.0)
            out[h] = {
                "origins": origins, "wape": half_up(wape), "bias": half_up(bias), "stability": half_up(100 * spread / base),
                "mae": half_up(total(np.abs(cell)) / 1e4 / count), "rmse": half_up(np.sqrt(total(error * error) / count)), "observations": origins * h,
            }
        return out

    def weighted(self, tested: dict[int, dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        """Averages of the horizons' metrics by number of origins, and the controlled score; missing without origins."""
        origins = sum(t["origins"] for t in tested.values())
        out = {"origins": origins}
        with np.errstate(divide="ignore", invalid="ignore"):
            for name in ("wape", "bias", "stability"):
                # a horizon without origins weighs nothing
                whole = sum(np.where(t["origins"] > 0, np.floor(t[name] * 100.0 + 0.5) * t["origins"], 0.0) for t in tested.values())
                out[name] = np.floor(whole / origins + 0.5) / 100.0
        score = half_up(out["wape"] + np.abs(out["bias"]) * 0.25 + out["stability"] * 0.15)
        out["score"] = np.where(origins > 0, score, np.nan)
        return out


def running(x: np.ndarray) -> np.ndarray:
    """Sums along the second axis, added from left to right."""
    out = np.zeros_like(x[:, 0])
    for k in range(x.shape[1]):
        out = out + x[:, k]
    return out


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(batch), SLICE):
        yield batch.slice(at, SLICE)


def schema_of(rows: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema)


TESTED = "model string, horizon int, origins long, wape double, bias double, stability double, mae double, rmse double, observations long"


def backtest(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, model, horizon and the metrics of every model with an origin; one row per series leaves the kernel."""
    names = ["origins", "wape", "bias", "stability", "mae", "rmse", "observations"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            s = Series(part.column(len(keys)))
            rows: list[list[dict]] = [[] for _ in s.n]
            for model in MODEL_NAMES:
                for h, t in s.backtest(s.paths(model)).items():
                    for i in np.flatnonzero(t["origins"]):
                        rows[i].append({"model": model, "horizon": h, **{n: t[n][i].item() for n in names}})
            kind = pa.list_(pa.struct([("model", pa.string()), ("horizon", pa.int32())] + [
                (n, pa.int64() if n in ("origins", "observations") else pa.float64()) for n in names]))
            yield pa.RecordBatch.from_arrays([*part.columns[:len(keys)], pa.array(rows, kind)], [*keys, "tested"])

    out = series.select(*keys, "values").mapInArrow(run, f"{schema_of(series, keys)}, tested array<struct<{struct(TESTED)}>>")
    return out.selectExpr(*[f"`{k}`" for k in keys], "inline(tested)")


def one_step(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, model, period, actual, pred: every model one month ahead, from the sixth month on."""
    columns = [*keys, "periods", "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            s, k = Series(part.column(len(columns) - 1)), len(keys)
            rows: list[list[dict]] = [[] for _ in s.n]
            for model in MODEL_NAMES:
                pred = half_up(np.maximum(0.0, s.paths(model)[:, :, 0]))
                for i, n in enumerate(s.n):
                    own = pred[i, FIRST[1] - 1:n - 1]
                    if len(own) and not np.isnan(own[-1]):
                        rows[i].append({"model": model, "pred": [None if np.isnan(x) else x for x in own.tolist()]})
            kind = pa.list_(pa.struct([("model", pa.string()), ("pred", pa.list_(pa.float64()))]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], [*columns, "models"])

    out = series.select(*columns).mapInArrow(run, f"{schema_of(series, columns)}, models array<struct<model: string, pred: array<double>>>")
    named = [f"`{k}`" for k in keys]
    first = FIRST[1]
    return out.selectExpr(*named, "periods", "`values`", "inline(models)").selectExpr(
        *named, "model", f"inline(arrays_zip(slice(periods, {first + 1}, size(pred)), slice(`values`, {first + 1}, size(pred)), pred)) as (period, actual, pred)"
    ).filter("pred is not null")


def struct(fields: str) -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in fields.split(", "))


RUN = {
    "winner": "string", "wape": "double", "bias": "double", "stability": "double", "score": "double",
    "comparisons": "array<struct<model: string, wape: double, bias: double, stability: double, score: double, origins: bigint>>",
    "forecast": "array<double>", "history": "array<double>",
}


def run(series: DataFrame, keys: list[str], intermittent: str) -> DataFrame:
    """keys and, for every series, the winner with its metrics, all models that could be tested, the winner's twelve
    months, and its one-step history from the sixth month on. `intermittent` names a boolean column.

    The lowest score wins, then the earlier model. A series without an origin has no winner.
    """
    columns = [*keys, intermittent, "values"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            s, k = Series(part.column(len(columns) - 1)), len(keys)
            sparse = part.column(k).to_numpy(zero_copy_only=False).astype(bool)
            scores, figures, paths = [], [], []
            for model in MODEL_NAMES:
                path = s.paths(model)
                tested = s.weighted(s.backtest(path))
                allowed = np.ones(len(s.n), dtype=bool) if model in INTERMITTENT_MODELS else ~sparse
                scores.append(np.where(allowed, tested["score"], np.nan))
                figures.append(tested)
                paths.append((path[np.arange(len(s.n)), s.n - 1], path[:, :, 0]))  # the last origin; the first step
            scores = np.array(scores)
            best = np.where(np.isnan(scores), np.inf, scores).argmin(axis=0)
            rows = []
            for i, b in enumerate(best):
                if np.isnan(scores[b, i]):
                    rows.append(dict.fromkeys(RUN))
                    continue
                of = lambda m: {n: figures[m][n][i].item() for n in ("wape", "bias", "stability", "score")}  # noqa: B023, E731
                rows.append({
                    "winner": MODEL_NAMES[b], **of(b),
                    "comparisons": [{"model": MODEL_NAMES[m], **of(m), "origins": figures[m]["origins"][i].item()} for m in np.flatnonzero(~np.isnan(scores[:, i]))],
                    "forecast": half_up(np.maximum(0.0, paths[b][0][i])).tolist(),
                    "history": [None if np.isnan(x) else half_up(np.maximum(0.0, x)).item() for x in paths[b][1][i, 5:s.n[i] - 1]],
                })
            kinds = [pa.string()] + [pa.float64()] * 4 + [
                pa.list_(pa.struct([("model", pa.string())] + [(n, pa.float64()) for n in ("wape", "bias", "stability", "score")] + [("origins", pa.int64())])),
                pa.list_(pa.float64()), pa.list_(pa.float64())]
            made = [pa.array([r[n] for r in rows], t) for n, t in zip(RUN, kinds)]
            yield pa.RecordBatch.from_arrays([*part.columns[:k], *made], [*keys, *RUN])

    kinds = ", ".join(f"{n} {t}" for n, t in RUN.items())
    return series.select(*columns).mapInArrow(task, f"{schema_of(series, keys)}, {kinds}")


def every_path(series: DataFrame, keys: list[str], model: str) -> DataFrame:
    """keys, months, origin, model, path: the model that the column `model` names, from every origin of its series.

    Where the history is too short for it, or no model is named, the last value.
    """
    columns = [*keys, model, "periods", "values"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            s, wanted = Series(part.column(len(columns) - 1)), part.column(len(keys)).to_pylist()
            naive = s.paths("Naive")
            held, used = naive.copy(), np.full(naive.shape[:2], "Naive", dtype=object)
            for name in set(wanted) - {None, "Naive"}:
                own = np.array([w == name for w in wanted])
                path = s.paths(name)
                fits = own[:, None] & ~np.isnan(path[:, :, 0])
                held[fits], used[fits] = path[fits], name
            at = np.arange(s.length) < s.n[:, None]
            row, origin = np.nonzero(at)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * STEPS, pa.int32()), pa.array(held[at].ravel()))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(i).take(pa.array(row)) for i in range(len(keys))], part.column(len(keys) + 1).take(pa.array(row)),
                 pa.array((origin + 1).astype(np.int32)), pa.array(used[at].tolist(), pa.string()), flat],
                [*keys, "months", "origin", "model", "path"])

    kinds = f"{schema_of(series, keys)}, months array<date>, origin int, model string, path array<double>"
    return series.select(*columns).mapInArrow(task, kinds)
