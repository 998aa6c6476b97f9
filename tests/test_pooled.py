"""Ridge and trees of many folds against plain fits, and the aligned records against loops."""

import datetime as dt
import json
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthmill.operators import pooled as po, records as rec, ridge as ri, selection as sel, trees as tr

KEYS = ["chain_id", "product_id"]
MONTHS = [dt.date(2020 + i // 12, i % 12 + 1, 1) for i in range(40)]
ISSUE = MONTHS[-1]


def panel(spark, series=6, months=30, seed=3, gaps=True):
    """The last `months` months; some values missing, one series of zeros, one that starts late."""
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(series):
        first = 40 - months + (7 if p == 1 else 0)
        for i in range(first, 40):
            v = 0.0 if p == 2 else float(20 + 9 * (p % 7) + 6 * math.sin(i / 2 + p) + round(rng.normal(0, 4)))
            if gaps and (i * 7 + p) % 11 == 0 and i < 39:
                v = None
            rows.append(("c" if p % 2 else "d", f"p{p}", i - first + 1, MONTHS[i], None if v is None else max(0.0, round(v, 1))))
    return spark.createDataFrame(rows, "chain_id string, product_id string, idx int, period date, sales double")


def collected(rows):
    """(sid, horizon, t) to (features, label)."""
    return {(r.sid, r.horizon, r.t): (np.array([np.nan if v is None else v for v in r.x]), r.label) for r in rows.collect()}


def plain_ridge(data, fold):
    """Standardised columns of features, flags and series, and the pseudo-inverse."""
    h, until = fold
    train = sorted((k, v) for k, v in data.items() if k[1] == h and k[2] < until and v[1] is not None)
    test = sorted((k, v) for k, v in data.items() if k[1] == h and k[2] == until)
    names = sorted({k[0] for k in data})
    one = lambda k: [float(k[0] == n) for n in names]
    x = np.array([np.r_[v[0], one(k)] for k, v in train])
    med = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in x.T])
    filled = np.where(np.isnan(x), med, x)
    mean, std = filled.mean(axis=0), filled.std(axis=0)
    std = np.where(std < 1e-9, 1.0, std)

    def prepared(rows):
        return np.column_stack([np.ones(len(rows)), (np.where(np.isnan(rows), med, rows) - mean) / std, np.isnan(rows).astype(float)])

    d, y = prepared(x), np.array([v[1] for _, v in train])
    penalty = np.eye(d.shape[1]) * po.RIDGE
    penalty[0, 0] = 0
    coef = np.linalg.pinv(d.T @ d + penalty) @ d.T @ y
    want = {k: max(0.0, float(p)) for (k, _), p in zip(test, prepared(np.array([np.r_[v[0], one(k)] for k, v in test])) @ coef)}
    size = np.abs(coef[1:])
    return want, dict(zip([*po.FEATURES, *names], (size / size.sum())[:len(po.FEATURES) + len(names)]))


def predicted(rows, model):
    out = {}
    for r in ri.predict(rows, model, KEYS).collect():
        sid = json.dumps({"chain_id": r.chain_id, "product_id": r.product_id}, separators=(",", ":"))
        out[sid, r.horizon, r.target_period.year * 12 + r.target_period.month - 1] = r.pred
    return out


def test_ridge_of_every_fold_equals_the_plain_fit(spark):
    rows = ri.design(panel(spark), KEYS, "sales", ISSUE)
    counts, data = ri.month_counts(rows), collected(rows)
    last = ISSUE.year * 12 + ISSUE.month - 1
    folds = [(1, last - 2), (1, last - 1), (1, last), (3, last), (12, last), (1, last + 1), (5, last + 5)]
    model = ri.fit(rows, folds, counts)
    got = predicted(rows, model)
    want = {}
    for fold in folds:
        want |= plain_ridge(data, fold)[0]
    assert set(got) == set(want) and len(got) >= 6 * len(folds) - 8
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-6)


def test_ridge_importance_equals_the_plain_fit(spark):
    rows = ri.design(panel(spark), KEYS, "sales", ISSUE)
    fold = (2, ISSUE.year * 12 + ISSUE.month + 1)
    want = plain_ridge(collected(rows), fold)[1]
    model = ri.fit(rows, [fold], ri.month_counts(rows))
    got = {r.feature: r.importance for r in ri.importance(rows, model, KEYS).collect()}
    for name, share in want.items():
        key = name if name in po.FEATURES else "product|" + "|".join(json.loads(name).values())
        assert got[key] == pytest.approx(share, abs=1e-7)
    assert len(got) == len(want)


def test_ridge_of_many_series_keeps_its_width(spark):
    """A series adds rows, never a column: the system and what reaches the driver stay the same."""
    rows = ri.design(panel(spark, series=1500, months=16, gaps=False), KEYS, "sales", ISSUE, (1,))
    counts = ri.month_counts(rows)
    fold = (1, ISSUE.year * 12 + ISSUE.month - 1)
    model = ri.fit(rows, [fold], counts)
    assert model.weights.shape == (1, ri.WIDTH) and model.sizes[0] > 15000
    plan = ri.predict(rows, model, KEYS)._jdf.queryExecution().toString()
    assert "product_id#" in plan and "p1499" not in plan
    # the effect of a series is its shrunken mean residual
    data, got = collected(rows), predicted(rows, model)
    c = model.centre
    r = lambda x: np.r_[1.0, np.where(np.isnan(x), 0.0, x - c), np.isnan(x)]
    for sid in sorted({k[0] for k in data})[::300]:
        own = [v for k, v in data.items() if k[0] == sid and k[2] < fold[1] and v[1] is not None]
        q = len(own) / model.sizes[0]
        effect = sum(y - r(x) @ model.weights[0] for x, y in own) / (len(own) + po.RIDGE * q * (1 - q))
        assert got[sid, *fold] == pytest.approx(max(0.0, r(data[sid, *fold][0]) @ model.weights[0] + effect), abs=1e-6)


def test_folds_of_the_design_never_see_the_future(spark):
    base = panel(spark)
    changed = base.withColumn("sales", F.when((F.col("period") >= F.lit(MONTHS[38])) & F.col("sales").isNotNull(), 999.0).otherwise(F.col("sales")))
    fold = (1, MONTHS[38].year * 12 + MONTHS[38].month - 1)
    ridge, forest = [], []
    for p in (base, changed):
        rows = ri.design(p, KEYS, "sales", None, (1,))
        counts = ri.month_counts(rows)
        ridge.append(predicted(rows, ri.fit(rows, [fold], counts)))
        out = tr.predict(rows, tr.fit(rows, [fold], counts), KEYS).collect()
        forest.append({r.product_id: (r.forest, r.boosting) for r in out})
    assert ridge[0] == pytest.approx(ridge[1]) and len(ridge[0]) == 6
    assert forest[0] == forest[1] and len(forest[0]) == 6


def test_folds_follow_the_rules():
    counts = {1: [(t, 6) for t in range(10)], 2: [(5, 30), (6, 3), (7, 3)]}
    assert ri.last_folds(counts, 2) == [(1, 8), (1, 9), (2, 6), (2, 7)]  # four or fewer months are all used, if 18 rows precede
    assert ri.valid_folds(counts, 3) == [(1, 7), (1, 8), (1, 9), (2, 6), (2, 7)]
    assert ri.valid_folds({1: [(1, 10), (2, 7)]}, 3) == []


# Trees ---------------------------------------------------------------------------------------

def grown(spark, folds_at=(0, 1)):
    rows = ri.design(panel(spark), KEYS, "sales", ISSUE, (1, 2))
    last = ISSUE.year * 12 + ISSUE.month - 1
    folds = [(1, last - 1), (1, last), (2, last)]
    return rows, folds, tr.fit(rows, folds, ri.month_counts(rows))


def test_every_split_is_the_best_of_its_node(spark):
    rows, folds, model = grown(spark)
    hashes = {(r.sid, r.horizon, r.t): r.u for r in tr.read(rows).select("sid", "horizon", "t", "u").collect()}
    data = collected(rows)
    names = sorted({k[0] for k in data})
    for i, (h, until) in enumerate(folds):
        train = sorted((k, v) for k, v in data.items() if k[1] == h and k[2] < until and v[1] is not None)
        x = np.array([v[0] for _, v in train])
        y, missing = np.array([v[1] for _, v in train]), np.isnan(x)
        columns = np.column_stack([np.where(missing, model.median[i], x), missing.astype(float)])
        u = np.array([hashes[k] for k, _ in train]).view(np.uint64)
        sid = np.array([names.index(k[0]) for k, _ in train])
        residual = y - y.mean()
        for key in sorted(k for k in model.nodes if k[1] == i):
            family, _, tree = key
            w = np.searchsorted(tr._POISSON, tr.mixed(u, tree), side="right").astype(float) if family == tr.FOREST else np.ones(len(y))
            label = y if family == tr.FOREST else residual
            node, leaf = np.ones(len(y), dtype=int), tr.LEAF[family]
            for k in sorted(model.nodes[key]):
                at = node == k
                n, total = w[at].sum(), (w * label)[at].sum()
                own = model.nodes[key][k]
                assert own.n == pytest.approx(n) and own.total == pytest.approx(total, abs=1e-6)
                if k >= 2 ** tr.DEPTH[family]:
                    continue
                choices = {}
                for j in tr.tried(key, k):
                    edges = model.cuts[h][j] if j < tr.K else [0.5]
                    for b, cut in enumerate(edges):
                        choices[int(j), b, None] = columns[:, j] <= cut
                for s, name in enumerate(names):
                    choices[tr.COLUMNS, 0, name] = sid != s
                gain = {}
                for c, left in choices.items():
                    a, b = at & left, at & ~left
                    if w[a].sum() >= leaf and w[b].sum() >= leaf:
                        gain[c] = (w * label)[a].sum() ** 2 / w[a].sum() + (w * label)[b].sum() ** 2 / w[b].sum() - total ** 2 / n
                best = max(gain.values(), default=0.0)
                if own.column < 0:
                    assert best <= 1e-6 or n < 2 * leaf
                    continue
                assert own.gain == pytest.approx(best, rel=1e-6)
                node[at & ~choices[own.column, own.cut, own.series]] = 2 * k + 1
                node[at & choices[own.column, own.cut, own.series]] = 2 * k
            if family == tr.BOOSTING:
                for k, own in model.nodes[key].items():
                    if own.column < 0:
                        residual = residual - tr.RATE * np.where(node == k, own.value, 0.0)


def test_tree_predictions_are_bounded_means(spark):
    rows, folds, model = grown(spark)
    out = tr.predict(rows, model, KEYS).collect()
    assert len(out) >= 15 and all(r.forest >= 0 and r.boosting >= 0 for r in out)
    labels = [v[1] for v in collected(rows).values() if v[1] is not None]
    assert max(r.forest for r in out) <= max(labels)
    zero = [r for r in out if r.product_id == "p2"]
    others = [r for r in out if r.product_id != "p2"]
    assert statistics.mean(r.forest for r in zero) < statistics.mean(r.forest for r in others) / 2


# Records -------------------------------------------------------------------------------------

def test_records_hold_what_was_known(spark):
    from monthmill.operators import backtest as bt, series as sr

    monthly = panel(spark).select(*KEYS, "period", "sales")
    values = sr.observed_values(monthly, KEYS, "sales")
    total = rec.total_values(monthly, ISSUE)
    pooled = monthly.filter("sales is not null").select(
        *KEYS, F.add_months("period", -2).alias("issue"), F.col("period").alias("target_period"), F.lit(2).alias("horizon"),
        F.col("sales").alias("actual"), (F.col("sales") * 2).alias("ml"))
    out = rec.aligned_records(pooled, values, total, ["ml"], ISSUE).collect()
    known = {}
    for r in monthly.filter("sales is not null").collect():
        known.setdefault((r.chain_id, r.product_id), {})[r.period] = r.sales
    winner = {(r.chain_id, r.product_id): r.winner for r in bt.run_series(values, KEYS).collect()}
    sums = {}
    for months in known.values():
        for p, v in months.items():
            sums[p] = sums.get(p, 0.0) + v
    flat = [r for r in out if r.model in ("Naive", "SES", "Media móvil 3") and r.product_id != "total"]
    assert flat and {r.product_id for r in out} >= {"total", "p0", "p1"}
    for r in flat:
        history = [v for p, v in sorted(known[r.chain_id, r.product_id].items()) if p <= r.issue]
        assert r.model in (winner[r.chain_id, r.product_id], "Naive")
        if r.model == "Naive":
            want = history[-1]
        elif r.model == "Media móvil 3":
            a = sum(history[-3:]) / 3
            want = (history[-2] + history[-1] + a) / 3
        else:
            first = next(i for i, v in enumerate(history) if v > 0)
            want = history[first]
            for v in history[first + 1:]:
                want = 0.35 * v + 0.65 * want
        assert r.statistical == pytest.approx(want, abs=0.00501) and r.ml == pytest.approx(2 * r.actual, abs=0.00501)
    whole = [r for r in out if r.product_id == "total"]
    for r in whole:
        parts = [x for x in out if x.product_id != "total" and (x.issue, x.target_period) == (r.issue, r.target_period)]
        assert r.actual == pytest.approx(sum(x.actual for x in parts)) and r.ml == pytest.approx(2 * r.actual, abs=0.00501)


def test_pooled_winner_against_loops(spark):
    rng = np.random.default_rng(8)
    rows = [("c" if p < 2 else "d", f"p{p}", float(rng.integers(0, 30)), m, float(rng.integers(0, 30)))
            for p in range(4) for m in ("linear", "forest", "boosting") for _ in range(9 if p else 5)]
    got = {(r.chain_id, r.product_id): (r.model, r.observations) for r in sel.pooled_winner(
        spark.createDataFrame(rows, "chain_id string, product_id string, actual double, model string, forecast double")).collect()}

    def best(own):
        scored = []
        for m in ("linear", "forest", "boosting"):
            mine = [r for r in own if r[3] == m]
            a = sum(r[2] for r in mine)
            wape, bias = 100 * sum(abs(r[2] - r[4]) for r in mine) / a, 100 * sum(r[2] - r[4] for r in mine) / a
            scored.append((round(wape, 4), round(abs(bias), 4), m, len(mine)))
        return min(scored)[2:]

    want = {(c, "ALL"): best([r for r in rows if r[0] == c]) for c in "cd"}
    want |= {(c, p): best([r for r in rows if r[1] == p]) for c, p in (("c", "p1"), ("d", "p2"), ("d", "p3"))}
    assert got == want


def test_ties_with_a_band_count_as_inside(spark):
    """Thirds carry noise in their last bits; a value at the bound is not below it."""
    from monthmill.operators import bands

    third = 1.0 / 3
    rows = [(1, 10 + third, 10 + 3 * third - 2 * third, 11.0, 12.0, 13.0), (1, 10.2, 10 + third, 11.0, 12.0, 13.0), (1, 12.0 + 1e-12, 9.0, 11.0, 12.0, 13.0)]
    df = spark.createDataFrame(rows, "k int, actual double, p10 double, p50 double, p90 double, p95 double")
    r = bands.interval_coverage(df, ["k"]).first()
    assert (r.observations, r.below_p10, r.coverage_p90) == (3, 1, 66.6667)
    assert sorted(x[0] for x in df.select(bands.coverage_bucket(*[F.col(c) for c in ("actual", "p10", "p50", "p90", "p95")])).collect()) == [
        "below_p10", "p10_p50", "p90_p95"]
