"""Pooled models and aligned records. The ridge has SQL twins; the trees are checked by tests."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from monthmill.functions import periods as pr
from monthmill.functions.numbers import rounded, snapped
from monthmill.operators import metrics as em, pooled as po, records as rec, ridge as ri, trees as tr
from monthmill.plans import ridge_sql as q
from monthmill.plans.models import ALLOWED_SQL, BT_SQL, CLASS_SQL, RUN_SQL
from monthmill.plans.registry import query
from monthmill.plans.scoring import metric_sql
from monthmill.plans.sql_parts import ISSUE as ISSUE_SQL, PANEL_BASE, PATHS, r, rs, vals, with_, ym
from monthmill.session import cut_lineage
from monthmill.sources.tables import ISSUE, SERIES, Tables

CP = ["chain_id", "product_id"]

SAMPLE_SQL = """
smp AS (SELECT p.*, h AS horizon, lead(sales, CAST(h AS INTEGER)) OVER (PARTITION BY chain_id, product_id, h ORDER BY idx) AS label, CAST(period + to_months(CAST(h AS INTEGER)) AS DATE) AS target FROM panel p, (SELECT unnest(range(1, 13)) AS h)),
sm AS (SELECT * FROM smp WHERE label IS NOT NULL AND idx >= 2)
"""


@query("f22_sample_set", with_(PANEL_BASE, SAMPLE_SQL) + f"SELECT chain_id, product_id, {ym('period')} AS issue, {ym('target')} AS target, horizon, label FROM sm")
def sample_set(t: Tables):
    return po.samples(t.panel, SERIES, "sales").select(
        *CP, pr.label("issue").alias("issue"), pr.label("target_period").alias("target"), "horizon", "label"
    )


@query("f21_feature_matrix", with_(PANEL_BASE, q.FEATURE_SQL) + f"""
SELECT chain_id, product_id, {ym('issue')} AS issue, horizon, {', '.join(f"{rs(f'xs[{i + 1}]')} AS {f}" for i, f in enumerate(po.FEATURES) if f != 'horizon')} FROM rw WHERE label IS NOT NULL""")
def feature_matrix(t: Tables):
    s = po.samples(t.panel, SERIES, "sales")
    features = [rounded(snapped(F.col(f).cast("double"))).alias(f) for f in po.FEATURES if f != "horizon"]
    return s.select(*CP, pr.label("issue").alias("issue"), "horizon", *features)


# Ridge: fitted for the twelve months after the issue month ----------------------------------

FUTURE = [(h, ISSUE.year * 12 + ISSUE.month - 1 + h) for h in po.HORIZONS]
FUTURE_SQL = with_(PANEL_BASE, q.FEATURE_SQL, q.FUTURE_FOLDS, q.RIDGE_SQL)


def design(t: Tables):
    """The samples and the rows to be forecast; every fit and prediction reads what is written here."""
    return t.kept("design", lambda: ri.design(t.panel, CP, "sales", ISSUE))


def future_model(t: Tables):
    rows = design(t)
    return rows, ri.fit(rows, FUTURE, ri.month_counts(rows))


def numbered(t: Tables, table):
    """One row per fold and feature; as many as there are horizons and features."""
    return t.spark.createDataFrame(table, "horizon int, feature string, median double, mean double, std double")


@query("f20_preprocessor", FUTURE_SQL + f"""
SELECT horizon, [{', '.join(f"'{f}'" for f in po.FEATURES)}][j] AS feature, {rs('md', 3)} AS median, {rs('mu', 3)} AS mean, {rs('sd', 3)} AS std FROM mo JOIN folds USING (fold)""")
def preprocessor(t: Tables):
    _, model = future_model(t)
    table = [
        (h, f, float(model.median[i, j]), float(model.mean[i, j]), float(model.std[i, j]))
        for i, (h, _) in enumerate(model.folds) for j, f in enumerate(po.FEATURES)
    ]
    return numbered(t, table).select("horizon", "feature", *[rounded(snapped(F.col(c)), 3).alias(c) for c in ("median", "mean", "std")])


def with_total(forecast):
    """Adds the sum of the rounded forecasts of all series."""
    total = forecast.groupBy("period", "horizon").agg(rounded(snapped(F.sum("forecast")), 2).alias("forecast"))
    return forecast.unionByName(total.select(F.lit("ALL").alias("chain_id"), F.lit("total").alias("product_id"), *total.columns))


def published(predicted, value: str):
    return with_total(predicted.select(
        *CP, pr.label("target_period").alias("period"), "horizon", rounded(snapped(F.col(value)), 2).alias("forecast")))


@query("f17_pooled_ridge", FUTURE_SQL + f"""
, fc AS (SELECT chain_id, product_id, {ym('target')} AS period, horizon, {rs('pred', 2)} AS forecast FROM ml)
SELECT * FROM fc UNION ALL SELECT 'ALL', 'total', period, horizon, {rs('sum(forecast)', 2)} FROM fc GROUP BY period, horizon""")
def pooled_ridge(t: Tables):
    return published(ri.predict(*future_model(t), CP), "pred")


def _tree_query(name: str, family: int, column: str) -> None:
    @query(name)
    def build(t: Tables):
        rows = design(t)
        model = tr.fit(rows, FUTURE, ri.month_counts(rows), (family,))
        return published(tr.predict(rows, model, CP, (family,)), column)


_tree_query("f18_pooled_forest", tr.FOREST, "forest")
_tree_query("f19_pooled_boosting", tr.BOOSTING, "boosting")


@query("f23_feature_importance", FUTURE_SQL.rstrip() + "," + q.IMPORTANCE_SQL + f"""
SELECT horizon, feature, {rs('importance', 5)} AS importance FROM im WHERE feature <> 'missing'""")
def feature_importance(t: Tables):
    return ri.importance(*future_model(t), CP).select("horizon", "feature", rounded(snapped(F.col("importance")), 5).alias("importance"))


@query("f23_tree_importance")
def tree_importance(t: Tables):
    """Shares of the gains of forest and stumps; a list of the columns that trees of bounded number and depth split on."""
    rows = design(t)
    model = tr.fit(rows, FUTURE, ri.month_counts(rows))
    table = [(name, *r) for name, family in (("forest", tr.FOREST), ("boosting", tr.BOOSTING)) for r in tr.importance(model, family)]
    return t.spark.createDataFrame(table, "family string, horizon int, feature string, importance double")


@query("t04_top_features", FUTURE_SQL.rstrip() + "," + q.IMPORTANCE_SQL + f"""
SELECT feature, {rs('100 * importance / sum(importance) OVER ()', 1)} AS share FROM (
  SELECT * FROM im WHERE feature <> 'missing' AND horizon = 1 ORDER BY importance DESC, feature LIMIT 8)""")
def top_features(t: Tables):
    top = ri.importance(*future_model(t), CP).filter("horizon = 1").orderBy(F.desc("importance"), "feature").limit(8)
    total = F.sum("importance").over(Window.partitionBy())  # over eight rows
    return top.select("feature", rounded(snapped(100 * F.col("importance") / total), 1).alias("share"))


# Backtests -----------------------------------------------------------------------------------

def metrics_by_horizon(rows, value: str):
    """By horizon, and over all as horizon 0."""
    both = rows.unionByName(rows.withColumn("horizon", F.lit(0)))
    return both.groupBy("horizon").agg(*em.error_metrics(F.col("actual"), F.col(value), "pooled"))


@query("b05_pooled_backtest", with_(PANEL_BASE, q.FEATURE_SQL, q.last_folds(2), q.RIDGE_SQL) + f"""
SELECT horizon, {metric_sql('pooled').replace('forecast', 'pred')} FROM (
  SELECT horizon, actual, {rs('pred', 2)} AS pred FROM ml UNION ALL SELECT 0, actual, {rs('pred', 2)} FROM ml) GROUP BY horizon""")
def pooled_backtest(t: Tables):
    rows = design(t)
    counts = ri.month_counts(rows)
    folds = ri.predict(rows, ri.fit(rows, ri.last_folds(counts, 2), counts), CP)
    return metrics_by_horizon(folds.withColumn("pred", rounded(snapped(F.col("pred")), 2)), "pred")


@query("b05_tree_backtest")
def tree_backtest(t: Tables):
    rows = design(t)
    counts = ri.month_counts(rows)
    out = tr.predict(rows, tr.fit(rows, ri.last_folds(counts, 2), counts), CP)
    forest, boosting = (metrics_by_horizon(out, f).withColumn("family", F.lit(f)) for f in ("forest", "boosting"))
    return forest.unionByName(boosting)


@query("b06_pooled_one_step_history", with_(PANEL_BASE, q.FEATURE_SQL, q.valid_folds(12, "1"), q.RIDGE_SQL) + f"""
, hs AS (SELECT sid AS series_id, {ym('target')} AS period, {r('actual', 2)} AS actual, {rs('pred', 2)} AS forecast FROM ml)
SELECT * FROM hs UNION ALL SELECT 'total', period, {rs('sum(actual)', 2)}, {rs('sum(forecast)', 2)} FROM hs GROUP BY period""")
def pooled_one_step(t: Tables):
    rows = design(t)
    counts = ri.month_counts(rows)
    folds = [f for f in ri.valid_folds(counts, 12) if f[0] == 1]
    own = ri.predict(rows, ri.fit(rows, folds, counts), CP).select(
        F.concat_ws("|", *CP).alias("series_id"), pr.label("target_period").alias("period"), rounded(F.col("actual"), 2).alias("actual"),
        rounded(snapped(F.col("pred")), 2).alias("forecast"))
    total = own.groupBy("period").agg(*[rounded(snapped(F.sum(c)), 2).alias(c) for c in ("actual", "forecast")])
    return own.unionByName(total.withColumn("series_id", F.lit("total")))


# The statistical value of a record: the winner of its series, from what was known at the issue month.
RECORD_VALS = vals(
    "(SELECT chain_id || '|' || product_id AS s, period, sales FROM monthly WHERE period <= " + ISSUE_SQL
    + " UNION ALL SELECT 'ALL|total', period, sum(sales) FROM monthly WHERE sales IS NOT NULL AND period <= " + ISSUE_SQL + " GROUP BY period)", "s")
WINNER_SQL = f"""
known AS (SELECT m.*, v.origin FROM ml m JOIN (SELECT sid, idx AS origin, period AS since, coalesce(lead(period) OVER (PARTITION BY sid ORDER BY idx), DATE '9999-01-01') AS until FROM vals) v
  ON v.sid = m.sid AND m.issue >= v.since AND m.issue < v.until),
whole AS (SELECT 'ALL|total' AS sid, 'ALL' AS chain_id, 'total' AS product_id, issue, target, horizon, sum(actual) AS actual, sum(pred) AS pred FROM known WHERE actual IS NOT NULL GROUP BY ALL),
wholes AS (SELECT w.*, (SELECT max(idx) FROM vals v WHERE v.sid = w.sid AND v.period <= w.issue) AS origin FROM whole w),
cases AS (SELECT chain_id, product_id, sid, issue, target, horizon, actual, pred, origin FROM known UNION ALL SELECT chain_id, product_id, sid, issue, target, horizon, actual, pred, origin FROM wholes),
paired AS (SELECT c.chain_id, c.product_id, c.issue, c.target AS period, c.horizon, c.actual, CASE WHEN w.pred IS NULL THEN 'Naive' ELSE w.model END AS model,
    {r('greatest(0e0, coalesce(w.pred, n.pred))', 2)} AS statistical, {rs('c.pred', 2)} AS ml
  FROM cases c JOIN res USING (sid) LEFT JOIN paths w ON w.sid = c.sid AND w.origin = c.origin AND w.step = c.horizon AND w.model = res.winner
  JOIN paths n ON n.sid = c.sid AND n.origin = c.origin AND n.step = c.horizon AND n.model = 'Naive')
"""
_RUN = (RECORD_VALS, PATHS, BT_SQL, CLASS_SQL, ALLOWED_SQL, RUN_SQL)
RECORDS_SQL = with_(PANEL_BASE, q.FEATURE_SQL, q.valid_folds(3), q.RIDGE_SQL, *_RUN, WINNER_SQL) + ", rec AS (SELECT * FROM paired WHERE actual IS NOT NULL)\n"
WHOLE_SQL = with_(PANEL_BASE, q.FEATURE_SQL, q.valid_and_future_folds(3), q.RIDGE_SQL, *_RUN, WINNER_SQL) + ", rec AS (SELECT * FROM paired WHERE actual IS NOT NULL)\n"
NEXT_SQL = with_(PANEL_BASE, q.FEATURE_SQL, q.FUTURE_FOLDS, q.RIDGE_SQL, *_RUN, WINNER_SQL)


def record_folds(t: Tables):
    rows = design(t)
    counts = ri.month_counts(rows)
    return rows, ri.valid_folds(counts, 3), counts


def records(t: Tables):
    """Statistical winner and ridge, twelve horizons, the last three targets that enough rows precede; stored."""
    def build():
        rows, folds, counts = record_folds(t)
        ml = ri.predict(rows, ri.fit(rows, folds, counts), CP).withColumnRenamed("pred", "ml")
        return rec.aligned_records(ml, t.brand_values, rec.total_values(t.monthly, ISSUE), ["ml"], ISSUE).withColumnRenamed("target_period", "period")

    return t.kept("records", lambda: cut_lineage(build()))


def family_records(t: Tables):
    """The same with the forest and the boosted stumps beside the ridge; stored."""
    def build():
        rows, folds, counts = record_folds(t)
        trees = tr.predict(rows, tr.fit(rows, folds, counts), CP).select(*CP, "horizon", "target_period", "forest", "boosting")
        ml = ri.predict(rows, ri.fit(rows, folds, counts), CP).withColumnRenamed("pred", "linear").join(trees, [*CP, "horizon", "target_period"])
        families = ["linear", "forest", "boosting"]
        return rec.aligned_records(ml, t.brand_values, rec.total_values(t.monthly, ISSUE), families, ISSUE).withColumnRenamed("target_period", "period")

    return t.kept("family_records", lambda: cut_lineage(build()))


def future_records(t: Tables):
    """Statistical winner and ridge for the twelve months after the issue month."""
    ml = ri.predict(*future_model(t), CP).withColumnRenamed("pred", "ml").filter(F.col("issue") == F.lit(ISSUE))
    return rec.beside(ml, rec.winner_paths(t.brand_values, CP, ISSUE), CP, ["ml"]).withColumnRenamed("target_period", "period")


@query("b07_aligned_records", RECORDS_SQL + f"""
SELECT chain_id, product_id, {ym('issue')} AS issue, {ym('period')} AS target, horizon, actual, model, statistical, ml FROM rec""")
def aligned_records(t: Tables):
    return records(t).select(*CP, pr.label("issue").alias("issue"), pr.label("period").alias("target"), "horizon", "actual", "model", "statistical", "ml")


@query("b07_family_records")
def all_families(t: Tables):
    return family_records(t).select(
        *CP, pr.label("issue").alias("issue"), pr.label("period").alias("target"), "horizon", "actual", "model", "statistical", "linear", "forest", "boosting")


@query("f26_cold_start_forest")
def cold_start_forest(t: Tables):
    """Scaled peer curves pooled over all peer groups, one forest, predictions back on the target's level."""
    from pyspark.ml.feature import VectorAssembler

    from monthmill.operators import coldstart as cs
    from monthmill.plans.intake import cold_peers, cold_targets

    grouped = cs.target_groups(cold_targets(t)).filter("age >= 1")
    picked = cs.select_peers(grouped, cold_peers(t))
    prefix = F.slice("history", F.lit(1), F.col("age"))
    shape = lambda values, lv: [
        (F.col("age") / 5.0).alias("f_age"), (F.element_at(values, -1) / lv).alias("f_last"),
        F.when(F.size(values) > 1, (F.element_at(values, -1) - F.element_at(values, 1)) / lv).otherwise(0.0).alias("f_move"),
    ]
    lv = cs.level(prefix)
    steps = F.posexplode(F.slice("history", F.col("age") + 1, F.lit(12))).alias("pos", "actual")
    curves = picked.dropDuplicates(["chain_id", "category_id", "peer_id", "age"]).select(*shape(prefix, lv), lv.alias("lv"), steps)
    train = curves.select(((F.col("pos") + 1) / 12.0).alias("f_step"), "f_age", "f_last", "f_move", (F.col("actual") / F.col("lv")).alias("label"))
    names = ["f_step", "f_age", "f_last", "f_move"]
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    model = po.forest(assemble.transform(train))
    v = F.col("values")
    targets = grouped.select("chain_id", "part_id", "age", *shape(v, cs.level(v)), cs.level(v).alias("lv"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("horizon"))
    scored = model.transform(assemble.transform(targets.withColumn("f_step", F.col("horizon") / 12.0)))
    return scored.select("chain_id", "part_id", "horizon", rounded(F.greatest(F.lit(0.0), F.col("prediction") * F.col("lv")), 2).alias("forecast"))
