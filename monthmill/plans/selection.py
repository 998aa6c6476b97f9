"""Retrospective evaluation, blending, selection, certification and the forecast table."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from monthmill.functions import periods as pr
from monthmill.functions.numbers import rounded, snapped
from monthmill.operators import backtest as bt, bands, metrics as em, models as m, records as rec, selection as sel, series as sr
from monthmill.operators.quantiles import exact_quantiles
from monthmill.plans.models import ALLOWED_SQL, BT_SQL, CLASS_SQL, RUN_SQL
from monthmill.plans.pooled import NEXT_SQL, RECORDS_SQL, WHOLE_SQL, family_records, future_records, records
from monthmill.plans.registry import query
from monthmill.plans.scoring import PAIRS_SQL, metric_sql, lpairs, pairs
from monthmill.plans.sql_parts import (
    BASE, BRAND_VALS, ISLAND_VALS, ISSUE as ISSUE_SQL, PANEL_BASE, PATHS, r, rs, vals, with_, ym,
)
from monthmill.session import cut_lineage
from monthmill.sources.tables import ISSUE, SERIES, Tables

CP = ["chain_id", "product_id"]

RETRO_SQL = f"""
pv AS (SELECT a.*, b.v AS v12 FROM vals a LEFT JOIN vals b ON b.sid = a.sid AND b.idx = a.idx - 12),
pc AS (SELECT sid, idx, period, count(*) OVER w AS k, count(*) FILTER (WHERE v > 0) OVER w AS kp, sum(v) OVER w AS s, sum(v * v) OVER w AS ss,
         sum(idx * v) OVER w AS sxy, sum(idx) OVER w AS sx, sum(idx * idx) OVER w AS sxx, corr(CASE WHEN v12 IS NOT NULL THEN v END, v12) OVER w AS sc
       FROM pv WINDOW w AS (PARTITION BY sid ORDER BY idx)),
pcls AS (SELECT sid, idx, period, CASE WHEN kp = 0 OR k / kp >= 3.0 THEN 'Altamente intermitente' WHEN k / kp >= 1.32 THEN 'Intermitente'
         WHEN k >= 24 AND coalesce(sc, 0e0) >= 0.55 AND ts < 0.03 THEN 'Estacional' WHEN ts >= 0.035 THEN 'Tendencia'
         WHEN kp > 1 AND (kp * ss - s * s) / (s * s) >= 0.49 THEN 'Irregular' ELSE 'Regular' END AS demand_class
       FROM (SELECT *, CASE WHEN k > 4 AND s > 0 THEN abs((k * sxy - sx * s) / (k * sxx - sx * sx)) / (s / k) ELSE 0e0 END AS ts FROM pc)),
fold0 AS (SELECT DISTINCT split_part(sid, '|', 1) AS chain_id, period FROM vals WHERE idx >= 6 AND period < {ISSUE_SQL}),
folds AS (SELECT * FROM fold0 QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY period DESC) <= 12),
retro0 AS (
  SELECT split_part(c.sid, '|', 1) AS chain_id, split_part(c.sid, '|', 2) AS product_id, c.period AS origin_period, p.step AS horizon, p.model,
         CAST(c.period + to_months(p.step) AS DATE) AS target_period, greatest(0e0, p.pred) AS pred
  FROM pcls c JOIN folds f ON f.chain_id = split_part(c.sid, '|', 1) AND f.period = c.period
  JOIN paths p ON p.sid = c.sid AND p.origin = c.idx
  WHERE p.step IN (1, 3, 6, 12) AND c.idx >= CASE WHEN p.step >= 6 THEN 12 ELSE 6 END
    AND (demand_class NOT LIKE '%ntermitente%' OR model IN (SELECT model FROM sparse))),
retro AS (SELECT a.*, b.category_id, b.sales AS actual FROM retro0 a JOIN panel b ON a.chain_id = b.chain_id AND a.product_id = b.product_id AND a.target_period = b.period
  WHERE b.sales IS NOT NULL AND a.target_period <= {ISSUE_SQL}),
nowc AS (SELECT split_part(sid, '|', 1) AS chain_id, split_part(sid, '|', 2) AS product_id, sid, idx, demand_class AS now_class FROM pcls WHERE period = {ISSUE_SQL}),
cand AS (SELECT r.* FROM retro r JOIN nowc USING (chain_id, product_id) WHERE now_class NOT LIKE '%ntermitente%' OR model IN (SELECT model FROM sparse)),
comm AS (SELECT * FROM cand QUALIFY count(*) OVER (PARTITION BY chain_id, product_id, origin_period, horizon) =
  (SELECT count(DISTINCT model) FROM cand z WHERE z.chain_id = cand.chain_id AND z.product_id = cand.product_id)),
wins AS (SELECT chain_id, product_id, model, wape, bias, observations, origins FROM (
  SELECT chain_id, product_id, model, {metric_sql('generic').replace('forecast', 'pred')}, count(DISTINCT origin_period) AS origins FROM comm GROUP BY ALL)
  WHERE wape IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chain_id, product_id ORDER BY wape, abs(bias), model) = 1)
"""
RETRO = with_(PANEL_BASE, ISLAND_VALS, PATHS, ALLOWED_SQL, RETRO_SQL)


def runs(t: Tables):
    return sr.spread(sr.island_values(t.panel, SERIES, "sales"), SERIES)


def retro(t: Tables):
    return bt.retrospective_rows(runs(t), t.panel, SERIES, ["chain_id"], ISSUE)


def comparable(t: Tables):
    return bt.common_support(bt.allowed_at_issue(retro(t), runs(t), SERIES, ISSUE), SERIES)


@query("b09_retrospective_rows", RETRO + f"""
SELECT chain_id, product_id, {ym('origin_period')} AS origin, {ym('target_period')} AS target, horizon, model, actual, {r('pred')} AS forecast FROM retro""")
def retrospective_rows(t: Tables):
    return retro(t).select(
        *CP, pr.label("origin_period").alias("origin"), pr.label("target_period").alias("target"), "horizon", "model", "actual",
        rounded(F.col("pred")).alias("forecast"),
    )


@query("b10_common_support", RETRO + """
SELECT chain_id, product_id, count(DISTINCT model) AS models, count(*) AS n_rows, count(DISTINCT origin_period) AS origins FROM comm GROUP BY ALL""")
def common_support(t: Tables):
    return comparable(t).groupBy(*CP).agg(
        F.count_distinct("model").alias("models"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("origin_period").alias("origins")
    )


@query("b11_statistical_winner", RETRO + "SELECT chain_id, product_id, model, wape, bias, observations, origins FROM wins")
def statistical_winner(t: Tables):
    return bt.series_winner(comparable(t), SERIES).select(*CP, "model", "wape", "bias", "observations", "origins")


@query("t01_best_candidate", RETRO + """
SELECT chain_id, model, wape, bias FROM (SELECT chain_id, model, """ + metric_sql("generic").replace("forecast", "pred") + """ FROM retro GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY wape NULLS LAST, abs(bias), model) = 1""")
def best_candidate(t: Tables):
    scored = retro(t).groupBy("chain_id", "model").agg(*em.error_metrics(F.col("actual"), F.col("pred"), "generic"))
    order = F.struct(F.coalesce("wape", F.lit(float("inf"))), F.abs("bias"), F.col("model"))
    return scored.groupBy("chain_id").agg(F.min_by(F.struct("model", "wape", "bias"), order).alias("w")).select("chain_id", "w.*")


@query("t02_leader_and_challenger", RETRO + """
SELECT chain_id, product_id, model, wape, position FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, product_id ORDER BY wape, abs(bias), model) AS position
  FROM (SELECT chain_id, product_id, model, """ + metric_sql("generic").replace("forecast", "pred") + """ FROM comm GROUP BY ALL) WHERE wape IS NOT NULL) WHERE position <= 2""")
def leader_and_challenger(t: Tables):
    scored = comparable(t).groupBy(*SERIES, "model").agg(*em.error_metrics(F.col("actual"), F.col("pred"), "generic")).filter("wape IS NOT NULL")
    w = Window.partitionBy(*SERIES).orderBy("wape", F.abs("bias"), "model")
    return scored.withColumn("position", F.row_number().over(w)).filter("position <= 2").select(*CP, "model", "wape", "position")


@query("t07_latest_origins", RETRO + f"SELECT chain_id, {ym('period')} AS origin FROM folds")
def latest_origins(t: Tables):
    return bt.fold_origins(runs(t), ["chain_id"], ISSUE).select("chain_id", F.explode("folds").alias("origin")).withColumn(
        "origin", pr.label("origin")
    )


@query("b17_evidence_signature", RETRO + """
SELECT chain_id, product_id, sha256(list_aggregate(list_sort(list(DISTINCT strftime(origin_period, '%Y-%m') || ',' || strftime(target_period, '%Y-%m') || ',' || horizon)), 'string_agg', ';')) AS signature FROM comm GROUP BY ALL""")
def evidence_signature(t: Tables):
    point = F.concat_ws(",", pr.label("origin_period"), pr.label("target_period"), F.col("horizon").cast("string"))
    return comparable(t).groupBy(*CP).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(point)), ";"), 256).alias("signature"))


@query("g37_model_distribution", RETRO + f"""
SELECT chain_id, model, count(*) AS products, {r('100 * count(*) / sum(count(*)) OVER (PARTITION BY chain_id)')} AS share FROM wins GROUP BY chain_id, model""")
def model_distribution(t: Tables):
    won = bt.series_winner(comparable(t), SERIES).groupBy("chain_id", "model").agg(F.count(F.lit(1)).alias("products"))
    share = 100 * F.col("products") / F.sum("products").over(Window.partitionBy("chain_id"))
    return won.withColumn("share", rounded(share))


# Forecast table ------------------------------------------------------------------------

FINAL_SQL = f"""
wres AS (SELECT c.chain_id, c.product_id, c.category_id, c.horizon, c.actual - c.pred AS residual FROM comm c JOIN wins w ON w.chain_id = c.chain_id AND w.product_id = c.product_id AND w.model = c.model),
qp AS (SELECT chain_id, product_id, horizon, count(*) AS n, quantile_cont(residual, [0.1, 0.9, 0.95]) AS q FROM wres GROUP BY ALL),
qc AS (SELECT chain_id, category_id, horizon, count(*) AS n, quantile_cont(residual, [0.1, 0.9, 0.95]) AS q FROM wres GROUP BY ALL),
qh AS (SELECT chain_id, horizon, count(*) AS n, quantile_cont(residual, [0.1, 0.9, 0.95]) AS q FROM wres GROUP BY ALL),
fin AS (SELECT n.chain_id, n.product_id, pn.category_id, n.now_class, n.idx, p.model, p.step AS horizon, greatest(0e0, p.pred) AS point
  FROM nowc n JOIN panel pn ON pn.chain_id = n.chain_id AND pn.product_id = n.product_id AND pn.period = {ISSUE_SQL}
  LEFT JOIN wins w ON w.chain_id = n.chain_id AND w.product_id = n.product_id JOIN paths p ON p.sid = n.sid AND p.origin = n.idx AND p.model = coalesce(w.model, 'Naive')),
fb AS (SELECT f.*, CASE WHEN qp.n >= 3 THEN 'PRODUCT' WHEN qc.n >= 3 THEN 'CATEGORY' WHEN qh.n >= 3 THEN 'CHAIN' ELSE 'INSUFFICIENT' END AS band_basis,
    CASE WHEN qp.n >= 3 THEN qp.n WHEN qc.n >= 3 THEN qc.n WHEN qh.n >= 3 THEN qh.n ELSE 0 END AS band_observations,
    CASE WHEN qp.n >= 3 THEN qp.q WHEN qc.n >= 3 THEN qc.q WHEN qh.n >= 3 THEN qh.q END AS q
  FROM fin f LEFT JOIN qp USING (chain_id, product_id, horizon) LEFT JOIN qc USING (chain_id, category_id, horizon) LEFT JOIN qh USING (chain_id, horizon))
"""


def final_points(t: Tables, rows=None):
    """Winner (or the naive fallback) applied at the issue month: twelve points per product."""
    current = runs(t).filter(F.element_at("periods", -1) == F.lit(ISSUE))
    rows = comparable(t) if rows is None else rows
    winners = bt.series_winner(rows, SERIES).select(*SERIES, F.col("model").alias("winner"))
    labelled = m.classify(current, [*SERIES, "periods"]).join(winners, SERIES, "left").withColumn(
        "chosen", F.array(F.coalesce("winner", F.lit("Naive")))
    )
    status = sr.lifecycle_label(F.col("values"))
    paths = m.forecast_paths(labelled.withColumn("status", status), [*SERIES, "demand_class", "status"], m.LAST_ORIGIN, allowed="chosen")
    return paths.select(*SERIES, "demand_class", "status", "model", F.posexplode("path").alias("p", "raw")).select(
        *SERIES, "demand_class", "status", "model", (F.col("p") + 1).alias("horizon"), F.greatest(F.lit(0.0), F.col("raw")).alias("point")
    )


@query("f28_forecast_table", with_(PANEL_BASE, ISLAND_VALS, PATHS, ALLOWED_SQL, RETRO_SQL, FINAL_SQL) + f"""
SELECT chain_id, product_id, category_id, horizon, strftime({ISSUE_SQL} + to_months(horizon), '%Y-%m') AS target, model, now_class AS demand_class,
  CASE WHEN idx < 18 THEN 'COLD_START' ELSE 'ACTIVE' END AS status, {r('point', 2)} AS forecast, band_basis, band_observations,
  CASE WHEN q IS NOT NULL THEN {rs('least(point, greatest(0e0, point + q[1]))', 2)} END AS p10, CASE WHEN q IS NOT NULL THEN {rs('greatest(point, point + q[2])', 2)} END AS p90,
  CASE WHEN q IS NOT NULL THEN {rs('greatest(greatest(point, point + q[2]), point + q[3])', 2)} END AS p95 FROM fb""")
def forecast_table(t: Tables):
    # read by the winner, the points and three band levels: written once
    rows = cut_lineage(comparable(t))
    won = bt.series_winner(rows, SERIES).select(*SERIES, "model")
    residuals = cut_lineage(rows.join(won, [*SERIES, "model"], "left_semi").withColumn("residual", F.col("actual") - F.col("pred")))
    chosen = bands.select_evidence(final_points(t, rows), residuals, CP, ["chain_id", "category_id"], ["chain_id"])
    b = bands.ordered_bands(F.col("point"), F.col("quantiles"))
    has = F.col("quantiles").isNotNull()
    return chosen.select(
        *SERIES, "horizon", pr.label(F.add_months(F.lit(ISSUE), F.col("horizon"))).alias("target"), "model", "demand_class", "status",
        rounded(F.col("point"), 2).alias("forecast"), "band_basis", "band_observations",
        *[F.when(has, b[n]).alias(n) for n in ("p10", "p90", "p95")],
    )


@query("g03_forecast_rollup", with_(PANEL_BASE, ISLAND_VALS, PATHS, ALLOWED_SQL, RETRO_SQL, FINAL_SQL) + f"""
SELECT CASE WHEN category_id IS NULL THEN 'CHAIN' ELSE 'CATEGORY' END AS level, coalesce(category_id, chain_id) AS key, chain_id, horizon, total, members FROM (
  SELECT chain_id, category_id, horizon, CAST(sum(CAST({r('point', 2)} AS DECIMAL(18,3))) AS DOUBLE) AS total, count(*) AS members FROM fin
  GROUP BY GROUPING SETS ((chain_id, category_id, horizon), (chain_id, horizon)))""")
def forecast_rollup(t: Tables):
    return sel.rollup_levels(final_points(t).withColumn("forecast", rounded(F.col("point"), 2)), "forecast")


@query("f29_fallback_bands", with_(PANEL_BASE, PAIRS_SQL) + f"""
SELECT chain_id, product_id, horizon, n, {rs('least(pt, greatest(0e0, pt + q[1] * sc))')} AS p10, {rs('pt')} AS p50, {rs('greatest(pt, pt + q[2] * sc)')} AS p90,
  {rs('greatest(greatest(pt, pt + q[2] * sc), pt + q[3] * sc)')} AS p95
FROM (SELECT *, CASE WHEN n < 5 THEN sqrt(horizon) ELSE 1e0 END AS sc FROM (
  SELECT chain_id, product_id, horizon, count(*) AS n, quantile_cont(actual - mean3, [0.1, 0.9, 0.95]) AS q, arg_max(mean3, period) AS pt FROM pairs GROUP BY ALL))""")
def fallback_bands(t: Tables):
    q = F.percentile(F.col("actual") - F.col("mean3"), F.array(*[F.lit(p) for p in bands.PROBABILITIES]))
    g = pairs(t).groupBy(*CP, "horizon").agg(F.count(F.lit(1)).alias("n"), q.alias("q"), F.max_by("mean3", "period").alias("pt"))
    scale = F.when(F.col("n") < 5, F.sqrt("horizon")).otherwise(1.0)
    b = bands.ordered_bands(F.col("pt"), F.col("q"), 4, scale)
    return g.select(*CP, "horizon", "n", *[c.alias(k) for k, c in b.items()])


# Tuning -------------------------------------------------------------------------------

TUNE_HEAD = with_(BASE, BRAND_VALS)
TUNE_TAIL = """
er AS (SELECT s.sid, s.g, avg(abs(v2.v - greatest(0e0, s.f))) AS mae FROM rec s JOIN vals v2 ON v2.sid = s.sid AND v2.idx = s.idx + 1
  WHERE s.idx >= greatest(6, v2.n - 5) GROUP BY ALL)
"""


@query("f15_tuned_ses", TUNE_HEAD + f""", grid AS (SELECT unnest([0.15e0, 0.35e0, 0.65e0, 0.85e0]) AS alpha, unnest([1, 2, 3, 4]) AS g),
rec AS (SELECT sid, g, alpha, idx, v AS f FROM vals, grid WHERE idx = 1 UNION ALL
  SELECT r.sid, r.g, r.alpha, x.idx, r.alpha * x.v + (1 - r.alpha) * r.f FROM rec r JOIN vals x ON x.sid = r.sid AND x.idx = r.idx + 1),""" + TUNE_TAIL + f"""
SELECT split_part(sid, '|', 1) AS chain_id, split_part(sid, '|', 2) AS product_id, alpha, {r('mae')} AS inner_mae FROM er JOIN grid USING (g) QUALIFY row_number() OVER (PARTITION BY sid ORDER BY mae, g) = 1""")
def tuned_ses(t: Tables):
    return m.tune(t.brand_values, CP, "SES").select(*CP, F.col("params.alpha").alias("alpha"), rounded(F.col("mae")).alias("inner_mae"))


@query("f15_tuned_holt", TUNE_HEAD + f""", grid AS (SELECT a AS alpha, b AS beta, row_number() OVER (ORDER BY a, b) AS g FROM (SELECT unnest([0.2e0, 0.5e0, 0.8e0]) AS a), (SELECT unnest([0.1e0, 0.3e0]) AS b)),
hr AS (SELECT a.sid, g, alpha, beta, a.idx, a.v AS l, b.v - a.v AS tr FROM vals a JOIN vals b ON b.sid = a.sid AND b.idx = 2, grid WHERE a.idx = 1 UNION ALL
  SELECT r.sid, r.g, r.alpha, r.beta, x.idx, r.alpha * x.v + (1 - r.alpha) * (r.l + r.tr), r.beta * (r.alpha * x.v + (1 - r.alpha) * (r.l + r.tr) - r.l) + (1 - r.beta) * r.tr
  FROM hr r JOIN vals x ON x.sid = r.sid AND x.idx = r.idx + 1),
rec AS (SELECT sid, g, idx, l + tr AS f FROM hr),""" + TUNE_TAIL + f"""
SELECT split_part(sid, '|', 1) AS chain_id, split_part(sid, '|', 2) AS product_id, alpha, beta, {r('mae')} AS inner_mae FROM er JOIN grid USING (g) QUALIFY row_number() OVER (PARTITION BY sid ORDER BY mae, g) = 1""")
def tuned_holt(t: Tables):
    return m.tune(t.brand_values, CP, "Holt").select(
        *CP, F.col("params.alpha").alias("alpha"), F.col("params.beta").alias("beta"), rounded(F.col("mae")).alias("inner_mae")
    )


# All six families in SQL: each grid runs as its own recursion, numbered in search order.
GRIDS_SQL = """
g1 AS (SELECT row_number() OVER () AS g, alpha, CAST(NULL AS DOUBLE) AS beta, CAST(NULL AS DOUBLE) AS gamma FROM (SELECT unnest([0.15e0, 0.35e0, 0.65e0, 0.85e0]) AS alpha)),
g2 AS (SELECT row_number() OVER (ORDER BY alpha, beta) AS g, alpha, beta, CAST(NULL AS DOUBLE) AS gamma FROM (SELECT unnest([0.2e0, 0.5e0, 0.8e0]) AS alpha), (SELECT unnest([0.1e0, 0.3e0]) AS beta)),
g3 AS (SELECT row_number() OVER (ORDER BY alpha, beta, gamma) AS g, alpha, beta, gamma FROM (SELECT unnest([0.2e0, 0.5e0]) AS alpha), (SELECT unnest([0.1e0, 0.3e0]) AS beta), (SELECT unnest([0.1e0, 0.3e0]) AS gamma)),
sr AS (SELECT sid, g, alpha, idx, v AS f FROM vals, g1 WHERE idx = 1 UNION ALL SELECT r.sid, r.g, r.alpha, x.idx, r.alpha * x.v + (1 - r.alpha) * r.f FROM sr r JOIN vals x ON x.sid = r.sid AND x.idx = r.idx + 1),
lr AS (SELECT a.sid, g, alpha, beta, a.idx, a.v AS l, b.v - a.v AS tr FROM vals a JOIN vals b ON b.sid = a.sid AND b.idx = 2, g2 WHERE a.idx = 1 UNION ALL
  SELECT sid, g, alpha, beta, idx, l2, beta * (l2 - l) + (1 - beta) * tr FROM (SELECT r.*, x.idx AS idx2, r.alpha * x.v + (1 - r.alpha) * (r.l + r.tr) AS l2 FROM lr r JOIN vals x ON x.sid = r.sid AND x.idx = r.idx + 1) q(sid, g, alpha, beta, old, l, tr, idx, l2)),
wr0 AS (SELECT sid, lvl, (m2 - lvl) / 12e0 AS tr, list_transform(f12, lambda q: q - lvl) AS seas FROM (
  SELECT sid, avg(v) FILTER (WHERE idx <= 12) AS lvl, avg(v) FILTER (WHERE idx BETWEEN 13 AND 24) AS m2, list(v ORDER BY idx) FILTER (WHERE idx <= 12) AS f12 FROM vals WHERE n >= 24 GROUP BY sid)),
hwr AS (SELECT sid, g, alpha, beta, gamma, CAST(0 AS BIGINT) AS idx, lvl, tr, seas FROM wr0, g3 UNION ALL
  SELECT sid, g, alpha, beta, gamma, idx, lv2, beta * (lv2 - lvl) + (1 - beta) * tr, list_transform(seas, lambda q, i: CASE WHEN i - 1 = (idx - 1) % 12 THEN gamma * (v - lv2) + (1 - gamma) * q ELSE q END)
  FROM (SELECT h.sid, h.g, h.alpha, h.beta, h.gamma, x.idx, h.lvl, h.tr, h.seas, x.v, h.alpha * (x.v - h.seas[(x.idx - 1) % 12 + 1]) + (1 - h.alpha) * (h.lvl + h.tr) AS lv2 FROM hwr h JOIN vals x ON x.sid = h.sid AND x.idx = h.idx + 1)),
ir AS (SELECT sid, g, alpha, beta, idx, v > 0 AS seen, CASE WHEN v > 0 THEN v ELSE 0e0 END AS z, CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END AS iv, 1e0 AS gap, CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END AS p FROM vals, g2 WHERE idx = 1 UNION ALL
  SELECT r.sid, r.g, r.alpha, r.beta, x.idx, r.seen OR x.v > 0, CASE WHEN NOT r.seen THEN CASE WHEN x.v > 0 THEN x.v ELSE 0e0 END WHEN x.v > 0 THEN r.alpha * x.v + (1 - r.alpha) * r.z ELSE r.z END,
    CASE WHEN NOT r.seen THEN CASE WHEN x.v > 0 THEN CAST(x.idx AS DOUBLE) ELSE 0e0 END WHEN x.v > 0 THEN r.beta * r.gap + (1 - r.beta) * r.iv ELSE r.iv END, CASE WHEN NOT r.seen OR x.v > 0 THEN 1e0 ELSE r.gap + 1 END,
    CASE WHEN NOT r.seen THEN CASE WHEN x.v > 0 THEN 1e0 / x.idx ELSE 0e0 END ELSE r.beta * CASE WHEN x.v > 0 THEN 1e0 ELSE 0e0 END + (1 - r.beta) * r.p END FROM ir r JOIN vals x ON x.sid = r.sid AND x.idx = r.idx + 1),
st6 AS (SELECT 'SES' AS model, 1 AS fam, sid, g, alpha, CAST(NULL AS DOUBLE) AS beta, CAST(NULL AS DOUBLE) AS gamma, idx, step, f FROM sr, steps6
  UNION ALL SELECT 'Holt', 2, sid, g, alpha, beta, NULL, idx, step, l + tr * step FROM lr, steps6 WHERE idx >= 3
  UNION ALL SELECT 'Holt-Winters', 3, sid, g, alpha, beta, gamma, idx, step, lvl + tr * step + seas[(idx + step - 1) % 12 + 1] FROM hwr, steps6 WHERE idx >= 24
  UNION ALL SELECT 'Croston', 4, sid, g, alpha, beta, NULL, idx, step, CASE WHEN seen THEN z / greatest(iv, 1e-9) ELSE 0e0 END FROM ir, steps6
  UNION ALL SELECT 'SBA', 5, sid, g, alpha, beta, NULL, idx, step, CASE WHEN seen THEN z / greatest(iv, 1e-9) * (1 - beta / 2) ELSE 0e0 END FROM ir, steps6
  UNION ALL SELECT 'TSB', 6, sid, g, alpha, beta, NULL, idx, step, CASE WHEN seen THEN p * z ELSE 0e0 END FROM ir, steps6),
er6 AS (SELECT s.model, s.sid, s.g, any_value(s.alpha) AS alpha, any_value(s.beta) AS beta, any_value(s.gamma) AS gamma, avg(abs(v2.v - greatest(0e0, s.f))) AS mae FROM st6 s JOIN vals v2 ON v2.sid = s.sid AND v2.idx = s.idx + 1
  WHERE s.step = 1 AND s.idx >= greatest(6, v2.n - 5) AND v2.n > 6 GROUP BY s.model, s.sid, s.g),
tuned AS (SELECT * FROM er6 QUALIFY row_number() OVER (PARTITION BY model, sid ORDER BY mae, g) = 1)
"""
TUNED = TUNE_HEAD.rstrip() + ", steps6 AS (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS step)," + GRIDS_SQL


def tuned(t: Tables):
    """The parameters of every family for every series, with all six in one table."""
    out = None
    for name in ("SES", "Holt", "Holt-Winters", "Croston", "SBA", "TSB"):
        fields = m.GRIDS[name][0]
        part = m.tune(t.brand_values, CP, name).select(
            *CP, F.lit(name).alias("model"), *[(F.col(f"params.{p}") if p in fields else F.lit(None).cast("double")).alias(p) for p in ("alpha", "beta", "gamma")], "mae")
        out = part if out is None else out.unionByName(part)
    return out


@query("f15_tuned_all", TUNED + f"""
SELECT split_part(sid, '|', 1) AS chain_id, split_part(sid, '|', 2) AS product_id, model, alpha, beta, gamma, {r('mae')} AS inner_mae FROM tuned""")
def tuned_all(t: Tables):
    return tuned(t).select(*CP, "model", "alpha", "beta", "gamma", rounded(F.col("mae")).alias("inner_mae"))


@query("f16_parameterised_prediction", TUNED + f"""
SELECT split_part(s.sid, '|', 1) AS chain_id, split_part(s.sid, '|', 2) AS product_id, s.model, s.step AS horizon, {rs('greatest(0e0, s.f)', 2)} AS forecast
FROM st6 s JOIN tuned u ON u.model = s.model AND u.sid = s.sid AND u.g = s.g JOIN (SELECT sid, max(n) AS n FROM vals GROUP BY sid) z ON z.sid = s.sid AND s.idx = z.n""")
def parameterised_prediction(t: Tables):
    """Twelve months of every family at its own tuned parameters."""
    out = None
    for name in ("SES", "Holt", "Holt-Winters", "Croston", "SBA", "TSB"):
        part = m.tuned_paths(t.brand_values, m.tune(t.brand_values, CP, name), CP, name).select(
            *CP, F.lit(name).alias("model"), F.posexplode("path").alias("p", "raw"))
        out = part if out is None else out.unionByName(part)
    if_finite = F.when(F.isnan("raw") | (F.abs("raw") == float("inf")), F.raise_error(F.lit("a parameterised prediction is not finite"))).otherwise(F.col("raw"))
    return out.select(*CP, "model", (F.col("p") + 1).alias("horizon"), rounded(snapped(F.greatest(F.lit(0.0), if_finite)), 2).alias("forecast"))


# Total series ------------------------------------------------------------------------

TOTAL_VALS = vals(f"(SELECT chain_id, period, sum(sales) AS sales FROM monthly WHERE period <= {ISSUE_SQL} AND sales IS NOT NULL GROUP BY ALL)", "chain_id")


@query("b04_total_series", with_(BASE, TOTAL_VALS, PATHS, BT_SQL, CLASS_SQL, ALLOWED_SQL, RUN_SQL) + """
SELECT sid AS chain_id, demand_class, winner, wape, bias, stability, score, alerts, status FROM res""")
def total_series(t: Tables):
    totals = t.monthly.filter((F.col("period") <= F.lit(ISSUE)) & F.col("sales").isNotNull()).groupBy("chain_id", "period").agg(F.sum("sales").alias("sales"))
    return bt.run_series(sr.spread(sr.observed_values(totals, ["chain_id"], "sales"), ["chain_id"]), ["chain_id"])


# Blending ------------------------------------------------------------------------------
# Two aligned candidates: the statistical winner of each series ("statistical") and the pooled ridge ("ml").

WEIGHT_SQL = f"""
wt AS (SELECT CAST(unnest(range(0, 41)) AS INTEGER) AS step),
wp AS (SELECT chain_id, step, period, sum(abs(actual - pred)) AS ae, sum(actual - pred) AS e, sum(actual) AS a, count(*) AS n
  FROM (SELECT chain_id, period, actual, step, greatest(0e0, statistical * (step / 40e0) + ml * (1 - step / 40e0)) AS pred FROM rec, wt) GROUP BY ALL),
wr AS (SELECT *, 100 * ae / a AS rate, row_number() OVER (PARTITION BY chain_id, step ORDER BY period) AS pos, count(*) OVER (PARTITION BY chain_id, step) AS cnt FROM wp WHERE a <> 0),
wm AS (SELECT chain_id, step, CAST(sum(n) AS BIGINT) AS observations, count(*) AS windows, {r('100 * sum(ae) / sum(a)')} AS wape, {r('100 * sum(e) / sum(a)')} AS bias,
    {r('CASE WHEN count(*) > 1 THEN stddev_pop(rate) ELSE 0e0 END')} AS stability,
    {r('greatest(0e0, coalesce(avg(rate) FILTER (WHERE pos > greatest(1, cnt * 2 // 3)), avg(rate) FILTER (WHERE pos <= greatest(1, cnt * 2 // 3))) - avg(rate) FILTER (WHERE pos <= greatest(1, cnt * 2 // 3)))')} AS deterioration
  FROM wr GROUP BY ALL),
ws AS (SELECT *, {r('wape + abs(bias) * 0.18e0 + stability * 0.1e0 + deterioration * 0.12e0')} AS score FROM wm),
ctr AS (SELECT chain_id, step AS center FROM ws WHERE step % 4 = 0 QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY score, step DESC) = 1),
wcand AS (SELECT ws.*, step / 40e0 AS statistical_weight, CASE step WHEN 40 THEN 'statistical' WHEN 0 THEN 'ml' ELSE 'ensemble' END AS strategy
  FROM ws JOIN ctr USING (chain_id) WHERE step % 4 = 0 OR abs(step - center) <= 4)
"""
BEST_SQL = "bst AS (SELECT * FROM wcand QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY score, wape, statistical_weight DESC) = 1)"
WEIGHTS = RECORDS_SQL.rstrip() + ",\n" + WEIGHT_SQL.strip() + "\n"
BLENDED = WEIGHTS + ", " + BEST_SQL + "\n"


def best_weights(t: Tables):
    """The weight of the best candidate of each chain."""
    order = F.struct(F.col("score"), F.col("wape"), -F.col("statistical_weight"))
    return sel.weight_search(records(t), ["chain_id"]).groupBy("chain_id").agg(F.min_by("statistical_weight", order).alias("w"))


def blended(t: Tables):
    """The records with the ensemble of their chain's best weight."""
    value = sel.blend(F.col("statistical"), F.col("ml"), F.col("w"))
    return records(t).join(best_weights(t), "chain_id").withColumn("ensemble", value)


@query("b13_weight_search", WEIGHTS + """
SELECT chain_id, statistical_weight, strategy, observations, windows, wape, bias, stability, deterioration, score FROM wcand""")
def weight_search(t: Tables):
    return sel.weight_search(records(t), ["chain_id"]).select(
        "chain_id", "statistical_weight", "strategy", "observations", "windows", "wape", "bias", "stability", "deterioration", "score"
    )


@query("u06_weight_grid", WEIGHTS + "SELECT chain_id, count(*) AS weights, min(statistical_weight) AS lo, max(statistical_weight) AS hi FROM wcand GROUP BY chain_id")
def weight_grid(t: Tables):
    return sel.weight_search(records(t), ["chain_id"]).groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("weights"), F.min("statistical_weight").alias("lo"), F.max("statistical_weight").alias("hi")
    )


@query("b14_strategy_states", BLENDED + """,
inc AS (SELECT * FROM wcand WHERE strategy = 'statistical'),
el AS (SELECT b.chain_id, b.step AS best_step, least(i.wape, 60e0) AS bench,
  b.strategy <> 'statistical' AND least(i.wape, 60e0) - b.wape >= 0.25 AND b.observations >= 24 AND b.windows >= 3 AND abs(b.bias) <= abs(i.bias) + 5 AND b.stability <= i.stability + 10 AND b.score < i.score AS eligible
  FROM bst b JOIN inc i USING (chain_id))
SELECT chain_id, statistical_weight, strategy, strategy = 'statistical' OR wape <= bench AS no_degradation_pass, bench - wape >= 0.25 AS minimum_improvement_pass,
  CASE WHEN eligible AND step = best_step THEN 'challenger' WHEN strategy = 'statistical' THEN 'champion' ELSE 'rejected' END AS state FROM wcand JOIN el USING (chain_id)""")
def strategy_states(t: Tables):
    return sel.strategy_states(sel.weight_search(records(t), ["chain_id"]), ["chain_id"], reference_wape=60.0).select(
        "chain_id", "statistical_weight", "strategy", "no_degradation_pass", "minimum_improvement_pass", "state"
    )


@query("f24_ensemble_value", BLENDED + f"""
SELECT chain_id, product_id, {ym('period')} AS period, horizon, statistical_weight, {rs('greatest(0e0, statistical * statistical_weight + ml * (1 - statistical_weight))')} AS ensemble FROM rec JOIN bst USING (chain_id)""")
def ensemble_value(t: Tables):
    return blended(t).select(
        *CP, pr.label("period").alias("period"), "horizon", F.col("w").alias("statistical_weight"), rounded(snapped(F.col("ensemble"))).alias("ensemble"))


@query("p31_divergence", NEXT_SQL + f"""
SELECT chain_id, product_id, {ym('period')} AS period, horizon, {rs('100 * abs(statistical - ml) / greatest(abs(statistical), 1e0)')} AS divergence, 100 * abs(statistical - ml) / greatest(abs(statistical), 1e0) >= 30 AS alert FROM paired""")
def divergence(t: Tables):
    d = sel.divergence(F.col("statistical"), F.col("ml"))
    return future_records(t).select(*CP, pr.label("period").alias("period"), "horizon", rounded(snapped(d)).alias("divergence"), (d >= 30).alias("alert"))


@query("p32_confidence", with_(PANEL_BASE, PAIRS_SQL) + f"""
SELECT chain_id, product_id, model, CASE WHEN pts >= 7 THEN 'Alta' WHEN pts >= 4 THEN 'Media' ELSE 'Baja' END AS confidence FROM (
  SELECT *, CASE WHEN wape <= 20 THEN 2 WHEN wape <= 35 THEN 1 ELSE 0 END + CASE WHEN stability <= 8 THEN 2 WHEN stability <= 18 THEN 1 ELSE 0 END
   + CASE WHEN abs(bias) <= 15 THEN 2 WHEN abs(bias) <= 30 THEN 1 ELSE 0 END + CASE WHEN observations >= 120 THEN 2 WHEN observations >= 48 THEN 1 ELSE 0 END AS pts
  FROM (SELECT chain_id, product_id, model, {metric_sql('generic')} FROM lpairs GROUP BY ALL))""")
def confidence(t: Tables):
    g = lpairs(t).groupBy(*CP, "model").agg(*em.error_metrics(F.col("actual"), F.col("forecast"), "generic"))
    return g.select(*CP, "model", sel.confidence(F.col("wape"), F.col("stability"), F.abs("bias"), F.col("observations")).alias("confidence"))


@query("g51_mean_divergence", NEXT_SQL + f"""
SELECT chain_id, product_id, {rs('avg(100 * abs(statistical - ml) / greatest(abs(statistical), 1e0))')} AS mean_divergence FROM paired GROUP BY ALL""")
def mean_divergence(t: Tables):
    """Over the twelve months after the issue month."""
    d = sel.divergence(F.col("statistical"), F.col("ml"))
    return future_records(t).groupBy(*CP).agg(rounded(snapped(F.avg(d))).alias("mean_divergence"))


# Split, certification, recommendation ------------------------------------------------------

SPLIT_SQL = f"""
plan0 AS (SELECT chain_id, min(period) AS start, date_diff('month', min(period), {ISSUE_SQL}) + 1 AS months FROM panel WHERE sales IS NOT NULL GROUP BY chain_id),
plan1 AS (SELECT *, CAST(start + to_months(CAST(least(months, greatest(18, least(30, months - 21))) - 1 AS INTEGER)) AS DATE) AS train_end FROM plan0),
plan AS (SELECT *, greatest(0, date_diff('month', train_end, {ISSUE_SQL}) - 12) AS targets, CAST(train_end + INTERVAL 13 MONTH AS DATE) AS first_target,
  CAST({ISSUE_SQL} - to_months(CAST(least(3, greatest(0, date_diff('month', train_end, {ISSUE_SQL}) - 12)) - 1 AS INTEGER)) AS DATE) AS cert_start FROM plan1),
lab AS (SELECT l.*, CASE WHEN l.period >= p.cert_start THEN 'certification' ELSE 'validation' END AS split FROM lpairs l JOIN plan p USING (chain_id) WHERE l.period >= p.first_target)
"""


@query("b08_split_plan", with_(PANEL_BASE, PAIRS_SQL, SPLIT_SQL) + f"""
SELECT chain_id, {ym('start')} AS first_month, months, {ym('train_end')} AS train_end, {ym('first_target')} AS first_target, targets, {ym('cert_start')} AS certification_start FROM plan""")
def split_plan(t: Tables):
    p = sel.split_plan(t.panel, ["chain_id"], ISSUE)
    return p.select(
        "chain_id", pr.label("start").alias("first_month"), "months", pr.label("train_end").alias("train_end"),
        pr.label("first_target").alias("first_target"), "targets", pr.label("certification_start").alias("certification_start"),
    )


def labelled(t: Tables):
    return sel.labelled_split(lpairs(t), sel.split_plan(t.panel, ["chain_id"], ISSUE), ["chain_id"])


@query("b08_split_counts", with_(PANEL_BASE, PAIRS_SQL, SPLIT_SQL) + "SELECT chain_id, split, count(*) AS n_rows, count(DISTINCT period) AS targets FROM lab GROUP BY ALL")
def split_counts(t: Tables):
    return labelled(t).groupBy("chain_id", "split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("period").alias("targets"))


LONG_SQL = """
lrec AS (SELECT chain_id, product_id, period, horizon, actual, 'statistical' AS model, statistical AS forecast FROM rec
  UNION ALL SELECT chain_id, product_id, period, horizon, actual, 'ml', ml FROM rec
  UNION ALL SELECT chain_id, product_id, period, horizon, actual, 'ensemble', greatest(0e0, statistical * statistical_weight + ml * (1 - statistical_weight)) FROM rec JOIN bst USING (chain_id))
"""
HELD_SQL = SPLIT_SQL.split("lab AS")[0].strip() + """
hrec AS (SELECT l.*, CASE WHEN l.period >= p.cert_start THEN 'certification' ELSE 'validation' END AS split FROM lrec l JOIN plan p USING (chain_id) WHERE l.period >= p.first_target)
"""


@query("b15_certified_metrics", BLENDED.rstrip() + "," + LONG_SQL.strip() + "," + HELD_SQL + f"""
SELECT a.*, d.certified_deterioration FROM (SELECT chain_id, model, {metric_sql('generic', 'certified_')} FROM hrec WHERE split = 'certification' GROUP BY ALL) a
LEFT JOIN (SELECT chain_id, model, CASE WHEN count(*) >= 2 THEN {r('greatest(0e0, arg_max(wape, period) - arg_min(wape, period))')} END AS certified_deterioration
  FROM (SELECT chain_id, model, period, {metric_sql('generic')} FROM hrec WHERE split = 'certification' GROUP BY ALL) WHERE wape IS NOT NULL GROUP BY ALL) d USING (chain_id, model)""")
def certified_metrics(t: Tables):
    long = blended(t).unpivot([*CP, "period", "horizon", "actual"], ["statistical", "ml", "ensemble"], "model", "forecast")
    return sel.certified(sel.labelled_split(long, sel.split_plan(t.panel, ["chain_id"], ISSUE), ["chain_id"]), ["chain_id", "model"])


@query("b12_pooled_winner")
def pooled_winner(t: Tables):
    """The best pooled family of each chain (product ALL) and of each product with six observations, on the same records."""
    long = family_records(t).filter(F.col("chain_id") != rec.TOTAL["chain_id"]).unpivot(
        [*CP, "actual"], ["linear", "forest", "boosting"], "model", "forecast")
    return sel.pooled_winner(long)


REC_SQL = f"""
last_model AS (SELECT chain_id, product_id, arg_max(model, issue) AS name FROM rec GROUP BY ALL),
fam AS (SELECT chain_id, product_id, period, horizon, actual, 'statistical' AS family, name AS model, statistical AS forecast FROM rec JOIN last_model USING (chain_id, product_id)
  UNION ALL SELECT chain_id, product_id, period, horizon, actual, 'ml', 'linear', ml FROM rec
  UNION ALL SELECT chain_id, product_id, period, horizon, actual, 'ensemble', 'blend', greatest(0e0, statistical * statistical_weight + ml * (1 - statistical_weight)) FROM rec JOIN bst USING (chain_id)),
fm AS (SELECT chain_id, product_id, family, model, {metric_sql('generic')}, count(DISTINCT period) AS windows, count(DISTINCT horizon) AS horizons,
   {', '.join(f"{r(f'100 * sum(abs(actual - forecast)) FILTER (WHERE horizon = {h}) / nullif(sum(actual) FILTER (WHERE horizon = {h}), 0)')} AS h{h}" for h in (1, 2, 3))} FROM fam GROUP BY ALL),
ok AS (SELECT f.*, b.wape AS bw, b.bias AS bb, b.stability AS bs, b.h1 AS bh1, b.h2 AS bh2, b.h3 AS bh3, count(*) OVER (PARTITION BY f.chain_id, f.product_id) AS nc
  FROM fm f LEFT JOIN fm b ON b.chain_id = f.chain_id AND b.product_id = f.product_id AND b.family = 'statistical' AND b.observations >= 6
  WHERE f.observations >= 6 AND f.wape IS NOT NULL AND f.horizons = 12 AND (f.family <> 'ensemble' OR (f.observations >= 24 AND f.windows >= 3))),
safe AS (SELECT *, CASE family WHEN 'statistical' THEN 0 WHEN 'ensemble' THEN 1 ELSE 2 END AS rf FROM ok WHERE family = 'statistical' OR bw IS NULL
  OR NOT (abs(bias) > abs(bb) + 5 OR coalesce(h1 > bh1 + 2, false) OR coalesce(h2 > bh2 + 2, false) OR coalesce(h3 > bh3 + 2, false) OR coalesce(stability > bs + 10, false))),
top AS (SELECT *, count(*) OVER (PARTITION BY chain_id, product_id) AS ns FROM safe QUALIFY row_number() OVER (PARTITION BY chain_id, product_id ORDER BY wape, abs(bias), stability, rf) = 1),
decided AS (SELECT t.chain_id, t.product_id, t.ns, t.nc, s.wape IS NOT NULL AND s.wape - t.wape < 0.25 AND t.family <> 'statistical' AS tie, t.family, t.model, t.wape, t.observations, t.windows,
  s.model AS smodel, s.wape AS swape, s.observations AS so, s.windows AS sw FROM top t LEFT JOIN safe s ON s.chain_id = t.chain_id AND s.product_id = t.product_id AND s.family = 'statistical')
"""


@query("b16_recommendation", BLENDED.rstrip() + "," + REC_SQL + """
SELECT chain_id, product_id, CASE WHEN tie THEN 'statistical' ELSE family END AS family, CASE WHEN tie THEN smodel ELSE model END AS model, CASE WHEN tie THEN swape ELSE wape END AS wape,
 CASE WHEN CASE WHEN tie THEN so ELSE observations END >= 24 AND CASE WHEN tie THEN sw ELSE windows END >= 3 AND nc > 1 THEN 'Alta' WHEN CASE WHEN tie THEN so ELSE observations END >= 12 AND nc > 1 THEN 'Media' ELSE 'Baja' END AS confidence,
 CASE WHEN ns = 1 THEN 'SUGGESTED_ONLY_ELIGIBLE' ELSE 'SUGGESTED_RETROSPECTIVE' END AS status, CASE WHEN nc > 1 THEN 'COMPARABLE' ELSE 'ONLY_ELIGIBLE_CANDIDATE' END AS comparison_status, tie AS practical_tie FROM decided""")
def recommendation(t: Tables):
    rows = blended(t)
    named = rows.groupBy(*CP).agg(F.max_by("model", "issue").alias("name"))
    long = rows.drop("model").join(named, CP).select(
        *CP, "issue", "period", "horizon", "actual",
        F.inline(F.array(*[
            F.struct(F.lit(family).alias("family"), model.alias("model"), F.col(family).alias("forecast"))
            for family, model in (("statistical", F.col("name")), ("ml", F.lit("linear")), ("ensemble", F.lit("blend")))
        ])),
    )

    def at(h: int):
        hit = F.col("horizon") == h
        e = F.sum(F.when(hit, F.abs(F.col("actual") - F.col("forecast"))))
        return rounded(F.try_divide(100 * e, F.sum(F.when(hit, F.col("actual")))))

    point = F.concat_ws(",", pr.label("issue"), pr.label("period"), F.col("horizon").cast("string"), F.col("actual").cast("string"))
    scored = long.groupBy(*CP, "family", "model").agg(
        *em.error_metrics(F.col("actual"), F.col("forecast"), "generic"), F.count_distinct("period").alias("windows"),
        *[at(h).alias(f"h{h}") for h in (1, 2, 3)], F.count_distinct("horizon").alias("horizons"),
        F.sha2(F.array_join(F.array_sort(F.collect_set(point)), ";"), 256).alias("signature"),  # of at most folds x horizons rows
    )
    return sel.recommend(scored, CP)


@query("g20_forecast_quality_gate", with_(PANEL_BASE, PAIRS_SQL) + f"""
, hm AS (SELECT chain_id, product_id, horizon, {r('100 * sum(abs(actual - last)) / nullif(sum(actual), 0)')} AS c, {r('100 * sum(abs(actual - mean3)) / nullif(sum(actual), 0)')} AS b FROM pairs GROUP BY ALL),
mx AS (SELECT chain_id, product_id, max(c - b) FILTER (WHERE horizon IN (1, 2, 3)) AS degradation FROM hm GROUP BY ALL),
ov AS (SELECT chain_id, product_id, {r('100 * sum(abs(actual - last)) / sum(actual)')} AS cw, {r('100 * sum(actual - last) / sum(actual)')} AS cb, {r('100 * sum(abs(actual - mean3)) / sum(actual)')} AS bw, {r('100 * sum(actual - mean3) / sum(actual)')} AS bb FROM pairs GROUP BY ALL HAVING sum(actual) > 0)
SELECT chain_id, product_id, cw AS candidate_wape, bw AS baseline_wape, {r('degradation')} AS degradation, CASE WHEN abs(cb) > 5 + abs(bb) OR cw > bw - 0.25 THEN 'FORECAST_QUALITY_BLOCKED' WHEN degradation > 2 THEN 'FORECAST_QUALITY_WARNING' ELSE 'FORECAST_QUALITY_READY' END AS status FROM ov JOIN mx USING (chain_id, product_id)""")
def forecast_quality_gate(t: Tables):
    def level(model: str):
        rows = lpairs(t).filter(F.col("model") == model)
        per_h = rows.groupBy(*CP, "horizon").agg(*em.error_metrics(F.col("actual"), F.col("forecast"), "generic"))
        rates = per_h.filter(F.col("horizon").isin(1, 2, 3)).groupBy(*CP).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("horizon", "wape"))), lambda x: x["wape"]).alias("horizon_rates")
        )
        total = rows.groupBy(*CP).agg(*em.error_metrics(F.col("actual"), F.col("forecast"), "generic")).filter("wape IS NOT NULL")
        return total.join(rates, CP, "left")

    return sel.quality_gate(level("last"), level("mean3"), CP).select(
        *CP, F.col("cw").alias("candidate_wape"), F.col("bw").alias("baseline_wape"), rounded(F.col("degradation")).alias("degradation"), "status"
    )


# Published forecast --------------------------------------------------------------------------

OFFICIAL_SQL = """
inc AS (SELECT * FROM wcand WHERE strategy = 'statistical'),
el AS (SELECT b.chain_id, b.strategy <> 'statistical' AND least(i.wape, 60e0) - b.wape >= 0.25 AND b.observations >= 24 AND b.windows >= 3 AND abs(b.bias) <= abs(i.bias) + 5 AND b.stability <= i.stability + 10 AND b.score < i.score AS eligible
  FROM bst b JOIN inc i USING (chain_id)),
off AS (SELECT w.chain_id, w.strategy, w.statistical_weight AS wt, w.wape, w.stability FROM wcand w JOIN el USING (chain_id) JOIN bst b USING (chain_id) WHERE w.statistical_weight = CASE WHEN eligible THEN b.statistical_weight ELSE 1e0 END),
ores AS (SELECT chain_id, product_id, horizon, actual - greatest(0e0, statistical * wt + ml * (1 - wt)) AS residual FROM rec JOIN off USING (chain_id)),
oq AS (SELECT chain_id, product_id, horizon, count(*) AS n, quantile_cont(residual, [0.1, 0.9, 0.95]) AS q FROM ores GROUP BY ALL),
aq AS (SELECT chain_id, horizon, count(*) AS n, quantile_cont(residual, [0.1, 0.9, 0.95]) AS q FROM ores GROUP BY ALL),
nxt AS (SELECT p.*, off.strategy, wt, wape, stability, greatest(0e0, statistical * wt + ml * (1 - wt)) AS value, 100 * abs(statistical - ml) / greatest(abs(statistical), 1e0) AS dv,
    coalesce(oq.n, aq.n, 0) AS n, coalesce(oq.q, aq.q) AS q, CASE WHEN coalesce(oq.n, aq.n, 0) < 5 THEN sqrt(p.horizon) ELSE 1e0 END AS sc
  FROM paired p JOIN off USING (chain_id) LEFT JOIN oq USING (chain_id, product_id, horizon) LEFT JOIN aq USING (chain_id, horizon) WHERE p.issue = """ + ISSUE_SQL + """ AND p.actual IS NULL)
"""


def official(t: Tables):
    """The strategy in use of each chain: the best candidate if it may challenge, the statistical one otherwise."""
    states = sel.strategy_states(sel.weight_search(records(t), ["chain_id"]), ["chain_id"], reference_wape=60.0)
    rank = F.when(F.col("state") == "challenger", 0).when(F.col("state") == "champion", 1)
    fields = F.struct("strategy", F.col("statistical_weight").alias("w"), "wape", "stability")
    return states.filter(rank.isNotNull()).groupBy("chain_id").agg(F.min_by(fields, rank).alias("o")).select("chain_id", "o.*")


@query("f28_published_forecast", WHOLE_SQL.rstrip() + ",\n" + WEIGHT_SQL.strip() + ", " + BEST_SQL + "," + OFFICIAL_SQL + f"""
SELECT chain_id, product_id, horizon, {ym('period')} AS target, strategy, statistical, ml, wt AS statistical_weight, {rs('value')} AS value, {rs('dv')} AS divergence, dv >= 30 AS divergence_alert, n AS comparable,
  CASE WHEN pts >= 7 THEN 'Alta' WHEN pts >= 4 THEN 'Media' ELSE 'Baja' END AS confidence,
  {rs('least(value, greatest(0e0, value + q[1] * sc))')} AS p10, {rs('greatest(value, value + q[2] * sc)')} AS p90, {rs('greatest(greatest(value, value + q[2] * sc), value + q[3] * sc)')} AS p95
FROM (SELECT *, CASE WHEN wape <= 20 THEN 2 WHEN wape <= 35 THEN 1 ELSE 0 END + CASE WHEN stability <= 8 THEN 2 WHEN stability <= 18 THEN 1 ELSE 0 END + CASE WHEN dv <= 15 THEN 2 WHEN dv <= 30 THEN 1 ELSE 0 END
  + CASE WHEN n >= 120 THEN 2 WHEN n >= 48 THEN 1 ELSE 0 END AS pts FROM nxt)""")
def published_forecast(t: Tables):
    """Twelve months of every series by its chain's strategy, with bands of the records' residuals and a confidence.

    Bands come from the series' own records at the same horizon, widened by the root of the horizon if there are fewer
    than five, or from those of the whole chain.
    """
    weights = official(t)
    value = sel.blend(F.col("statistical"), F.col("ml"), F.col("w"))
    residuals = cut_lineage(records(t).join(weights.select("chain_id", "w"), "chain_id").select(*CP, "horizon", (F.col("actual") - value).alias("residual")))
    probabilities = F.array(*[F.lit(p) for p in bands.PROBABILITIES])
    # a series has at most as many records at a horizon as there are folds
    own = residuals.groupBy(*CP, "horizon").agg(F.count("residual").alias("n_own"), F.percentile("residual", probabilities).alias("q_own"))
    wide = exact_quantiles(residuals, ["chain_id", "horizon"], "residual", bands.PROBABILITIES).withColumnsRenamed({"n": "n_all", "quantiles": "q_all"})
    rows = future_records(t).join(weights, "chain_id").join(own, [*CP, "horizon"], "left").join(wide, ["chain_id", "horizon"], "left")
    rows = rows.withColumns({
        "value": value, "n": F.coalesce("n_own", "n_all", F.lit(0)), "q": F.coalesce("q_own", "q_all"), "divergence": sel.divergence(F.col("statistical"), F.col("ml")),
    })
    b = bands.ordered_bands(F.col("value"), F.col("q"), 4, F.when(F.col("n") < 5, F.sqrt("horizon")).otherwise(1.0))
    return rows.select(
        *CP, "horizon", pr.label("period").alias("target"), "strategy", "statistical", "ml", F.col("w").alias("statistical_weight"), rounded(snapped(F.col("value"))).alias("value"),
        rounded(snapped(F.col("divergence"))).alias("divergence"), (F.col("divergence") >= 30).alias("divergence_alert"), F.col("n").alias("comparable"),
        sel.confidence(F.col("wape"), F.col("stability"), F.col("divergence"), F.col("n")).alias("confidence"), *[b[n].alias(n) for n in ("p10", "p90", "p95")],
    )
