"""Forecast models and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthmill.functions.numbers import rounded
from monthmill.functions.periods import label
from monthmill.operators import backtest as bt, kernel
from monthmill.operators import models as m
from monthmill.operators.series import island_values
from monthmill.plans.registry import query
from monthmill.plans.sql_parts import (
    BASE, BRAND_VALS, ISLAND_VALS, PANEL_BASE, PART_BASE, PART_VALS, PATHS, r, with_, ym,
)
from monthmill.sources.tables import ISSUE, SERIES, Tables

CP = ["chain_id", "product_id"]
SPLIT = "split_part(sid, '|', 1) AS chain_id, split_part(sid, '|', 2) AS product_id"
BRAND_SQL = with_(BASE, BRAND_VALS, PATHS)
PART_SQL = with_(PART_BASE, PART_VALS, PATHS)


def _model_query(name: str, model: str, part: bool) -> None:
    keys = ["part_id"] if part else CP
    prefix = PART_SQL if part else BRAND_SQL
    ids = "CAST(sid AS BIGINT) AS part_id" if part else SPLIT
    sql = prefix + f"""
    SELECT {ids}, step AS horizon, {r('greatest(0e0, pred)', 2)} AS forecast
    FROM paths WHERE model = '{model}' AND (sid, origin) IN (SELECT sid, n FROM vals)"""

    @query(name, sql)
    def build(t: Tables):
        series = t.part_values if part else t.brand_values
        paths = m.forecast_paths(series, keys, m.LAST_ORIGIN, [model])
        return paths.select(*keys, F.posexplode("path").alias("p", "raw")).select(
            *keys, (F.col("p") + 1).alias("horizon"), rounded(F.greatest(F.lit(0.0), F.col("raw")), 2).alias("forecast")
        )


for _name, _model, _part in [
    ("f01_naive", "Naive", False), ("f02_seasonal_naive", "Naive estacional", False),
    ("f03_moving_average_3", "Media móvil 3", False), ("f03_moving_average_6", "Media móvil 6", False),
    ("f03_moving_average_12", "Media móvil 12", False), ("f04_weighted_moving_average", "Media móvil ponderada", False),
    ("f05_ses", "SES", False), ("f06_holt", "Holt", False), ("f07_holt_winters", "Holt-Winters", False),
    ("f08_linear_trend", "Tendencia lineal", False), ("f09_quadratic_trend", "Tendencia polinómica", False),
    ("f10_croston", "Croston", True), ("f11_sba", "SBA", True), ("f12_tsb", "TSB", True),
]:
    _model_query(_name, _model, _part)


CLASS_SQL = """
cls AS (
  SELECT sid, n, npos, n / nullif(npos, 0) AS adi, coalesce(cv2, 0e0) AS cv2, ts,
         coalesce(sc, 0e0) AS sc,
         CASE WHEN npos = 0 OR n / npos >= 3.0 THEN 'Altamente intermitente' WHEN n / npos >= 1.32 THEN 'Intermitente'
              WHEN coalesce(sc, 0e0) >= 0.55 AND ts < 0.03 THEN 'Estacional' WHEN ts >= 0.035 THEN 'Tendencia'
              WHEN coalesce(cv2, 0e0) >= 0.49 THEN 'Irregular' ELSE 'Regular' END AS demand_class
  FROM (SELECT a.sid, count(*) AS n, count(*) FILTER (WHERE a.v > 0) AS npos,
               CASE WHEN count(*) FILTER (WHERE a.v > 0) > 1
                    THEN (count(*) FILTER (WHERE a.v > 0) * sum(a.v * a.v) - sum(a.v) * sum(a.v)) / (sum(a.v) * sum(a.v)) END AS cv2,
               CASE WHEN avg(a.v) > 0 AND count(*) > 4 THEN abs((count(*) * sum(a.idx * a.v) - sum(a.idx) * sum(a.v)) / (count(*) * sum(a.idx * a.idx) - sum(a.idx) * sum(a.idx))) / (sum(a.v) / count(*)) ELSE 0e0 END AS ts,
               CASE WHEN count(*) >= 24 THEN corr(a.v, b.v) END AS sc
        FROM vals a LEFT JOIN vals b ON b.sid = a.sid AND b.idx = a.idx - 12 GROUP BY a.sid))
"""


@query("g14_demand_class", with_(PART_BASE, PART_VALS, CLASS_SQL) + f"""
SELECT CAST(sid AS BIGINT) AS part_id, demand_class, {r('coalesce(adi, 999e0)', 3)} AS adi, {r('cv2', 3)} AS cv2,
       {r('ts', 3)} AS trend_strength, {r('sc', 3)} AS seasonal_correlation FROM cls""")
def demand_class(t: Tables):
    return m.classify(t.part_values, ["part_id"]).select(
        "part_id", "demand_class", rounded(F.col("adi"), 3).alias("adi"), rounded(F.col("cv2"), 3).alias("cv2"),
        rounded(F.col("trend_strength"), 3).alias("trend_strength"),
        rounded(F.col("seasonal_corr"), 3).alias("seasonal_correlation"),
    )


ALLOWED_SQL = """
reg AS (
  SELECT * FROM (VALUES ('Naive', 1, 1), ('Naive estacional', 12, 2), ('Media móvil 3', 3, 3), ('Media móvil 6', 6, 4),
    ('Media móvil 12', 12, 5), ('Media móvil ponderada', 3, 6), ('SES', 1, 7), ('Holt', 3, 8), ('Holt-Winters', 24, 9),
    ('Tendencia lineal', 3, 10), ('Tendencia polinómica', 4, 11), ('Croston', 1, 12), ('SBA', 1, 13), ('TSB', 1, 14)) x(model, need, pos)),
sparse AS (SELECT unnest(['Naive', 'Media móvil 3', 'SES', 'Croston', 'SBA', 'TSB']) AS model)
"""


@query("f13_allowed_models", with_(PART_BASE, PART_VALS, CLASS_SQL, ALLOWED_SQL) + """
SELECT CAST(sid AS BIGINT) AS part_id, model FROM cls, reg
WHERE demand_class NOT LIKE '%ntermitente%' OR model IN (SELECT model FROM sparse)""")
def allowed_models(t: Tables):
    return m.classify(t.part_values, ["part_id"]).select("part_id", F.explode(bt.allowed(F.col("demand_class"))).alias("model"))


@query("f14_model_requirements", with_(PART_BASE, PART_VALS, CLASS_SQL, ALLOWED_SQL) + """
SELECT CAST(sid AS BIGINT) AS part_id, count(*) FILTER (WHERE n >= need) AS usable,
       count(*) FILTER (WHERE n < need) AS short, min(CASE WHEN n < need THEN need END) AS next_need FROM cls, reg GROUP BY sid""")
def model_requirements(t: Tables):
    need = F.array(*[F.lit(v) for v in m.REQUIREMENTS.values()])
    return t.part_values.select("part_id", F.size("values").alias("n"), need.alias("need")).select(
        "part_id",
        F.size(F.filter("need", lambda k: k <= F.col("n"))).cast("long").alias("usable"),
        F.size(F.filter("need", lambda k: k > F.col("n"))).cast("long").alias("short"),
        F.array_min(F.filter("need", lambda k: k > F.col("n"))).alias("next_need"),
    )


BT_SQL = f"""
bt AS (
  SELECT p.sid, p.model, p.origin, p.step, a.n, a.v AS actual, a.period, {r('greatest(0e0, p.pred)', 2)} AS pred
  FROM paths p JOIN vals a ON a.sid = p.sid AND a.idx = p.origin + p.step WHERE p.origin >= 6),
hz AS (SELECT unnest([1, 3, 6, 12]) AS h),
win AS (
  SELECT sid, model, h AS horizon, count(*) FILTER (WHERE step = 1) AS origins, count(*) AS observations,
    CASE WHEN sum(actual) <> 0 THEN {r('100 * (sum(abs(q)) / 1e4) / sum(actual)', 2)}
         WHEN sum(abs(pred)) = 0 THEN 0e0 ELSE 999e0 END AS wape,
    CASE WHEN sum(actual) <> 0 THEN {r('100 * (sum(q) / 1e4) / sum(actual)', 2)} ELSE 0e0 END AS bias,
    {r('(sum(abs(q)) / 1e4) / count(*)', 2)} AS mae, {r('sqrt(avg((actual - pred) ** 2))', 2)} AS rmse,
    {r('100 * stddev_pop(abs(actual - pred)) / CASE WHEN avg(actual) <> 0 THEN avg(actual) ELSE 1e0 END', 2)} AS stability
  FROM (SELECT *, floor((actual - pred) * 1e4 + 0.5e0) AS q FROM bt), hz WHERE step <= h AND origin + h <= n AND origin >= CASE WHEN h >= 6 THEN 12 ELSE 6 END
  GROUP BY sid, model, h),
agg AS (
  SELECT sid, model, floor(sum(floor(wape * 100e0 + 0.5e0) * origins) / sum(origins) + 0.5e0) / 100e0 AS wape,
         floor(sum(floor(bias * 100e0 + 0.5e0) * origins) / sum(origins) + 0.5e0) / 100e0 AS bias,
         floor(sum(floor(stability * 100e0 + 0.5e0) * origins) / sum(origins) + 0.5e0) / 100e0 AS stability,
         CAST(sum(origins) AS BIGINT) AS origins FROM win GROUP BY sid, model),
scored AS (SELECT *, {r('wape + abs(bias) * 0.25e0 + stability * 0.15e0', 2)} AS score FROM agg)
"""


@query("b01_rolling_origin", with_(BASE, BRAND_VALS, PATHS, BT_SQL) + f"""
SELECT {SPLIT}, model, horizon, origins, observations, wape, bias, mae, rmse, stability FROM win""")
def rolling_origin(t: Tables):
    return kernel.backtest(t.brand_values, CP).select(
        *CP, "model", "horizon", "origins", "observations", "wape", "bias", "mae", "rmse", "stability")


@query("g11_weighted_metrics", with_(BASE, BRAND_VALS, PATHS, BT_SQL) + f"""
SELECT {SPLIT}, model, wape, bias, stability, origins, score FROM scored""")
def weighted_metrics(t: Tables):
    return bt.weighted_score(kernel.backtest(t.brand_values, CP), CP)


@query("b02_one_step_history", with_(BASE, BRAND_VALS, PATHS, BT_SQL) + f"""
SELECT {SPLIT}, model, {ym('period')} AS period, actual, pred AS forecast FROM bt WHERE step = 1""")
def one_step_history(t: Tables):
    return kernel.one_step(t.brand_values, CP).select(*CP, "model", label(F.col("period")).alias("period"), "actual", F.col("pred").alias("forecast"))


RUN_SQL = """
best AS (
  SELECT s.*, c.demand_class FROM scored s JOIN cls c USING (sid) JOIN reg USING (model)
  WHERE demand_class NOT LIKE '%ntermitente%' OR model IN (SELECT model FROM sparse)
  QUALIFY row_number() OVER (PARTITION BY sid ORDER BY score, pos) = 1),
tail3 AS (SELECT sid, count(*) = 3 AND max(abs(v)) = 0 AS still FROM vals WHERE idx > n - 3 GROUP BY sid),
run AS (
  SELECT c.sid, c.demand_class, b.model AS winner, b.wape, b.bias, b.stability, b.score,
    CASE WHEN b.sid IS NULL THEN '' ELSE concat_ws(',', CASE WHEN b.wape >= 50 THEN 'accuracy' END,
      CASE WHEN abs(b.bias) >= 25 THEN 'bias' END, CASE WHEN t.still THEN 'no_movement' END) END AS alerts, b.sid IS NULL AS none
  FROM cls c JOIN tail3 t USING (sid) LEFT JOIN best b USING (sid)),
res AS (SELECT *, CASE WHEN none THEN 'insufficient' WHEN alerts <> '' THEN 'completed_with_alerts' ELSE 'completed' END AS status FROM run)
"""


@query("b03_series_run", with_(BASE, BRAND_VALS, PATHS, BT_SQL, CLASS_SQL, ALLOWED_SQL, RUN_SQL) + f"""
SELECT {SPLIT}, demand_class, winner, wape, bias, stability, score, alerts, status FROM res""")
def series_run(t: Tables):
    return bt.run_series(t.brand_values, CP)


@query("b03_series_run_parts", with_(PART_BASE, PART_VALS, PATHS, BT_SQL, CLASS_SQL, ALLOWED_SQL, RUN_SQL) + """
SELECT CAST(sid AS BIGINT) AS part_id, demand_class, winner, wape, bias, stability, score, alerts, status FROM res""")
def series_run_parts(t: Tables):
    return bt.run_series(t.part_values, ["part_id"])


RESULT_SQL = with_(BASE, BRAND_VALS, PATHS, BT_SQL, CLASS_SQL, ALLOWED_SQL, RUN_SQL)


@query("b03_series_forecast", RESULT_SQL + f"""
SELECT {SPLIT}, winner, step AS horizon, {ym('last_p + to_months(step)')} AS period, {r('greatest(0e0, pred)', 2)} AS forecast
FROM res JOIN (SELECT sid, max(period) AS last_p, max(n) AS n FROM vals GROUP BY sid) USING (sid) JOIN paths p USING (sid) WHERE p.model = winner AND p.origin = n""")
def series_forecast(t: Tables):
    """The winner's twelve months after the last month of its series."""
    ahead = bt.series_results(t.brand_values, CP).select(*CP, "winner", F.element_at("periods", -1).alias("last"), F.posexplode("forecast").alias("p", "forecast"))
    step = F.col("p") + 1
    return ahead.select(*CP, "winner", step.alias("horizon"), label(F.add_months("last", step)).alias("period"), "forecast")


@query("b03_series_comparisons", RESULT_SQL + f"""
SELECT {SPLIT}, model, wape, bias, stability, score, origins, model = winner AS selected FROM scored JOIN res USING (sid)
WHERE demand_class NOT LIKE '%ntermitente%' OR model IN (SELECT model FROM sparse)""".replace("wape, bias, stability, score, origins", "scored.wape, scored.bias, scored.stability, scored.score, origins"))
def series_comparisons(t: Tables):
    out = bt.series_results(t.brand_values, CP).select(*CP, "winner", F.explode("comparisons").alias("c"))
    return out.select(*CP, "c.model", "c.wape", "c.bias", "c.stability", "c.score", "c.origins", (F.col("c.model") == F.col("winner")).alias("selected"))


@query("b03_series_history", RESULT_SQL + f"""
SELECT {SPLIT}, {ym('period')} AS period, pred AS forecast FROM bt JOIN res USING (sid) WHERE step = 1 AND model = winner""")
def series_history(t: Tables):
    """The winner's forecast of each month from the one before, as it would have been."""
    rows = bt.series_results(t.brand_values, CP).select(*CP, "periods", F.posexplode("history").alias("p", "forecast"))
    return rows.filter("forecast is not null").select(*CP, label(F.element_at("periods", F.col("p") + 7)).alias("period"), "forecast")
