"""Closure, live scoring, decisions and their read models."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from monthmill.functions import periods as pr
from monthmill.functions.numbers import rounded
from monthmill.operators import closure as cl, decisions as dc, live as lv, metrics as em, quality as ql, reporting as rep, versions as vs
from monthmill.plans.registry import query
from monthmill.plans.scoring import EVID_SQL, PAIRS_SQL, RES_SQL, lpairs, metric_sql, pairs, residuals
from monthmill.plans.sql_parts import BASE, ISSUE as ISSUE_SQL, PANEL_BASE, r, with_, ym
from monthmill.sources.tables import ISSUE, SERIES, Tables

CP = ["chain_id", "product_id"]
NTZ = "timestamp_ntz"

# Calculations are frozen every month for every series: last value, mean of three
# months and their blend, with creation times that are partly too late.
CALC_SQL = """
calc AS (
  SELECT chain_id || '|' || product_id || '|' || strftime(period, '%Y-%m') AS calculation_id, chain_id, product_id, category_id, period AS issue, bn,
    CAST(period AS TIMESTAMP) + to_days(CAST((bn % 3) * 20 + 5 AS INTEGER)) AS created_at, CAST(month(period) AS INTEGER) AS mo,
    CASE month(period) % 3 WHEN 0 THEN 'READY_FOR_DECISION' WHEN 1 THEN 'DECIDED' ELSE 'SUPERSEDED' END AS status,
    CASE WHEN month(period) % 2 = 0 THEN 'STATISTICAL' ELSE 'ML' END AS suggested, 'v' || (bn % 2) AS engine, sales AS sv, m3 AS mv
  FROM (SELECT *, CAST(substr(product_id, 7) AS INTEGER) AS bn, avg(sales) OVER (PARTITION BY chain_id, product_id ORDER BY idx ROWS 2 PRECEDING) AS m3 FROM panel) WHERE sales IS NOT NULL),
hor AS (SELECT calc.*, h AS horizon, CAST(issue + to_months(h) AS DATE) AS target, sv AS statistical_value, mv AS ml_value, sv * 0.5e0 + mv * 0.5e0 AS ensemble_value
  FROM calc, (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS h)),
seln AS (SELECT calculation_id, CASE bn % 4 WHEN 1 THEN 'STATISTICAL' WHEN 2 THEN 'ML' ELSE 'ENSEMBLE' END AS selected_candidate, created_at + INTERVAL 3 DAY AS selected_at FROM calc WHERE bn % 4 <> 0),
salev AS (SELECT chain_id, product_id, period AS target, 1 AS ver, delivery AS actual, orders, delivery, CAST(period AS TIMESTAMP) + INTERVAL 1 MONTH + INTERVAL 4 DAY AS first_av FROM panel WHERE sales IS NOT NULL
  UNION ALL SELECT chain_id, product_id, period, 2, sales, orders, delivery, CAST(period AS TIMESTAMP) + INTERVAL 1 MONTH + INTERVAL 4 DAY FROM panel WHERE sales IS NOT NULL),
elig AS (SELECT h.*, s.ver, s.actual, s.orders, s.delivery, n.selected_candidate FROM hor h JOIN salev s ON s.chain_id = h.chain_id AND s.product_id = h.product_id AND s.target = h.target
  LEFT JOIN seln n ON n.calculation_id = h.calculation_id AND n.selected_at < CAST(h.target AS TIMESTAMP) AND n.selected_at <= s.first_av
  WHERE h.created_at < CAST(h.target AS TIMESTAMP) AND h.created_at < s.first_av),
liv AS (SELECT *, actual - forecast AS se, abs(actual - forecast) AS ae FROM (
  SELECT *, 'STATISTICAL' AS candidate, statistical_value AS forecast FROM elig UNION ALL SELECT *, 'ML', ml_value FROM elig UNION ALL SELECT *, 'ENSEMBLE', ensemble_value FROM elig
  UNION ALL SELECT *, 'SELECTED', CASE selected_candidate WHEN 'STATISTICAL' THEN statistical_value WHEN 'ML' THEN ml_value WHEN 'ENSEMBLE' THEN ensemble_value END FROM elig) WHERE forecast IS NOT NULL)
"""
CALC = with_(PANEL_BASE, CALC_SQL)


def calculations(t: Tables):
    w = Window.partitionBy(*SERIES).orderBy("idx").rowsBetween(-2, 0)
    bn = F.substring("product_id", 7, 9).cast("int")
    mo = F.month("issue")
    rows = t.panel.withColumn("m3", F.avg("sales").over(w)).filter("sales IS NOT NULL").withColumnRenamed("period", "issue")
    return rows.select(
        F.concat_ws("|", "chain_id", "product_id", pr.label("issue")).alias("calculation_id"), *SERIES, "issue", bn.alias("bn"),
        F.date_add("issue", (bn % 3) * 20 + 5).cast(NTZ).alias("created_at"), mo.alias("mo"),
        F.when(mo % 3 == 0, "READY_FOR_DECISION").when(mo % 3 == 1, "DECIDED").otherwise("SUPERSEDED").alias("status"),
        F.when(mo % 2 == 0, "STATISTICAL").otherwise("ML").alias("suggested_candidate"),
        F.concat(F.lit("v"), (bn % 2).cast("string")).alias("engine"),
        F.col("sales").alias("statistical_value"), F.col("m3").alias("ml_value"),
        (F.col("sales") * 0.5 + F.col("m3") * 0.5).alias("ensemble_value"),
    )


def horizons(t: Tables):
    return calculations(t).withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn(
        "target_period", F.add_months("issue", F.col("horizon"))
    )


def selections(t: Tables):
    return calculations(t).filter("bn % 4 <> 0").select(
        "calculation_id", F.concat(F.lit("S-"), "calculation_id").alias("selection_id"),
        F.when(F.col("bn") % 4 == 1, "STATISTICAL").when(F.col("bn") % 4 == 2, "ML").otherwise("ENSEMBLE").alias("selected_candidate"),
        (F.col("created_at") + F.expr("interval 3 days")).alias("selected_at"),
    )


def sale_versions(t: Tables):
    rows = t.panel.filter("sales IS NOT NULL").withColumnRenamed("period", "target_period")
    return rows.select(
        *CP, "target_period", "orders", "delivery",
        (F.add_months("target_period", 1).cast(NTZ) + F.expr("interval 4 days")).alias("first_available_at"),
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("sale_version"), F.col("delivery").alias("actual")),
                F.struct(F.lit(2).alias("sale_version"), F.col("sales").alias("actual")),
            )
        ),
    )


def evaluated(t: Tables):
    rows = lv.eligible(horizons(t), sale_versions(t), CP)
    # one selection per calculation here, so its rules are plain filters after one join
    chosen = rows.join(selections(t).drop("selection_id"), "calculation_id", "left")
    in_force = (F.col("selected_at") < F.col("target_period").cast(NTZ)) & (F.col("selected_at") <= F.col("first_available_at"))
    return lv.live_rows(chosen.withColumn("selected_candidate", F.when(in_force, F.col("selected_candidate"))))


@query("j07_live_eligibility", CALC + f"""
SELECT chain_id, {ym('target')} AS target, horizon, count(*) AS eligible FROM elig GROUP BY ALL""")
def live_eligibility(t: Tables):
    return lv.eligible(horizons(t), sale_versions(t), CP).groupBy("chain_id", pr.label("target_period").alias("target"), "horizon").agg(
        F.count(F.lit(1)).alias("eligible")
    )


@query("j08_choice_in_force", CALC + f"""
SELECT calculation_id, horizon, {ym('target')} AS target, selected_candidate FROM elig WHERE ver = 2""")
def choice_in_force(t: Tables):
    rows = lv.eligible(horizons(t), sale_versions(t).filter("sale_version = 2"), CP)
    return lv.choice_in_force(rows, selections(t)).select(
        "calculation_id", "horizon", pr.label("target_period").alias("target"), "selected_candidate"
    )


@query("l01_live_rows", CALC + f"""
SELECT calculation_id, horizon, candidate, ver AS sale_version, {r('forecast')} AS forecast, actual, {r('ae')} AS absolute_error, {r('CASE WHEN actual > 0 THEN 100 * ae / actual END')} AS ape FROM liv""")
def live_rows(t: Tables):
    return evaluated(t).select(
        "calculation_id", "horizon", "candidate", "sale_version", rounded(F.col("forecast")).alias("forecast"), "actual",
        rounded(F.col("absolute_error")).alias("absolute_error"), rounded(F.col("ape")).alias("ape"),
    )


@query("g35_live_metrics", CALC + f"""
SELECT candidate, horizon, count(*) AS evaluations, {r('100 * sum(ae) / sum(actual)')} AS wape, {r('100 * sum(se) / sum(actual)')} AS bias,
  {r('100 * sum(delivery) FILTER (WHERE orders IS NOT NULL) / sum(orders) FILTER (WHERE delivery IS NOT NULL)')} AS fill_rate
FROM (SELECT * FROM liv QUALIFY row_number() OVER (PARTITION BY calculation_id, candidate, horizon, target ORDER BY ver DESC) = 1) GROUP BY ALL""")
def live_metrics(t: Tables):
    return lv.live_metrics(evaluated(t), ["candidate", "horizon"])


@query("l02_learning_events", CALC + f"""
, ev AS (SELECT calculation_id, chain_id, product_id, horizon, target, ver, any_value(suggested) AS suggested, any_value(selected_candidate) AS sel, any_value(actual) AS a, any_value(orders) AS o, any_value(delivery) AS d,
  arg_min(candidate, (ae, candidate)) FILTER (WHERE candidate <> 'SELECTED') AS best, min(ae) FILTER (WHERE candidate <> 'SELECTED') AS be, max(ae) FILTER (WHERE candidate = 'SELECTED') AS se2, max(ae) FILTER (WHERE candidate = suggested) AS ge FROM liv GROUP BY ALL)
SELECT calculation_id, horizon, ver AS sale_version, best AS best_candidate, suggested AS suggested_candidate, sel AS selected_candidate, {r('se2 - be')} AS regret,
  CASE WHEN sel IS DISTINCT FROM suggested AND se2 IS NOT NULL AND ge IS NOT NULL THEN {r('ge - se2')} END AS value_added,
  concat_ws(',', CASE WHEN se2 > 0 THEN 'DEMAND_FORECAST_ERROR' END, CASE WHEN o <> a THEN 'ORDER_DEVIATION' END, CASE WHEN d > a THEN 'SELL_THROUGH_GAP' END, CASE WHEN d < o THEN 'SUPPLY_SHORTFALL' END,
   CASE WHEN o > 0 AND d / o < 0.95 THEN 'LOW_FILL_RATE' END, CASE WHEN sel IS DISTINCT FROM suggested AND se2 IS NOT NULL AND ge IS NOT NULL THEN CASE WHEN ge - se2 > 0 THEN 'DECISION_OUTPERFORMED_RECOMMENDATION' ELSE 'DECISION_UNDERPERFORMED_RECOMMENDATION' END END) AS signals FROM ev""")
def learning_events(t: Tables):
    return lv.learning_events(evaluated(t)).select(
        "calculation_id", "horizon", "sale_version", "best_candidate", "suggested_candidate", "selected_candidate", "regret", "value_added", "signals"
    )


@query("l03_calculation_completeness", CALC + """
, frozen AS (SELECT calculation_id, issue, CASE WHEN month(issue) = 2 AND horizon = 7 THEN CAST(target + INTERVAL 1 MONTH AS DATE) ELSE target END AS target, horizon, statistical_value, ml_value,
    CASE WHEN month(issue) = 3 AND horizon = 4 THEN ensemble_value + 0.03 WHEN month(issue) = 4 THEN ensemble_value + 0.01 ELSE ensemble_value END AS ensemble_value FROM hor WHERE NOT (month(issue) = 5 AND horizon = 11))
SELECT calculation_id, count(*) = 12 AND count(DISTINCT horizon) = 12 AS complete, bool_and(target = CAST(issue + to_months(horizon) AS DATE)) AS aligned,
  bool_and(abs(ensemble_value - (statistical_value * 0.5 + ml_value * 0.5)) <= 0.02) AS blend_holds FROM frozen GROUP BY calculation_id""")
def calculation_completeness(t: Tables):
    """Calculations as they were frozen: some lost a horizon, some have a shifted month or a blend that does not add up."""
    month, value = F.month("issue"), F.col("ensemble_value")
    h = horizons(t).filter(~((month == 5) & (F.col("horizon") == 11))).withColumns({
        "target_period": F.when((month == 2) & (F.col("horizon") == 7), F.add_months("target_period", 1)).otherwise(F.col("target_period")),
        "ensemble_value": F.when((month == 3) & (F.col("horizon") == 4), value + 0.03).when(month == 4, value + 0.01).otherwise(value),
    })
    blend = F.abs(F.col("ensemble_value") - (F.col("statistical_value") * 0.5 + F.col("ml_value") * 0.5)) <= 0.02
    return h.groupBy("calculation_id").agg(
        ((F.count(F.lit(1)) == 12) & (F.count_distinct("horizon") == 12)).alias("complete"),
        F.bool_and(F.col("target_period") == F.add_months("issue", F.col("horizon"))).alias("aligned"), F.bool_and(blend).alias("blend_holds"),
    )


@query("l04_selected_curve", CALC + f"""
SELECT h.calculation_id, h.horizon, {r("CASE n.selected_candidate WHEN 'STATISTICAL' THEN statistical_value WHEN 'ML' THEN ml_value ELSE ensemble_value END")} AS value, n.selected_candidate <> h.suggested AS reason_required
FROM hor h JOIN seln n USING (calculation_id)""")
def selected_curve(t: Tables):
    curves = lv.selection_curves(horizons(t), selections(t)).filter("complete")
    suggested = calculations(t).select("calculation_id", "suggested_candidate")
    return curves.join(suggested, "calculation_id").select(
        "calculation_id", F.explode("curve").alias("c"), (F.col("selected_candidate") != F.col("suggested_candidate")).alias("reason_required")
    ).select("calculation_id", F.col("c.horizon").alias("horizon"), rounded(F.col("c.value")).alias("value"), "reason_required")


@query("l14_selection_events", CALC + f"""
SELECT n.calculation_id, n.selected_candidate, strftime(n.selected_at, '%Y-%m-%d') AS selected_on, lag(n.calculation_id) OVER (PARTITION BY c.chain_id, c.product_id ORDER BY n.selected_at) AS previous_calculation,
  lead(n.calculation_id) OVER (PARTITION BY c.chain_id, c.product_id ORDER BY n.selected_at) IS NOT NULL AS superseded FROM seln n JOIN calc c USING (calculation_id)""")
def selection_events(t: Tables):
    curves = lv.selection_curves(horizons(t), selections(t)).filter("complete")
    w = Window.partitionBy(*CP).orderBy("selected_at")
    return curves.select(
        "calculation_id", "selected_candidate", F.date_format("selected_at", "yyyy-MM-dd").alias("selected_on"),
        F.lag("calculation_id").over(w).alias("previous_calculation"), F.lead("calculation_id").over(w).isNotNull().alias("superseded"),
    )


@query("l10_decision_lineage", CALC + """
, told AS (SELECT h.calculation_id, h.horizon, n.selected_candidate, CASE n.selected_candidate WHEN 'STATISTICAL' THEN statistical_value WHEN 'ML' THEN ml_value ELSE ensemble_value END AS value FROM hor h JOIN seln n USING (calculation_id)),
event AS (SELECT calculation_id, horizon, selected_candidate, CASE WHEN month(issue) = 6 AND horizon = 5 THEN value + 1 ELSE value END AS value FROM told JOIN (SELECT calculation_id, issue FROM calc) USING (calculation_id) WHERE NOT (month(issue) = 9 AND horizon = 12))
SELECT t.calculation_id, count(*) AS points, count(*) FILTER (WHERE e.calculation_id IS NULL) AS missing, count(*) FILTER (WHERE e.calculation_id IS NOT NULL AND e.value IS DISTINCT FROM t.value) AS mismatches,
  count(*) FILTER (WHERE e.calculation_id IS NULL OR e.value IS DISTINCT FROM t.value) = 0 AS valid FROM told t LEFT JOIN event e USING (calculation_id, horizon) GROUP BY t.calculation_id""")
def decision_lineage(t: Tables):
    """Curves as the events keep them, some with a changed or a lost point, against the stored horizons they were chosen from."""
    month = F.month("issue")
    points = lv.selection_curves(horizons(t), selections(t)).select("calculation_id", "selected_candidate", F.inline("curve"))
    events = points.join(calculations(t).select("calculation_id", "issue"), "calculation_id").filter(~((month == 9) & (F.col("horizon") == 12))).select(
        "calculation_id", "horizon", F.when((month == 6) & (F.col("horizon") == 5), F.col("value") + 1).otherwise(F.col("value")).alias("told"), F.lit(True).alias("there"))
    stored = horizons(t).join(selections(t).select("calculation_id", "selected_candidate"), "calculation_id")
    value = (
        F.when(F.col("selected_candidate") == "STATISTICAL", F.col("statistical_value"))
        .when(F.col("selected_candidate") == "ML", F.col("ml_value")).otherwise(F.col("ensemble_value"))
    )
    gone, other = F.col("there").isNull(), F.col("there").isNotNull() & ~F.col("told").eqNullSafe(value)
    return stored.join(events, ["calculation_id", "horizon"], "left").groupBy("calculation_id").agg(
        F.count(F.lit(1)).alias("points"), F.count_if(gone).alias("missing"), F.count_if(other).alias("mismatches"), (F.count_if(gone | other) == 0).alias("valid"))


@query("w05_latest_calculation", CALC + """
SELECT chain_id, product_id, calculation_id, status FROM calc QUALIFY row_number() OVER (PARTITION BY chain_id, product_id ORDER BY issue DESC, created_at DESC) = 1""")
def latest_calculation(t: Tables):
    return vs.latest(calculations(t).select(*CP, "calculation_id", "status", "issue", "created_at"), CP, ["issue", "created_at"]).select(
        *CP, "calculation_id", "status"
    )


@query("w06_compatible_curves", CALC + """
, chosen AS (SELECT * FROM calc QUALIFY row_number() OVER (PARTITION BY chain_id, product_id ORDER BY issue DESC, created_at DESC) = 1),
anchor AS (SELECT issue, engine FROM chosen ORDER BY issue DESC, created_at DESC, calculation_id DESC LIMIT 1)
SELECT calculation_id, chain_id, product_id FROM calc JOIN anchor USING (issue, engine)""")
def compatible_curves(t: Tables):
    chosen = vs.latest(calculations(t).select(*CP, "calculation_id", "issue", "created_at", "engine"), CP, ["issue", "created_at"])
    anchor = chosen.agg(F.max_by(F.struct("issue", "engine"), F.struct("issue", "created_at", "calculation_id")).alias("a")).select("a.*")
    return calculations(t).join(anchor, ["issue", "engine"], "left_semi").select("calculation_id", *CP)


@query("w21_latest_provisional", CALC + f"""
SELECT chain_id, product_id, year(issue) AS issue_year, arg_max(calculation_id, created_at) AS calculation_id, {r('arg_max(ml_value, created_at)')} AS value FROM (SELECT *, mv AS ml_value FROM calc) GROUP BY ALL""")
def latest_provisional(t: Tables):
    rows = calculations(t).withColumn("issue_year", F.year("issue"))
    return vs.latest(rows.select(*CP, "issue_year", "calculation_id", "ml_value", "created_at"), [*CP, "issue_year"], ["created_at"]).select(
        *CP, "issue_year", "calculation_id", rounded(F.col("ml_value")).alias("value")
    )


@query("w22_newest_champion_version", CALC + f"""
SELECT chain_id, product_id, {ym('target')} AS target, horizon, {r('arg_max(statistical_value, (created_at, calculation_id))')} AS value FROM hor GROUP BY ALL""")
def newest_champion_version(t: Tables):
    h = horizons(t).groupBy(*CP, "target_period", "horizon").agg(F.max_by("statistical_value", F.struct("created_at", "calculation_id")).alias("v"))
    return h.select(*CP, pr.label("target_period").alias("target"), "horizon", rounded(F.col("v")).alias("value"))


@query("j06_lowest_horizon", CALC + f"""
SELECT chain_id, product_id, {ym('target')} AS target, min(horizon) AS horizon, {r('arg_min(statistical_value, horizon)')} AS forecast, any_value(actual) AS actual FROM elig WHERE ver = 2 GROUP BY ALL""")
def lowest_horizon(t: Tables):
    rows = lv.eligible(horizons(t), sale_versions(t).filter("sale_version = 2"), CP)
    low = cl.lowest_horizon(rows.withColumn("forecast", F.col("statistical_value")), [*CP, "target_period", "actual"])
    return low.select(*CP, pr.label("target_period").alias("target"), "horizon", rounded(F.col("forecast")).alias("forecast"), "actual")


# Closure -----------------------------------------------------------------------------

ENG_SQL = f"""
eng AS (SELECT chain_id, model AS engine, period, {metric_sql('closure')} FROM lpairs WHERE horizon = 1 GROUP BY ALL)
"""


def engine_history(t: Tables):
    return cl.engine_metrics(lpairs(t).filter("horizon = 1").withColumnRenamed("model", "engine"), ["chain_id", "engine", "period"])


@query("l08_engine_metrics", with_(PANEL_BASE, PAIRS_SQL, ENG_SQL) + f"""
SELECT chain_id, engine, {ym('period')} AS period, wape, bias, observations, CASE WHEN bias > 0 THEN 'overforecast' WHEN bias < 0 THEN 'underforecast' ELSE 'neutral' END AS bias_direction FROM eng""")
def engine_metrics(t: Tables):
    return engine_history(t).select("chain_id", "engine", pr.label("period").alias("period"), "wape", "bias", "observations", "bias_direction")


@query("w14_rolling_accuracy", with_(PANEL_BASE, PAIRS_SQL, ENG_SQL) + f"""
SELECT chain_id, engine, {ym('period')} AS period, {', '.join(r(f'avg(floor({m} * 1e4 + 0.5e0)) OVER (PARTITION BY chain_id, engine ORDER BY period ROWS {k - 1} PRECEDING) / 1e4') + f' AS {m}_{k}' for k in (3, 6, 12) for m in ('wape', 'bias'))},
 {r('avg(floor(wape * 1e4 + 0.5e0)) OVER (PARTITION BY chain_id, engine ORDER BY period) / 1e4')} AS wape_all, count(*) OVER (PARTITION BY chain_id, engine ORDER BY period) AS closures FROM eng""")
def rolling_accuracy(t: Tables):
    return cl.rolling_accuracy(engine_history(t), ["chain_id", "engine"]).select(
        "chain_id", "engine", pr.label("period").alias("period"), *[f"{m}_{k}" for k in (3, 6, 12) for m in ("wape", "bias")], "wape_all", "closures"
    )


@query("w15_persistent_bias", with_(PANEL_BASE, PAIRS_SQL, ENG_SQL) + f"""
SELECT chain_id, engine, {ym('period')} AS period, CASE WHEN lo > 0 THEN 'overforecast' ELSE 'underforecast' END AS direction FROM (
 SELECT *, count(*) OVER w AS n, min(sign(bias)) OVER w AS lo, max(sign(bias)) OVER w AS hi FROM eng WINDOW w AS (PARTITION BY chain_id, engine ORDER BY period ROWS 3 PRECEDING)) WHERE n = 4 AND lo = hi AND lo <> 0""")
def persistent_bias(t: Tables):
    return cl.persistent_bias(engine_history(t), ["chain_id", "engine"]).select("chain_id", "engine", pr.label("period").alias("period"), "direction")


CHAL_SQL = """
pr AS (SELECT a.chain_id, a.period, a.wape AS cw, b.wape AS hw, b.bias AS hb, row_number() OVER (PARTITION BY a.chain_id ORDER BY a.period) AS pos, b.wape + 0.25e0 <= a.wape AND abs(b.bias) <= 20 AS win
  FROM eng a JOIN eng b ON a.chain_id = b.chain_id AND a.period = b.period AND a.engine = 'last' AND b.engine = 'mean3'),
ch AS (SELECT *, pos - coalesce(max(CASE WHEN NOT win THEN pos END) OVER (PARTITION BY chain_id ORDER BY period), 0) AS wins, count(*) OVER w3 >= 3 AND stddev_pop(hw) OVER w3 <= 8 AS stable FROM pr
  WINDOW w3 AS (PARTITION BY chain_id ORDER BY period ROWS 2 PRECEDING)),
crit AS (SELECT chain_id, max(CASE WHEN hb - hl > 2 THEN 1 ELSE 0 END) = 1 AS degraded FROM (
  SELECT chain_id, horizon, 100 * sum(abs(actual - mean3)) / sum(actual) AS hb, 100 * sum(abs(actual - last)) / sum(actual) AS hl FROM pairs WHERE horizon IN (1, 2, 3) GROUP BY ALL) GROUP BY chain_id)
"""


def challenger_pairs(t: Tables):
    # both engines side by side per closure: one aggregation instead of a self join
    e, is_last = engine_history(t), F.col("engine") == "last"
    return e.groupBy("chain_id", "period").agg(
        F.max(F.when(is_last, F.col("wape"))).alias("champion_wape"), F.max(F.when(~is_last, F.col("wape"))).alias("challenger_wape"),
        F.max(F.when(~is_last, F.col("bias"))).alias("challenger_bias"),
    ).filter("champion_wape IS NOT NULL AND challenger_wape IS NOT NULL")


@query("w16_consecutive_wins", with_(PANEL_BASE, PAIRS_SQL, ENG_SQL, CHAL_SQL) + f"SELECT chain_id, {ym('period')} AS period, win, wins AS consecutive_wins, stable FROM ch")
def consecutive_wins(t: Tables):
    return cl.challenger_history(challenger_pairs(t), ["chain_id"]).select(
        "chain_id", pr.label("period").alias("period"), "win", "consecutive_wins", "stable"
    )


@query("b23_challenger_state", with_(PANEL_BASE, PAIRS_SQL, ENG_SQL, CHAL_SQL) + f"""
SELECT chain_id, {ym('period')} AS period, CASE WHEN wins >= 3 AND stable AND NOT degraded THEN 'candidate_for_promotion' WHEN pos >= 3 AND wins = 0 THEN 'not_consistent' ELSE 'in_validation' END AS state FROM ch JOIN crit USING (chain_id)""")
def challenger_state(t: Tables):
    history = cl.challenger_history(challenger_pairs(t), ["chain_id"])
    a = F.col("actual")
    rate = lambda c: 100 * F.sum(F.abs(a - F.col(c))) / F.sum(a)
    per = pairs(t).filter(F.col("horizon").isin(*cl.CRITICAL_HORIZONS)).groupBy("chain_id", "horizon").agg((rate("mean3") - rate("last") > cl.MAX_CRITICAL_DEGRADATION).alias("worse"))
    critical = per.groupBy("chain_id").agg(F.bool_or("worse").alias("degraded"))
    return cl.challenger_state(history.join(critical, "chain_id"), F.col("degraded")).select("chain_id", pr.label("period").alias("period"), "state")


@query("l09_closure_validation", with_(BASE) + f"""
SELECT {ym('period')} AS period, chain_id, rule, count(*) AS series FROM (SELECT chain_id, period, unnest(list_filter([CASE WHEN sales IS NULL THEN 'missing_sale' END, CASE WHEN orders IS NULL THEN 'missing_order' END,
  CASE WHEN delivery IS NULL THEN 'missing_delivery' END, CASE WHEN sales < 0 THEN 'negative_sale' END, CASE WHEN orders = 0 AND delivery > 0 THEN 'delivery_without_order' END], lambda x: x IS NOT NULL)) AS rule FROM monthly) GROUP BY ALL""")
def closure_validation(t: Tables):
    rules = {
        "missing_sale": F.col("sales").isNull(), "missing_order": F.col("orders").isNull(), "missing_delivery": F.col("delivery").isNull(),
        "negative_sale": F.col("sales") < 0, "delivery_without_order": (F.col("orders") == 0) & (F.col("delivery") > 0),
    }
    return ql.violations(t.monthly, rules, ["chain_id", "period"]).groupBy(pr.label("period").alias("period"), "chain_id", "rule").agg(
        F.count(F.lit(1)).alias("series")
    )


@query("q03_closure_blockers", with_(PANEL_BASE, PAIRS_SQL, CALC_SQL) + f"""
SELECT severity, rule, count(*) AS n FROM (SELECT CASE WHEN w.chain_id IS NULL THEN 'blocker' END AS severity, 'missing_frozen_forecast' AS rule FROM (SELECT * FROM panel WHERE sales IS NOT NULL) p LEFT JOIN (SELECT DISTINCT chain_id, product_id, target FROM elig) w
   ON w.chain_id = p.chain_id AND w.product_id = p.product_id AND w.target = p.period
 UNION ALL SELECT CASE WHEN created_at >= CAST(target AS TIMESTAMP) THEN 'warning' END, 'forecast_not_prior' FROM hor) WHERE severity IS NOT NULL GROUP BY ALL""")
def closure_blockers(t: Tables):
    frozen = lv.eligible(horizons(t), sale_versions(t).filter("sale_version = 2"), CP).select(*CP, "target_period").distinct()
    missing = t.panel.filter("sales IS NOT NULL").withColumnRenamed("period", "target_period").join(frozen, [*CP, "target_period"], "left_anti")
    late = horizons(t).filter(F.col("created_at") >= F.col("target_period").cast(NTZ))
    rows = missing.select(F.lit("blocker").alias("severity"), F.lit("missing_frozen_forecast").alias("rule")).unionByName(
        late.select(F.lit("warning").alias("severity"), F.lit("forecast_not_prior").alias("rule"))
    )
    return rows.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("g08_vintage_close", CALC + f"""
, vc AS (SELECT chain_id, target, horizon, sum(abs(actual)) AS den, sum(abs(actual - statistical_value)) AS sa, sum(statistical_value - actual) AS ss, sum((statistical_value - actual) ** 2) AS sq, count(*) AS n FROM elig WHERE ver = 2 GROUP BY ALL),
sv AS (SELECT chain_id, period, CASE WHEN count(*) FILTER (WHERE (orders IS NULL) OR (delivery IS NULL) OR (orders = 0 AND delivery > 0)) > 0 THEN NULL WHEN sum(orders) = 0 THEN 100e0 ELSE 100 * sum(delivery) / sum(orders) END AS fr
  FROM monthly WHERE orders IS NOT NULL OR delivery IS NOT NULL GROUP BY ALL)
SELECT chain_id, {ym('target')} AS period, horizon, m.metric, {r('m.value')} AS value FROM (SELECT vc.*, fr FROM vc LEFT JOIN sv ON sv.chain_id = vc.chain_id AND sv.period = vc.target) x,
 LATERAL (VALUES ('WAPE', CASE WHEN den = 0 THEN CASE WHEN sa = 0 THEN 0e0 ELSE 100e0 END ELSE 100 * sa / den END), ('BIAS', CASE WHEN den = 0 THEN CASE WHEN ss = 0 THEN 0e0 WHEN ss > 0 THEN 100e0 ELSE -100e0 END ELSE 100 * ss / den END),
  ('MAE', sa / n), ('RMSE', sqrt(sq / n)), ('FILL_RATE', fr)) m(metric, value)""")
def vintage_close(t: Tables):
    rows = lv.eligible(horizons(t), sale_versions(t).filter("sale_version = 2"), CP)
    m = rows.groupBy("chain_id", "target_period", "horizon").agg(*em.error_metrics(F.col("actual"), F.col("statistical_value"), "vintage"))
    service = cl.observed_service(t.monthly.filter("orders IS NOT NULL OR delivery IS NOT NULL"), ["chain_id", "period"], 95.0).select(
        "chain_id", F.col("period").alias("target_period"), "fill_rate"
    )
    wide = m.join(service, ["chain_id", "target_period"], "left").select(
        "chain_id", pr.label("target_period").alias("period"), "horizon", F.col("wape").alias("WAPE"), F.col("bias").alias("BIAS"),
        F.col("mae").alias("MAE"), F.col("rmse").alias("RMSE"), F.col("fill_rate").alias("FILL_RATE"),
    )
    return wide.unpivot(["chain_id", "period", "horizon"], ["WAPE", "BIAS", "MAE", "RMSE", "FILL_RATE"], "metric", "value")


@query("g39_benchmark_improvement", with_(PANEL_BASE, PAIRS_SQL, ENG_SQL) + f"""
SELECT chain_id, {r('c')} AS customer_wape, {r('s')} AS system_wape, {r('c - s')} AS improvement_points FROM (SELECT chain_id, avg(wape) FILTER (WHERE engine = 'last') AS c, avg(wape) FILTER (WHERE engine = 'mean3') AS s FROM eng GROUP BY chain_id)""")
def benchmark_improvement(t: Tables):
    g = engine_history(t).groupBy("chain_id").agg(
        F.avg(F.when(F.col("engine") == "last", F.col("wape"))).alias("c"), F.avg(F.when(F.col("engine") == "mean3", F.col("wape"))).alias("s")
    )
    return g.select("chain_id", rounded(F.col("c")).alias("customer_wape"), rounded(F.col("s")).alias("system_wape"), rounded(F.col("c") - F.col("s")).alias("improvement_points"))


@query("g40_bias_and_fill_summary", with_(PANEL_BASE, PAIRS_SQL, ENG_SQL) + f"""
SELECT chain_id, {ym('period')} AS period, bias, CASE WHEN bias > 0 THEN 'overforecast' WHEN bias < 0 THEN 'underforecast' ELSE 'neutral' END AS bias_direction, fill_rate FROM eng
JOIN (SELECT chain_id, period, {r('100 * sum(delivery) / sum(orders)')} AS fill_rate FROM panel WHERE orders IS NOT NULL AND delivery IS NOT NULL GROUP BY ALL HAVING sum(orders) > 0) USING (chain_id, period) WHERE engine = 'mean3'""")
def bias_and_fill(t: Tables):
    e = engine_history(t).filter("engine = 'mean3'").select("chain_id", "period", "bias", "bias_direction")
    f = t.panel.filter("orders IS NOT NULL AND delivery IS NOT NULL").groupBy("chain_id", "period").agg(
        rounded(rep.fill_rate(F.sum("delivery"), F.sum("orders"))).alias("fill_rate")
    ).filter("fill_rate IS NOT NULL")
    return e.join(f, ["chain_id", "period"]).withColumn("period", pr.label("period"))


# Decisions -----------------------------------------------------------------------------

DEC_ISSUE = "2000-07-01"
DEC_SQL = f"""
pts AS (SELECT h.chain_id, h.product_id, h.category_id, h.bn, h.horizon, h.target, h.ensemble_value AS base, h.ensemble_value * 0.6e0 AS p10, h.ensemble_value * 1.4e0 AS p90, h.ensemble_value * 1.6e0 AS p95 FROM hor h WHERE issue = DATE '{DEC_ISSUE}'),
prop AS (SELECT *, (bn + horizon) % 6 AS k FROM pts),
dec AS (SELECT *, adjusted - base AS delta, CASE WHEN base = 0 AND adjusted - base = 0 THEN 0e0 WHEN base <> 0 THEN (adjusted - base) / base * 100 END AS pct FROM (
  SELECT *, CASE k WHEN 1 THEN 'absolute' WHEN 2 THEN 'percentage' WHEN 3 THEN 'final_value' WHEN 4 THEN 'absolute' WHEN 5 THEN 'guess' ELSE 'none' END AS method,
    CASE k WHEN 1 THEN base + 40 WHEN 2 THEN base * (1.0e0 + 25e0 / 100.0e0) WHEN 3 THEN 120e0 WHEN 4 THEN base - 150 ELSE base END AS adjusted,
    CASE k WHEN 1 THEN 'promotion' WHEN 2 THEN 'market_signal' WHEN 3 THEN 'stock_correction' WHEN 4 THEN 'rumour' WHEN 5 THEN 'other' ELSE 'no_adjustment' END AS reason,
    CASE k WHEN 1 THEN 'campaign' WHEN 2 THEN 'survey' WHEN 3 THEN '' WHEN 4 THEN 'talk' WHEN 5 THEN 'x' ELSE 'reviewed' END AS explanation FROM prop)),
fva AS (SELECT d.*, d.adjusted AS approved, p.sales AS actual FROM dec d JOIN panel p ON p.chain_id = d.chain_id AND p.product_id = d.product_id AND p.period = d.target WHERE p.sales IS NOT NULL AND k IN (0, 1, 2))
"""
DEC = with_(PANEL_BASE, CALC_SQL, DEC_SQL)


def points(t: Tables):
    base = F.col("ensemble_value")
    return horizons(t).filter(F.col("issue") == F.lit(DEC_ISSUE).cast("date")).select(
        *SERIES, "bn", "horizon", "target_period", base.alias("base"), (base * 0.6).alias("p10"), (base * 1.4).alias("p90"), (base * 1.6).alias("p95")
    )


def proposals(t: Tables):
    k = (F.col("bn") + F.col("horizon")) % 6
    rows = points(t).withColumn("k", k).filter("k > 0")

    def pick(*values):
        out = None
        for i, v in enumerate(values, 1):
            out = F.when(F.col("k") == i, v) if out is None else out.when(F.col("k") == i, v)
        return out

    return rows.select(
        *CP, "horizon", pick("absolute", "percentage", "final_value", "absolute", "guess").alias("method"),
        pick(40.0, 25.0, 120.0, -150.0, 0.0).alias("proposed"),
        pick("promotion", "market_signal", "stock_correction", "rumour", "other").alias("reason"),
        pick("campaign", "survey", "", "talk", "x").alias("explanation"),
    )


def decided(t: Tables):
    return dc.decide(points(t), proposals(t), [*CP, "horizon"])


def approved(t: Tables):
    """Entries without blockers, approved as adjusted, with the realised sale."""
    ok = decided(t).filter("blockers = ''").withColumn("approved", F.col("adjusted"))
    actual = t.panel.filter("sales IS NOT NULL").select(*CP, F.col("period").alias("target_period"), F.col("sales").alias("actual"))
    return ok.join(actual, [*CP, "target_period"])


@query("p28_adjusted_value", DEC + f"SELECT chain_id, product_id, horizon, method, {r('base')} AS base, {r('adjusted')} AS adjusted FROM dec")
def adjusted_value(t: Tables):
    return decided(t).select(*CP, "horizon", "method", rounded(F.col("base")).alias("base"), rounded(F.col("adjusted")).alias("adjusted"))


@query("p29_band_position", DEC + """
SELECT chain_id, product_id, horizon, adjusted >= p10 AND adjusted <= p90 AS within_p90, adjusted > p95 AS outside_p95, adjusted < p10 AS below_p10, (pct IS NULL OR abs(pct) >= 20) AND delta <> 0 AS significant FROM dec""")
def band_position(t: Tables):
    return decided(t).select(*CP, "horizon", "within_p90", "outside_p95", "below_p10", "significant")


@query("j24_proposal_join", DEC + "SELECT method, reason, count(*) AS n FROM dec GROUP BY ALL")
def proposal_join(t: Tables):
    return decided(t).groupBy("method", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("l05_decision_blockers", DEC + f"""
SELECT chain_id, product_id, horizon, {r('pct')} AS percent, concat_ws(',', CASE WHEN method = 'guess' THEN 'invalid_method' END, CASE WHEN reason = 'rumour' THEN 'invalid_reason' END,
 CASE WHEN method <> 'none' AND trim(explanation) = '' THEN 'explanation_required' END, CASE WHEN adjusted < 0 THEN 'negative_adjusted_forecast' END, CASE WHEN (adjusted > p95 OR adjusted < p10) AND bn % 2 = 1 THEN 'outside_band_authorization_required' END) AS blockers,
 concat_ws(',', CASE WHEN adjusted > p95 OR adjusted < p10 THEN 'outside_probability_range' END, CASE WHEN (pct IS NULL OR abs(pct) >= 20) AND delta <> 0 THEN 'significant_adjustment' END) AS alerts FROM dec""")
def decision_blockers(t: Tables):
    """Managers propose for even brands, editors for odd ones."""
    role = F.when(F.col("bn") % 2 == 0, "manager").otherwise("editor")
    rows = dc.decide(points(t).withColumn("role", role), proposals(t), [*CP, "horizon"], "role")
    return rows.select(*CP, "horizon", rounded(F.col("percent")).alias("percent"), "blockers", "alerts")


@query("l06_approved_copy", DEC + f"""
SELECT *, lag(version) OVER (PARTITION BY product_id, target ORDER BY chain_id) AS previous_version FROM (
  SELECT chain_id, product_id, horizon, {ym('target')} AS target, {r('adjusted')} AS approved, 'DEC-' || strftime(target, '%Y-%m') || '-V' || lpad(CAST(row_number() OVER (PARTITION BY product_id, target ORDER BY chain_id) AS VARCHAR), 2, '0') AS version FROM dec WHERE k IN (0, 1, 2))""")
def approved_copy(t: Tables):
    """What was adjusted is approved; decisions on a product's month are revisions of one another, chain by chain."""
    rows = dc.version_chain(decided(t).filter("blockers = ''"), ["product_id", "target_period"], ["chain_id"], "DEC-", "target_period")
    return rows.select(
        *CP, "horizon", pr.label("target_period").alias("target"), rounded(F.col("adjusted")).alias("approved"), "version", "previous_version")


@query("l07_decision_history", DEC + f"""
SELECT d.chain_id, d.product_id, d.horizon, d.reason, {r('d.adjusted')} AS approved, p.sales AS actual FROM dec d LEFT JOIN panel p ON p.chain_id = d.chain_id AND p.product_id = d.product_id AND p.period = d.target WHERE k IN (0, 1, 2)""")
def decision_history(t: Tables):
    actual = t.panel.select(*CP, F.col("period").alias("target_period"), F.col("sales").alias("actual"))
    return decided(t).filter("blockers = ''").join(actual, [*CP, "target_period"], "left").select(
        *CP, "horizon", "reason", rounded(F.col("adjusted")).alias("approved"), "actual"
    )


FVA_AGG = f"""sum(abs(actual)) AS volume, {r('100 * sum(abs(actual - base)) / sum(abs(actual))')} AS sw, {r('100 * sum(abs(actual - approved)) / sum(abs(actual))')} AS aw, max(abs(delta)) AS big"""


@query("g17_value_added", DEC + f"""
SELECT chain_id, sw AS system_wape, aw AS approved_wape, {r('sw - aw')} AS fva_points, CASE WHEN big = 0 THEN 'no_intervention' WHEN {r('sw - aw')} > 0.25 THEN 'positive' WHEN {r('sw - aw')} < -0.25 THEN 'negative' ELSE 'neutral' END AS classification
FROM (SELECT chain_id, {FVA_AGG} FROM fva GROUP BY chain_id HAVING sum(abs(actual)) > 0)""")
def value_added(t: Tables):
    return dc.value_added(approved(t), ["chain_id"]).filter("volume > 0").select("chain_id", "system_wape", "approved_wape", "fva_points", "classification")


@query("g17_value_by_reason", DEC + f"""
SELECT reason, count(*) AS observations, {r('avg(abs(actual - base) - abs(actual - approved))')} AS average_fva, {r('100 * avg(CASE WHEN abs(actual - base) - abs(actual - approved) > 0 THEN 1e0 ELSE 0e0 END)')} AS positive_rate FROM fva GROUP BY reason""")
def value_by_reason(t: Tables):
    d = dc.value_details(approved(t))
    return d.groupBy("reason").agg(
        F.count(F.lit(1)).alias("observations"), rounded(F.avg("fva_absolute")).alias("average_fva"),
        rounded(100 * F.avg(F.when(F.col("fva_absolute") > 0, 1.0).otherwise(0.0))).alias("positive_rate"),
    )


@query("g18_weighted_value_added", DEC + f"""
SELECT count(*) AS decisions, {r('sum((sw - aw) * volume) / sum(volume)')} AS weighted_fva FROM (SELECT chain_id, {FVA_AGG} FROM fva GROUP BY chain_id HAVING sum(abs(actual)) > 0)""")
def weighted_value_added(t: Tables):
    v = dc.value_added(approved(t), ["chain_id"]).filter("volume > 0")
    fva = F.col("system_wape") - F.col("approved_wape")
    return v.agg(F.count(F.lit(1)).alias("decisions"), rounded(F.sum(fva * F.col("volume")) / F.sum("volume")).alias("weighted_fva"))


@query("g49_value_added_levels", DEC + f"""
SELECT CASE WHEN horizon IS NOT NULL AND series IS NOT NULL THEN 'series_horizon' WHEN reason IS NOT NULL THEN 'reason' WHEN horizon IS NOT NULL THEN 'horizon' WHEN chain_id IS NOT NULL THEN 'user' ELSE 'total' END AS level,
  series, horizon, reason, chain_id AS user_id, observations, value, negatives, negatives >= 3 AS repeated_negative FROM (
 SELECT series, horizon, reason, chain_id, count(*) AS observations, {r('sum(g)')} AS value, count(*) FILTER (WHERE g < 0) AS negatives FROM (SELECT *, chain_id || '/' || product_id AS series, abs(actual - base) - abs(actual - approved) AS g FROM fva)
 GROUP BY GROUPING SETS ((series, horizon), (reason), (horizon), (chain_id), ()))""")
def value_added_levels(t: Tables):
    d = dc.value_details(approved(t)).withColumn("series", F.concat_ws("/", *CP))
    c = {n: F.col(n) for n in ("series", "horizon", "reason", "chain_id")}
    sets = [[c["series"], c["horizon"]], [c["reason"]], [c["horizon"]], [c["chain_id"]], []]
    g = d.groupingSets(sets, *c.values()).agg(
        F.count(F.lit(1)).alias("observations"), rounded(F.sum("fva_absolute")).alias("value"), F.count_if(F.col("fva_absolute") < 0).alias("negatives")
    )
    level = (
        F.when(c["series"].isNotNull(), "series_horizon").when(c["reason"].isNotNull(), "reason").when(c["horizon"].isNotNull(), "horizon")
        .when(c["chain_id"].isNotNull(), "user").otherwise("total")
    )
    return g.select(
        level.alias("level"), "series", "horizon", "reason", c["chain_id"].alias("user_id"), "observations", "value", "negatives",
        (F.col("negatives") >= 3).alias("repeated_negative"),
    )


# Completeness and bands ------------------------------------------------------------------

@query("q05_horizon_completeness", with_(PANEL_BASE, PAIRS_SQL, RES_SQL, EVID_SQL) + """
SELECT chain_id, product_id, count(DISTINCT horizon) AS distinct_horizons, count(*) AS points, count(DISTINCT horizon) = 12 AND count(*) = 12 AS complete,
  bool_and(CASE WHEN q IS NULL THEN true ELSE b10 <= point AND point <= b90 AND b90 <= b95 END) AS ordered FROM banded GROUP BY ALL""")
def horizon_completeness(t: Tables):
    from monthmill.operators import bands

    res = residuals(t)
    pts = res.groupBy(*SERIES, "horizon").agg(F.max_by("mean3", "period").alias("point"))
    b = bands.ordered_bands(F.col("point"), F.col("quantiles"), 6)
    rows = bands.select_evidence(pts, res, CP, ["chain_id", "category_id"], ["chain_id"]).select(*CP, "horizon", *[c.alias(n) for n, c in b.items()])
    ordered = F.coalesce(ql.band_order(*[F.col(n) for n in ("p10", "p50", "p90", "p95")]), F.lit(True))
    return rows.groupBy(*CP).agg(
        F.count_distinct("horizon").alias("distinct_horizons"), F.count(F.lit(1)).alias("points"),
        ((F.count_distinct("horizon") == 12) & (F.count(F.lit(1)) == 12)).alias("complete"), F.bool_and(ordered).alias("ordered"),
    )


@query("q07_actual_guard", CALC + """
, hs AS (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS horizon)
SELECT horizon, status, count(*) AS n FROM (SELECT hs.horizon, CASE WHEN h.calculation_id IS NULL THEN 'no_frozen_horizon' WHEN s.actual IS NULL THEN 'no_observation' WHEN h.created_at >= s.first_av THEN 'frozen_after_observation' ELSE 'ok' END AS status
  FROM (SELECT * FROM salev WHERE ver = 2) s, hs LEFT JOIN hor h ON h.chain_id = s.chain_id AND h.product_id = s.product_id AND h.target = s.target AND h.horizon = hs.horizon) GROUP BY horizon, status""")
def actual_guard(t: Tables):
    """Each observation against the frozen point of every horizon: it must exist, and be older than the observation."""
    keys = [*CP, "target_period", "horizon"]
    wanted = sale_versions(t).filter("sale_version = 2").withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(12))))
    frozen = horizons(t).select(*keys, "calculation_id", "created_at")
    status = (
        F.when(F.col("calculation_id").isNull(), "no_frozen_horizon").when(F.col("actual").isNull(), "no_observation")
        .when(F.col("created_at") >= F.col("first_available_at"), "frozen_after_observation").otherwise("ok")
    )
    return wanted.join(frozen, keys, "left").groupBy("horizon", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("b21_vintage_evaluation", CALC + f"""
SELECT h.calculation_id, h.horizon, CASE WHEN p.sales IS NULL THEN 'pending' ELSE 'evaluated' END AS evaluation_status, p.sales AS actual, {r('p.sales - h.ensemble_value')} AS signed_error
FROM hor h LEFT JOIN panel p ON p.chain_id = h.chain_id AND p.product_id = h.product_id AND p.period = h.target""")
def vintage_evaluation(t: Tables):
    actual = t.panel.select(*CP, F.col("period").alias("target_period"), F.col("sales").alias("actual"))
    return horizons(t).join(actual, [*CP, "target_period"], "left").select(
        "calculation_id", "horizon", F.when(F.col("actual").isNull(), "pending").otherwise("evaluated").alias("evaluation_status"), "actual",
        rounded(F.col("actual") - F.col("ensemble_value")).alias("signed_error"),
    )


# Reporting over calculations -----------------------------------------------------------------

COMM_SQL = f"""
pick AS (SELECT chain_id, product_id, target, arg_max(calculation_id, (issue, created_at)) AS calculation_id, arg_max(horizon, (issue, created_at)) AS horizon, arg_max(statistical_value, (issue, created_at)) AS stat,
   arg_max(created_at, (issue, created_at)) AS created_at FROM hor GROUP BY ALL),
com AS (SELECT p.chain_id, p.product_id, p.period, p.sales, p.orders, p.delivery, k.calculation_id, k.horizon, k.stat, CASE WHEN k.created_at < CAST(p.period AS TIMESTAMP) THEN abs(p.sales - k.stat) END AS live_error,
   CASE WHEN p.orders > 0 THEN 100 * p.delivery / p.orders END AS fill_rate FROM panel p LEFT JOIN pick k ON k.chain_id = p.chain_id AND k.product_id = p.product_id AND k.target = p.period)
"""


def commercial(t: Tables):
    best = F.struct("issue", "created_at")
    pick = horizons(t).groupBy(*CP, "target_period").agg(
        F.max_by(F.struct("calculation_id", "horizon", "statistical_value", "created_at"), best).alias("k")
    ).select(*CP, F.col("target_period").alias("period"), "k.*")
    rows = t.panel.join(pick, [*CP, "period"], "left")
    live = F.col("created_at") < F.col("period").cast(NTZ)
    return rows.withColumns(
        {
            "live_error": F.when(live, F.abs(F.col("sales") - F.col("statistical_value"))),
            "fill_rate": rep.fill_rate(F.col("delivery"), F.col("orders")),
        }
    )


@query("j25_commercial_rows", with_(PANEL_BASE, CALC_SQL, COMM_SQL) + f"""
SELECT chain_id, product_id, {ym('period')} AS period, sales, calculation_id, horizon, {r('stat')} AS statistical, {r('live_error')} AS live_error, {r('fill_rate')} AS fill_rate FROM com""")
def commercial_rows(t: Tables):
    return commercial(t).select(
        *CP, pr.label("period").alias("period"), "sales", "calculation_id", "horizon", rounded(F.col("statistical_value")).alias("statistical"),
        rounded(F.col("live_error")).alias("live_error"), rounded(F.col("fill_rate")).alias("fill_rate"),
    )


@query("g36_commercial_totals", with_(PANEL_BASE, CALC_SQL, COMM_SQL) + f"""
SELECT chain_id, count(*) AS observations, count(live_error) AS live_observations, {r('100 * sum(live_error) / sum(CASE WHEN live_error IS NOT NULL THEN sales END)')} AS wape_live,
 {r('100 * sum(CASE WHEN orders IS NOT NULL THEN delivery END) / sum(CASE WHEN delivery IS NOT NULL THEN orders END)')} AS fill_rate FROM com GROUP BY chain_id""")
def commercial_totals(t: Tables):
    live = F.col("live_error").isNotNull()
    both = F.col("orders").isNotNull() & F.col("delivery").isNotNull()
    return commercial(t).groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("observations"), F.count("live_error").alias("live_observations"),
        rounded(F.try_divide(100 * F.sum("live_error"), F.sum(F.when(live, F.col("sales"))))).alias("wape_live"),
        rounded(F.try_divide(100 * F.sum(F.when(both, F.col("delivery"))), F.sum(F.when(both, F.col("orders"))))).alias("fill_rate"),
    )


@query("g46_monthly_live_columns", with_(PANEL_BASE, CALC_SQL, COMM_SQL) + f"""
SELECT chain_id, {ym('period')} AS period, {r('avg(CASE WHEN live_error IS NOT NULL AND sales > 0 THEN 100 * live_error / sales END)')} AS mean_live_rate, {r('avg(fill_rate)')} AS mean_fill_rate FROM com GROUP BY ALL""")
def monthly_live_columns(t: Tables):
    rate = F.when(F.col("live_error").isNotNull() & (F.col("sales") > 0), 100 * F.col("live_error") / F.when(F.col("sales") > 0, F.col("sales")))
    return commercial(t).groupBy("chain_id", pr.label("period").alias("period")).agg(
        rounded(F.avg(rate)).alias("mean_live_rate"), rounded(F.avg("fill_rate")).alias("mean_fill_rate")
    )


@query("g50_monthly_and_cumulative", with_(PANEL_BASE, CALC_SQL, COMM_SQL) + f"""
SELECT coalesce(period, 'ALL') AS period, count(live_error) AS evaluations, {r('100 * sum(live_error) / sum(CASE WHEN live_error IS NOT NULL THEN sales END)')} AS wape FROM (SELECT *, {ym('period')} AS ymp FROM com) x(chain_id, product_id, p0, sales, orders, delivery, calculation_id, horizon, stat, live_error, fill_rate, period)
GROUP BY GROUPING SETS ((period), ())""")
def monthly_and_cumulative(t: Tables):
    rows = commercial(t).withColumn("period", pr.label("period"))
    return rows.rollup("period").agg(
        F.count("live_error").alias("evaluations"),
        rounded(F.try_divide(100 * F.sum("live_error"), F.sum(F.when(F.col("live_error").isNotNull(), F.col("sales"))))).alias("wape"),
    ).withColumn("period", F.coalesce("period", F.lit("ALL")))


@query("l11_forecast_matrix", CALC + f"""
SELECT chain_id, product_id, {', '.join(r(f'max(ensemble_value) FILTER (WHERE horizon = {h})') + f' AS h{h}' for h in range(1, 13))} FROM hor WHERE issue = {ISSUE_SQL} GROUP BY ALL""")
def forecast_matrix(t: Tables):
    rows = horizons(t).filter(F.col("issue") == F.lit(ISSUE))
    wide = rows.groupBy(*CP).pivot("horizon", list(range(1, 13))).agg(F.max("ensemble_value"))
    return wide.select(*CP, *[rounded(F.col(str(h))).alias(f"h{h}") for h in range(1, 13)])


@query("l12_dashboard_points", CALC + f"""
, pts AS (SELECT chain_id, CAST(unnest(generate_series({ISSUE_SQL} - INTERVAL 8 MONTH, {ISSUE_SQL} + INTERVAL 3 MONTH, INTERVAL 1 MONTH)) AS DATE) AS period FROM (SELECT DISTINCT chain_id FROM panel))
SELECT p.chain_id, {ym('p.period')} AS period, a.s AS actual, {r('f.v')} AS forecast, coalesce(f.n, 0) AS covered FROM pts p
LEFT JOIN (SELECT chain_id, period, sum(sales) AS s FROM panel GROUP BY ALL) a ON a.chain_id = p.chain_id AND a.period = p.period
LEFT JOIN (SELECT chain_id, target, sum(ensemble_value) AS v, count(*) AS n FROM hor WHERE issue = {ISSUE_SQL} GROUP BY ALL) f ON f.chain_id = p.chain_id AND f.target = p.period""")
def dashboard_points(t: Tables):
    actual = t.panel.groupBy("chain_id", "period").agg(F.sum("sales").alias("actual"))
    window = F.sequence(F.add_months(F.lit(ISSUE), -8), F.add_months(F.lit(ISSUE), 3), F.expr("interval 1 month"))
    spine = t.panel.select("chain_id").distinct().select("chain_id", F.explode(window).alias("period"))
    future = horizons(t).filter(F.col("issue") == F.lit(ISSUE)).groupBy("chain_id", F.col("target_period").alias("period")).agg(
        F.sum("ensemble_value").alias("v"), F.count(F.lit(1)).alias("covered")
    )
    return spine.join(actual, ["chain_id", "period"], "left").join(future, ["chain_id", "period"], "left").select(
        "chain_id", pr.label("period").alias("period"), "actual", rounded(F.col("v")).alias("forecast"), F.coalesce("covered", F.lit(0)).alias("covered")
    )


@query("l13_scope_completeness", CALC + """
SELECT chain_id, count(DISTINCT product_id) AS products, count(DISTINCT horizon) = 12 AND count(*) = 12 * count(DISTINCT product_id) AS complete FROM hor WHERE issue = DATE '2001-07-01' GROUP BY chain_id""")
def scope_completeness(t: Tables):
    rows = horizons(t).filter(F.col("issue") == F.lit(ISSUE))
    return rows.groupBy("chain_id").agg(
        F.count_distinct("product_id").alias("products"),
        ((F.count_distinct("horizon") == 12) & (F.count(F.lit(1)) == 12 * F.count_distinct("product_id"))).alias("complete"),
    )


@query("l15_curve_overlay", CALC + f"""
SELECT a.chain_id, a.product_id, {ym('a.target')} AS target, {r('a.ensemble_value')} AS first_curve, {r('b.ensemble_value')} AS second_curve, p.sales AS actual
FROM (SELECT * FROM hor WHERE issue = DATE '2000-07-01') a LEFT JOIN (SELECT * FROM hor WHERE issue = DATE '2000-10-01') b ON a.chain_id = b.chain_id AND a.product_id = b.product_id AND a.target = b.target
LEFT JOIN panel p ON p.chain_id = a.chain_id AND p.product_id = a.product_id AND p.period = a.target""")
def curve_overlay(t: Tables):
    keys = [*CP, "target_period"]
    curve = lambda d, n: horizons(t).filter(F.col("issue") == F.lit(d).cast("date")).select(*keys, F.col("ensemble_value").alias(n))
    actual = t.panel.select(*CP, F.col("period").alias("target_period"), F.col("sales").alias("actual"))
    return curve("2000-07-01", "a").join(curve("2000-10-01", "b"), keys, "left").join(actual, keys, "left").select(
        *CP, pr.label("target_period").alias("target"), rounded(F.col("a")).alias("first_curve"), rounded(F.col("b")).alias("second_curve"), "actual"
    )


CONTEXT_SQL = """
ctx AS (SELECT *, CASE WHEN bn % 2 = 0 THEN 'SALES' ELSE 'ORDER' END AS objective, CASE WHEN day(created_at) < 20 THEN 'LIVE' ELSE 'TEST' END AS environment, md5(chain_id || '|' || product_id || '|' || year(issue) || '|' || CAST(sv AS BIGINT) % 4) AS data_hash FROM calc)
"""


@query("j26_champion_context", CALC.rstrip() + "," + CONTEXT_SQL + """
SELECT a.calculation_id, b.calculation_id AS champion_id FROM ctx a JOIN (SELECT chain_id, product_id, objective, environment, data_hash, engine, arg_max(calculation_id, issue) AS calculation_id FROM ctx WHERE status = 'DECIDED' GROUP BY ALL) b USING (chain_id, product_id, objective, environment, data_hash, engine)""")
def champion_context(t: Tables):
    """A calculation's champion is the latest decided one of the same chain, product, objective, environment, data and engine."""
    context = [*CP, "objective", "environment", "data_hash", "engine"]
    rows = calculations(t).withColumns({
        "objective": F.when(F.col("bn") % 2 == 0, "SALES").otherwise("ORDER"),
        "environment": F.when(F.dayofmonth("created_at") < 20, "LIVE").otherwise("TEST"),
        "data_hash": F.md5(F.concat_ws("|", *CP, F.year("issue").cast("string"), (F.col("statistical_value").cast("bigint") % 4).cast("string")).cast("binary")),
    })
    champion = rows.filter("status = 'DECIDED'").groupBy(*context).agg(F.max_by("calculation_id", "issue").alias("champion_id"))
    return rows.join(champion, context).select("calculation_id", "champion_id")


@query("j30_published_forecast", CALC + f"""
SELECT h.calculation_id, h.horizon, {r('h.ensemble_value')} AS value, n.selected_candidate AS published_as FROM hor h JOIN (SELECT calculation_id FROM calc QUALIFY row_number() OVER (PARTITION BY chain_id, product_id ORDER BY issue DESC) = 1) c USING (calculation_id) LEFT JOIN seln n USING (calculation_id)""")
def published_forecast(t: Tables):
    current = vs.latest(calculations(t).select(*CP, "calculation_id", "issue"), CP, ["issue"]).select("calculation_id")
    return horizons(t).join(current, "calculation_id").join(selections(t), "calculation_id", "left").select(
        "calculation_id", "horizon", rounded(F.col("ensemble_value")).alias("value"), F.col("selected_candidate").alias("published_as")
    )


@query("j31_statistical_with_ml", CALC + f"""
SELECT calculation_id, horizon, {r('statistical_value')} AS statistical, {r("CASE WHEN engine = 'v1' THEN ml_value END")} AS ml FROM hor""")
def statistical_with_ml(t: Tables):
    s = horizons(t).select("calculation_id", "horizon", "statistical_value")
    ml = horizons(t).filter("engine = 'v1'").select("calculation_id", "horizon", "ml_value")
    return s.join(ml, ["calculation_id", "horizon"], "left").select(
        "calculation_id", "horizon", rounded(F.col("statistical_value")).alias("statistical"), rounded(F.col("ml_value")).alias("ml")
    )


@query("t08_accuracy_ranking", with_(PANEL_BASE, PAIRS_SQL) + f"""
SELECT chain_id, product_id, wape, bias FROM (SELECT chain_id, product_id, {metric_sql('generic')} FROM lpairs WHERE model = 'mean3' GROUP BY ALL) WHERE wape IS NOT NULL""")
def accuracy_ranking(t: Tables):
    m = lpairs(t).filter("model = 'mean3'").groupBy(*CP).agg(*em.error_metrics(F.col("actual"), F.col("forecast"), "generic")).filter("wape IS NOT NULL")
    return m.select(*CP, "wape", "bias").orderBy("chain_id", "wape", "product_id")


@query("t03_worst_series", with_(PANEL_BASE, PAIRS_SQL) + f"""
SELECT chain_id, product_id, wape FROM (SELECT chain_id, product_id, {metric_sql('generic')} FROM lpairs WHERE model = 'mean3' GROUP BY ALL) WHERE wape IS NOT NULL ORDER BY wape DESC, chain_id, product_id LIMIT 10""")
def worst_series(t: Tables):
    m = lpairs(t).filter("model = 'mean3'").groupBy(*CP).agg(*em.error_metrics(F.col("actual"), F.col("forecast"), "generic")).filter("wape IS NOT NULL")
    return m.select(*CP, "wape").orderBy(F.desc("wape"), *CP).limit(10)
