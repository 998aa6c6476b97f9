"""Error metrics in every dialect, window features, drift, service and band statistics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from monthmill.functions import periods as pr
from monthmill.functions.numbers import rounded
from monthmill.operators import bands, metrics as em, pairs as prs, reporting as rep, series as sr
from monthmill.operators.quantiles import exact_quantiles
from monthmill.plans.registry import query
from monthmill.plans.sql_parts import BASE, FACTS, ISLANDS, ISSUE as ISSUE_SQL, PANEL_BASE, r, rs, with_, ym
from monthmill.sources.tables import ISSUE, SERIES, Tables

CP = ["chain_id", "product_id"]

MONTHS = range(1, 13)
LAST_CASES = " ".join(f"WHEN {h} THEN l{h}" for h in MONTHS)
MEAN_CASES = " ".join(f"WHEN {h} THEN m{h}" for h in MONTHS)
LAGGED = ", ".join(
    f"lag(sales, {h}) OVER w AS l{h}, avg(sales) OVER (PARTITION BY chain_id, product_id ORDER BY idx "
    f"ROWS BETWEEN {h + 2} PRECEDING AND {h} PRECEDING) AS m{h}" for h in MONTHS
)

PAIRS_SQL = f"""
wide AS (
  SELECT chain_id, product_id, category_id, period, idx, sales AS actual, h AS horizon,
    CASE h {LAST_CASES} END AS last, CASE h {MEAN_CASES} END AS mean3
  FROM (SELECT *, {LAGGED}
        FROM panel WINDOW w AS (PARTITION BY chain_id, product_id ORDER BY idx)), (SELECT unnest(range(1, 13)) AS h)
  WHERE sales IS NOT NULL),
pairs AS (SELECT * FROM wide WHERE last IS NOT NULL AND mean3 IS NOT NULL),
lpairs AS (SELECT chain_id, product_id, category_id, period, idx, actual, horizon, 'last' AS model, last AS forecast FROM pairs
  UNION ALL SELECT chain_id, product_id, category_id, period, idx, actual, horizon, 'mean3', mean3 FROM pairs)
"""
PAIRS = with_(PANEL_BASE, PAIRS_SQL)


def pairs(t: Tables):
    return prs.direct_pairs(t.panel, SERIES)


def lpairs(t: Tables):
    return prs.long_pairs(pairs(t))


def metric_sql(dialect: str, prefix: str = "") -> str:
    d = em.DIALECTS[dialect]
    e = "(actual - forecast)" if d.sign > 0 else "(forecast - actual)"
    den = "sum(abs(actual))" if d.absolute_denominator else "sum(actual)"
    if d.grid:
        q = f"floor({e} * 1e4 + 0.5e0)"
        sa, s = f"(sum(abs({q})) / 1e4)", f"(sum({q}) / 1e4)"
    else:
        sa, s = f"sum(abs({e}))", f"sum({e})"
    w, b = r(f"100 * {sa} / {den}", d.digits), r(f"100 * {s} / {den}", d.digits)
    if d.zero == "null":
        wape, bias = f"CASE WHEN {den} > 0 THEN {w} END", f"CASE WHEN {den} > 0 THEN {b} END"
    elif d.zero == "zero":
        wape, bias = f"CASE WHEN {den} <> 0 THEN {w} ELSE 0e0 END", f"CASE WHEN {den} <> 0 THEN {b} ELSE 0e0 END"
    elif d.zero == "0_or_999":
        wape = f"CASE WHEN {den} <> 0 THEN {w} WHEN sum(abs(forecast)) = 0 THEN 0e0 ELSE 999e0 END"
        bias = f"CASE WHEN {den} <> 0 THEN {b} ELSE 0e0 END"
    else:
        wape = f"CASE WHEN {den} <> 0 THEN {w} WHEN {sa} = 0 THEN 0e0 ELSE 100e0 END"
        bias = f"CASE WHEN {den} <> 0 THEN {b} WHEN {s} = 0 THEN 0e0 WHEN {s} > 0 THEN 100e0 ELSE -100e0 END"
    out = [f"{wape} AS {prefix}wape", f"{bias} AS {prefix}bias", f"{r(f'{sa} / count(*)', d.digits)} AS {prefix}mae",
           f"{r(f'sqrt(avg({e} * {e}))', d.digits)} AS {prefix}rmse"]
    if d.stability == "units":
        out.append(f"{r(f'stddev_pop(abs({e}))', d.digits)} AS {prefix}stability")
    elif d.stability == "percent":
        out.append(f"{r(f'100 * stddev_pop(abs({e})) / CASE WHEN avg(actual) <> 0 THEN avg(actual) ELSE 1e0 END', d.digits)} AS {prefix}stability")
    return ", ".join([*out, f"count(*) AS {prefix}observations"])


def _dialect_query(dialect: str) -> None:
    @query(f"g01_metrics_{dialect}", PAIRS + f"SELECT chain_id, model, horizon, {metric_sql(dialect)} FROM lpairs GROUP BY ALL")
    def build(t: Tables):
        return lpairs(t).groupBy("chain_id", "model", "horizon").agg(
            *em.error_metrics(F.col("actual"), F.col("forecast"), dialect)
        )


for _d in em.DIALECTS:
    _dialect_query(_d)

WINDOWED_SQL = f"""
pw AS (SELECT chain_id, model, period, sum(abs(actual - forecast)) AS ae, sum(actual - forecast) AS e, sum(actual) AS a, count(*) AS n FROM lpairs GROUP BY ALL),
rt AS (SELECT *, 100 * ae / a AS rate, row_number() OVER (PARTITION BY chain_id, model ORDER BY period) AS pos,
       count(*) OVER (PARTITION BY chain_id, model) AS cnt FROM pw WHERE a <> 0),
sp AS (SELECT chain_id, model, CASE WHEN count(*) > 1 THEN stddev_pop(rate) ELSE 0e0 END AS stab,
         avg(rate) FILTER (WHERE pos <= greatest(1, cnt * 2 // 3)) AS old, avg(rate) FILTER (WHERE pos > greatest(1, cnt * 2 // 3)) AS new
       FROM rt GROUP BY ALL),
tot AS (SELECT chain_id, model, CAST(sum(n) AS BIGINT) AS observations, count(*) AS windows, 100 * sum(ae) / sum(a) AS w, 100 * sum(e) / sum(a) AS b FROM pw GROUP BY ALL)
"""


@query("g01_metrics_ensemble_windows", with_(PANEL_BASE, PAIRS_SQL, WINDOWED_SQL) + f"""
SELECT chain_id, model, observations, windows, {r('w')} AS wape, {r('b')} AS bias, {r('stab')} AS stability, {r('coalesce(new, old)')} AS recent_wape,
       {r('old')} AS historical_wape, {r('greatest(0e0, coalesce(new, old) - old)')} AS deterioration FROM tot JOIN sp USING (chain_id, model)""")
def ensemble_windows(t: Tables):
    return em.windowed_metrics(lpairs(t), ["chain_id", "model"], "period", "actual", "forecast")


@query("w17_recent_vs_historical", with_(PANEL_BASE, PAIRS_SQL, WINDOWED_SQL) + f"""
SELECT chain_id, model, {r('coalesce(new, old)')} AS recent_wape, {r('old')} AS historical_wape FROM sp""")
def recent_vs_historical(t: Tables):
    return em.windowed_metrics(lpairs(t), ["chain_id", "model"], "period", "actual", "forecast").select(
        "chain_id", "model", "recent_wape", "historical_wape"
    )


@query("g02_metrics_by_level", PAIRS + f"""
SELECT model, horizon, chain_id || '/' || product_id AS series_id, {metric_sql('generic')} FROM lpairs
GROUP BY GROUPING SETS ((model), (model, horizon), (model, chain_id || '/' || product_id)) HAVING series_id IS NULL OR count(*) >= 6""")
def metrics_by_level(t: Tables):
    rows = lpairs(t).withColumn("series_id", F.concat_ws("/", "chain_id", "product_id"))
    sets = [[F.col("model")], [F.col("model"), F.col("horizon")], [F.col("model"), F.col("series_id")]]
    return (
        rows.groupingSets(sets, F.col("model"), F.col("horizon"), F.col("series_id"))
        .agg(*em.error_metrics(F.col("actual"), F.col("forecast"), "generic"))
        .filter(F.col("series_id").isNull() | (F.col("observations") >= 6))
    )


@query("g10_candidate_score", with_(PANEL_BASE, PAIRS_SQL) + f"""
SELECT chain_id, model, {r('wape + abs(bias) * 0.25e0 + stability * 0.15e0', 2)} AS statistical_score, {r('wape + abs(bias) * 0.18e0 + stability * 0.1e0 + 0.25e0', 2)} AS pooled_score
FROM (SELECT chain_id, model, {metric_sql('pooled')} FROM lpairs GROUP BY ALL)""")
def candidate_score(t: Tables):
    m = lpairs(t).groupBy("chain_id", "model").agg(*em.error_metrics(F.col("actual"), F.col("forecast"), "pooled"))
    w, b, s = F.col("wape"), F.abs("bias"), F.col("stability")
    return m.select(
        "chain_id", "model", rounded(w + b * 0.25 + s * 0.15, 2).alias("statistical_score"),
        rounded(w + b * 0.18 + s * 0.1 + 0.25, 2).alias("pooled_score"),
    )


# Sums with coverage, service ---------------------------------------------------

@query("g04_strict_sum", with_(PANEL_BASE) + f"""
SELECT chain_id, category_id, {ym('period')} AS period, CASE WHEN count(sales) = count(*) THEN sum(sales) END AS sales,
       CASE WHEN count(orders) = count(*) THEN sum(orders) END AS orders FROM panel GROUP BY ALL""")
def strict_sum(t: Tables):
    return t.panel.groupBy("chain_id", "category_id", pr.label("period").alias("period")).agg(
        rep.strict_sum(F.col("sales")).alias("sales"), rep.strict_sum(F.col("orders")).alias("orders")
    )


@query("g05_covered_sum", with_(PANEL_BASE) + f"""
SELECT chain_id, {ym('period')} AS period, sum(sales) AS sales, count(sales) AS sales_covered, count(*) AS sales_eligible FROM panel GROUP BY ALL""")
def covered_sum(t: Tables):
    return t.panel.groupBy("chain_id", pr.label("period").alias("period")).agg(*rep.covered_sum(F.col("sales"), "sales"))


@query("g06_service_level", with_(BASE) + f"""
SELECT chain_id, {ym('period')} AS period, matched, incomplete, undefined_pairs, order_total, delivery_total,
  CASE WHEN matched = 0 OR incomplete > 0 OR undefined_pairs > 0 THEN NULL WHEN order_total = 0 THEN 100e0 ELSE {r('100 * delivery_total / order_total')} END AS fill_rate,
  CASE WHEN matched = 0 OR incomplete > 0 OR undefined_pairs > 0 THEN 'NOT_MEASURABLE' WHEN order_total = 0 OR 100 * delivery_total / order_total >= 95 THEN 'TARGET_MET' ELSE 'TARGET_NOT_MET' END AS status
FROM (SELECT chain_id, period, count(*) FILTER (WHERE orders IS NOT NULL AND delivery IS NOT NULL) AS matched,
        count(*) FILTER (WHERE (orders IS NULL) <> (delivery IS NULL)) AS incomplete,
        count(*) FILTER (WHERE orders = 0 AND delivery > 0) AS undefined_pairs,
        coalesce(sum(orders) FILTER (WHERE delivery IS NOT NULL), 0e0) AS order_total, coalesce(sum(delivery) FILTER (WHERE orders IS NOT NULL), 0e0) AS delivery_total
      FROM monthly GROUP BY ALL)""")
def service_level(t: Tables):
    from monthmill.operators.closure import observed_service

    return observed_service(t.monthly, ["chain_id", "period"], 95.0).withColumn("period", pr.label("period"))


@query("g07_closure_totals", with_(BASE) + f"""
SELECT {ym('period')} AS period, sale, ordered, delivered, CASE WHEN ordered <> 0 THEN {r('100 * delivered / ordered')} WHEN delivered = 0 THEN 100e0 END AS fill_rate,
  CASE WHEN ordered <> 0 THEN {r('100 * sale / ordered')} WHEN sale = 0 THEN 100e0 END AS sale_to_order
FROM (SELECT period, coalesce(sum(sales), 0e0) AS sale, coalesce(sum(orders), 0e0) AS ordered, coalesce(sum(delivery), 0e0) AS delivered FROM monthly GROUP BY period)""")
def closure_totals(t: Tables):
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    s = t.monthly.groupBy("period").agg(zero("sales").alias("sale"), zero("orders").alias("ordered"), zero("delivery").alias("delivered"))
    return s.select(
        pr.label("period").alias("period"), "sale", "ordered", "delivered",
        rounded(rep.ratio(F.col("delivered"), F.col("ordered"))).alias("fill_rate"),
        rounded(rep.ratio(F.col("sale"), F.col("ordered"))).alias("sale_to_order"),
    )


@query("j03_metric_merge", with_(BASE, FACTS) + f"""
SELECT chain_id, product_id, {ym('period')} AS period, max(value) FILTER (WHERE metric_code = 'SALES') AS sales, max(value) FILTER (WHERE metric_code = 'ORDER') AS orders,
       max(value) FILTER (WHERE metric_code = 'DELIVERY') AS delivery FROM facts GROUP BY ALL""")
def metric_merge(t: Tables):
    merged = t.facts.groupBy(*CP, "period").pivot("metric_code", ["SALES", "ORDER", "DELIVERY"]).agg(F.max("value"))
    return merged.select(
        *CP, pr.label("period").alias("period"), F.col("SALES").alias("sales"), F.col("ORDER").alias("orders"), F.col("DELIVERY").alias("delivery")
    )


@query("g38_history_summary", with_(BASE, FACTS) + f"""
SELECT count(DISTINCT chain_id) AS scopes, count(DISTINCT chain_id || '|' || product_id) AS products, count(*) AS observations, {ym('max(period)')} AS latest_period FROM facts""")
def history_summary(t: Tables):
    return t.facts.agg(
        F.count_distinct("chain_id").alias("scopes"), F.count_distinct("chain_id", "product_id").alias("products"),
        F.count(F.lit(1)).alias("observations"), pr.label(F.max("period")).alias("latest_period"),
    )


@query("g48_distinct_sets", with_(BASE) + """
SELECT product_id, count(DISTINCT chain_id) AS chains, count(DISTINCT part_id) AS parts, list_aggregate(list_sort(list_distinct(list(chain_id))), 'string_agg', ',') AS chain_list FROM lines GROUP BY product_id""")
def distinct_sets(t: Tables):
    return t.lines.groupBy("product_id").agg(
        F.count_distinct("chain_id").alias("chains"), F.count_distinct("part_id").alias("parts"),
        F.array_join(F.array_sort(F.collect_set("chain_id")), ",").alias("chain_list"),
    )


@query("g45_dataset_hash", with_(BASE, FACTS) + """
SELECT chain_id, count(*) AS n_facts, CAST(sum(CAST(('0x' || substr(md5(product_id || '|' || metric_code || '|' || strftime(period, '%Y-%m') || '|' || CAST(CAST(value AS BIGINT) AS VARCHAR)), 1, 12)) AS BIGINT)) % 1000000007 AS BIGINT) AS content_hash
FROM facts GROUP BY chain_id""")
def dataset_hash(t: Tables):
    text = F.concat_ws("|", "product_id", "metric_code", pr.label("period"), F.col("value").cast("bigint").cast("string"))
    part = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("decimal(20,0)")
    return t.facts.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("n_facts"), (F.sum(part) % F.lit(1000000007)).cast("bigint").alias("content_hash")
    )


# Bands ---------------------------------------------------------------------------

RES_SQL = "res AS (SELECT *, actual - forecast AS residual FROM lpairs WHERE model = 'mean3')"


def residuals(t: Tables):
    return pairs(t).withColumn("residual", F.col("actual") - F.col("mean3"))


@query("g12_residual_quantiles", with_(PANEL_BASE, PAIRS_SQL, RES_SQL) + f"""
SELECT chain_id, horizon, count(*) AS n, {r('quantile_cont(residual, 0.1)')} AS q10, {r('quantile_cont(residual, 0.9)')} AS q90, {r('quantile_cont(residual, 0.95)')} AS q95 FROM res GROUP BY ALL""")
def residual_quantiles(t: Tables):
    q = exact_quantiles(residuals(t), ["chain_id", "horizon"], "residual", bands.PROBABILITIES)
    return q.select("chain_id", "horizon", "n", *[rounded(F.col("quantiles")[i]).alias(n) for i, n in enumerate(["q10", "q90", "q95"])])


EVID_SQL = f"""
lastp AS (SELECT chain_id, product_id, category_id, horizon, arg_max(mean3, period) AS point FROM pairs GROUP BY ALL),
qp AS (SELECT chain_id, product_id, horizon, count(*) AS n, quantile_cont(residual, [0.1, 0.9, 0.95]) AS q FROM res GROUP BY ALL),
qc AS (SELECT chain_id, category_id, horizon, count(*) AS n, quantile_cont(residual, [0.1, 0.9, 0.95]) AS q FROM res GROUP BY ALL),
qh AS (SELECT chain_id, horizon, count(*) AS n, quantile_cont(residual, [0.1, 0.9, 0.95]) AS q FROM res GROUP BY ALL),
ev AS (SELECT l.*, CASE WHEN qp.n >= 3 THEN 'PRODUCT' WHEN qc.n >= 3 THEN 'CATEGORY' WHEN qh.n >= 3 THEN 'CHAIN' ELSE 'INSUFFICIENT' END AS band_basis,
    CASE WHEN qp.n >= 3 THEN qp.n WHEN qc.n >= 3 THEN qc.n WHEN qh.n >= 3 THEN qh.n ELSE 0 END AS band_observations,
    CASE WHEN qp.n >= 3 THEN qp.q WHEN qc.n >= 3 THEN qc.q WHEN qh.n >= 3 THEN qh.q END AS q
  FROM lastp l LEFT JOIN qp USING (chain_id, product_id, horizon) LEFT JOIN qc USING (chain_id, category_id, horizon) LEFT JOIN qh USING (chain_id, horizon)),
banded AS (SELECT *, least(point, greatest(0e0, point + q[1])) AS b10, greatest(point, point + q[2]) AS b90, greatest(greatest(point, point + q[2]), point + q[3]) AS b95 FROM ev)
"""


@query("g13_band_evidence", with_(PANEL_BASE, PAIRS_SQL, RES_SQL, EVID_SQL) + f"""
SELECT chain_id, product_id, horizon, band_basis, band_observations, {rs('b10', 2)} AS p10, {rs('point', 2)} AS p50, {rs('b90', 2)} AS p90, {rs('b95', 2)} AS p95 FROM banded""")
def band_evidence(t: Tables):
    res = residuals(t)
    points = res.groupBy(*SERIES, "horizon").agg(F.max_by("mean3", "period").alias("point"))
    chosen = bands.select_evidence(points, res, CP, ["chain_id", "category_id"], ["chain_id"])
    cols = bands.ordered_bands(F.col("point"), F.col("quantiles"))
    return chosen.select(*CP, "horizon", "band_basis", "band_observations", *[c.alias(n) for n, c in cols.items()])


COV_SQL = """
cov0 AS (SELECT l.*, least(forecast, greatest(0e0, forecast + q[1])) AS p10, forecast AS p50, greatest(forecast, forecast + q[2]) AS p90, greatest(greatest(forecast, forecast + q[2]), forecast + q[3]) AS p95
  FROM res l JOIN (SELECT chain_id, product_id, horizon, quantile_cont(residual, [0.1, 0.9, 0.95]) AS q FROM res GROUP BY ALL) USING (chain_id, product_id, horizon)),
cov AS (SELECT chain_id, horizon, """ + ", ".join(f"round({c} * 1e7) / 1e7 AS {c}" for c in ("actual", "p10", "p50", "p90", "p95")) + """ FROM cov0)
"""


def banded_pairs(t: Tables):
    """Pairs with bands from the same series' residuals."""
    w = Window.partitionBy(*SERIES, "horizon")
    q = F.percentile("residual", F.array(*[F.lit(p) for p in bands.PROBABILITIES])).over(w)
    rows = residuals(t).withColumn("q", q)
    f = F.col("mean3")
    p90 = F.greatest(f, f + F.col("q")[1])
    return rows.withColumns(
        {"p10": F.least(f, F.greatest(F.lit(0.0), f + F.col("q")[0])), "p50": f, "p90": p90, "p95": F.greatest(p90, f + F.col("q")[2])}
    )


@query("g09_interval_coverage", with_(PANEL_BASE, PAIRS_SQL, RES_SQL, COV_SQL) + f"""
SELECT horizon, count(*) AS observations, {r("100 * sum(CASE WHEN actual >= p10 AND actual <= p90 THEN 1 ELSE 0 END) / count(*)")} AS coverage_p90,
  {r("100 * sum(CASE WHEN actual >= p10 AND actual <= p95 THEN 1 ELSE 0 END) / count(*)")} AS coverage_p95, count(*) FILTER (WHERE actual < p10) AS below_p10,
  count(*) FILTER (WHERE actual <= p50) AS at_or_below_p50, count(*) FILTER (WHERE actual < p10 OR actual > p95) AS outside_p95 FROM cov GROUP BY horizon""")
def interval_coverage(t: Tables):
    return bands.interval_coverage(banded_pairs(t), ["horizon"])


@query("p30_coverage_bucket", with_(PANEL_BASE, PAIRS_SQL, RES_SQL, COV_SQL) + """
SELECT chain_id, horizon, CASE WHEN actual < p10 THEN 'below_p10' WHEN actual < p50 THEN 'p10_p50' WHEN actual < p90 THEN 'p50_p90' WHEN actual < p95 THEN 'p90_p95' ELSE 'above_p95' END AS coverage, count(*) AS n FROM cov GROUP BY ALL""")
def coverage_bucket(t: Tables):
    bucket = bands.coverage_bucket(*[F.col(c) for c in ("actual", "p10", "p50", "p90", "p95")])
    return banded_pairs(t).groupBy("chain_id", "horizon", bucket.alias("coverage")).agg(F.count(F.lit(1)).alias("n"))


# Window features --------------------------------------------------------------------

def _lag_sql() -> str:
    lags = ", ".join(f"lag(sales, {k - 1}) OVER w AS lag_{k}" if k > 1 else "sales AS lag_1" for k in (1, 2, 3, 6, 12))
    return f"SELECT chain_id, product_id, {ym('period')} AS period, {lags} FROM panel WINDOW w AS (PARTITION BY chain_id, product_id ORDER BY idx)"


@query("w07_lags", with_(PANEL_BASE) + _lag_sql())
def lags(t: Tables):
    out = sr.lag_features(t.panel, SERIES, "sales")
    return out.select(*CP, pr.label("period").alias("period"), *[f"lag_{k}" for k in (1, 2, 3, 6, 12)])


def _roll_sql() -> str:
    parts = []
    for w in (3, 6, 12):
        over = f"OVER (PARTITION BY chain_id, product_id ORDER BY idx ROWS {w - 1} PRECEDING)"
        parts += [r(f"avg(sales) {over}") + f" AS mean_{w}", r(f"stddev_pop(sales) {over}") + f" AS std_{w}", f"min(sales) {over} AS min_{w}", f"max(sales) {over} AS max_{w}"]
    return f"SELECT chain_id, product_id, {ym('period')} AS period, {', '.join(parts)} FROM panel"


@query("w08_rolling_statistics", with_(PANEL_BASE) + _roll_sql())
def rolling_statistics(t: Tables):
    out = sr.lag_features(t.panel, SERIES, "sales")
    cols = []
    for w in (3, 6, 12):
        cols += [rounded(F.col(f"mean_{w}")).alias(f"mean_{w}"), rounded(F.col(f"std_{w}")).alias(f"std_{w}"), f"min_{w}", f"max_{w}"]
    return out.select(*CP, pr.label("period").alias("period"), *cols)


@query("w09_growth", with_(PANEL_BASE) + f"""
SELECT chain_id, product_id, {ym('period')} AS period, {r('sales / nullif(p1, 0) - 1')} AS mom, {r('sales / nullif(p11, 0) - 1')} AS yoy,
  {r('CASE WHEN n1 > 1 THEN (l1 - f1) / greatest(1, n1 - 1) END')} AS slope,
  {r('CASE WHEN n1 > 1 THEN (l1 - f1) / greatest(1, n1 - 1) END - CASE WHEN n2 > 1 THEN (l2 - f2) / greatest(1, n2 - 1) END')} AS acceleration
FROM (SELECT *, lag(sales, 1) OVER w AS p1, lag(sales, 11) OVER w AS p11, count(sales) OVER a AS n1, count(sales) OVER b AS n2,
        first_value(sales IGNORE NULLS) OVER a AS f1, last_value(sales IGNORE NULLS) OVER a AS l1, first_value(sales IGNORE NULLS) OVER b AS f2, last_value(sales IGNORE NULLS) OVER b AS l2
      FROM panel WINDOW w AS (PARTITION BY chain_id, product_id ORDER BY idx), a AS (PARTITION BY chain_id, product_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY chain_id, product_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING))""")
def growth(t: Tables):
    out = sr.growth_features(t.panel, SERIES, "sales")
    return out.select(*CP, pr.label("period").alias("period"), *[rounded(F.col(c)).alias(c) for c in ("mom", "yoy", "slope", "acceleration")])


@query("w10_movement", with_(PANEL_BASE) + f"""
SELECT chain_id, product_id, {ym('period')} AS period, coalesce(idx - lst, idx) AS months_since_sale, zeros AS zero_months, {r('coalesce(hits / nullif(obs, 0), 0e0)')} AS movement_share,
  {r('CASE WHEN hits > 1 THEN (lst - fst) / (hits - 1) END')} AS mean_interval
FROM (SELECT *, max(CASE WHEN sales > 0 THEN idx END) OVER w AS lst, min(CASE WHEN sales > 0 THEN idx END) OVER w AS fst, count(*) FILTER (WHERE sales > 0) OVER w AS hits,
        count(*) FILTER (WHERE sales = 0) OVER w AS zeros, count(sales) OVER w AS obs FROM panel WINDOW w AS (PARTITION BY chain_id, product_id ORDER BY idx))""")
def movement(t: Tables):
    out = sr.movement_features(t.panel, SERIES, "sales")
    return out.select(
        *CP, pr.label("period").alias("period"), "months_since_sale", "zero_months",
        rounded(F.col("movement_share")).alias("movement_share"), rounded(F.col("mean_interval")).alias("mean_interval"),
    )


@query("w11_launch_history", with_(PANEL_BASE) + f"""
SELECT chain_id, product_id, {ym('period')} AS period, sales FROM (
  SELECT *, sum(CASE WHEN sales IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY chain_id, product_id ORDER BY idx) AS broken FROM (
    SELECT *, min(CASE WHEN sales > 0 THEN idx END) OVER (PARTITION BY chain_id, product_id) AS start FROM panel) WHERE idx >= start) WHERE broken = 0""")
def launch_history(t: Tables):
    return sr.launch_history(t.panel, SERIES, "sales").select(*CP, pr.label("period").alias("period"), "sales")


@query("w11_issue_history", with_(PANEL_BASE, ISLANDS) + f"""
SELECT chain_id, product_id, {ym('period')} AS period, sales FROM (
  SELECT *, max(period) OVER (PARTITION BY chain_id, product_id, island) AS last_p, min(CASE WHEN sales > 0 THEN period END) OVER (PARTITION BY chain_id, product_id, island) AS launch FROM runs WHERE sales IS NOT NULL)
WHERE last_p = {ISSUE_SQL} AND period >= launch""")
def issue_history(t: Tables):
    runs = sr.island_values(t.panel, SERIES, "sales").filter(F.element_at("periods", -1) == F.lit(ISSUE))
    return runs.select(*CP, F.explode(F.arrays_zip("periods", "values")).alias("p")).select(
        *CP, pr.label(F.col("p.periods")).alias("period"), F.col("p.values").alias("sales")
    )


@query("w12_prelaunch_trim", with_(BASE) + f"""
SELECT part_id, {ym('period')} AS period, sales FROM (SELECT part_id, period, sales, min(CASE WHEN sales > 0 THEN period END) OVER (PARTITION BY part_id) AS launch
  FROM (SELECT part_id, ship_m AS period, sum(CASE WHEN l_returnflag = 'R' THEN 0e0 ELSE qty END) AS sales FROM lines GROUP BY ALL)) WHERE launch IS NULL OR period >= launch""")
def prelaunch_trim(t: Tables):
    return t.part_values.select("part_id", F.explode(F.arrays_zip("periods", "values")).alias("p")).select(
        "part_id", pr.label(F.col("p.periods")).alias("period"), F.col("p.values").alias("sales")
    )


@query("w13_lifecycle", with_(BASE) + """
, h AS (SELECT part_id, period, sales, count(*) OVER (PARTITION BY part_id) AS n, row_number() OVER (PARTITION BY part_id ORDER BY period DESC) AS back
  FROM (SELECT part_id, period, sales, min(CASE WHEN sales > 0 THEN period END) OVER (PARTITION BY part_id) AS launch
    FROM (SELECT part_id, ship_m AS period, sum(CASE WHEN l_returnflag = 'R' THEN 0e0 ELSE qty END) AS sales FROM lines GROUP BY ALL)) WHERE period >= launch)
SELECT p_partkey AS part_id, CASE WHEN n IS NULL THEN 'PRE-LAUNCH' WHEN n < 18 THEN 'COLD_START' WHEN recent = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS lifecycle
FROM (SELECT DISTINCT part_id AS p_partkey FROM lines) LEFT JOIN (SELECT part_id, max(n) AS n, sum(sales) FILTER (WHERE back <= 6) AS recent FROM h GROUP BY part_id) ON p_partkey = part_id""")
def lifecycle(t: Tables):
    positive = F.when(F.exists("values", lambda x: x > 0), F.col("values"))
    return t.part_values.select("part_id", sr.lifecycle_label(positive).alias("lifecycle"))


@query("w23_recent_decline", with_(BASE) + """
SELECT part_id, count(*) = 3 AND max(sales) = 0 AS declined FROM (SELECT part_id, sales, row_number() OVER (PARTITION BY part_id ORDER BY period DESC) AS back
  FROM (SELECT part_id, ship_m AS period, sum(CASE WHEN l_returnflag = 'R' THEN 0e0 ELSE qty END) AS sales FROM lines GROUP BY ALL)) WHERE back <= 3 GROUP BY part_id""")
def recent_decline(t: Tables):
    tail = F.slice("values", F.greatest(F.size("values") - 2, F.lit(1)), F.lit(3))
    return t.part_values.select("part_id", ((F.size("values") + F.col("excluded") >= 3) & F.forall(tail, lambda x: x == 0) & (F.size("values") >= 3)).alias("declined"))


@query("j12_seasonal_lag_pairs", with_(PANEL_BASE) + f"""
SELECT chain_id, product_id, count(*) AS n, CASE WHEN stddev_pop(sales) > 0 AND stddev_pop(l12) > 0 THEN {r('corr(sales, l12)')} END AS seasonal_corr FROM (
  SELECT *, lag(sales, 12) OVER (PARTITION BY chain_id, product_id ORDER BY idx) AS l12 FROM panel) WHERE sales IS NOT NULL AND l12 IS NOT NULL GROUP BY ALL""")
def seasonal_lag_pairs(t: Tables):
    w = Window.partitionBy(*SERIES).orderBy("idx")
    rows = t.panel.withColumn("l12", F.lag("sales", 12).over(w)).filter("sales IS NOT NULL AND l12 IS NOT NULL")
    return rows.groupBy(*CP).agg(F.count(F.lit(1)).alias("n"), 
        # a constant side has no correlation
        rounded(F.try_divide(F.covar_pop("sales", "l12"), F.stddev_pop("sales") * F.stddev_pop("l12"))).alias("seasonal_corr"),
    )


@query("g15_level_drift", with_(PANEL_BASE) + f"""
SELECT chain_id, {r('abs(r3 - b9) / CASE WHEN sd <> 0 THEN sd ELSE 1e0 END', 2)} AS score, CASE WHEN {r('abs(r3 - b9) / CASE WHEN sd <> 0 THEN sd ELSE 1e0 END', 2)} >= 2 THEN 'alert' ELSE 'stable' END AS status FROM (
  SELECT chain_id, avg(s) FILTER (WHERE back <= 3) AS r3, avg(s) FILTER (WHERE back BETWEEN 4 AND 12) AS b9, stddev_pop(s) FILTER (WHERE back BETWEEN 4 AND 12) AS sd FROM (
    SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY period DESC) AS back FROM (SELECT chain_id, period, coalesce(sum(sales), 0e0) AS s FROM panel GROUP BY ALL)) GROUP BY chain_id)""")
def level_drift(t: Tables):
    from monthmill.operators.closure import level_drift as drift

    return drift(t.panel, ["chain_id"], "sales")


@query("g16_point_drift", with_(PANEL_BASE) + f"""
SELECT chain_id, product_id, {ym('period')} AS period, {r('rel')} AS relative_change, {r('base')} AS baseline, sales AS actual, CASE WHEN rel >= 0.35e0 * 1.5e0 THEN 'significant' ELSE 'warning' END AS severity FROM (
  SELECT *, abs(sales - base) / greatest(abs(base), 1e0) AS rel FROM (
    SELECT *, avg(sales) OVER (PARTITION BY chain_id, product_id ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS base,
      count(*) OVER (PARTITION BY chain_id, product_id ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS n FROM panel WHERE sales IS NOT NULL) WHERE n >= 3) WHERE rel >= 0.35e0""")
def point_drift(t: Tables):
    from monthmill.operators.closure import point_drift as drift

    return drift(t.panel.filter("sales IS NOT NULL"), SERIES, "period", "sales").select(
        *CP, pr.label("period").alias("period"), "relative_change", "baseline", F.col("sales").alias("actual"), "severity"
    )
