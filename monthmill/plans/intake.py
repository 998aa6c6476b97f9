"""Sources, sinks, customer forecasts, replays, paging and cold start."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from monthmill.functions import periods as pr
from monthmill.functions import text as tx
from monthmill.functions.numbers import rounded
from monthmill.operators import bands, champions, coldstart as cs, launchforest as lf, models as m, replay as rp, series as sr
from monthmill.plans.facts import RAW_SQL, raw_cells
from monthmill.plans.models import ALLOWED_SQL, BT_SQL, CLASS_SQL, RUN_SQL
from monthmill.plans.reconciling import CAND_SQL, candidates
from monthmill.plans.registry import query
from monthmill.plans.scored import CALC, calculations, horizons
from monthmill.plans.sql_parts import BASE, FACTS, ISSUE as ISSUE_SQL, PANEL_BASE, PART_BASE, PART_VALS, PATHS, r, vals, with_, ym
from monthmill.session import checkpoint_dir, cut_lineage
from monthmill.sources import cells as cl
from monthmill.sources import monthly_files as mf
from monthmill.sources.ledger import Ledger, versioned
from monthmill.sources.tables import ISSUE, SERIES, Tables

CP = ["chain_id", "product_id"]


@query("s01_normalised_facts", with_(BASE) + f"""
SELECT product_id, {ym('ship_m')} AS period, CASE WHEN l_returnflag = 'R' OR qty < 5 THEN NULL ELSE qty END AS value FROM lines WHERE l_linestatus = 'F'
QUALIFY row_number() OVER (PARTITION BY product_id, ship_m ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, qty DESC, l_returnflag DESC) = 1""")
def normalised_facts(t: Tables):
    text = t.lines.select(
        "product_id", pr.label("ship_m").alias("period"), F.when(F.col("l_linestatus") == "F", "Venta").otherwise("Pedido").alias("objective"),
        F.when(F.col("l_returnflag") == "R", "TRUE").otherwise("false").alias("is_missing"), F.when(F.col("qty") < 5, " ").otherwise(F.col("qty").cast("string")).alias("value"),
        "l_orderkey", "l_linenumber", "l_suppkey", "qty", "l_returnflag",
    )
    return mf.normalise_facts(text, F.lit("venta"), ["product_id", "period"], ["l_orderkey", "l_linenumber", "l_suppkey", "qty", "l_returnflag"])


S02_SQL = """
imp AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'total' ELSE 'P' || user_id END AS code, CASE WHEN value < 5 THEN ' ' ELSE event_type END AS descr, CASE WHEN event_id % 7 = 0 THEN strftime(ts, '%Y/%m') ELSE strftime(ts, '%Y-%m') END AS per, raw_text, event_type FROM raw),
ers AS (SELECT *, list_filter([CASE WHEN code = 'total' THEN 'invalid_product_code' END, CASE WHEN trim(descr) = '' THEN 'description_required' END, CASE WHEN event_id % 7 = 0 THEN 'invalid_period' END,
  CASE WHEN raw_text LIKE '=%' THEN 'unverified_formula:sales' END, CASE WHEN event_type IN ('error', 'signup') THEN 'invalid_metric:sales' END, CASE WHEN event_type NOT IN ('click', 'view') THEN 'no_valid_metric' END], lambda x: x IS NOT NULL) AS errors FROM imp)
"""


def import_rows(t: Tables):
    kind = F.col("event_type")
    return raw_cells(t).select(
        "event_id", F.when(kind == "error", "total").otherwise(F.concat(F.lit("P"), F.col("user_id").cast("string"))).alias("SKU"),
        F.when(F.col("value") < 5, " ").otherwise(kind).alias("TEXT"),
        F.when(F.col("event_id") % 7 == 0, F.date_format("ts", "yyyy/MM")).otherwise(F.date_format("ts", "yyyy-MM")).alias("MONTH"), F.col("raw_text").alias("SOLD"),
    )


PROFILE = {"product_code": "SKU", "description": "TEXT", "period": "MONTH", "sales": "SOLD"}


@query("s02_monthly_import_rejected", with_(RAW_SQL, S02_SQL) + "SELECT event_id, list_aggregate(errors, 'string_agg', ',') AS errors FROM ers WHERE len(errors) > 0")
def monthly_import_rejected(t: Tables):
    return mf.parse_monthly(import_rows(t), PROFILE)[1].select("event_id", F.array_join("errors", ",").alias("errors"))


@query("s02_monthly_import_accepted", with_(RAW_SQL, S02_SQL) + "SELECT event_id, code AS product_code, per AS period, CAST(CAST(replace(raw_text, ',', '') AS DECIMAL(38,6)) AS DOUBLE) AS sales FROM ers WHERE len(errors) = 0")
def monthly_import_accepted(t: Tables):
    return mf.parse_monthly(import_rows(t), PROFILE)[0].select("event_id", "product_code", "period", F.col("sales").cast("double").alias("sales"))


# Sheets --------------------------------------------------------------------------------------

METRIC_COLUMNS = {"sales": ("POS Qty", 2), "orders": ("Total Eaches Str Ordered", 14), "delivery": ("Total Eaches Str Received", 26)}


def sheet_cells(t: Tables):
    """Yearly sheets per chain: column 1 the item, then twelve months per metric."""
    rows = t.monthly.withColumns({"sheet": F.year("period").cast("string"), "row_no": F.substring("product_id", 7, 9).cast("int"), "mo": F.month("period")})
    items = rows.select(F.col("chain_id").alias("source"), "sheet", "row_no", F.lit(1).alias("column"), F.col("product_id").alias("raw_text")).distinct()
    data = rows.select(
        F.col("chain_id").alias("source"), "sheet", "row_no",
        F.inline(F.array(*[F.struct((F.col("mo") + start - 1).alias("column"), F.col(m).cast("bigint").cast("string").alias("raw_text")) for m, (_, start) in METRIC_COLUMNS.items()])),
    ).filter("raw_text IS NOT NULL")
    return items.unionByName(data)


def sheet_headers(t: Tables):
    sheets = t.monthly.select(F.col("chain_id").alias("source"), F.year("period").cast("string").alias("sheet")).distinct()
    entries = [
        F.struct(F.lit(start + mo - 1).alias("column"), F.concat("sheet", F.lit(f"/{mo:02d} {text}")).alias("header"))
        for text, start in METRIC_COLUMNS.values() for mo in range(1, 13)
    ]
    return sheets.select("source", "sheet", F.inline(F.array(*entries)))


SHEET_SQL = f"SELECT chain_id AS source, product_id AS item, {ym('period')} AS period, metric_code AS metric, CAST(CAST(value AS BIGINT) AS VARCHAR) AS raw_text FROM facts"


@query("s04_wide_sheet", with_(BASE, FACTS) + SHEET_SQL)
def wide_sheet(t: Tables):
    return cl.wide_rows(sheet_cells(t), sheet_headers(t), 1).select("source", "item", "period", "metric", "raw_text")


@query("s05_block_sheet", with_(BASE, FACTS) + SHEET_SQL)
def block_sheet(t: Tables):
    return cl.block_rows(sheet_cells(t), 1, F.col("sheet")).select("source", "item", "period", "metric", "raw_text")


@query("s06_master_sheet", with_(BASE) + f"""
SELECT chain_id, product_id, {ym('ship_m')} AS period, metric, sum(v) AS value FROM (SELECT chain_id, product_id, ship_m, 'SALES' AS metric, qty AS v FROM lines WHERE l_returnflag <> 'R' UNION ALL SELECT chain_id, product_id, ship_m, 'DELIVERY', qty FROM lines) GROUP BY ALL""")
def master_sheet(t: Tables):
    rows = t.lines.select(*CP, "l_shipdate", F.when(F.col("l_returnflag") != "R", F.col("qty")).alias("SALES"), F.col("qty").alias("DELIVERY"))
    long = rows.unpivot([*CP, "l_shipdate"], ["SALES", "DELIVERY"], "metric", "v").filter("v IS NOT NULL")
    return long.groupBy(*CP, pr.label(pr.month(F.col("l_shipdate"))).alias("period"), "metric").agg(F.sum("v").alias("value"))


@query("s07_profile_scan", with_(BASE, FACTS) + f"""
SELECT chain_id AS source, product_id AS item, {ym('period')} AS period, metric_code AS metric, CAST(CAST(value AS BIGINT) AS VARCHAR) AS raw_text FROM facts
WHERE CAST(substr(product_id, 7) AS INTEGER) BETWEEN CASE metric_code WHEN 'ORDER' THEN 10 ELSE 3 END AND 21 AND period <= DATE '2000-12-01'""")
def profile_scan(t: Tables):
    fields = cl.header_fields(sheet_headers(t)).filter("period <= '2000-12'").select(
        "source", "sheet", "column", "metric", "period", F.when(F.col("metric") == "ORDER", 10).otherwise(3).alias("row_from"), F.lit(21).alias("row_to")
    )
    items = sheet_cells(t).filter("column = 1").select("source", "sheet", "row_no", F.col("raw_text").alias("item"))
    return cl.profile_rows(sheet_cells(t).filter("column > 1"), fields).join(items, ["source", "sheet", "row_no"]).select("source", "item", "period", "metric", "raw_text")


@query("s08_distinct_files", "SELECT sha256(text) AS sha256, min(doc_id) AS representative, count(*) AS copies FROM documents GROUP BY 1")
def distinct_files(t: Tables):
    return mf.distinct_files(t.read("documents"), "text", "doc_id")


@query("s08_source_manifest", with_(BASE, CAND_SQL) + f"""
SELECT source, count(*) AS facts, count(DISTINCT period) AS periods, count(DISTINCT chain_id) AS chains, count(DISTINCT item) AS products, count(*) FILTER (WHERE literal_class <> 'VALUE') AS issues, {ym('min(period)')} AS period_min, {ym('max(period)')} AS period_max FROM cand GROUP BY source""")
def source_manifest(t: Tables):
    return candidates(t).groupBy("source").agg(
        F.count(F.lit(1)).alias("facts"), F.count_distinct("period").alias("periods"), F.count_distinct("chain_id").alias("chains"), F.count_distinct("item").alias("products"),
        F.count_if(F.col("literal_class") != "VALUE").alias("issues"), pr.label(F.min("period")).alias("period_min"), pr.label(F.max("period")).alias("period_max"),
    )


AVAILABLE = "CAST(period + to_months(CAST(1 + CAST(substr(product_id, 7) AS INTEGER) % 3 AS INTEGER)) AS DATE)"


def read_history(facts, chain: str, metric: str, until, cutoff=None, product: str | None = None):
    """The current values of one chain and metric up to a month, known at a cutoff if one is given.

    Every condition is one on a column of the store, so it reaches the scan. Two rows of a product and month are an error.
    """
    rows = facts.filter((F.col("chain_id") == chain) & (F.col("metric_code") == metric) & (F.col("period") <= until))
    if product is not None:
        rows = rows.filter(F.col("product_id") == product)
    if cutoff is not None:
        rows = rows.filter(F.col("available_at").isNotNull() & (F.col("available_at") <= cutoff))
    one = F.count(F.lit(1)).over(Window.partitionBy("product_id", "period"))
    checked = rows.withColumn("_n", one).withColumn("value", F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate observation"))).otherwise(F.col("value")))
    return checked.drop("_n")


@query("s09_chain_reader", with_(BASE, FACTS) + f"""
SELECT product_id, {ym('period')} AS period, value, {ym(AVAILABLE)} AS available FROM facts WHERE chain_id = 'BUILDING' AND metric_code = 'SALES' AND period <= {ISSUE_SQL} - INTERVAL 12 MONTH AND {AVAILABLE} <= {ISSUE_SQL} - INTERVAL 11 MONTH""")
def chain_reader(t: Tables):
    """Sales of one chain as they were known eleven months before the issue month."""
    delay = 1 + F.substring("product_id", 7, 9).cast("int") % 3
    facts = t.facts.withColumn("available_at", F.add_months("period", delay))
    at = lambda months: F.add_months(F.lit(ISSUE), months)
    rows = read_history(facts, "BUILDING", "SALES", at(-12), at(-11))
    return rows.select("product_id", pr.label("period").alias("period"), "value", pr.label("available_at").alias("available"))


@query("s11_line_actuals", with_(BASE) + f"""
, cat AS (SELECT DISTINCT chain_id, product_id FROM lines)
SELECT c.chain_id, c.product_id, s.v AS sale, o.v AS ordered, d.v AS delivered, {r('f.v')} AS customer_forecast FROM cat c
LEFT JOIN (SELECT chain_id, product_id, sum(qty) AS v FROM lines WHERE ship_m = {ISSUE_SQL} AND l_returnflag <> 'R' GROUP BY ALL) s USING (chain_id, product_id)
LEFT JOIN (SELECT chain_id, product_id, sum(qty) AS v FROM lines WHERE order_m = {ISSUE_SQL} GROUP BY ALL) o USING (chain_id, product_id)
LEFT JOIN (SELECT chain_id, product_id, sum(qty) AS v FROM lines WHERE ship_m = {ISSUE_SQL} GROUP BY ALL) d USING (chain_id, product_id)
LEFT JOIN (SELECT chain_id, product_id, sum(qty * l_discount * 10) AS v FROM lines WHERE ship_m = {ISSUE_SQL} - INTERVAL 12 MONTH GROUP BY ALL) f USING (chain_id, product_id)""")
def line_actuals(t: Tables):
    # the four measures come from one pass: a group without rows of a kind stays null
    at, ship, order = F.lit(ISSUE), F.col("ship_m"), F.col("order_m")
    total = lambda cond, v=F.col("qty"): F.sum(F.when(cond, v))
    return t.lines.groupBy(*CP).agg(
        total((ship == at) & (F.col("l_returnflag") != "R")).alias("sale"), total(order == at).alias("ordered"), total(ship == at).alias("delivered"),
        rounded(total(ship == F.add_months(at, -12), F.col("qty") * F.col("l_discount") * 10)).alias("customer_forecast"),
    )


@query("s12_frozen_fan_out", CALC + f"""
SELECT h.chain_id, h.product_id, {ym('target')} AS target, horizon, e.engine, {r('e.v')} AS value FROM (SELECT * FROM hor QUALIFY row_number() OVER (PARTITION BY chain_id, product_id, target, horizon ORDER BY created_at DESC, calculation_id DESC) = 1) h,
 LATERAL (VALUES ('statistical', statistical_value), ('ml', ml_value), ('official', ensemble_value)) e(engine, v)""")
def frozen_fan_out(t: Tables):
    keys = [*CP, "target_period", "horizon"]
    newest = horizons(t).groupBy(*keys).agg(
        F.max_by(F.struct("statistical_value", "ml_value", "ensemble_value"), F.struct("created_at", "calculation_id")).alias("v")
    )
    wide = newest.select(*keys, F.col("v.statistical_value").alias("statistical"), F.col("v.ml_value").alias("ml"), F.col("v.ensemble_value").alias("official"))
    return wide.unpivot(keys, ["statistical", "ml", "official"], "engine", "value").select(
        *CP, pr.label("target_period").alias("target"), "horizon", "engine", rounded(F.col("value")).alias("value")
    )


FACT_KEY = [*CP, "period", "metric_code"]


def two_uploads(t: Tables):
    """Facts before 2000, and those from June 1999 on, which overlap by seven months."""
    cut = lambda c: F.lit(c).cast("date")
    rows = cut_lineage(t.facts.select(*FACT_KEY, "value"))
    return rows.filter(F.col("period") < cut("2000-01-01")), rows.filter(F.col("period") >= cut("1999-06-01"))


@query("s13_append_only_rows", with_(BASE, FACTS) + f"""
SELECT chain_id, product_id, {ym('period')} AS period, metric_code, value, CASE WHEN period < DATE '2000-01-01' THEN 1 ELSE 2 END AS batch FROM facts""")
def append_only_rows(t: Tables):
    """Both uploads, the first again in another order, and a batch that breaks off before its manifest; then read back."""
    ledger = Ledger(t.spark, f"{checkpoint_dir(t.spark)}/facts-{uuid.uuid4().hex}")
    stored, incoming = two_uploads(t)
    ledger.append_new(stored, FACT_KEY, ["value"])
    ledger.append_new(incoming, FACT_KEY, ["value"])
    ledger.commit(stored.orderBy(F.desc("value")))
    ledger.stage(incoming.withColumn("value", F.lit(-1.0)))
    return ledger.read(stored.schema).select(*CP, pr.label("period").alias("period"), "metric_code", "value", "batch")


@query("s14_batch_confirm", with_(BASE, FACTS) + f"""
SELECT chain_id, product_id, {ym('period')} AS period, metric_code, value, v AS version_no, v_at AS available_at FROM facts,
  LATERAL (SELECT 1 AS v, CASE WHEN period < DATE '2000-01-01' THEN '2000-01-05' ELSE '2001-08-05' END AS v_at UNION ALL SELECT 2, '2001-08-05' WHERE period >= DATE '1999-06-01' AND period < DATE '2000-01-01') x""")
def batch_confirm(t: Tables):
    """Both uploads as versions, each confirmed twice; what overlaps gets a second version."""
    ledger = Ledger(t.spark, f"{checkpoint_dir(t.spark)}/versions-{uuid.uuid4().hex}")
    stored, incoming = two_uploads(t)
    for rows, at in ((stored, "2000-01-05"), (stored, "2000-02-05"), (incoming, "2001-08-05"), (incoming, "2001-09-05")):
        ledger.append_versions(rows, FACT_KEY, ["value"], at)
    return ledger.read(versioned(stored)).select(
        *CP, pr.label("period").alias("period"), "metric_code", "value", F.col("version_no").cast("int").alias("version_no"),
        F.date_format("available_at", "yyyy-MM-dd").alias("available_at"))


@query("s14_product_upsert", with_(BASE) + f"""
SELECT chain_id, product_id, {ym('min(period)')} AS first_seen, {ym('max(period)')} AS last_seen FROM monthly GROUP BY ALL""")
def product_upsert(t: Tables):
    old = t.monthly.filter(F.col("period") < F.lit("2000-01-01").cast("date")).groupBy(*CP).agg(F.min("period").alias("first_seen"), F.max("period").alias("last_seen"))
    new = t.monthly.filter(F.col("period") >= F.lit("1999-06-01").cast("date"))
    return mf.upsert_products(old, new, CP).select(*CP, pr.label("first_seen").alias("first_seen"), pr.label("last_seen").alias("last_seen"))


@query("s15_import_preview", with_(BASE) + """
SELECT chain_id, count(*) FILTER (WHERE k IS NULL) AS new_products, count(*) FILTER (WHERE k IS NOT NULL AND last_old >= DATE '1996-12-01') AS existing, count(*) FILTER (WHERE k IS NOT NULL AND last_old < DATE '1996-12-01') AS updated FROM (
 SELECT i.chain_id, e.part_id AS k, e.last_old FROM (SELECT DISTINCT chain_id, part_id FROM lines WHERE ship_m >= DATE '1997-01-01') i LEFT JOIN (SELECT chain_id, part_id, max(ship_m) AS last_old FROM lines WHERE ship_m < DATE '1997-01-01' GROUP BY ALL) e USING (chain_id, part_id)) GROUP BY chain_id""")
def import_preview(t: Tables):
    cut = lambda c: F.lit(c).cast("date")
    # old and new side in one grouping: no join between them is needed
    g = t.lines.groupBy("chain_id", "part_id").agg(
        F.max(F.when(F.col("ship_m") < cut("1997-01-01"), F.col("ship_m"))).alias("last_old"), F.count_if(F.col("ship_m") >= cut("1997-01-01")).alias("incoming")
    ).filter("incoming > 0")
    old = F.col("last_old")
    return g.groupBy("chain_id").agg(
        F.count_if(old.isNull()).alias("new_products"), F.count_if(old >= cut("1996-12-01")).alias("existing"), F.count_if(old < cut("1996-12-01")).alias("updated")
    )


@query("s16_json_export", with_(BASE) + """
SELECT '{"chain_id":"' || chain_id || '","product_id":"' || product_id || '","months":' || count(*) || ',"sold":' || CAST(sum(sales) AS BIGINT) || '}' AS line FROM monthly GROUP BY chain_id, product_id""")
def json_export(t: Tables):
    g = t.monthly.groupBy(*CP).agg(F.count(F.lit(1)).alias("months"), F.sum("sales").cast("bigint").alias("sold"))
    path = f"{checkpoint_dir(t.spark)}/export-{uuid.uuid4().hex}"
    mf.write_json(g, path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


S17_SQL = """
el AS (SELECT * FROM cand WHERE CASE WHEN year(period) % 2 = 0 THEN source IN ('S1', 'S2', 'S3') ELSE source IN ('S4', 'S5') END)
"""


@query("s17_input_builder", with_(BASE, CAND_SQL, S17_SQL) + f"""
SELECT {ym('period')} AS period, sum(value) FILTER (WHERE metric = 'SALES') AS sales, sum(value) FILTER (WHERE metric = 'DELIVERY') AS delivery, list_aggregate(list_sort(list(DISTINCT source)), 'string_agg', ',') AS lineage
FROM (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY chain_id, item, period, metric ORDER BY source DESC, sheet DESC) = 1) GROUP BY period""")
def input_builder(t: Tables):
    even = F.year("period") % 2 == 0
    eligible = candidates(t).filter(F.when(even, F.col("source").isin("S1", "S2", "S3")).otherwise(F.col("source").isin("S4", "S5")))
    last = eligible.groupBy("chain_id", "item", "period", "metric").agg(F.max_by(F.struct("value", "source"), F.struct("source", "sheet")).alias("r")).select("period", "metric", "r.*")
    lineage = last.groupBy("period").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("lineage"))
    totals = last.groupBy("period").pivot("metric", ["SALES", "DELIVERY"]).agg(F.sum("value"))
    return totals.join(lineage, "period").select(pr.label("period").alias("period"), F.col("SALES").alias("sales"), F.col("DELIVERY").alias("delivery"), "lineage")


@query("s18_nested_vintage", CALC + f"SELECT calculation_id, horizon, {r('ensemble_value')} AS value FROM hor WHERE status = 'DECIDED'")
def nested_vintage(t: Tables):
    doc = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("horizon", F.col("ensemble_value").alias("value")))).alias("horizons")))
    documents = horizons(t).filter("status = 'DECIDED'").groupBy("calculation_id").agg(doc.alias("document"))
    rows = mf.explode_document(documents, "document", "horizons array<struct<horizon int, value double>>", "horizons", ["calculation_id"])
    return rows.select("calculation_id", "horizon", rounded(F.col("value")).alias("value"))


@query("s18_event_properties", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def event_properties(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# Customer forecasts ------------------------------------------------------------------------------

CUST_SQL = """
cv AS (SELECT chain_id, product_id, ship_m AS target, order_m AS issue, l_orderkey AS version_no, sum(qty) AS value FROM lines WHERE o_orderstatus IN ('F', 'P') AND order_m <= DATE '2000-06-01' GROUP BY ALL)
"""


def customer_versions(t: Tables):
    """Orders act as forecast versions of their customer's chain; open ones are drafts."""
    return (
        t.lines.filter(F.col("o_orderstatus").isin("F", "P") & (F.col("order_m") <= F.lit("2000-06-01").cast("date")))
        .groupBy(*CP, F.col("ship_m").alias("target"), F.col("order_m").alias("issue"), F.col("l_orderkey").alias("version_no"))
        .agg(F.sum("qty").alias("value"))
    )


@query("j05_customer_forecast_by_product", with_(BASE, CUST_SQL) + f"""
SELECT chain_id, product_id, {ym('target')} AS target, arg_max(value, (issue, version_no)) AS value FROM cv GROUP BY ALL""")
def customer_by_product(t: Tables):
    v = customer_versions(t).groupBy(*CP, "target").agg(F.max_by("value", F.struct("issue", "version_no")).alias("value"))
    return v.select(*CP, pr.label("target").alias("target"), "value")


@query("j05_customer_forecast_by_header", with_(BASE, CUST_SQL) + f"""
SELECT chain_id, {ym('target')} AS target, sum(value) AS value FROM cv JOIN (SELECT chain_id, arg_max(version_no, (issue, version_no)) AS version_no FROM cv GROUP BY chain_id) h USING (chain_id, version_no) GROUP BY ALL""")
def customer_by_header(t: Tables):
    v = customer_versions(t)
    header = v.groupBy("chain_id").agg(F.max(F.struct("issue", "version_no")).alias("h")).select("chain_id", F.col("h.version_no").alias("version_no"))
    return v.join(header, ["chain_id", "version_no"]).groupBy("chain_id", pr.label("target").alias("target")).agg(F.sum("value").alias("value"))


@query("j28_closed_observations", with_(BASE) + f"""
, closed AS (SELECT chain_id, product_id, ship_m AS period FROM lines GROUP BY ALL HAVING arg_max(l_linestatus, (l_shipdate, l_orderkey, l_linenumber)) = 'F')
SELECT objective, chain_id, product_id, {ym('period')} AS period, sum(v) AS value FROM (SELECT 'sales' AS objective, chain_id, product_id, period, sales AS v FROM monthly WHERE sales IS NOT NULL UNION ALL SELECT 'order', chain_id, product_id, period, orders FROM monthly WHERE orders IS NOT NULL) JOIN closed USING (chain_id, product_id, period) GROUP BY ALL""")
def closed_observations(t: Tables):
    # a month of a series is closed when its latest status row says so, whatever its volume
    status = F.max_by("l_linestatus", F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    closed = t.lines.groupBy(*CP, F.col("ship_m").alias("period")).agg(status.alias("s")).filter("s = 'F'").select(*CP, "period")
    long = t.monthly.withColumnRenamed("orders", "order").unpivot([*CP, "period"], ["sales", "order"], "objective", "v").filter("v IS NOT NULL")
    return long.join(closed, [*CP, "period"]).groupBy("objective", *CP, pr.label("period").alias("period")).agg(F.sum("v").alias("value"))


@query("j29_dense_training_matrix", with_(PANEL_BASE) + f"""
SELECT p.chain_id, p.product_id, {ym('p.period')} AS period, p.sales, p.orders, p.delivery, c.sales AS year_before FROM panel p LEFT JOIN panel c ON c.chain_id = p.chain_id AND c.product_id = p.product_id AND c.period = p.period - INTERVAL 12 MONTH""")
def dense_training_matrix(t: Tables):
    w = Window.partitionBy(*SERIES).orderBy("idx")
    return t.panel.select(*CP, pr.label("period").alias("period"), "sales", "orders", "delivery", F.lag("sales", 12).over(w).alias("year_before"))


@query("j09_expansion", with_(PANEL_BASE, ALLOWED_SQL) + f"""
SELECT chain_id, product_id, {ym('period')} AS origin, h AS horizon, {ym('period + to_months(h)')} AS target, list_aggregate(list_sort(list(model)), 'string_agg', ',') AS models
FROM (SELECT *, count(sales) OVER (PARTITION BY chain_id, product_id ORDER BY idx) AS known FROM panel), (SELECT CAST(unnest([1, 3, 6, 12]) AS INTEGER) AS h), reg WHERE sales IS NOT NULL AND need <= known GROUP BY ALL""")
def expansion(t: Tables):
    """Every origin, horizon and model that the months known by then are enough for; the models of a point in one list."""
    w = Window.partitionBy(*SERIES).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    known = t.panel.withColumn("known", F.count("sales").over(w)).filter("sales IS NOT NULL")
    able = F.array_compact(F.array(*[F.when(F.col("known") >= need, name) for name, need in m.REQUIREMENTS.items()]))
    rows = known.select(*CP, "period", able.alias("models"), F.explode(F.array(*[F.lit(h) for h in (1, 3, 6, 12)])).alias("horizon"))
    return rows.select(
        *CP, pr.label("period").alias("origin"), "horizon", pr.label(F.add_months("period", F.col("horizon"))).alias("target"),
        F.array_join(F.array_sort("models"), ",").alias("models"))


# Quality, dashboards, replays ---------------------------------------------------------------------

@query("g19_data_quality", with_(BASE) + f"""
SELECT chain_id, product_id, obs AS observed, date_diff('month', p0, {ISSUE_SQL}) + 1 AS expected, greatest(0, date_diff('month', p0, {ISSUE_SQL}) + 1 - obs) AS missing, {r(f"obs / (date_diff('month', p0, {ISSUE_SQL}) + 1)", 6)} AS continuity,
 CASE WHEN most > 1 THEN 'IDENTITY_CONFLICT' WHEN bad > 0 THEN 'BLOCKED' WHEN obs < date_diff('month', p0, {ISSUE_SQL}) + 1 AND obs / (date_diff('month', p0, {ISSUE_SQL}) + 1) < 0.85 THEN 'HISTORICAL_INCOMPLETE' WHEN obs < 18 THEN 'INSUFFICIENT_HISTORY'
  WHEN obs < date_diff('month', p0, {ISSUE_SQL}) + 1 OR unk > 0 THEN 'DATA_QUALITY_WARNING' ELSE 'DATA_QUALITY_READY' END AS status
FROM (SELECT chain_id, product_id, count(*) AS obs, min(period) AS p0, 1 AS most, count(*) FILTER (WHERE sales < 0) AS bad, count(*) FILTER (WHERE orders IS NULL) AS unk FROM monthly WHERE sales IS NOT NULL AND period <= {ISSUE_SQL} GROUP BY ALL)""")
def data_quality(t: Tables):
    rows = t.monthly.filter("sales IS NOT NULL").select(*CP, "period", F.col("sales").alias("value"), F.when(F.col("orders").isNotNull(), F.col("period")).alias("available_at"))
    return rp.data_quality(rows, CP, ISSUE).select(*CP, "observed", "expected", "missing", "continuity", "status")


@query("g32_year_offsets", with_(BASE) + f"""
, tot AS (SELECT chain_id, period, sum(sales) AS s FROM monthly GROUP BY ALL)
SELECT a.chain_id, {ym('a.period')} AS period, a.s AS actual, b.s AS previous_1, c.s AS previous_2 FROM tot a LEFT JOIN tot b ON b.chain_id = a.chain_id AND b.period = a.period - INTERVAL 12 MONTH LEFT JOIN tot c ON c.chain_id = a.chain_id AND c.period = a.period - INTERVAL 24 MONTH""")
def year_offsets(t: Tables):
    tot = t.monthly.groupBy("chain_id", "period").agg(F.sum("sales").alias("s"))
    # each total serves its own month and the same month one and two years later
    moved = tot.select("chain_id", "s", F.explode(F.array(F.lit(0), F.lit(12), F.lit(24))).alias("off"), "period").withColumn("at", F.add_months("period", F.col("off")))
    pick = lambda o: F.max(F.when(F.col("off") == o, F.col("s")))
    g = moved.groupBy("chain_id", "at").agg(
        F.count_if(F.col("off") == 0).alias("own"), pick(0).alias("actual"), pick(12).alias("previous_1"), pick(24).alias("previous_2")
    ).filter("own > 0")
    return g.select("chain_id", pr.label("at").alias("period"), "actual", "previous_1", "previous_2")


REPLAY_SQL = """
dv AS (SELECT user_id, event_type, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(ts AS DATE) AS day, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL),
days AS (SELECT DISTINCT day FROM dv)
"""


@query("b19_replay_totals", with_(REPLAY_SQL) + f"""
SELECT strftime(d.day, '%Y-%m-%d') AS cutoff, count(*) AS known_facts, {r('sum(v)', 2)} AS total FROM days d, LATERAL (SELECT user_id, event_type, week, arg_max(v, dv.day) AS v FROM dv WHERE dv.day <= d.day GROUP BY ALL) x GROUP BY d.day""")
def replay_totals(t: Tables):
    rows = t.events.select("user_id", "event_type", F.to_date(F.date_trunc("week", "ts")).alias("week"), F.to_date("ts").alias("day"), "ts", "event_id", "value")
    out = rp.replay_totals(rows, ["user_id", "event_type", "week"], "day", ["ts", "event_id"], "value")
    return out.select(F.date_format("cutoff", "yyyy-MM-dd").alias("cutoff"), "known_facts", rounded(F.col("total"), 2).alias("total"))


READY_SQL = """
rd0 AS (SELECT *, min(CASE WHEN sales > 0 THEN idx END) OVER (PARTITION BY chain_id, product_id ORDER BY idx) AS start FROM panel),
rd1 AS (SELECT *, sum(CASE WHEN idx >= start AND sales IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY chain_id, product_id ORDER BY idx) AS broken FROM rd0),
rd2 AS (SELECT *, sum(CASE WHEN idx >= start AND broken = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY chain_id, product_id ORDER BY idx) AS run FROM rd1),
rd AS (SELECT *, CASE WHEN start IS NULL THEN 'NO_DATA' WHEN run < 7 OR start + run - 1 < idx - 1 THEN 'INSUFFICIENT_HISTORY' ELSE 'READY' END AS status FROM rd2)
"""


@query("b20_temporal_readiness", with_(PANEL_BASE, READY_SQL) + f"SELECT chain_id, product_id, {ym('period')} AS period, CAST(run AS BIGINT) AS consecutive, status FROM rd")
def temporal_readiness(t: Tables):
    return rp.readiness(t.panel, SERIES, "sales").select(*CP, pr.label("period").alias("period"), "consecutive", "status")


@query("b20_first_valid_month", with_(PANEL_BASE, READY_SQL) + f"SELECT chain_id, product_id, {ym('min(CASE WHEN status = $$READY$$ THEN period END)')} AS first_valid FROM rd GROUP BY ALL".replace("$$", "'"))
def first_valid_month(t: Tables):
    ready = rp.readiness(t.panel, SERIES, "sales")
    return ready.groupBy(*CP).agg(pr.label(F.min(F.when(F.col("status") == "READY", F.col("period")))).alias("first_valid"))


@query("b22_eligibility_counts", with_(PART_BASE, PART_VALS) + """
SELECT lifecycle, count(*) AS series FROM (SELECT sid, CASE WHEN max(v) <= 0 THEN 'PRE-LAUNCH' WHEN count(*) < 18 THEN 'COLD_START' WHEN coalesce(max(v) FILTER (WHERE idx > n - 6), 0) = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS lifecycle FROM vals GROUP BY sid) GROUP BY lifecycle""")
def eligibility_counts(t: Tables):
    positive = F.when(F.exists("values", lambda x: x > 0), F.col("values"))
    return t.part_values.groupBy(sr.lifecycle_label(positive).alias("lifecycle")).agg(F.count(F.lit(1)).alias("series"))


@query("b22_not_eligible_scopes", with_(PART_BASE, PART_VALS) + """
, life AS (SELECT sid, CASE WHEN max(v) <= 0 THEN 'PRE-LAUNCH' WHEN count(*) < 18 THEN 'COLD_START' WHEN coalesce(max(v) FILTER (WHERE idx > n - 6), 0) = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS lifecycle FROM vals GROUP BY sid)
SELECT p_brand || '|' || p_size AS scope, count(lifecycle) AS products, count(*) FILTER (WHERE lifecycle = 'ACTIVE') AS eligible, CASE WHEN count(*) FILTER (WHERE lifecycle = 'ACTIVE') = 0 THEN 'NOT_ELIGIBLE' ELSE 'ELIGIBLE' END AS status
FROM part LEFT JOIN life ON CAST(p_partkey AS VARCHAR) = sid GROUP BY 1""")
def not_eligible_scopes(t: Tables):
    """A brand and size is eligible if one of its products is active; products without a line have no lifecycle."""
    positive = F.when(F.exists("values", lambda x: x > 0), F.col("values"))
    life = t.part_values.select(F.col("part_id").alias("p_partkey"), sr.lifecycle_label(positive).alias("lifecycle"))
    rows = t.read("part").select("p_partkey", F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("scope")).join(life, "p_partkey", "left")
    eligible = F.count_if(F.col("lifecycle") == "ACTIVE")
    return rows.groupBy("scope").agg(
        F.count("lifecycle").alias("products"), eligible.alias("eligible"), F.when(eligible == 0, "NOT_ELIGIBLE").otherwise("ELIGIBLE").alias("status"))


# Publications: every order proposes a version for the chain and objective it belongs to. Who may publish, what is
# certified and which version the author expects in force follow from its numbers.
EVENTS_SQL = """
pub AS (SELECT c_mktsegment AS chain_id, CASE o_orderstatus WHEN 'F' THEN 'SALES' WHEN 'O' THEN 'ORDER' ELSE 'DELIVERY' END AS objective, o_orderdate AS moment, o_orderkey AS seq, 'V' || (o_custkey % 5) AS version,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'V' || (o_orderkey % 5) END AS expected,
  CASE WHEN o_orderkey % 11 = 0 THEN 'UNAUTHORISED' WHEN o_custkey % 7 = 0 THEN 'UNCERTIFIED' WHEN day(o_orderdate) = 13 THEN 'GATE_NOT_READY' WHEN o_orderkey % 13 < 2 THEN 'COMMENT_TOO_SHORT' END AS own
  FROM orders JOIN customer ON o_custkey = c_custkey),
lined AS (SELECT *, row_number() OVER (PARTITION BY chain_id, objective ORDER BY moment, seq) AS k FROM pub WHERE own IS NULL),
fold(chain_id, objective, k, moment, seq, version, expected, before, now) AS (
  SELECT chain_id, objective, k, moment, seq, version, expected, CAST(NULL AS VARCHAR), CASE WHEN expected IS NULL THEN version END FROM lined WHERE k = 1 UNION ALL
  SELECT l.chain_id, l.objective, l.k, l.moment, l.seq, l.version, l.expected, f.now, CASE WHEN l.expected IS NULL OR l.expected IS NOT DISTINCT FROM f.now OR l.version IS NOT DISTINCT FROM f.now THEN l.version ELSE f.now END
  FROM fold f JOIN lined l ON l.chain_id = f.chain_id AND l.objective = f.objective AND l.k = f.k + 1),
told AS (SELECT *, CASE WHEN version IS NOT DISTINCT FROM before THEN 'UNCHANGED' WHEN expected IS NOT NULL AND expected IS DISTINCT FROM before THEN 'REFUSED' ELSE 'PUBLISHED' END AS outcome FROM fold),
champ AS (SELECT chain_id, objective, moment AS valid_from, seq, version, before AS previous_version, lead(moment) OVER (PARTITION BY chain_id, objective ORDER BY moment, seq) AS valid_to FROM told WHERE outcome = 'PUBLISHED')
"""
SCOPE = ["chain_id", "objective"]


def publication_events(t: Tables):
    rows = t.read("orders").join(t.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    key, cust, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    return rows.select(
        F.col("c_mktsegment").alias("chain_id"), F.when(status == "F", "SALES").when(status == "O", "ORDER").otherwise("DELIVERY").alias("objective"),
        F.col("o_orderdate").cast("timestamp").alias("at"), key.alias("seq"), F.concat(F.lit("V"), (cust % 5).cast("string")).alias("version"),
        F.when(key % 4 != 0, F.concat(F.lit("V"), (key % 5).cast("string"))).alias("expected"), F.when(key % 11 != 0, F.concat(F.lit("U"), (cust % 9).cast("string"))).alias("actor"),
        (cust % 7 != 0).alias("certified"), (F.dayofmonth("o_orderdate") != 13).alias("gate_ready"), F.when(key % 13 < 2, 2).otherwise(20).alias("comment_length"),
    )


def published(t: Tables):
    return champions.publications(publication_events(t), SCOPE)


@query("b18_champion_publication", with_(EVENTS_SQL) + """
SELECT chain_id, objective, seq, version, previous_version, strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(valid_to, '%Y-%m-%d') AS valid_to, CASE WHEN valid_to IS NULL THEN 'ACTIVE' ELSE 'RETIRED' END AS status FROM champ""")
def champion_publication(t: Tables):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return champions.in_force(published(t)).select(
        *SCOPE, "seq", "version", "previous_version", day("at").alias("valid_from"), day("valid_to").alias("valid_to"), "status")


@query("b18_refused_transitions", with_(EVENTS_SQL) + """
SELECT chain_id, objective, outcome, reason, count(*) AS n FROM (SELECT chain_id, objective, 'REFUSED' AS outcome, own AS reason FROM pub WHERE own IS NOT NULL
  UNION ALL SELECT chain_id, objective, outcome, CASE WHEN outcome = 'REFUSED' THEN 'STALE_PREDECESSOR' END FROM told WHERE outcome <> 'PUBLISHED') GROUP BY ALL""")
def refused_transitions(t: Tables):
    return published(t).filter("outcome <> 'PUBLISHED'").groupBy(*SCOPE, "outcome", "reason").agg(F.count(F.lit(1)).alias("n"))


# Facts become known late: deliveries one to three months after their month, corrected sales three or four.
KNOWN_SQL = f"""
fv AS (SELECT chain_id, product_id, period, 1 AS ver, delivery AS v, CAST(period + to_months(CAST(1 + bn % 3 AS INTEGER)) AS DATE) AS av FROM (SELECT *, CAST(substr(product_id, 7) AS INTEGER) AS bn FROM panel) WHERE sales IS NOT NULL
  UNION ALL SELECT chain_id, product_id, period, 2, sales, CAST(period + to_months(CAST(3 + bn % 2 AS INTEGER)) AS DATE) FROM (SELECT *, CAST(substr(product_id, 7) AS INTEGER) AS bn FROM panel) WHERE sales IS NOT NULL),
cutoffs AS (SELECT chain_id, CAST(unnest(generate_series(min(av), {ISSUE_SQL}, INTERVAL 1 MONTH)) AS DATE) AS c FROM fv GROUP BY chain_id),
kn AS (SELECT chain_id, c, period, sum(v) AS v FROM (SELECT k.chain_id, c, product_id, period, arg_max(v, (av, ver)) AS v FROM cutoffs k JOIN fv f ON f.chain_id = k.chain_id AND f.av <= k.c AND f.period <= k.c GROUP BY ALL) GROUP BY ALL),
"""
REPLAY_VALS = vals("(SELECT chain_id || '|' || strftime(c, '%Y-%m') AS s, period, v AS sales FROM kn)", "s", keep_zero=False)
REPLAY_RUN = with_(PANEL_BASE, KNOWN_SQL, REPLAY_VALS, PATHS, BT_SQL, CLASS_SQL, ALLOWED_SQL, RUN_SQL, f"""
hist AS (SELECT sid, list((period, v) ORDER BY period) AS h, max(period) AS last_p, max(n) AS n FROM vals GROUP BY sid),
runs AS (SELECT k.chain_id, k.c, coalesce(n, 0) AS n, last_p, sid, h IS NOT DISTINCT FROM lag(h) OVER (PARTITION BY k.chain_id ORDER BY k.c) AND row_number() OVER (PARTITION BY k.chain_id ORDER BY k.c) > 1 AS carried
  FROM cutoffs k LEFT JOIN hist ON sid = k.chain_id || '|' || strftime(k.c, '%Y-%m')),
vint AS (SELECT r.*, winner, CASE WHEN r.n = 0 THEN 'BLOCKED' WHEN r.n < 7 THEN 'SKIPPED_INSUFFICIENT_HISTORY' ELSE 'COMPLETED' END AS state FROM runs r LEFT JOIN res USING (sid)),
pts AS (SELECT v.chain_id, v.c, p.step AS horizon, CAST(last_p + to_months(p.step) AS DATE) AS target, {r('greatest(0e0, p.pred)', 2)} AS forecast FROM vint v JOIN paths p ON p.sid = v.sid AND p.origin = v.n AND p.model = v.winner),
fin AS (SELECT chain_id, period AS target, v AS actual FROM kn WHERE c = {ISSUE_SQL}),
rq AS (SELECT v.chain_id, v.c, quantile_cont(b.actual - b.pred, [0.1, 0.5, 0.9, 0.95]) AS q FROM vint v JOIN bt b ON b.sid = v.sid AND b.model = v.winner AND b.step = 1 GROUP BY ALL),
ev AS (SELECT *, CASE WHEN a < b10 THEN 'below_p10' WHEN a < b50 THEN 'p10_p50' WHEN a < b90 THEN 'p50_p90' WHEN a < b95 THEN 'p90_p95' ELSE 'above_p95' END AS coverage FROM (
  SELECT p.*, actual, round(actual * 1e7) / 1e7 AS a, round(greatest(0e0, forecast + q[1]) * 1e7) / 1e7 AS b10, round(greatest(0e0, forecast + q[2]) * 1e7) / 1e7 AS b50, round((forecast + q[3]) * 1e7) / 1e7 AS b90, round((forecast + q[4]) * 1e7) / 1e7 AS b95
  FROM pts p JOIN fin USING (chain_id, target) JOIN rq USING (chain_id, c)))
""")


def replayed(t: Tables):
    """Every chain at every month from its first known fact to the issue month; stored."""
    def build():
        bn = F.substring("product_id", 7, 9).cast("int")
        rows = t.panel.filter("sales IS NOT NULL").select(*CP, "period", F.inline(F.array(
            F.struct(F.lit(1).alias("ver"), F.col("delivery").alias("v"), F.add_months("period", 1 + bn % 3).alias("av")),
            F.struct(F.lit(2).alias("ver"), F.col("sales").alias("v"), F.add_months("period", 3 + bn % 2).alias("av")),
        )))
        known = cut_lineage(rp.known_totals(rows.filter(F.col("av") <= F.lit(ISSUE)), ["chain_id"], ["product_id"], "period", "av", ["ver"], "v"))
        final = known.groupBy("chain_id", "period").agg(F.max_by("known", "cutoff").alias("actual"))
        return cut_lineage(rp.replay(known, ["chain_id"], ISSUE).join(
            final.groupBy("chain_id").agg(F.map_from_entries(F.collect_list(F.struct("period", "actual"))).alias("actuals")), "chain_id"))

    return t.kept("replayed", build)


def replay_points(t: Tables):
    """One row for each run and horizon whose month is known by now, with the bands of the run's own one-step residuals."""
    runs = replayed(t).filter("status = 'COMPLETED'")
    steps = runs.select("chain_id", "cutoff", "last_month", "actuals", F.posexplode("forecast").alias("p", "forecast"))
    rows = steps.withColumns({"horizon": F.col("p") + 1, "target": F.add_months("last_month", F.col("p") + 1)})
    return rows.withColumn("actual", F.col("actuals")[F.col("target")]).filter("actual is not null").select("chain_id", "cutoff", "horizon", "target", "forecast", "actual")


@query("b19_replay_runs", REPLAY_RUN + f"""
SELECT v.chain_id, {ym('v.c')} AS cutoff, state AS status, carried, CAST(v.n AS INTEGER) AS known_months, {ym('last_p')} AS last_month, winner, forecast AS next_month FROM vint v LEFT JOIN pts p ON p.chain_id = v.chain_id AND p.c = v.c AND p.horizon = 1""")
def replay_runs(t: Tables):
    return replayed(t).select(
        "chain_id", pr.label("cutoff").alias("cutoff"), "status", "carried", F.col("n").alias("known_months"), pr.label("last_month").alias("last_month"), "winner",
        F.col("forecast")[0].alias("next_month"))


@query("g41_replay_summary", REPLAY_RUN + f"""
SELECT chain_id, count(*) AS periods_requested, count(*) FILTER (WHERE state = 'COMPLETED') AS executed, count(*) FILTER (WHERE state = 'SKIPPED_INSUFFICIENT_HISTORY') AS skipped, count(*) FILTER (WHERE state = 'BLOCKED') AS blocked,
  count(*) FILTER (WHERE carried) AS carried, {ym("min(CASE WHEN state = 'COMPLETED' THEN c END)")} AS first_forecastable, {ym("max(CASE WHEN state = 'COMPLETED' THEN c END)")} AS last_forecast FROM vint GROUP BY chain_id""")
def replay_summary(t: Tables):
    done = F.when(F.col("status") == "COMPLETED", F.col("cutoff"))
    of = lambda s: F.count_if(F.col("status") == s)
    return replayed(t).groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("periods_requested"), of("COMPLETED").alias("executed"), of("SKIPPED_INSUFFICIENT_HISTORY").alias("skipped"), of("BLOCKED").alias("blocked"),
        F.count_if("carried").alias("carried"), pr.label(F.min(done)).alias("first_forecastable"), pr.label(F.max(done)).alias("last_forecast"))


@query("g41_replay_metrics", REPLAY_RUN + f"""
SELECT horizon, count(*) AS observations, {r('100 * sum(abs(actual - forecast)) / sum(actual)')} AS wape, {r('100 * sum(actual - forecast) / sum(actual)')} AS bias,
  {', '.join(f"count(*) FILTER (WHERE coverage = '{b}') AS {b}" for b in ('below_p10', 'p10_p50', 'p50_p90', 'p90_p95', 'above_p95'))} FROM ev GROUP BY GROUPING SETS ((horizon), ())""")
def replay_metrics(t: Tables):
    """Errors and coverage of all runs by horizon, and over all horizons."""
    q = F.percentile("residual", F.array(*[F.lit(p) for p in (0.1, 0.5, 0.9, 0.95)])).alias("q")
    quantiles = replayed(t).select("chain_id", "cutoff", F.explode("residuals").alias("residual")).filter("residual is not null").groupBy("chain_id", "cutoff").agg(q)
    rows = replay_points(t).join(quantiles, ["chain_id", "cutoff"])
    a, f = F.col("actual"), F.col("forecast")
    low = lambda i: F.greatest(F.lit(0.0), f + F.col("q")[i])
    bucket = bands.coverage_bucket(a, low(0), low(1), f + F.col("q")[2], f + F.col("q")[3])
    counted = [F.count_if(F.col("coverage") == b).alias(b) for b in ("below_p10", "p10_p50", "p50_p90", "p90_p95", "above_p95")]
    return rows.withColumn("coverage", bucket).rollup("horizon").agg(
        F.count(F.lit(1)).alias("observations"), rounded(100 * F.sum(F.abs(a - f)) / F.sum(a)).alias("wape"), rounded(100 * F.sum(a - f) / F.sum(a)).alias("bias"), *counted)


@query("g42_availability_matrix", """
SELECT event_type AS field, day, count(*) AS records, count(*) FILTER (WHERE value >= 20) AS eligible, count(*) FILTER (WHERE value < 20) AS excluded FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, value FROM events) GROUP BY CUBE (event_type, day)""")
def availability_matrix(t: Tables):
    rows = t.events.select(F.col("event_type").alias("field"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    return rows.cube("field", "day").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("value") >= 20).alias("eligible"), F.count_if(F.col("value") < 20).alias("excluded"))


# Paging -----------------------------------------------------------------------------------------------

@query("t05_keyset_page", with_(BASE) + f"""
SELECT chain_id, product_id, {ym('period')} AS period, sales FROM monthly WHERE (chain_id, product_id, period) > ('BUILDING', 'Brand#12', DATE '1997-05-01') ORDER BY chain_id, product_id, monthly.period LIMIT 50""")
def keyset_page(t: Tables):
    key = F.struct("chain_id", "product_id", "period")
    cursor = F.struct(F.lit("BUILDING").alias("chain_id"), F.lit("Brand#12").alias("product_id"), F.lit("1997-05-01").cast("date").alias("period"))
    # the leading column is stated alone as well, so that it can be pushed to a stored table
    page = t.monthly.filter(F.col("chain_id") >= "BUILDING").filter(key > cursor).orderBy(*CP, "period").limit(50)
    return page.select(*CP, pr.label("period").alias("period"), "sales")


@query("t06_offset_page", with_(BASE) + f"""
SELECT chain_id, product_id, {ym('period')} AS period, sales FROM monthly ORDER BY chain_id, product_id, monthly.period LIMIT 50 OFFSET 100""")
def offset_page(t: Tables):
    return t.monthly.orderBy(*CP, "period").offset(100).limit(50).select(*CP, pr.label("period").alias("period"), "sales")


# Cold start ----------------------------------------------------------------------------------------------
# Targets: a part inside one chain with at most five observed months; peers: the
# chain's brand series of the same category.

COLD_SQL = f"""
pt AS (SELECT chain_id, part_id, category_id, any_value(p_name) AS p_name, ship_m AS period, sum(CASE WHEN l_returnflag = 'R' THEN 0e0 ELSE qty END) AS s FROM lines WHERE ship_m <= {ISSUE_SQL} GROUP BY chain_id, part_id, category_id, ship_m),
tl AS (SELECT *, min(CASE WHEN s > 0 THEN period END) OVER (PARTITION BY chain_id, part_id) AS launch FROM pt),
tg AS (SELECT chain_id, part_id, category_id, any_value(p_name) AS p_name, list(s ORDER BY period) AS vv, count(*) AS age FROM tl WHERE launch IS NULL OR period >= launch GROUP BY chain_id, part_id, category_id HAVING count(*) <= 5
  UNION ALL SELECT chain_id, part_id, category_id, any_value(p_name), CAST([] AS DOUBLE[]), 0 FROM lines GROUP BY chain_id, part_id, category_id HAVING min(ship_m) > {ISSUE_SQL}),
bname AS (SELECT p_brand AS product_id, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY p_brand),
bl AS (SELECT *, min(CASE WHEN sales > 0 THEN period END) OVER (PARTITION BY chain_id, product_id) AS launch FROM monthly WHERE sales IS NOT NULL AND period <= {ISSUE_SQL}),
br AS (SELECT chain_id, product_id, category_id, any_value(b.p_name) AS p_name, list(sales ORDER BY period) AS hist, count(*) AS n FROM bl JOIN bname b USING (product_id) WHERE launch IS NULL OR period >= launch GROUP BY chain_id, product_id, category_id HAVING count(*) >= 18),
grp AS (SELECT DISTINCT chain_id, category_id, list_aggregate(list_sort(string_split(p_name, ' ')), 'string_agg', ' ') AS tk, age FROM tg),
cnd AS (SELECT g.*, b.product_id AS peer_id, b.hist, len(list_intersect(string_split(g.tk, ' '), string_split(b.p_name, ' '))) AS similarity FROM grp g JOIN br b USING (chain_id, category_id) WHERE b.n >= g.age + 12),
cn2 AS (SELECT *, count(*) FILTER (WHERE similarity >= 1) OVER (PARTITION BY chain_id, category_id, tk, age) AS rel FROM cnd),
pk AS (SELECT * FROM cn2 WHERE rel < 3 OR similarity >= 1 QUALIFY row_number() OVER (PARTITION BY chain_id, category_id, tk, age ORDER BY similarity DESC, peer_id) <= 12)
"""
COLD2_SQL = f"""
rat AS (SELECT chain_id, category_id, tk, age, peer_id, lv, h AS step, hist[age + h] AS actual, hist[age + h] / lv AS ratio FROM (SELECT *, CASE WHEN age = 0 THEN 1e0 ELSE greatest(1e0, list_avg(hist[greatest(age - 2, 1):age])) END AS lv FROM pk), (SELECT unnest(range(1, 13)) AS h)),
zer AS (SELECT a.chain_id, a.category_id, a.tk, a.peer_id, a.step, median(b.ratio) AS med FROM rat a JOIN rat b ON a.age = 0 AND b.age = 0 AND a.chain_id = b.chain_id AND a.category_id = b.category_id AND a.tk = b.tk AND a.step = b.step AND a.peer_id <> b.peer_id GROUP BY ALL),
lo AS (SELECT rat.*, count(*) OVER w AS n, CASE WHEN age = 0 THEN m.med ELSE lv * (sum(ratio) OVER w - ratio) / nullif(count(*) OVER w - 1, 0) END AS analog, CASE WHEN age = 0 THEN f.med ELSE lv END AS flat
  FROM rat LEFT JOIN zer m ON age = 0 AND m.chain_id = rat.chain_id AND m.category_id = rat.category_id AND m.tk = rat.tk AND m.peer_id = rat.peer_id AND m.step = rat.step
  LEFT JOIN zer f ON age = 0 AND f.chain_id = rat.chain_id AND f.category_id = rat.category_id AND f.tk = rat.tk AND f.peer_id = rat.peer_id AND f.step = 1
  WINDOW w AS (PARTITION BY rat.chain_id, rat.category_id, rat.tk, age, rat.step)),
sco AS (SELECT chain_id, category_id, tk, age, count(DISTINCT peer_id) AS peers, {r('100 * sum(abs(analog - actual)) / sum(actual)', 2)} AS analog_wape, {r('100 * sum(analog - actual) / sum(actual)', 2)} AS analog_bias, {r('100 * sum(abs(flat - actual)) / sum(actual)', 2)} AS baseline_wape, {r('100 * sum(flat - actual) / sum(actual)', 2)} AS baseline_bias FROM lo WHERE n >= 3 GROUP BY ALL),
cho AS (SELECT *, CASE WHEN abs(analog_bias) <= abs(baseline_bias) + 5 AND analog_wape < baseline_wape THEN 'analog' ELSE 'baseline' END AS model FROM sco),
crv AS (SELECT chain_id, category_id, tk, age, step, CASE WHEN age = 0 THEN median(ratio) ELSE avg(ratio) END AS ratio FROM rat GROUP BY chain_id, category_id, tk, age, step)
"""
COLD = with_(BASE, COLD_SQL, COLD2_SQL)


def cold_targets(t: Tables):
    """Parts of a chain with at most five months up to the issue; written once, as groups, sets and launches read them."""
    return t.kept("cold_targets", lambda: cut_lineage(_cold_targets(t)))


def _cold_targets(t: Tables):
    from monthmill.operators.series import drop_leading_zeros

    keys = ["chain_id", "part_id", "category_id", "p_name"]
    # a part sells in few months of a chain: its lines are dealt by the part, and one shuffle serves both groupings
    rows = t.dealt(t.lines.select(*keys, F.col("ship_m").alias("period"), "l_returnflag", "qty"), *keys)
    monthly = rows.groupBy(*keys, "period").agg(F.sum(F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("qty"))).alias("s"))
    known = F.when((F.col("period") <= F.lit(ISSUE)) & F.col("s").isNotNull(), F.struct("period", F.col("s").alias("value")))
    points = monthly.groupBy(*keys).agg(F.array_sort(F.collect_list(known)).alias("points"), F.min("period").alias("since"))
    series = drop_leading_zeros(points, [*keys, "since"])
    # a part sold by the chain, but not yet at the issue, has no history
    young = (F.size("periods") > 0) & (F.size("values") <= cs.MAX_AGE)
    targets = series.filter(young | (F.col("since") > F.lit(ISSUE))).select(*keys, "values")
    return targets.withColumn("terms", tx.terms(F.col("p_name"), []))


def cold_peers(t: Tables):
    """Brand series with their terms; written once."""
    return t.kept("cold_peers", lambda: cut_lineage(_cold_peers(t)))


def _cold_peers(t: Tables):
    name = t.read("part").groupBy(F.col("p_brand").alias("product_id")).agg(F.min_by("p_name", "p_partkey").alias("p_name"))
    return t.brand_values.join(name, "product_id").withColumn("terms", tx.terms(F.col("p_name"), []))


@query("f27_peer_selection", with_(BASE, COLD_SQL) + "SELECT chain_id, category_id, tk AS term_key, age, peer_id, similarity FROM pk")
def peer_selection(t: Tables):
    g = cs.target_groups(cold_targets(t))
    picked = cs.select_peers(g, cold_peers(t))
    return picked.join(g.select("group_id", "term_key").distinct(), "group_id").select("chain_id", "category_id", "term_key", "age", "peer_id", "similarity")


@query("w20_peer_rank", with_(BASE, COLD_SQL) + """
SELECT chain_id, category_id, tk AS term_key, age, peer_id, row_number() OVER (PARTITION BY chain_id, category_id, tk, age ORDER BY similarity DESC, peer_id) AS rank FROM pk""")
def peer_rank(t: Tables):
    g = cs.target_groups(cold_targets(t))
    picked = cs.select_peers(g, cold_peers(t))
    return picked.join(g.select("group_id", "term_key").distinct(), "group_id").select("chain_id", "category_id", "term_key", "age", "peer_id", "rank")


@query("j13_leave_one_out", COLD + "SELECT chain_id, category_id, tk AS term_key, age, peers, analog_wape, analog_bias, baseline_wape, baseline_bias FROM sco")
def leave_one_out(t: Tables):
    g = cs.target_groups(cold_targets(t))
    scores = cs.leave_one_out(cs.peer_ratios(cs.select_peers(g, cold_peers(t))))
    names = g.select("group_id", "chain_id", "category_id", "term_key", "age").distinct()
    return scores.join(names, "group_id").select(
        "chain_id", "category_id", "term_key", "age", "peers", "analog_wape", "analog_bias", "baseline_wape", "baseline_bias"
    )


@query("b24_cold_start_method", COLD + "SELECT chain_id, category_id, tk AS term_key, age, model FROM cho")
def cold_start_method(t: Tables):
    g = cs.target_groups(cold_targets(t))
    chosen = cs.choose_method(cs.leave_one_out(cs.peer_ratios(cs.select_peers(g, cold_peers(t)))))
    return chosen.join(g.select("group_id", "chain_id", "category_id", "term_key", "age").distinct(), "group_id").select("chain_id", "category_id", "term_key", "age", "model")


@query("f25_cold_start_forecast", COLD + f"""
SELECT t.chain_id, t.part_id, t.age, c.model, k.step AS horizon, {r("CASE c.model WHEN 'analog' THEN t.lv * k.ratio ELSE CASE WHEN t.age = 0 THEN z.ratio ELSE t.lv END END", 2)} AS forecast
FROM (SELECT *, list_aggregate(list_sort(string_split(p_name, ' ')), 'string_agg', ' ') AS tk, greatest(1e0, coalesce(list_avg(vv[greatest(age - 2, 1):age]), 1e0)) AS lv FROM tg) t JOIN cho c USING (chain_id, category_id, tk, age) JOIN crv k USING (chain_id, category_id, tk, age) JOIN (SELECT chain_id, category_id, tk, age, ratio FROM crv WHERE step = 1) z USING (chain_id, category_id, tk, age)""")
def cold_start_forecast(t: Tables):
    return cs.launch_forecasts(cold_targets(t), cold_peers(t)).select(
        "chain_id", "part_id", "age", "model", F.col("step").alias("horizon"), rounded(F.col("forecast"), 2).alias("forecast")
    )


# Three methods ------------------------------------------------------------------------------------

def three_methods(t: Tables):
    """Sets of peers scored by all methods, once per application and folder."""
    groups, sets = lf.peer_sets(cold_targets(t), cold_peers(t))
    scores = t.kept("cold_scores", lambda: cut_lineage(lf.scored(cut_lineage(sr.spread(sets, ["set_id"])))))
    return groups, scores


@query("b24_three_methods")
def cold_start_three_methods(t: Tables):
    """The method chosen for every group among flat level, analog and forest, ages 0 to 5."""
    groups, scores = three_methods(t)
    info = cs.target_groups(cold_targets(t)).select("group_id", "chain_id", "category_id", "term_key", "age").distinct()
    figures = [f"{m}_{c}" for m in ("baseline", "analog", "ml") for c in ("wape", "bias")]
    return info.join(groups, "group_id").join(lf.choose(scores), "set_id").select("chain_id", "category_id", "term_key", "age", "model", *figures)


@query("j13_leave_one_out_horizons")
def leave_one_out_horizons(t: Tables):
    """Error and bias of the three methods at horizons 1, 3, 6 and 12 for every set of peers."""
    _, scores = three_methods(t)
    return scores.filter("horizon > 0").select("set_id", "method", "horizon", rounded(F.col("wape"), 2).alias("wape"), rounded(F.col("bias"), 2).alias("bias"))


@query("f26_cold_start_launch")
def cold_start_launch(t: Tables):
    """Twelve provisional months of every new product by the method chosen for its peers."""
    groups, scores = three_methods(t)
    rows = lf.launch(cold_targets(t), cold_peers(t), lf.choose(scores), groups)
    return rows.select("chain_id", "part_id", "age", "model", "step", rounded(F.col("forecast"), 2).alias("forecast"))
