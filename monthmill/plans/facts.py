"""Facts, periods, scalar functions and version selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthmill.functions import periods as pr
from monthmill.functions import text as tx
from monthmill.functions.numbers import amount, rounded
from monthmill.operators import versions as vs
from monthmill.plans.registry import query
from monthmill.plans.sql_parts import BASE, FACTS, ISSUE as ISSUE_SQL, PANEL_BASE, r, with_, ym
from monthmill.sources.tables import ISSUE, SERIES, Tables

CP = ["chain_id", "product_id"]
STAMP = "%Y-%m-%d %H:%M:%S"


def stamp(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


# Periods --------------------------------------------------------------------

@query("p01_add_months", with_(BASE) + f"""
SELECT chain_id, product_id, {ym('period')} AS period, {ym("period + INTERVAL 7 MONTH")} AS plus_7,
       {ym("period - INTERVAL 24 MONTH")} AS minus_24 FROM monthly""")
def add_months(t: Tables):
    return t.monthly.select(
        *CP, pr.label("period").alias("period"), pr.label(pr.shift(F.col("period"), 7)).alias("plus_7"),
        pr.label(pr.shift(F.col("period"), -24)).alias("minus_24"),
    )


@query("p02_month_end_distance", with_(BASE) + f"""
SELECT chain_id, product_id, {ym('period')} AS period, strftime(last_day(period), '%Y-%m-%d') AS month_end,
       date_diff('month', period, {ISSUE_SQL}) AS months_to_issue FROM monthly""")
def month_end_distance(t: Tables):
    return t.monthly.select(
        *CP, pr.label("period").alias("period"), F.date_format(pr.month_end(F.col("period")), "yyyy-MM-dd").alias("month_end"),
        pr.distance(F.col("period"), F.lit(ISSUE)).alias("months_to_issue"),
    )


@query("p03_calendar_spine", with_(PANEL_BASE) + f"""
SELECT chain_id, product_id, category_id, {ym('period')} AS period, idx, sales, orders, delivery FROM panel""")
def calendar_spine(t: Tables):
    return t.panel.select(*SERIES, pr.label("period").alias("period"), "idx", "sales", "orders", "delivery")


@query("p17_period_range", with_(BASE) + f"""
SELECT chain_id, count(*) FILTER (WHERE period >= DATE '1998-01-01') AS from_1998,
       count(*) FILTER (WHERE period <= DATE '1999-12-01') AS to_1999,
       count(*) FILTER (WHERE period BETWEEN DATE '1998-01-01' AND DATE '1999-12-01') AS closed, count(*) AS open_both
FROM monthly GROUP BY chain_id""")
def period_range(t: Tables):
    a, b, none = F.lit("1998-01-01").cast("date"), F.lit("1999-12-01").cast("date"), F.lit(None).cast("date")
    p = F.col("period")
    return t.monthly.groupBy("chain_id").agg(
        F.count_if(pr.in_range(p, a, none)).alias("from_1998"), F.count_if(pr.in_range(p, none, b)).alias("to_1999"),
        F.count_if(pr.in_range(p, a, b)).alias("closed"), F.count_if(pr.in_range(p, none, none)).alias("open_both"),
    )


@query("p21_temporal_label", f"""
SELECT o_orderkey, CASE WHEN m < DATE '2000-03-01' THEN 'elapsed' WHEN m = DATE '2000-03-01' THEN 'current' ELSE 'future' END
  || ' / ' || CASE WHEN o_orderdate >= m THEN 'issued after start' ELSE 'issued before month' END AS temporal_label
FROM (SELECT o_orderkey, o_orderdate, CAST(date_trunc('month', o_orderdate) + to_months(CAST(o_orderkey % 3 - 1 AS INTEGER)) AS DATE) AS m FROM orders)""")
def temporal_label(t: Tables):
    from monthmill.operators.reporting import temporal_label as label_of

    orders = t.read("orders").select("o_orderkey", "o_orderdate")
    target = F.add_months(pr.month(F.col("o_orderdate")), (F.col("o_orderkey") % 3 - 1).cast("int"))
    return orders.select(
        "o_orderkey", label_of(target, F.col("o_orderdate"), F.lit("2000-03-01").cast("date")).alias("temporal_label")
    )


# Text and literals ------------------------------------------------------------
# Spreadsheet-like texts made from the events: numbers, grouped numbers, error
# tokens, negatives, blanks and formulas.

RAW_SQL = """
raw AS (
  SELECT event_id, user_id, event_type, value, ts,
    CASE event_type WHEN 'click' THEN CAST(value AS VARCHAR) WHEN 'view' THEN format('{:,.2f}', value * 1000)
      WHEN 'error' THEN '#N/A' WHEN 'signup' THEN '-' || CAST(value AS VARCHAR)
      ELSE CASE WHEN value < 50 THEN ' ' ELSE '=' || CAST(value AS VARCHAR) END END AS raw_text
  FROM events)
"""


def raw_cells(t: Tables):
    v = F.col("value")
    text = (
        F.when(F.col("event_type") == "click", v.cast("string"))
        .when(F.col("event_type") == "view", F.format_number(v * 1000, 2))
        .when(F.col("event_type") == "error", "#N/A")
        .when(F.col("event_type") == "signup", F.concat(F.lit("-"), v.cast("string")))
        .otherwise(F.when(v < 50, " ").otherwise(F.concat(F.lit("="), v.cast("string"))))
    )
    return t.events.select("event_id", "user_id", "event_type", "value", "ts", text.alias("raw_text"))


@query("p06_literal_class", with_(RAW_SQL) + """
SELECT event_id, CASE WHEN trim(raw_text) = '' THEN 'MISSING' WHEN event_type IN ('click', 'view') THEN 'VALUE' ELSE 'INVALID' END AS literal_class,
       CASE event_type WHEN 'click' THEN CAST(CAST(raw_text AS DECIMAL(38,6)) AS DOUBLE)
            WHEN 'view' THEN CAST(CAST(replace(raw_text, ',', '') AS DECIMAL(38,6)) AS DOUBLE) END AS canonical FROM raw""")
def literal_class(t: Tables):
    raw = F.col("raw_text")
    return raw_cells(t).select(
        "event_id", tx.literal_class(raw).alias("literal_class"), tx.literal_value(raw).cast("double").alias("canonical")
    )


@query("p07_formula_flag", with_(RAW_SQL) + """
SELECT event_type, count(*) FILTER (WHERE raw_text LIKE '=%') AS formulas, count(*) AS n_cells FROM raw GROUP BY event_type""")
def formula_flag(t: Tables):
    return raw_cells(t).groupBy("event_type").agg(
        F.count_if(tx.is_formula(F.col("raw_text"))).alias("formulas"), F.count(F.lit(1)).alias("n_cells")
    )


@query("p16_amount", with_(RAW_SQL) + """
SELECT event_id, CASE WHEN try_cast(raw_text AS DOUBLE) >= 0 THEN try_cast(raw_text AS DOUBLE) END AS amount FROM raw""")
def null_safe_amount(t: Tables):
    return raw_cells(t).select("event_id", amount(F.col("raw_text")).alias("amount"))


IDS_SQL = """
ids AS (
  SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN CAST(p_partkey AS DOUBLE) + CASE WHEN p_type = 'STANDARD' THEN 0.5e0 ELSE 0e0 END END AS num,
    CASE p_type WHEN 'PROMO' THEN ' SKU-' || p_partkey || ' ' WHEN 'SMALL' THEN 'Total' WHEN 'LARGE' THEN '=A' || p_partkey
      WHEN 'MEDIUM' THEN lpad(CAST(p_partkey * 7919 AS VARCHAR), 9, '0') WHEN 'STANDARD' THEN CAST(CAST(p_partkey AS DOUBLE) + 0.5e0 AS VARCHAR)
      ELSE CAST(CAST(p_partkey AS DOUBLE) AS VARCHAR) END AS txt
  FROM part)
"""


def raw_ids(t: Tables):
    key, kind = F.col("p_partkey"), F.col("p_type")
    half = F.when(kind == "STANDARD", 0.5).otherwise(0.0)
    num = F.when(kind.isin("ECONOMY", "STANDARD"), key.cast("double") + half)
    txt = (
        F.when(kind == "PROMO", F.concat(F.lit(" SKU-"), key.cast("string"), F.lit(" ")))
        .when(kind == "SMALL", "Total")
        .when(kind == "LARGE", F.concat(F.lit("=A"), key.cast("string")))
        .when(kind == "MEDIUM", F.lpad((key * 7919).cast("string"), 9, "0"))
        .otherwise(num.cast("string"))
    )
    return t.read("part").select("p_partkey", "p_type", num.alias("num"), txt.alias("txt"))


CODE_SQL = """
codes AS (SELECT *, CASE WHEN num IS NOT NULL AND num = floor(num) THEN CAST(CAST(num AS BIGINT) AS VARCHAR)
  WHEN lower(trim(txt)) IN ('none', 'nan', 'item', 'total', '-') THEN '' ELSE trim(txt) END AS code FROM ids)
"""


@query("p04_clean_code", with_(IDS_SQL, CODE_SQL) + "SELECT p_partkey, code FROM codes")
def clean_code(t: Tables):
    return raw_ids(t).select("p_partkey", tx.clean_code(F.col("num"), F.col("txt")).alias("code"))


@query("p05_identifier", with_(IDS_SQL, CODE_SQL) + """
SELECT p_partkey, CASE WHEN txt NOT LIKE '=%' AND regexp_full_match(code, '[A-Za-z0-9_-]+') AND regexp_matches(code, '[0-9]') AND NOT regexp_full_match(code, '0+') THEN code ELSE '' END AS item,
  CASE WHEN txt NOT LIKE '=%' AND regexp_full_match(code, '[0-9]{8,14}') AND NOT regexp_full_match(code, '0+') THEN code ELSE '' END AS upc FROM codes""")
def identifier(t: Tables):
    num, txt = F.col("num"), F.col("txt")
    return raw_ids(t).select("p_partkey", tx.identifier(num, txt).alias("item"), tx.identifier(num, txt, upc=True).alias("upc"))


@query("p08_unit_key", """
SELECT c_custkey, CASE WHEN trim(c_mktsegment) = '' THEN '' WHEN n_name <> c_mktsegment THEN c_mktsegment || '::' || n_name ELSE c_mktsegment END AS unit
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def unit_key(t: Tables):
    return t.read("customer").join(t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", tx.unit_key(F.col("c_mktsegment"), F.col("n_name")).alias("unit")
    )


@query("p09_comparison_key", """
SELECT doc_id, md5(trim(regexp_replace(upper(replace(strip_accents(text), 'ß', 'SS')), '\\s+', ' ', 'g'))) AS key_hash FROM documents""")
def comparison_key(t: Tables):
    return t.read("documents").select("doc_id", F.md5(tx.comparison_key(F.col("text")).cast("binary")).alias("key_hash"))


@query("p10_display_key", """
SELECT doc_id, md5(upper(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), 'ß', 'SS'))) AS key_hash FROM documents""")
def display_key(t: Tables):
    return t.read("documents").select("doc_id", F.md5(tx.display_key(F.col("text")).cast("binary")).alias("key_hash"))


@query("p35_fold", "SELECT doc_id, md5(lower(strip_accents(text))) AS fold_hash FROM documents")
def fold(t: Tables):
    return t.read("documents").select("doc_id", F.md5(tx.fold(F.col("text")).cast("binary")).alias("fold_hash"))


@query("p11_scope_token", """
SELECT o_orderkey, 'RUN-' || tok || '-' || per || '-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS run_id,
       'FT-' || tok || '-' || replace(per, '-', '') || '-V' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS model_version
FROM (SELECT o_orderkey, regexp_replace(regexp_replace(upper(o_orderpriority), '[^A-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS tok,
             strftime(o_orderdate, '%Y-%m') AS per FROM orders)""")
def scope_token(t: Tables):
    scope, per = F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM")
    return t.read("orders").select(
        "o_orderkey", tx.run_id(scope, per, F.col("o_orderkey") % 1000).alias("run_id"),
        tx.model_version("FT", scope, per, F.col("o_orderkey") % 100).alias("model_version"),
    )


@query("p12_utc_timestamp", """
SELECT event_id, strftime(CASE WHEN event_type = 'click' THEN date_trunc('day', ts) ELSE date_trunc('second', ts) - CASE WHEN event_type = 'view' THEN INTERVAL 6 HOUR ELSE INTERVAL 0 HOUR END END, '%Y-%m-%d %H:%M:%S') AS utc FROM events""")
def utc_timestamp(t: Tables):
    ts = F.col("ts")
    text = (
        F.when(F.col("event_type") == "click", F.date_format(ts, "yyyy-MM-dd"))
        .when(F.col("event_type") == "view", F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+06:00")))
        .otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    )
    # rendered in UTC whatever the session zone is
    instant = F.convert_timezone(F.current_timezone(), F.lit("UTC"), tx.utc_instant(text).cast("timestamp_ntz"))
    midnight = F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd"))
    return t.events.select(
        "event_id", stamp(F.when(F.col("event_type") == "click", midnight).otherwise(instant)).alias("utc")
    )


@query("p13_missing_flag", """
SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS is_missing, event_type NOT IN ('click', 'view') AS bad_marker FROM events""")
def missing_flag(t: Tables):
    text = F.when(F.col("event_type") == "click", "TRUE").when(F.col("event_type") == "view", "false").otherwise(F.col("event_type"))
    flag = tx.missing_flag(text)
    return t.events.select("event_id", flag.alias("is_missing"), flag.isNull().alias("bad_marker"))


@query("p14_fingerprint", with_(BASE, FACTS) + """
SELECT chain_id, product_id, metric_code, strftime(period, '%Y-%m') AS period,
       sha256(chain_id || '|' || product_id || '|' || metric_code || '|' || strftime(period, '%Y-%m') || '|' || CAST(CAST(value AS BIGINT) AS VARCHAR)) AS fingerprint FROM facts""")
def fingerprint(t: Tables):
    per = pr.label("period")
    return t.facts.select(
        *CP, "metric_code", per.alias("period"),
        tx.fingerprint(F.col("chain_id"), F.col("product_id"), F.col("metric_code"), per, F.col("value").cast("bigint")).alias("fingerprint"),
    )


@query("p15_clamp", with_(PANEL_BASE) + f"""
SELECT chain_id, product_id, {ym('period')} AS period, CASE WHEN sales IS NOT NULL AND orders IS NOT NULL THEN {r('greatest(0e0, sales - orders)', 2)} END AS excess FROM panel""")
def clamp(t: Tables):
    return t.panel.select(
        *CP, pr.label("period").alias("period"),
        F.when(F.col("sales").isNotNull() & F.col("orders").isNotNull(), rounded(F.greatest(F.lit(0.0), F.col("sales") - F.col("orders")), 2)).alias("excess"),
    )


@query("p27_terms", "SELECT p_partkey, list_aggregate(list_sort(list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ('old', 'new')))), 'string_agg', ' ') AS terms FROM part")
def terms(t: Tables):
    found = F.array_sort(tx.terms(F.col("p_name"), ["old", "new"]))
    return t.read("part").select("p_partkey", F.array_join(found, " ").alias("terms"))


@query("p34_key_extraction", with_(BASE, FACTS) + """
SELECT chain_id, substr(strftime(period, '%Y-%m'), 1, 4) AS year, regexp_extract(product_id, '^([A-Za-z]+)#([0-9]+)$', 1) AS letters,
       CAST(regexp_extract(product_id, '^([A-Za-z]+)#([0-9]+)$', 2) AS INTEGER) AS row_no, count(*) AS n_facts FROM facts GROUP BY ALL""")
def key_extraction(t: Tables):
    pattern = "^([A-Za-z]+)#([0-9]+)$"
    return t.facts.groupBy(
        "chain_id", F.substring(pr.label("period"), 1, 4).alias("year"), F.regexp_extract("product_id", pattern, 1).alias("letters"),
        F.regexp_extract("product_id", pattern, 2).cast("int").alias("row_no"),
    ).agg(F.count(F.lit(1)).alias("n_facts"))


# Versions ------------------------------------------------------------------
# Events are revisions of a fact: key (user, type, week), available at ts.

VERS_SQL = """
vers AS (SELECT event_id, user_id, event_type, CAST(date_trunc('week', ts) AS DATE) AS week, ts, value FROM events)
"""
KEY = ["user_id", "event_type", "week"]


def version_rows(t: Tables):
    return t.events.select("event_id", "user_id", "event_type", F.to_date(F.date_trunc("week", "ts")).alias("week"), "ts", "value")


@query("w01_latest_version", with_(VERS_SQL) + """
SELECT user_id, event_type, strftime(week, '%Y-%m-%d') AS week, event_id, value FROM vers
QUALIFY row_number() OVER (PARTITION BY user_id, event_type, week ORDER BY ts DESC, event_id DESC) = 1""")
def latest_version(t: Tables):
    return vs.latest(version_rows(t), KEY, ["ts", "event_id"]).select(
        "user_id", "event_type", F.date_format("week", "yyyy-MM-dd").alias("week"), "event_id", "value"
    )


CUT = "2024-01-18 12:00:00"


@query("j04_as_of_selection", with_(VERS_SQL) + f"""
SELECT event_id, value, CASE WHEN ts > TIMESTAMP '{CUT}' THEN 'available_after_cutoff'
  WHEN row_number() OVER (PARTITION BY user_id, event_type, week, ts > TIMESTAMP '{CUT}' ORDER BY ts DESC, event_id DESC) = 1 THEN 'selected'
  ELSE 'superseded_as_of_cutoff' END AS status FROM vers""")
def as_of_selection(t: Tables):
    rows = version_rows(t)
    cutoff = F.lit(CUT).cast(rows.schema["ts"].dataType)
    return vs.as_of(rows, KEY, "event_id", "ts", "event_id", cutoff).select("event_id", "value", "status")


@query("j04_same_instant_conflicts", """
SELECT user_id, event_type, strftime(d, '%Y-%m-%d') AS day, n_rows FROM (
  SELECT user_id, event_type, CAST(ts AS DATE) AS d, count(*) AS n_rows, count(DISTINCT value) AS k FROM events GROUP BY ALL) WHERE k > 1""")
def same_instant_conflicts(t: Tables):
    rows = t.events.withColumn("day", F.to_date("ts"))
    return vs.timestamp_conflicts(rows, ["user_id", "event_type"], "day", "value").select(
        "user_id", "event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("rows").alias("n_rows")
    )


@query("w18_change_log", """
SELECT event_id, user_id, event_type, k AS value, prev AS previous FROM (
  SELECT event_id, user_id, event_type, k, lag(k) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS prev
  FROM (SELECT *, floor(value / 20) AS k FROM events)) WHERE k IS DISTINCT FROM prev""")
def change_log(t: Tables):
    rows = t.events.select(
        "event_id", "user_id", "event_type", "ts", F.floor(F.col("value") / 20).cast("double").alias("value"), F.to_date("ts").alias("day")
    )
    return vs.change_log(rows, ["user_id", "event_type"], "ts", "value", "day").select(
        "event_id", "user_id", "event_type", "value", "previous"
    )


@query("w03_current_selection", """
SELECT o_custkey, o_orderkey, o_orderpriority AS candidate FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def current_selection(t: Tables):
    rows = t.read("orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("candidate"))
    return vs.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "candidate")


@query("w24_validity_intervals", """
SELECT o_custkey, strftime(d, '%Y-%m-%d') AS valid_from, o_orderpriority AS champion, strftime(lead(d) OVER (PARTITION BY o_custkey ORDER BY d), '%Y-%m-%d') AS valid_to,
       lead(d) OVER (PARTITION BY o_custkey ORDER BY d) IS NULL AS active
FROM (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority FROM orders GROUP BY ALL)""")
def validity_intervals(t: Tables):
    rows = t.read("orders").withColumn("d", pr.month(F.col("o_orderdate")))
    monthly = rows.groupBy("o_custkey", "d").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("champion"))
    return vs.validity_intervals(monthly, ["o_custkey"], "d").select(
        "o_custkey", F.date_format("d", "yyyy-MM-dd").alias("valid_from"), "champion",
        F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"), "active",
    )


@query("w25_latest_closure_revision", with_(BASE) + f"""
SELECT {ym('period')} AS period, strftime(max(l_shipdate), '%Y-%m-%d') AS closed_through, CAST(arg_max(l_orderkey, (l_shipdate, l_orderkey)) AS BIGINT) AS revision_id
FROM (SELECT ship_m AS period, l_shipdate, l_orderkey FROM lines) GROUP BY period""")
def latest_closure_revision(t: Tables):
    rows = t.lines.select(F.col("ship_m").alias("period"), "l_shipdate", "l_orderkey")
    return vs.latest(rows, ["period"], ["l_shipdate", "l_orderkey"]).select(
        pr.label("period").alias("period"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("closed_through"), F.col("l_orderkey").alias("revision_id")
    )


@query("w26_latest_adjustment_with_approval", """
WITH d AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
a AS (SELECT l_orderkey, min(l_shipdate) AS approved_at FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT o_custkey, o_orderkey, o_totalprice AS adjusted, strftime(approved_at, '%Y-%m-%d') AS approved_at FROM d LEFT JOIN a ON l_orderkey = o_orderkey""")
def latest_adjustment(t: Tables):
    rows = t.read("orders").filter("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    current = vs.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    approvals = t.read("lineitem").filter("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("approved_at"))
    return current.join(approvals, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_custkey", "o_orderkey", F.col("o_totalprice").alias("adjusted"), F.date_format("approved_at", "yyyy-MM-dd").alias("approved_at")
    )


@query("w19_first_last_seen", with_(BASE) + f"""
SELECT part_id, {ym('min(ship_m)')} AS first_seen, {ym('max(ship_m)')} AS last_seen, count(DISTINCT ship_m) AS months FROM lines GROUP BY part_id""")
def first_last_seen(t: Tables):
    return t.lines.groupBy("part_id").agg(
        pr.label(F.min("ship_m")).alias("first_seen"), pr.label(F.max("ship_m")).alias("last_seen"), F.count_distinct("ship_m").alias("months")
    )


@query("q02_duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(t: Tables):
    from monthmill.operators.quality import duplicate_keys as dup

    return dup(t.read("lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "copies")


@query("q06_fact_rules", """
SELECT rule, count(*) AS violations FROM (
  SELECT unnest(list_filter([CASE WHEN event_id < 0 THEN 'version_not_positive' END, CASE WHEN value < 0 THEN 'negative_value' END,
    CASE WHEN event_type = 'signup' AND value > 100 THEN 'unexpected_size' END, CASE WHEN date_trunc('hour', ts) <> date_trunc('hour', ts - INTERVAL 30 MINUTE) THEN 'availability_shape' END], lambda x: x IS NOT NULL)) AS rule
  FROM events) GROUP BY rule""")
def fact_rules(t: Tables):
    from monthmill.operators.quality import violations

    half = F.expr("date_trunc('hour', ts) <> date_trunc('hour', ts - interval 30 minutes)")
    rules = {
        "version_not_positive": F.col("event_id") < 0, "negative_value": F.col("value") < 0,
        "unexpected_size": (F.col("event_type") == "signup") & (F.col("value") > 100), "availability_shape": half,
    }
    return violations(t.events, rules).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


@query("q01_normalisation_guard", with_(BASE) + """
SELECT rule, count(*) AS violations FROM (
  SELECT 'period_after_cutoff' AS rule FROM lines WHERE order_m > DATE '2000-12-01' UNION ALL SELECT 'availability_required' FROM lines WHERE l_returnflag = 'R'
  UNION ALL SELECT 'available_after_month_end' FROM lines WHERE l_returnflag <> 'R' AND CAST(l_shipdate AS DATE) > DATE '2000-12-31'
  UNION ALL SELECT 'duplicate_observation_conflict' FROM (SELECT chain_id, part_id, order_m FROM lines GROUP BY ALL HAVING min(qty) <> max(qty))) GROUP BY rule""")
def normalisation_guard(t: Tables):
    from monthmill.operators.quality import normalisation_guard as guard

    rows = t.lines.select(
        "chain_id", "part_id", F.col("order_m").alias("period"), F.col("qty").alias("value"),
        F.when(F.col("l_returnflag") != "R", F.col("l_shipdate")).alias("available_at"),
    )
    return guard(rows, ["chain_id", "part_id"], F.lit("2000-12-01").cast("date")).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))
