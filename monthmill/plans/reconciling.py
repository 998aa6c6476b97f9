"""Source claims, routing, reconciliation, certification and load checks."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from monthmill.functions import periods as pr
from monthmill.functions import text as tx
from monthmill.functions.numbers import rounded
from monthmill.operators import reconcile as rc, snapshots as sn
from monthmill.operators.intervals import matches
from monthmill.plans.registry import query
from monthmill.plans.sql_parts import BASE, FACTS, PANEL_BASE, r, with_, ym
from monthmill.session import cut_lineage
from monthmill.sources.tables import SERIES, Tables

CP = ["chain_id", "product_id"]

CAND_SQL = """
cand AS (
  SELECT *, 'S' || ln AS source, CASE ln WHEN 7 THEN 'D' WHEN 6 THEN 'C' ELSE 'A' END AS level, ln = 5 AND sheet = 'R' AS formula,
    CASE ln WHEN 1 THEN 'PRIMARY' WHEN 2 THEN 'SECONDARY_CONTROL' ELSE '' END AS role, (ln + 1) // 2 AS cutoff, CASE WHEN ln <= 4 THEN 'Q' END AS sequence,
    CASE WHEN ln % 2 = 1 THEN item || '-U' || CASE WHEN bn % 5 = 0 THEN year(period) % 2 ELSE 0 END END AS upc,
    CASE WHEN ln = 4 AND sheet = 'N' AND value = 50 THEN 'INVALID' WHEN ln = 3 AND sheet = 'N' AND value = 0 THEN 'MISSING' ELSE 'VALUE' END AS literal_class,
    NOT (ln = 6 AND sheet = 'A') AS fact_eligible
  FROM (SELECT chain_id, product_id AS item, CAST(substr(product_id, 7) AS INTEGER) AS bn, ship_m AS period, l_linenumber AS ln, l_returnflag AS sheet,
          CASE WHEN l_linestatus = 'F' THEN 'SALES' ELSE 'DELIVERY' END AS metric, floor(max(qty) / 25) * 25 AS value FROM lines GROUP BY ALL)),
ovr AS (SELECT chain_id, item, count(DISTINCT upc) AS nu, min(upc) AS u FROM cand WHERE upc IS NOT NULL GROUP BY ALL),
per AS (SELECT chain_id, item, period, count(DISTINCT upc) AS nu, min(upc) AS u FROM cand WHERE upc IS NOT NULL GROUP BY ALL),
canon AS (SELECT c.*, CASE WHEN c.upc IS NOT NULL THEN c.upc WHEN o.nu = 1 THEN o.u WHEN o.nu > 1 AND p.nu = 1 THEN p.u WHEN o.nu > 1 THEN NULL ELSE c.item END AS product,
    c.upc IS NULL AND coalesce(o.nu, 0) > 1 AND coalesce(p.nu, 0) <> 1 AS ambiguous
  FROM cand c LEFT JOIN ovr o USING (chain_id, item) LEFT JOIN per p USING (chain_id, item, period)),
chk AS (SELECT *, CASE WHEN NOT fact_eligible THEN 'WRONG_GRAIN_EXCLUDED' WHEN formula OR level = 'D' THEN 'FORMULA_UNVERIFIED' WHEN literal_class = 'MISSING' THEN 'MISSING'
    WHEN literal_class = 'INVALID' THEN 'INVALID_VALUE' WHEN ambiguous THEN 'ITEM_ONLY_AMBIGUOUS' END AS reason FROM canon),
act AS (SELECT chain_id, product, min(CASE WHEN level = 'A' AND value > 0 THEN period END) AS first_active FROM chk WHERE reason IS NULL GROUP BY ALL),
zer AS (SELECT chk.* EXCLUDE (reason), CASE WHEN value = 0 AND first_active IS NULL THEN 'UNPROVEN_ZERO' WHEN value = 0 AND period < first_active THEN 'PRE_LAUNCH_ZERO' END AS reason FROM chk JOIN act USING (chain_id, product) WHERE reason IS NULL),
pass AS (SELECT *, level = 'A' AND NOT formula AS direct FROM zer WHERE reason IS NULL),
au AS (SELECT chain_id, product, period, metric, count(*) AS claims, count(*) FILTER (WHERE direct) AS nd, count(*) FILTER (WHERE direct AND role = 'PRIMARY') > 0 AND count(*) FILTER (WHERE direct AND role = '') = 0 AS authority,
   min(value) AS amin, max(value) AS amax FROM pass GROUP BY ALL),
eff AS (SELECT p.* FROM pass p JOIN au USING (chain_id, product, period, metric) WHERE direct AND (NOT authority OR role = 'PRIMARY')),
e1 AS (SELECT chain_id, product, period, metric, count(DISTINCT value) AS kv, min(value) AS vmin, arg_min(value, source || sheet) AS vfirst, count(*) FILTER (WHERE sequence IS NULL) AS unproven, count(DISTINCT sequence) AS seqs FROM eff GROUP BY ALL),
e2 AS (SELECT chain_id, product, period, metric, max(k) AS ks FROM (SELECT chain_id, product, period, metric, source, count(DISTINCT value) AS k FROM eff GROUP BY ALL) GROUP BY ALL),
e3 AS (SELECT chain_id, product, period, metric, max(k) AS kc, arg_max(v, cutoff) AS vlast FROM (SELECT chain_id, product, period, metric, cutoff, count(DISTINCT value) AS k, min(value) AS v FROM eff GROUP BY ALL) GROUP BY ALL),
e4 AS (SELECT chain_id, product, period, metric, count(*) FILTER (WHERE v IS DISTINCT FROM pv) AS changes FROM (SELECT *, lag(v) OVER (PARTITION BY chain_id, product, period, metric ORDER BY cutoff) AS pv
   FROM (SELECT chain_id, product, period, metric, cutoff, arg_min(value, source || sheet) AS v FROM eff GROUP BY ALL)) GROUP BY ALL),
rs AS (SELECT au.*, e1.*EXCLUDE (chain_id, product, period, metric), ks, kc, vlast, changes, CASE WHEN nd = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN ks > 1 THEN 'INTERNAL_SOURCE_DUPLICATE'
   WHEN kv = 1 AND (amin <> vmin OR amax <> vmin) AND authority THEN 'SOURCE_AUTHORITY' WHEN kv = 1 AND (amin <> vmin OR amax <> vmin) THEN 'DIRECT_VS_SUMMARY' WHEN kv = 1 AND claims > 1 THEN 'EQUIVALENT_DUPLICATE'
   WHEN kv = 1 AND vmin = 0 THEN 'CONFIRMED_ZERO' WHEN kv = 1 THEN 'DIRECT_FACT' WHEN kc > 1 THEN 'SAME_SNAPSHOT_CONFLICT' WHEN unproven = 0 AND seqs = 1 THEN 'VALIDATED_REVISION' ELSE 'CROSS_SOURCE_CONFLICT' END AS reason
  FROM au LEFT JOIN e1 USING (chain_id, product, period, metric) LEFT JOIN e2 USING (chain_id, product, period, metric) LEFT JOIN e3 USING (chain_id, product, period, metric) LEFT JOIN e4 USING (chain_id, product, period, metric)),
res AS (SELECT chain_id, product, period, metric, reason, claims, reason IN ('INTERNAL_SOURCE_DUPLICATE', 'SAME_SNAPSHOT_CONFLICT', 'CROSS_SOURCE_CONFLICT') AS blocking,
   CASE WHEN reason = 'VALIDATED_REVISION' THEN vlast WHEN reason IN ('INSUFFICIENT_EVIDENCE', 'INTERNAL_SOURCE_DUPLICATE', 'SAME_SNAPSHOT_CONFLICT', 'CROSS_SOURCE_CONFLICT') THEN NULL ELSE vfirst END AS value,
   CASE WHEN reason = 'VALIDATED_REVISION' THEN changes WHEN reason IN ('INSUFFICIENT_EVIDENCE', 'INTERNAL_SOURCE_DUPLICATE', 'SAME_SNAPSHOT_CONFLICT', 'CROSS_SOURCE_CONFLICT') THEN NULL ELSE 1 END AS version_no FROM rs),
led AS (SELECT chain_id, product, period, metric, reason, claims, blocking, value FROM res
  UNION ALL SELECT chain_id, coalesce(product, item), period, metric, reason, 1, reason = 'ITEM_ONLY_AMBIGUOUS', NULL FROM chk WHERE reason IS NOT NULL
  UNION ALL SELECT chain_id, product, period, metric, reason, 1, false, NULL FROM zer WHERE reason IS NOT NULL)
"""
CAND = with_(BASE, CAND_SQL)


def candidates(t: Tables):
    """Claims of all sources; written once, as every query here reads them several times."""
    return t.kept("candidates", lambda: cut_lineage(_candidates(t)))


def _candidates(t: Tables):
    """Each line number is a source claiming a coarse monthly value per return flag (its sheet)."""
    g = t.lines.groupBy(
        "chain_id", F.col("product_id").alias("item"), F.col("ship_m").alias("period"), F.col("l_linenumber").alias("ln"),
        F.col("l_returnflag").alias("sheet"), F.when(F.col("l_linestatus") == "F", "SALES").otherwise("DELIVERY").alias("metric"),
    ).agg((F.floor(F.max("qty") / 25) * 25.0).alias("value"))
    ln, sheet, v = F.col("ln"), F.col("sheet"), F.col("value")
    bn = F.substring("item", 7, 9).cast("int")
    return g.withColumns(
        {
            "source": F.concat(F.lit("S"), ln.cast("string")), "level": F.when(ln == 7, "D").when(ln == 6, "C").otherwise("A"),
            "formula": (ln == 5) & (sheet == "R"),
            "role": F.when(ln == 1, "PRIMARY").when(ln == 2, "SECONDARY_CONTROL").otherwise(""),
            "cutoff": F.floor((ln + 1) / 2).cast("int"), "sequence": F.when(ln <= 4, "Q"),
            "upc": F.when(ln % 2 == 1, F.concat("item", F.lit("-U"), F.when(bn % 5 == 0, F.year("period") % 2).otherwise(0).cast("string"))),
            "literal_class": F.when((ln == 4) & (sheet == "N") & (v == 50), "INVALID").when((ln == 3) & (sheet == "N") & (v == 0), "MISSING").otherwise("VALUE"),
            "fact_eligible": ~((ln == 6) & (sheet == "A")),
        }
    )


def canonical(t: Tables):
    """Claims with their product; written once."""
    return t.kept("canonical", lambda: cut_lineage(rc.canonical_product(candidates(t))))


def ledger(t: Tables):
    return rc.ledger(candidates(t))


def passing(t: Tables):
    """Claims that no rule excludes; written once, as most queries here read them."""
    return t.kept("passing", lambda: cut_lineage(_passing(t)))


def _passing(t: Tables):
    checked = rc.row_exclusions(canonical(t))
    zeros = rc.zero_exclusions(checked.filter(F.col("reason").isNull()))
    return zeros.filter(F.col("reason").isNull())


def decisions(t: Tables):
    """One decision for each key; written once."""
    return t.kept("decisions", lambda: cut_lineage(rc.resolve(passing(t))))


KEYS = ["chain_id", "product", "period", "metric"]


def ymd(df):
    return df.withColumn("period", pr.label("period"))


@query("j15_identity_bridge", CAND + f"SELECT chain_id, item, {ym('period')} AS period, metric, source, sheet, product, ambiguous FROM canon")
def identity_bridge(t: Tables):
    return ymd(canonical(t).select("chain_id", "item", "period", "metric", "source", "sheet", "product", "ambiguous"))


@query("g21_resolution", CAND + f"SELECT chain_id, product, {ym('period')} AS period, metric, reason, blocking, claims, value, version_no FROM res")
def resolution(t: Tables):
    return ymd(decisions(t).select(*KEYS, "reason", "blocking", "claims", "value", "version_no"))


@query("g22_simple_reconcile", CAND + f"""
SELECT chain_id, item, {ym('period')} AS period, metric, min(value) <> max(value) AS conflict, count(*) AS claims, CASE WHEN min(value) = max(value) THEN min(value) END AS value,
 CASE WHEN min(value) = max(value) THEN arg_max(source, (cutoff, NOT formula, source, sheet)) END AS source, CASE WHEN min(value) = max(value) THEN arg_max(sheet, (cutoff, NOT formula, source, sheet)) END AS sheet FROM cand GROUP BY ALL""")
def simple_reconcile(t: Tables):
    return ymd(rc.simple_reconcile(candidates(t), ["chain_id", "item", "period", "metric"]))


@query("g23_activation", CAND + f"SELECT chain_id, product, {ym('first_active')} AS first_active FROM act")
def activation(t: Tables):
    checked = rc.row_exclusions(canonical(t)).filter(F.col("reason").isNull())
    return rc.activation(checked).select("chain_id", "product", pr.label("first_active").alias("first_active"))


@query("u01_ledger_union", CAND + "SELECT reason, blocking, count(*) AS n_rows, CAST(sum(claims) AS BIGINT) AS claims FROM led GROUP BY ALL")
def ledger_union(t: Tables):
    return ledger(t).groupBy("reason", "blocking").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("claims").alias("claims"))


@query("g24_ledger_summary", CAND + """
SELECT reason, chain_id, year, metric, count(*) AS n_rows FROM (SELECT *, year(period) AS year FROM led) GROUP BY GROUPING SETS ((reason), (chain_id, year), (metric))""")
def ledger_summary(t: Tables):
    c = {n: F.col(n) for n in ("reason", "chain_id", "year", "metric")}
    sets = [[c["reason"]], [c["chain_id"], c["year"]], [c["metric"]]]
    return ledger(t).withColumn("year", F.year("period")).groupingSets(sets, *c.values()).agg(F.count(F.lit(1)).alias("n_rows")).select(*c, "n_rows")


CLUS_SQL = """
blk AS (SELECT chain_id, product, period, metric, reason FROM res WHERE blocking),
srcs AS (SELECT b.*, list_aggregate(list_sort(list(DISTINCT p.source || ':' || p.sheet)), 'string_agg', ',') AS pattern FROM blk b JOIN pass p USING (chain_id, product, period, metric) WHERE p.level = 'A' GROUP BY ALL),
clus AS (SELECT chain_id, year(period) AS year, metric, reason, pattern, count(*) AS n_keys, min(period) AS p0, max(period) AS p1 FROM srcs GROUP BY ALL)
"""


def clusters(t: Tables):
    blocked = decisions(t).filter("blocking").select(*KEYS, "reason")
    claims = passing(t).filter("level = 'A'").select(*KEYS, F.concat_ws(":", "source", "sheet").alias("locator")).distinct()
    # a key has one locator per source sheet: as many as there are files
    patterns = claims.groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_set("locator")), ",").alias("pattern"))
    rows = blocked.join(patterns, KEYS)
    return rows.groupBy("chain_id", F.year("period").alias("year"), "metric", "reason", "pattern").agg(
        F.count(F.lit(1)).alias("n_keys"), F.min("period").alias("p0"), F.max("period").alias("p1")
    )


@query("g25_conflict_clusters", with_(BASE, CAND_SQL, CLUS_SQL) + f"SELECT chain_id, year, metric, reason, pattern, n_keys, {ym('p0')} AS period_min, {ym('p1')} AS period_max FROM clus")
def conflict_clusters(t: Tables):
    return clusters(t).select("chain_id", "year", "metric", "reason", "pattern", "n_keys", pr.label("p0").alias("period_min"), pr.label("p1").alias("period_max"))


@query("g26_pareto_cover", with_(BASE, CAND_SQL, CLUS_SQL) + """
SELECT th AS threshold, min(rk) AS clusters FROM (SELECT row_number() OVER (ORDER BY n_keys DESC, chain_id, year, metric, reason, pattern) AS rk, sum(n_keys) OVER (ORDER BY n_keys DESC, chain_id, year, metric, reason, pattern) AS run,
  sum(n_keys) OVER () AS total FROM clus), (SELECT unnest([80, 90, 95, 100]) AS th) WHERE run * 100 >= total * th GROUP BY th""")
def pareto_cover(t: Tables):
    return rc.pareto(clusters(t), "n_keys")


@query("g27_review_pack", with_(BASE, CAND_SQL, CLUS_SQL) + f"""
SELECT chain_id, reason, pattern, CAST(sum(n_keys) AS BIGINT) AS affected, count(*) AS clusters, {ym('min(p0)')} AS period_min, {ym('max(p1)')} AS period_max FROM clus GROUP BY ALL""")
def review_pack(t: Tables):
    return clusters(t).groupBy("chain_id", "reason", "pattern").agg(
        F.sum("n_keys").alias("affected"), F.count(F.lit(1)).alias("clusters"), pr.label(F.min("p0")).alias("period_min"), pr.label(F.max("p1")).alias("period_max")
    )


@query("t09_stable_sample", CAND + f"""
SELECT chain_id, min(product || '/' || {ym('period')} || '/' || metric) AS sample_key, list_aggregate(list_sort(list(product || '/' || {ym('period')} || '/' || metric))[1:5], 'string_agg', ',') AS first_five FROM res WHERE value IS NOT NULL GROUP BY chain_id""")
def stable_sample(t: Tables):
    key = F.concat_ws("/", "product", pr.label("period"), "metric")
    rows = decisions(t).filter("value IS NOT NULL").select("chain_id", key.alias("k"))
    # only the five smallest per chain are ever kept: partial top-5 first, then the final five
    pos = F.row_number().over(Window.partitionBy("chain_id").orderBy("k"))
    top = rows.withColumn("pos", pos).filter("pos <= 5")
    return top.groupBy("chain_id").agg(
        F.min("k").alias("sample_key"), F.array_join(F.array_sort(F.collect_list("k")), ",").alias("first_five")
    )


@query("g28_scope_certification", CAND + f"""
SELECT chain_id, count(DISTINCT product) AS products, count(*) FILTER (WHERE metric = 'SALES') AS sales_facts, count(*) FILTER (WHERE metric = 'DELIVERY') AS delivery_facts, count(*) FILTER (WHERE value IS NOT NULL) AS certified,
 count(*) FILTER (WHERE blocking) AS blocked, {ym('min(period)')} AS period_min, {ym('max(period)')} AS period_max, bool_and(NOT blocking) AS passed FROM res GROUP BY chain_id""")
def scope_certification(t: Tables):
    return decisions(t).groupBy("chain_id").agg(
        F.count_distinct("product").alias("products"), F.count_if(F.col("metric") == "SALES").alias("sales_facts"),
        F.count_if(F.col("metric") == "DELIVERY").alias("delivery_facts"), F.count_if(F.col("value").isNotNull()).alias("certified"),
        F.count_if("blocking").alias("blocked"), pr.label(F.min("period")).alias("period_min"), pr.label(F.max("period")).alias("period_max"),
        F.bool_and(~F.col("blocking")).alias("passed"),
    )


@query("g29_fan_out", with_(BASE) + """
SELECT l_orderkey, l_linenumber, count(DISTINCT chain_id || product_id) AS scopes FROM lines GROUP BY ALL HAVING count(DISTINCT chain_id || product_id) > 1""")
def fan_out(t: Tables):
    return t.lines.groupBy("l_orderkey", "l_linenumber").agg(F.count_distinct(F.concat("chain_id", "product_id")).alias("scopes")).filter("scopes > 1")


@query("g30_scope_rollup_guard", with_(BASE, FACTS) + """
SELECT chain_id, metric_code, CAST(sum(CAST(value AS DECIMAL(18,3))) AS DOUBLE) AS total, count(DISTINCT chain_id) > 1 OR count(*) > count(DISTINCT product_id || strftime(period, '%Y-%m')) AS refused FROM facts GROUP BY chain_id, metric_code""")
def scope_rollup_guard(t: Tables):
    return t.facts.groupBy("chain_id", "metric_code").agg(
        F.sum(F.col("value").cast("decimal(18,3)")).cast("double").alias("total"),
        (F.count(F.lit(1)) > F.count_distinct("product_id", "period")).alias("refused"),
    )


@query("g31_scope_coverage", """
SELECT r_name AS parent, count(*) FILTER (WHERE k = 0) AS no_child, count(*) FILTER (WHERE k = 1) AS one_child, count(*) FILTER (WHERE k > 1) AS many_children FROM (
  SELECT r_name, c_custkey, count(DISTINCT o_orderstatus) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) GROUP BY r_name""")
def scope_coverage(t: Tables):
    c = t.read("customer").join(t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kids = t.read("orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("k"))
    rows = c.join(kids, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return rows.groupBy(F.col("r_name").alias("parent")).agg(
        F.count_if(F.col("k") == 0).alias("no_child"), F.count_if(F.col("k") == 1).alias("one_child"), F.count_if(F.col("k") > 1).alias("many_children")
    )


# Comparison of fact sets -----------------------------------------------------------------
# The simple winner is the "golden" set, the full resolution the current one.

GOLD_SQL = """
gold AS (SELECT chain_id, product, period, metric, min(value) AS value FROM canon WHERE product IS NOT NULL AND literal_class = 'VALUE' GROUP BY ALL HAVING min(value) = max(value)),
curr AS (SELECT chain_id, product, period, metric, value FROM res WHERE value IS NOT NULL)
"""
GOLD = with_(BASE, CAND_SQL, GOLD_SQL)


def golden(t: Tables):
    rows = canonical(t).filter("product IS NOT NULL AND literal_class = 'VALUE'")
    return rc.simple_reconcile(rows, KEYS).filter("NOT conflict").select(*KEYS, "value")


def current(t: Tables):
    return decisions(t).filter("value IS NOT NULL").select(*KEYS, "value")


def both_sides(t: Tables):
    """Golden and current set, each derived and written once per application."""
    def build(name, rows):
        return t.kept(f"snapshot_{name}", lambda: sn.snapshot(rows(t), KEYS, "value"))

    return build("golden", golden), build("current", current)


@query("j23_golden_comparison", GOLD + """
SELECT metric, CASE WHEN g.chain_id IS NULL THEN 'new' WHEN c.chain_id IS NULL THEN 'missing' WHEN g.value = c.value THEN 'equal' ELSE 'changed' END AS status, count(*) AS n FROM gold g FULL JOIN curr c USING (chain_id, product, period, metric) GROUP BY ALL""")
def golden_comparison(t: Tables):
    return sn.summary(*both_sides(t), ["metric"])


@query("u02_set_difference", GOLD + """
SELECT 'only_golden' AS side, count(*) AS n FROM (SELECT * FROM gold EXCEPT ALL SELECT * FROM curr) UNION ALL SELECT 'only_current', count(*) FROM (SELECT * FROM curr EXCEPT ALL SELECT * FROM gold)""")
def set_difference(t: Tables):
    found = sn.differences(*both_sides(t))
    # a changed key stands on both sides
    sides = found.select(F.explode(F.array_compact(F.array(
        F.when(F.col("status") != "new", "only_golden"), F.when(F.col("status") != "missing", "only_current")))).alias("side"))
    every = t.spark.createDataFrame([("only_golden",), ("only_current",)], "side string")
    return every.join(sides.groupBy("side").agg(F.count(F.lit(1)).alias("n")), "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("n"))


@query("u03_key_intersection", GOLD + """
SELECT count(*) AS n FROM (SELECT chain_id, product, period, metric FROM gold INTERSECT SELECT chain_id, product, period, metric FROM res WHERE blocking)""")
def key_intersection(t: Tables):
    return golden(t).select(*KEYS).intersect(decisions(t).filter("blocking").select(*KEYS)).agg(F.count(F.lit(1)).alias("n"))


@query("j11_backlog_anti_join", GOLD + f"""
SELECT chain_id, product, {ym('period')} AS period, metric, value FROM gold g WHERE NOT EXISTS (SELECT 1 FROM res b WHERE b.blocking AND b.chain_id = g.chain_id AND b.product = g.product AND b.period = g.period AND b.metric = g.metric)""")
def backlog_anti_join(t: Tables):
    return ymd(golden(t).join(decisions(t).filter("blocking").select(*KEYS), KEYS, "left_anti"))


@query("j10_allowed_products", with_(BASE, FACTS) + f"""
SELECT chain_id, product_id, metric_code, count(*) AS n_facts, sum(value) AS total FROM facts WHERE product_id IN (SELECT p_brand FROM part WHERE p_size >= 49) GROUP BY ALL""")
def allowed_products(t: Tables):
    allowed = t.read("part").filter("p_size >= 49").select(F.col("p_brand").alias("product_id")).distinct()
    return t.facts.join(allowed, "product_id", "left_semi").groupBy(*CP, "metric_code").agg(F.count(F.lit(1)).alias("n_facts"), F.sum("value").alias("total"))


@query("u04_inventory_equality", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part)) AS lines_without_part, (SELECT count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem)) AS parts_without_line""")
def inventory_equality(t: Tables):
    a = t.read("lineitem").select(F.col("l_partkey").alias("k")).distinct()
    b = t.read("part").select(F.col("p_partkey").alias("k"))
    left = a.join(b, "k", "left_anti").select(F.lit(1).alias("l"), F.lit(0).alias("p"))
    right = b.join(a, "k", "left_anti").select(F.lit(0).alias("l"), F.lit(1).alias("p"))
    return left.unionByName(right).agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("lines_without_part"), F.coalesce(F.sum("p"), F.lit(0)).alias("parts_without_line")
    )


@query("u05_period_union", with_(BASE) + f"SELECT {ym('p')} AS period FROM (SELECT ship_m AS p FROM lines UNION SELECT order_m FROM lines UNION SELECT CAST(ship_m + INTERVAL 12 MONTH AS DATE) FROM lines)")
def period_union(t: Tables):
    m = t.lines.groupBy("ship_m", "order_m").agg(F.count(F.lit(1)).alias("n"))
    all_periods = m.select(F.explode(F.array("ship_m", "order_m", F.add_months("ship_m", 12))).alias("p")).distinct()
    return all_periods.select(pr.label("p").alias("period"))


@query("u07_incoming_classification", GOLD + f"""
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN b.chain_id IS NOT NULL THEN CASE WHEN rv THEN 'RESOLVES_BACKLOG' ELSE 'CONFLICT' END WHEN a.chain_id IS NULL THEN 'NEW' WHEN i.value = a.value THEN 'SAME' WHEN rv THEN 'REVISION' ELSE 'CONFLICT' END AS kind
 FROM (SELECT chain_id, product, period, metric, max(value) AS value, month(period) % 2 = 0 AS rv FROM canon WHERE product IS NOT NULL GROUP BY ALL) i LEFT JOIN curr a USING (chain_id, product, period, metric)
 LEFT JOIN (SELECT * FROM res WHERE blocking) b USING (chain_id, product, period, metric)) GROUP BY kind""")
def incoming_classification(t: Tables):
    incoming = canonical(t).filter("product IS NOT NULL").groupBy(*KEYS).agg(F.max("value").alias("value")).withColumn(
        "reviewed", F.month("period") % 2 == 0
    )
    d = decisions(t)
    return rc.classify_incoming(incoming, d.filter("value IS NOT NULL"), d.filter("blocking"), KEYS).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# Routing -------------------------------------------------------------------------------------

ROUTE_SQL = """
mem AS (SELECT DISTINCT l_linenumber AS source, part_id AS item, CASE WHEN l_suppkey % 3 <> 0 THEN part_id || '-' || (l_suppkey % 2) END AS upc, chain_id AS unit, ship_m AS period FROM lines WHERE l_returnflag <> 'N'),
rows0 AS (SELECT l_linenumber AS source, part_id AS item, CASE WHEN l_suppkey % 5 = 0 THEN part_id || '-' || (l_suppkey % 2) END AS upc, ship_m AS period, CASE WHEN l_linestatus = 'O' AND o_orderstatus = 'O' THEN chain_id END AS explicit_unit FROM lines WHERE l_returnflag = 'N'),
mi AS (SELECT source, item, period, count(DISTINCT unit) AS units, min(unit) AS unit, count(DISTINCT upc) AS upcs, min(upc) AS upc FROM mem GROUP BY ALL),
mu AS (SELECT source, upc, period, count(DISTINCT unit) AS units, min(unit) AS unit FROM mem WHERE upc IS NOT NULL GROUP BY ALL),
me AS (SELECT source, item, period, unit, count(DISTINCT upc) AS upcs FROM mem GROUP BY ALL),
kn AS (SELECT DISTINCT unit, item FROM mem WHERE upc IS NOT NULL),
rt1 AS (SELECT r.*, CASE WHEN r.upc IS NOT NULL THEN coalesce(mu.units, 0) ELSE coalesce(mi.units, 0) END AS units, CASE WHEN explicit_unit IS NOT NULL THEN explicit_unit WHEN CASE WHEN r.upc IS NOT NULL THEN mu.units ELSE mi.units END = 1 THEN CASE WHEN r.upc IS NOT NULL THEN mu.unit ELSE mi.unit END END AS fu,
   coalesce(CASE WHEN explicit_unit IS NOT NULL THEN me.upcs ELSE mi.upcs END, 0) AS opts
  FROM rows0 r LEFT JOIN mi ON mi.source = r.source AND mi.item = r.item AND mi.period = r.period LEFT JOIN mu ON mu.source = r.source AND mu.upc = r.upc AND mu.period = r.period
  LEFT JOIN me ON me.source = r.source AND me.item = r.item AND me.period = r.period AND me.unit = r.explicit_unit),
rt AS (SELECT rt1.*, CASE WHEN fu IS NOT NULL AND upc IS NULL AND (opts > 1 OR (opts = 0 AND kn.item IS NOT NULL)) THEN 'INSUFFICIENT_IDENTITY' WHEN explicit_unit IS NOT NULL THEN 'RESOLVED_EXPLICIT_ROW_CHAIN'
   WHEN units > 1 THEN 'MULTIPLE_COMMERCIAL_MEMBERSHIP' WHEN units = 1 THEN 'RESOLVED_UNIQUE_ITEM_UPC' ELSE 'NO_COMMERCIAL_MEMBERSHIP' END AS resolution FROM rt1 LEFT JOIN kn ON kn.unit = fu AND kn.item = rt1.item)
"""
ROUTE = with_(BASE, ROUTE_SQL)


def members(t: Tables):
    upc = F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.col("part_id").cast("string"), F.lit("-"), (F.col("l_suppkey") % 2).cast("string")))
    return t.lines.filter("l_returnflag <> 'N'").select(
        F.col("l_linenumber").alias("source"), F.col("part_id").alias("item"), upc.alias("upc"), F.col("chain_id").alias("unit"), F.col("ship_m").alias("period")
    ).distinct()


def route_rows(t: Tables):
    upc = F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.col("part_id").cast("string"), F.lit("-"), (F.col("l_suppkey") % 2).cast("string")))
    explicit = F.when((F.col("l_linestatus") == "O") & (F.col("o_orderstatus") == "O"), F.col("chain_id"))
    return t.lines.filter("l_returnflag = 'N'").select(
        F.col("l_linenumber").alias("source"), F.col("part_id").alias("item"), upc.alias("upc"), F.col("ship_m").alias("period"), explicit.alias("explicit_unit")
    )


@query("j16_membership_routing", ROUTE + f"SELECT resolution, CASE WHEN resolution <> 'INSUFFICIENT_IDENTITY' THEN fu END AS unit, year(period) AS year, count(*) AS n FROM rt GROUP BY ALL")
def membership_routing(t: Tables):
    return rc.route_memberships(route_rows(t), members(t)).groupBy("resolution", "unit", F.year("period").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("j17_membership_without_period", ROUTE + """
SELECT CASE WHEN m.units IS NULL THEN 'NONE' WHEN m.units = 1 THEN 'UNIQUE' ELSE 'MULTIPLE' END AS resolution, count(*) AS n FROM rows0 r LEFT JOIN (SELECT source, item, count(DISTINCT unit) AS units FROM mem GROUP BY ALL) m USING (source, item) GROUP BY ALL""")
def membership_without_period(t: Tables):
    m = members(t).groupBy("source", "item").agg(F.count_distinct("unit").alias("units"))
    status = F.when(F.col("units").isNull(), "NONE").when(F.col("units") == 1, "UNIQUE").otherwise("MULTIPLE")
    return route_rows(t).join(m, ["source", "item"], "left").groupBy(status.alias("resolution")).agg(F.count(F.lit(1)).alias("n"))


@query("j18_grain_routing", ROUTE + """
, g AS (SELECT r.*, coalesce(c.k, 0) AS kids FROM rt r LEFT JOIN (SELECT source, item, period, count(DISTINCT unit) AS k FROM mem GROUP BY ALL) c ON c.source = r.source AND c.item = r.item AND c.period = r.period)
SELECT CASE WHEN explicit_unit IS NOT NULL THEN 'EXPLICIT_ROW_UNIT' WHEN source <= 3 THEN 'PARENT_CHAIN' WHEN source <= 5 THEN 'COMMERCIAL_UNIT' ELSE 'UNKNOWN_SCOPE' END AS grain,
 CASE WHEN explicit_unit IS NOT NULL THEN CASE WHEN resolution = 'INSUFFICIENT_IDENTITY' THEN 'INSUFFICIENT_PRODUCT_IDENTITY' ELSE 'RESOLVED_EXPLICIT_UNIT_GRAIN' END
  WHEN source <= 3 THEN CASE WHEN kids > 1 THEN 'PARENT_VALID_CHILD_MULTI' WHEN kids = 0 THEN 'PARENT_VALID_CHILD_UNKNOWN' ELSE 'RESOLVED_PARENT_CHAIN_GRAIN' END
  WHEN source <= 5 THEN CASE WHEN resolution = 'INSUFFICIENT_IDENTITY' THEN 'INSUFFICIENT_PRODUCT_IDENTITY' ELSE 'RESOLVED_EXPLICIT_UNIT_GRAIN' END ELSE 'TRUE_SCOPE_BLOCKER' END AS scope_resolution, count(*) AS n FROM g GROUP BY ALL""")
def grain_routing(t: Tables):
    children = members(t).groupBy("source", "item", "period").agg(F.count_distinct("unit").alias("kids"))
    routed = rc.route_memberships(route_rows(t), members(t)).join(children, ["source", "item", "period"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    explicit, src = F.col("explicit_unit").isNotNull(), F.col("source")
    grain = F.when(explicit, "EXPLICIT_ROW_UNIT").when(src <= 3, "PARENT_CHAIN").when(src <= 5, "COMMERCIAL_UNIT").otherwise("UNKNOWN_SCOPE")
    unsure = F.col("resolution") == "INSUFFICIENT_IDENTITY"
    unit_grain = F.when(unsure, "INSUFFICIENT_PRODUCT_IDENTITY").otherwise("RESOLVED_EXPLICIT_UNIT_GRAIN")
    parent = F.when(F.col("kids") > 1, "PARENT_VALID_CHILD_MULTI").when(F.col("kids") == 0, "PARENT_VALID_CHILD_UNKNOWN").otherwise("RESOLVED_PARENT_CHAIN_GRAIN")
    how = F.when(explicit, unit_grain).when(src <= 3, parent).when(src <= 5, unit_grain).otherwise("TRUE_SCOPE_BLOCKER")
    return routed.groupBy(grain.alias("grain"), how.alias("scope_resolution")).agg(F.count(F.lit(1)).alias("n"))


RULE_SQL = """
rules AS (SELECT 'S' || s AS source, m AS metric, 'R' || s || m AS rule_id, CAST(make_date(1994 + s, 1, 1) AS DATE) AS valid_from, CAST(make_date(1996 + s, 12, 1) AS DATE) AS valid_to, CASE WHEN s % 2 = 0 THEN 'SUMMARY_ONLY' ELSE 'PRIMARY' END AS authority_role
  FROM (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS s), (SELECT unnest(['SALES', 'DELIVERY']) AS m)
  UNION ALL SELECT 'S3', 'SALES', 'R3X', DATE '1999-06-01', DATE '2000-06-01', 'EXCLUDED_DERIVED')
"""


def rules(t: Tables):
    """One authority rule per source and metric seen in the claims, plus one that overlaps."""
    seen = candidates(t).select("source", "metric").distinct().withColumn("s", F.substring("source", 2, 3).cast("int"))
    base = seen.select(
        "source", "metric", F.concat(F.lit("R"), "s", "metric").alias("rule_id"), F.make_date(F.col("s") + 1994, F.lit(1), F.lit(1)).alias("valid_from"),
        F.make_date(F.col("s") + 1996, F.lit(12), F.lit(1)).alias("valid_to"), F.when(F.col("s") % 2 == 0, "SUMMARY_ONLY").otherwise("PRIMARY").alias("authority_role"),
    )
    extra = base.filter("source = 'S3' AND metric = 'SALES'").select(
        "source", "metric", F.lit("R3X").alias("rule_id"), F.lit("1999-06-01").cast("date").alias("valid_from"), F.lit("2000-06-01").cast("date").alias("valid_to"),
        F.lit("EXCLUDED_DERIVED").alias("authority_role"),
    )
    return base.unionByName(extra)


@query("j19_authority_rules", with_(BASE, CAND_SQL, RULE_SQL) + """
SELECT source, metric, matches, rule_id, count(*) AS n FROM (SELECT c.source, c.metric, count(r.rule_id) AS matches, min(r.rule_id) AS rule_id FROM cand c LEFT JOIN rules r ON r.source = c.source AND r.metric = c.metric AND c.period BETWEEN r.valid_from AND r.valid_to
  GROUP BY c.chain_id, c.item, c.period, c.metric, c.source, c.sheet) GROUP BY ALL""")
def authority_rules(t: Tables):
    rows = candidates(t).withColumn("row_id", F.concat_ws("|", "chain_id", "item", "period", "metric", "source", "sheet"))
    return rc.apply_rules(rows, rules(t)).groupBy("source", "metric", "matches", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("j20_snapshot_pair_coverage", with_(BASE, CAND_SQL, RULE_SQL) + """
, hit AS (SELECT DISTINCT c.chain_id, c.item, c.period, c.metric, c.source, c.sheet, c.cutoff, c.sequence, r.rule_id FROM cand c JOIN rules r ON r.source = c.source AND r.metric = c.metric AND c.period BETWEEN r.valid_from AND r.valid_to WHERE c.sequence = 'Q'),
pair AS (SELECT a.*, b.cutoff AS later FROM hit a JOIN (SELECT DISTINCT chain_id, item, period, metric, cutoff, rule_id FROM hit) b ON b.chain_id = a.chain_id AND b.item = a.item AND b.period = a.period AND b.metric = a.metric AND b.rule_id = a.rule_id AND b.cutoff > a.cutoff)
SELECT metric, rule_id, count(*) AS covered, count(DISTINCT cutoff) AS cutoffs, (SELECT count(DISTINCT (chain_id, item, period, cutoff, later)) FROM pair p WHERE p.metric = h.metric AND p.rule_id = h.rule_id) AS ordered_pairs FROM hit h GROUP BY metric, rule_id""")
def snapshot_pair_coverage(t: Tables):
    """Claims of a sequence that a proof covers, and the pairs of an earlier and a later cutoff of one key under one proof."""
    rows = candidates(t).filter("sequence = 'Q'").select("chain_id", "item", "period", "metric", "source", "sheet", "cutoff")
    proofs = matches(rows, rules(t), ["source", "metric"], "period", "valid_from", "valid_to").select("source", "metric", "period", "rule_id")
    hit = rows.join(proofs, ["source", "metric", "period"])
    key = ["chain_id", "item", "period", "metric", "rule_id"]
    # of k different cutoffs of a key, k (k - 1) / 2 pairs are in order
    pairs = hit.groupBy(*key).agg(F.count_distinct("cutoff").alias("k")).groupBy("metric", "rule_id").agg(
        F.sum(F.col("k") * (F.col("k") - 1) / 2).cast("bigint").alias("ordered_pairs"))
    return hit.groupBy("metric", "rule_id").agg(F.count(F.lit(1)).alias("covered"), F.count_distinct("cutoff").alias("cutoffs")).join(pairs, ["metric", "rule_id"])


@query("j21_derived_cell_lineage", with_(BASE, FACTS) + """
, f AS (SELECT chain_id, product_id, period, '=XLOOKUP(A' || row_number() OVER (PARTITION BY chain_id ORDER BY product_id, period) || ',''' || chain_id || '''!A:A,''' || chain_id || '''!C:C)' AS formula FROM facts WHERE metric_code = 'SALES')
SELECT regexp_extract(formula, '''([^'']+)''![$]?([A-Z]+):[$]?[A-Z]+,''[^'']+''![$]?([A-Z]+):', 1) AS sheet, regexp_extract(formula, '''([^'']+)''![$]?([A-Z]+):[$]?[A-Z]+,''[^'']+''![$]?([A-Z]+):', 3) AS value_column, count(*) AS n_cells, count(d.value) AS matched
FROM f LEFT JOIN (SELECT * FROM facts WHERE metric_code = 'DELIVERY') d ON d.chain_id = f.chain_id AND d.product_id = f.product_id AND d.period = f.period GROUP BY ALL""")
def derived_cell_lineage(t: Tables):
    from monthmill.sources.cells import lookup_reference

    sales = t.facts.filter("metric_code = 'SALES'")
    formula = F.concat(F.lit("=XLOOKUP(A1,'"), "chain_id", F.lit("'!A:A,'"), "chain_id", F.lit("'!C:C)"))
    ref = lookup_reference(F.col("formula"))
    raw = t.facts.filter("metric_code = 'DELIVERY'").select(F.col("chain_id").alias("sheet"), "product_id", "period", "value")
    derived = sales.withColumn("formula", formula).withColumn("ref", ref).select("product_id", "period", F.col("ref.sheet").alias("sheet"), F.col("ref.value_column").alias("value_column"))
    return derived.join(raw, ["sheet", "product_id", "period"], "left").groupBy("sheet", "value_column").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count("value").alias("matched")
    )


@query("j22_baseline_trace", CAND + f"""
, old AS (SELECT chain_id, item, period, metric FROM cand GROUP BY ALL HAVING min(value) <> max(value)),
lk AS (SELECT o.*, n.reason, n.value FROM old o LEFT JOIN (SELECT DISTINCT chain_id, item, product, period, metric FROM canon WHERE product IS NOT NULL) m USING (chain_id, item, period, metric) LEFT JOIN res n USING (chain_id, product, period, metric)),
oc AS (SELECT chain_id, item, period, metric, CASE WHEN count(*) FILTER (WHERE reason IN ('INTERNAL_SOURCE_DUPLICATE', 'SAME_SNAPSHOT_CONFLICT', 'CROSS_SOURCE_CONFLICT')) > 0 THEN 'STILL_BLOCKED' WHEN count(reason) = 0 THEN 'UNACCOUNTED'
   WHEN count(value) = 0 THEN 'NO_LONGER_A_FACT' WHEN count(DISTINCT reason) > 1 THEN 'RESOLVED_MIXED' ELSE 'RESOLVED' END AS outcome FROM lk GROUP BY ALL)
SELECT chain_id, outcome, count(*) AS n FROM oc GROUP BY ALL""")
def baseline_trace(t: Tables):
    old_key = ["chain_id", "item", "period", "metric"]
    old = rc.simple_reconcile(candidates(t), old_key).filter("conflict").select(*old_key)
    links = canonical(t).filter("product IS NOT NULL").select("chain_id", "item", "product", "period", "metric").distinct()
    traced = old.join(links, old_key, "left").join(decisions(t).select(*KEYS, "reason", "value", "blocking"), KEYS, "left")
    outcome = traced.groupBy(*old_key).agg(
        F.when(F.count_if("blocking") > 0, "STILL_BLOCKED").when(F.count("reason") == 0, "UNACCOUNTED").when(F.count("value") == 0, "NO_LONGER_A_FACT")
        .when(F.count_distinct("reason") > 1, "RESOLVED_MIXED").otherwise("RESOLVED").alias("outcome")
    )
    return outcome.groupBy("chain_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("j27_hierarchy_match", ROUTE + """
, leg AS (SELECT DISTINCT source, item, period FROM rows0),
fx AS (SELECT source, item, period, unit, 'CHILD' AS grain FROM mem WHERE upc IS NOT NULL UNION SELECT source, item, period, 'ALL', 'PARENT' FROM mem),
mt AS (SELECT l.source, l.item, l.period, count(DISTINCT unit) FILTER (WHERE grain = 'CHILD') AS kids, count(DISTINCT unit) FILTER (WHERE grain = 'PARENT') AS parents FROM leg l LEFT JOIN fx f USING (source, item, period) GROUP BY ALL)
SELECT CASE WHEN kids = 1 THEN 'CHILD' WHEN kids > 1 THEN 'AMBIGUOUS' WHEN parents = 1 THEN 'PARENT' ELSE 'MISSING' END AS matched, count(*) AS n FROM mt GROUP BY ALL""")
def hierarchy_match(t: Tables):
    loc = ["source", "item", "period"]
    legacy = route_rows(t).select(*loc).distinct()
    kids = members(t).groupBy(*loc).agg(F.count_distinct(F.when(F.col("upc").isNotNull(), F.col("unit"))).alias("kids"))
    status = F.when(F.col("kids") == 1, "CHILD").when(F.col("kids") > 1, "AMBIGUOUS").when(F.col("kids") == 0, "PARENT").otherwise("MISSING")
    return legacy.join(kids, loc, "left").groupBy(status.alias("matched")).agg(F.count(F.lit(1)).alias("n"))


@query("j14_leaf_scopes", """
WITH RECURSIVE e AS (SELECT 'N' || n_nationkey AS scope, 'R' || n_regionkey AS parent FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer),
sel AS (SELECT scope FROM e WHERE scope LIKE 'N%' UNION SELECT DISTINCT parent FROM e WHERE parent LIKE 'R%' UNION SELECT 'C' || c_custkey FROM customer WHERE c_acctbal > 0),
up AS (SELECT s.scope AS start, e.parent AS anc FROM sel s JOIN e ON e.scope = s.scope UNION ALL SELECT up.start, e.parent FROM up JOIN e ON e.scope = up.anc)
SELECT scope FROM sel WHERE scope NOT IN (SELECT anc FROM up WHERE anc IN (SELECT scope FROM sel))""")
def leaf_scopes(t: Tables):
    from monthmill.operators.hierarchy import leaf_scopes as leaves

    nation, customer = t.read("nation"), t.read("customer")
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = nation.select(tag("N", "n_nationkey").alias("scope"), tag("R", "n_regionkey").alias("parent")).unionByName(
        customer.select(tag("C", "c_custkey").alias("scope"), tag("N", "c_nationkey").alias("parent"))
    )
    chosen = edges.filter(F.col("scope").startswith("N")).select("scope").unionByName(
        edges.filter(F.col("parent").startswith("R")).select(F.col("parent").alias("scope"))
    ).unionByName(customer.filter("c_acctbal > 0").select(tag("C", "c_custkey").alias("scope"))).distinct()
    return leaves(edges, chosen, depth=3)


# What was loaded differs from what was expected in planted places: lost rows, changed values, rows of an unknown product.
LOADED_SQL = """
loaded AS (SELECT chain_id, product_id, period, metric_code, CASE WHEN product_id = 'Brand#7' AND month(period) = 5 THEN value + 1 ELSE value END AS value FROM facts
    WHERE NOT (chain_id = 'BUILDING' AND product_id = 'Brand#3' AND metric_code = 'ORDER')
  UNION ALL SELECT chain_id, 'Brand#99', period, metric_code, value FROM facts WHERE chain_id = 'MACHINERY' AND product_id = 'Brand#11' AND metric_code = 'SALES'),
cmp AS (SELECT chain_id, CASE WHEN f.value IS NULL THEN 'new' WHEN l.value IS NULL THEN 'missing' WHEN f.value <> l.value THEN 'changed' ELSE 'equal' END AS status
  FROM facts f FULL JOIN loaded l USING (chain_id, product_id, period, metric_code))
"""


def loaded_facts(t: Tables):
    rows = t.facts.select(*CP, "period", "metric_code", "value")
    kept = rows.filter(~((F.col("chain_id") == "BUILDING") & (F.col("product_id") == "Brand#3") & (F.col("metric_code") == "ORDER")))
    changed = kept.withColumn("value", F.when((F.col("product_id") == "Brand#7") & (F.month("period") == 5), F.col("value") + 1).otherwise(F.col("value")))
    extra = rows.filter((F.col("chain_id") == "MACHINERY") & (F.col("product_id") == "Brand#11") & (F.col("metric_code") == "SALES"))
    return changed.unionByName(extra.withColumn("product_id", F.lit("Brand#99")))


@query("g47_scope_readback", with_(BASE, FACTS, LOADED_SQL) + """
SELECT chain_id, count(*) FILTER (WHERE status <> 'new') AS expected, count(*) FILTER (WHERE status <> 'missing') AS loaded, count(*) FILTER (WHERE status = 'changed') AS changed, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'new') AS unexpected,
  count(*) FILTER (WHERE status <> 'equal') = 0 AS matches FROM cmp GROUP BY chain_id""")
def scope_readback(t: Tables):
    keys = [*CP, "period", "metric_code"]
    rows = sn.summary(sn.snapshot(t.facts.select(*keys, "value"), keys, "value"), sn.snapshot(loaded_facts(t), keys, "value"), ["chain_id"])
    of = lambda *kinds: F.coalesce(F.sum(F.when(F.col("status").isin(*kinds), F.col("n"))), F.lit(0))
    return rows.groupBy("chain_id").agg(
        of("equal", "changed", "missing").alias("expected"), of("equal", "changed", "new").alias("loaded"), of("changed").alias("changed"),
        of("missing").alias("missing"), of("new").alias("unexpected"), (of("changed", "missing", "new") == 0).alias("matches"))


# Certification, residuals, availability evidence -------------------------------------------

# The certified copy of the decisions: some values were typed wrong, some facts were never copied.
CERTIFIED_SQL = """
copy AS (SELECT chain_id, product, period, metric, blocking, version_no, CASE WHEN month(period) = 4 AND metric = 'SALES' AND value = 25 THEN 52 ELSE value END AS value FROM res WHERE NOT coalesce(month(period) = 9 AND metric = 'DELIVERY' AND value = 50, false)),
cert AS (SELECT r.blocking, r.version_no, r.value AS source, c.value AS copied, c.chain_id IS NULL AS absent FROM res r LEFT JOIN copy c USING (chain_id, product, period, metric))
"""


@query("q08_fact_certification", with_(BASE, CAND_SQL, CERTIFIED_SQL) + """
SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN blocking THEN 'BLOCKED' END, CASE WHEN NOT absent AND source IS DISTINCT FROM copied THEN 'LITERAL_CHANGED' END, CASE WHEN absent THEN 'NOT_COPIED' END,
  CASE WHEN source IS NULL AND NOT blocking THEN 'NOT_A_FACT' END, CASE WHEN version_no > 1 THEN 'REVISED' END], lambda x: x IS NOT NULL)) AS issue FROM cert) GROUP BY issue""")
def fact_certification(t: Tables):
    """Every decision against its copy; only what the hash tree finds different is compared value by value."""
    from monthmill.operators.quality import violations

    rows = decisions(t).select(*KEYS, "value", "blocking", "version_no")
    month, value = F.month("period"), F.col("value")
    copy = rows.filter(~F.coalesce((month == 9) & (F.col("metric") == "DELIVERY") & (value == 50), F.lit(False))).withColumn(
        "value", F.when((month == 4) & (F.col("metric") == "SALES") & (value == 25), 52.0).otherwise(value))
    found = sn.differences(sn.snapshot(rows, KEYS, "value"), sn.snapshot(copy, KEYS, "value"))
    state = violations(rows, {
        "BLOCKED": F.col("blocking"), "NOT_A_FACT": value.isNull() & ~F.col("blocking"), "REVISED": F.col("version_no") > 1,
    }).select(F.col("rule").alias("issue"))
    told = found.select(F.when(F.col("status") == "changed", "LITERAL_CHANGED").when(F.col("status") == "missing", "NOT_COPIED").otherwise("UNKNOWN_FACT").alias("issue"))
    return state.unionByName(told).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query("q09_residual_types", ROUTE + """
, u AS (SELECT r.*, coalesce(c.k, 0) AS kids FROM rt r LEFT JOIN (SELECT source, item, period, count(DISTINCT unit) AS k FROM mem GROUP BY ALL) c ON c.source = r.source AND c.item = r.item AND c.period = r.period WHERE resolution IN ('INSUFFICIENT_IDENTITY', 'MULTIPLE_COMMERCIAL_MEMBERSHIP', 'NO_COMMERCIAL_MEMBERSHIP'))
SELECT CASE WHEN resolution = 'INSUFFICIENT_IDENTITY' THEN 'IDENTITY_SCOPE_COUPLED' WHEN source = 7 THEN 'CALC_SHEET_WITHOUT_VALUE_SCOPE' WHEN kids > 1 THEN 'MULTIPLE_POSSIBLE_CHILD' WHEN source = 1 THEN 'RAW_SOURCE_WITHOUT_SCOPE' WHEN kids = 1 THEN 'CHILD_SCOPE_MISSING' ELSE 'OTHER' END AS block_type, count(*) AS n FROM u GROUP BY ALL""")
def residual_types(t: Tables):
    children = members(t).groupBy("source", "item", "period").agg(F.count_distinct("unit").alias("kids"))
    open_rows = rc.route_memberships(route_rows(t), members(t)).filter(
        F.col("resolution").isin("INSUFFICIENT_IDENTITY", "MULTIPLE_COMMERCIAL_MEMBERSHIP", "NO_COMMERCIAL_MEMBERSHIP")
    ).join(children, ["source", "item", "period"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    kind = (
        F.when(F.col("resolution") == "INSUFFICIENT_IDENTITY", "IDENTITY_SCOPE_COUPLED").when(F.col("source") == 7, "CALC_SHEET_WITHOUT_VALUE_SCOPE")
        .when(F.col("kids") > 1, "MULTIPLE_POSSIBLE_CHILD").when(F.col("source") == 1, "RAW_SOURCE_WITHOUT_SCOPE").when(F.col("kids") == 1, "CHILD_SCOPE_MISSING").otherwise("OTHER")
    )
    return open_rows.groupBy(kind.alias("block_type")).agg(F.count(F.lit(1)).alias("n"))


@query("q10_residual_closure", with_(BASE, CAND_SQL, RULE_SQL) + """
, open0 AS (SELECT * FROM res WHERE blocking), srcs AS (SELECT DISTINCT o.chain_id, o.product, o.period, o.metric, p.source FROM open0 o JOIN pass p USING (chain_id, product, period, metric)),
done AS (SELECT DISTINCT s.chain_id, s.product, s.period, s.metric FROM srcs s JOIN rules r ON r.source = s.source AND r.metric = s.metric AND s.period BETWEEN r.valid_from AND r.valid_to WHERE r.authority_role = 'PRIMARY')
SELECT o.metric, count(*) AS before_count, count(d.chain_id) AS closed, count(*) - count(d.chain_id) AS after_count, true AS accounted FROM open0 o LEFT JOIN done d USING (chain_id, product, period, metric) GROUP BY o.metric""")
def residual_closure(t: Tables):
    """Blocked keys that a primary rule closes. Closed and still open are counted apart, and must add up to what was there."""
    blocked = decisions(t).filter("blocking").select(*KEYS)
    claims = passing(t).select(*KEYS, "source").distinct().join(blocked, KEYS, "left_semi")
    primary = rules(t).filter("authority_role = 'PRIMARY'")
    ruled = matches(claims, primary, ["source", "metric"], "period", "valid_from", "valid_to").select("source", "metric", "period").distinct()
    closed = claims.join(ruled, ["source", "metric", "period"], "left_semi").select(*KEYS).distinct()
    count = lambda rows, name: rows.groupBy("metric").agg(F.count(F.lit(1)).alias(name))
    sides = count(blocked, "before_count").join(count(closed, "closed"), "metric", "left").join(
        count(blocked.join(closed, KEYS, "left_anti"), "after_count"), "metric", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sides.select("metric", "before_count", zero("closed"), zero("after_count")).withColumn(
        "accounted", F.col("before_count") == F.col("closed") + F.col("after_count"))


@query("q11_availability_evidence", """
SELECT source, confidence, count(*) AS n FROM (SELECT CASE WHEN event_type = 'view' THEN 'system_timestamp' WHEN event_type = 'click' AND c.day IS NOT NULL THEN 'monthly_closure' WHEN event_type = 'error' THEN 'source_file_timestamp' WHEN event_type = 'signup' THEN 'business_rule' ELSE 'unknown' END AS source,
  CASE WHEN event_type = 'view' THEN 'verified' WHEN event_type = 'click' AND c.day IS NOT NULL THEN 'documented' WHEN event_type = 'signup' AND value > 50 THEN 'documented' ELSE 'unknown' END AS confidence
 FROM events e LEFT JOIN (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase') c ON c.user_id = e.user_id AND c.day = CAST(e.ts AS DATE)) GROUP BY ALL""")
def availability_evidence(t: Tables):
    day = F.to_date("ts")
    # a user's day is closed by a closure row of that user and day
    closures = t.events.filter("event_type = 'purchase'").select("user_id", day.alias("day")).distinct().withColumn("closed", F.lit(True))
    e = t.events.withColumn("day", day).join(closures, ["user_id", "day"], "left")
    kind, closed = F.col("event_type"), F.col("closed").isNotNull()
    source = (
        F.when(kind == "view", "system_timestamp").when((kind == "click") & closed, "monthly_closure").when(kind == "error", "source_file_timestamp")
        .when(kind == "signup", "business_rule").otherwise("unknown")
    )
    confidence = F.when(kind == "view", "verified").when((kind == "click") & closed, "documented").when((kind == "signup") & (F.col("value") > 50), "documented").otherwise("unknown")
    return e.groupBy(source.alias("source"), confidence.alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("q12_availability_backfill", with_(BASE, CAND_SQL, RULE_SQL) + """
, ruled AS (SELECT c.*, min(r.rule_id) AS rule_id, max(1 + CAST(substr(r.rule_id, 2, 1) AS INTEGER) % 3) AS receipt FROM cand c LEFT JOIN rules r ON r.source = c.source AND r.metric = c.metric AND c.period BETWEEN r.valid_from AND r.valid_to GROUP BY ALL)
SELECT change, count(*) AS n FROM (SELECT CASE WHEN abs(c.value - r.value) > 1e-6 THEN 'value_mismatch' WHEN c.rule_id IS NULL THEN 'no_rule' WHEN c.cutoff < c.receipt THEN 'before_receipt' ELSE 'backfilled' END AS change
  FROM ruled c JOIN canon k USING (chain_id, item, period, metric, source, sheet) JOIN res r ON r.chain_id = k.chain_id AND r.product = k.product AND r.period = k.period AND r.metric = k.metric WHERE r.value IS NOT NULL) GROUP BY change""")
def availability_backfill(t: Tables):
    """A claim is backfilled if its value is the fact's and a rule that was in force received it by then."""
    rows = canonical(t).filter("product IS NOT NULL")
    facts = decisions(t).filter("value IS NOT NULL").select(*KEYS, F.col("value").alias("fact_value"))
    receipt = (F.substring("rule_id", 2, 1).cast("int") % 3 + 1).alias("receipt")
    ruled = matches(rows, rules(t).select("*", receipt), ["source", "metric"], "period", "valid_from", "valid_to").groupBy("source", "metric", "period").agg(
        F.max("receipt").alias("receipt"))
    change = (
        F.when(F.abs(F.col("value") - F.col("fact_value")) > 1e-6, "value_mismatch").when(F.col("receipt").isNull(), "no_rule")
        .when(F.col("cutoff") < F.col("receipt"), "before_receipt").otherwise("backfilled")
    )
    return rows.join(facts, KEYS).join(ruled, ["source", "metric", "period"], "left").groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


@query("q17_membership_extraction", ROUTE + f"""
, br AS (SELECT source, unit, item, period, min(upc) AS u, count(DISTINCT upc) AS k FROM mem WHERE upc IS NOT NULL GROUP BY ALL)
SELECT m.source, m.unit, count(DISTINCT (m.item, coalesce(m.upc, CASE WHEN b.k = 1 THEN b.u ELSE '' END))) AS memberships, {ym('min(m.period)')} AS first_period, {ym('max(m.period)')} AS last_period FROM mem m LEFT JOIN br b USING (source, unit, item, period) GROUP BY m.source, m.unit""")
def membership_extraction(t: Tables):
    m = members(t)
    bridge = m.filter("upc IS NOT NULL").groupBy("source", "unit", "item", "period").agg(F.min("upc").alias("u"), F.count_distinct("upc").alias("k"))
    rows = m.join(bridge, ["source", "unit", "item", "period"], "left").withColumn("mapped", F.coalesce("upc", F.when(F.col("k") == 1, F.col("u")), F.lit("")))
    return rows.groupBy("source", "unit").agg(
        F.count_distinct("item", "mapped").alias("memberships"), pr.label(F.min("period")).alias("first_period"), pr.label(F.max("period")).alias("last_period")
    )


@query("q18_scope_hierarchy_conflicts", """
SELECT c_mktsegment AS scope, count(DISTINCT r_name) AS parents, count(DISTINCT r_name) > 1 AS conflict FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1
UNION ALL SELECT n_name, count(DISTINCT n_regionkey), count(DISTINCT n_regionkey) > 1 FROM nation GROUP BY 1""")
def scope_hierarchy_conflicts(t: Tables):
    c = t.read("customer").join(t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    edges = c.select(F.col("c_mktsegment").alias("scope"), F.col("r_name").alias("parent")).unionByName(
        t.read("nation").select(F.col("n_name").alias("scope"), F.col("n_regionkey").cast("string").alias("parent"))
    )
    return edges.groupBy("scope").agg(F.count_distinct("parent").alias("parents"), (F.count_distinct("parent") > 1).alias("conflict"))


@query("q19_source_inventory", CAND + f"""
SELECT source, sheet, count(DISTINCT item) AS identifiers, count(*) FILTER (WHERE formula) AS formulas, count(*) AS facts, {ym('min(period)')} AS period_min, {ym('max(period)')} AS period_max FROM cand GROUP BY ALL""")
def source_inventory(t: Tables):
    return candidates(t).groupBy("source", "sheet").agg(
        F.count_distinct("item").alias("identifiers"), F.count_if("formula").alias("formulas"), F.count(F.lit(1)).alias("facts"),
        pr.label(F.min("period")).alias("period_min"), pr.label(F.max("period")).alias("period_max"),
    )


@query("q20_differing_dimensions", CAND + """
SELECT differing, count(*) AS n_keys FROM (SELECT concat_ws(',', CASE WHEN count(DISTINCT source) > 1 THEN 'source' END, CASE WHEN count(DISTINCT sheet) > 1 THEN 'sheet' END, CASE WHEN count(DISTINCT cutoff) > 1 THEN 'cutoff' END, CASE WHEN count(DISTINCT level) > 1 THEN 'level' END) AS differing
 FROM cand GROUP BY chain_id, item, period, metric HAVING min(value) <> max(value)) GROUP BY differing""")
def differing_dimensions(t: Tables):
    varies = lambda c: F.when(F.min(c) != F.max(c), F.lit(c))
    g = candidates(t).groupBy("chain_id", "item", "period", "metric").agg(
        F.concat_ws(",", varies("source"), varies("sheet"), varies("cutoff"), varies("level")).alias("differing"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    return g.filter("lo <> hi").groupBy("differing").agg(F.count(F.lit(1)).alias("n_keys"))
