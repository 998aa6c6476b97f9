"""Catalogue texts, facets, dimension joins and classifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthmill.functions import periods as pr
from monthmill.operators import catalogue as cat, versions as vs
from monthmill.plans.registry import query
from monthmill.plans.sql_parts import BASE, r, with_, ym
from monthmill.sources.tables import Tables

RULES = cat.Rules(
    types=["ring", "widget", "bolt", "gear", "gizmo", "plate", "anvil", "rod"],
    leading=["ring", "widget", "bolt", "gear", "gizmo", "plate", "anvil", "rod"],
    presentations={"GRANDE": ["GRANDE", "GDE"], "MEDIANO": ["MEDIANO"]},
    unresolved=["MEDIUM"],
    colours=["red", "blue", "dark red"],
    suffix_stop=["COLD"],
)
NOUNS = "RING|WIDGET|BOLT|GEAR|GIZMO|PLATE|ANVIL|ROD"

# Descriptions in the shape of a retail catalogue, built from the part table.
DESC_SQL = f"""
dsc AS (SELECT p_partkey, p_brand, p_type, p_size, p_name, split_part(p_name, ' ', 2) || ' ' || p_type || CASE p_size % 3 WHEN 0 THEN ' ' || p_size || ' x ' || (p_size + 10) || ' cm' WHEN 1 THEN ' Grande' ELSE ' mediano gde' END
   || CASE WHEN p_size = 50 THEN ' (SS24)' ELSE '' END || ' ' || split_part(p_name, ' ', 1) AS description FROM part),
prep AS (SELECT *, upper(description) AS k, list_sort(list_distinct(list_concat(list_filter([CASE WHEN regexp_matches(upper(description), '\\b(GRANDE|GDE)\\b') THEN 'GRANDE' END, CASE WHEN regexp_matches(upper(description), '\\bMEDIANO\\b') THEN 'MEDIANO' END], lambda x: x IS NOT NULL),
   regexp_extract_all(upper(description), '[0-9]+ X [0-9]+ CM')))) AS pres,
   trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(description), '[0-9]+ X [0-9]+ CM', ' ', 'g'), '\\b(GRANDE|GDE|MEDIANO)\\b', ' ', 'g'), '^(({NOUNS})\\b\\s*)+', ''), '\\s+', ' ', 'g')) AS cleaned FROM dsc),
prb AS (SELECT *, list_filter([CASE WHEN contains(k, '(') THEN 'LEGACY_OR_PARENTHETICAL_NAME' END, CASE WHEN len(pres) > 1 THEN 'MULTIPLE_PRESENTATION_LITERALS' END, CASE WHEN regexp_matches(k, 'SS[0-9][0-9]') THEN 'SEASON_CODE_UNVALIDATED' END,
   CASE WHEN regexp_matches(k, '\\bMEDIUM\\b') THEN 'UNRESOLVED_ABBREVIATION' END], lambda x: x IS NOT NULL) AS problems FROM prep)
"""
DESC = with_(DESC_SQL)


def descriptions(t: Tables):
    adjective, noun = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    size = F.col("p_size")
    shape = (
        F.when(size % 3 == 0, F.concat(F.lit(" "), size.cast("string"), F.lit(" x "), (size + 10).cast("string"), F.lit(" cm")))
        .when(size % 3 == 1, " Grande").otherwise(" mediano gde")
    )
    season = F.when(size == 50, " (SS24)").otherwise("")
    text = F.concat(noun, F.lit(" "), "p_type", shape, season, F.lit(" "), adjective)
    return t.read("part").select("p_partkey", "p_brand", "p_type", "p_size", "p_name", text.alias("description"))


def prepared(t: Tables):
    d = F.col("description")
    return descriptions(t).withColumns(
        {
            "cleaned": cat.cleaned(d, RULES), "presentations": cat.presentations(d, RULES), "problems": cat.problems(d, RULES),
            "type": cat.product_type(d, F.col("p_name"), RULES),
        }
    )


@query("p22_product_type", DESC + f"SELECT p_partkey, regexp_extract(k, '\\b({NOUNS})\\b', 1) AS product_type FROM prep")
def product_type(t: Tables):
    return prepared(t).select("p_partkey", F.col("type").alias("product_type"))


@query("p23_presentations", DESC + "SELECT p_partkey, list_aggregate(pres, 'string_agg', ',') AS presentations FROM prep")
def presentations(t: Tables):
    return prepared(t).select("p_partkey", F.array_join("presentations", ",").alias("presentations"))


@query("p24_leading_words", DESC + "SELECT p_partkey, cleaned FROM prep")
def leading_words(t: Tables):
    return prepared(t).select("p_partkey", "cleaned")


@query("p25_quality_flags", DESC + "SELECT p_partkey, coalesce(list_aggregate(problems, 'string_agg', ','), '') AS problems FROM prb")
def quality_flags(t: Tables):
    return prepared(t).select("p_partkey", F.array_join("problems", ",").alias("problems"))


@query("p26_colour_suffix", DESC + """
SELECT p_partkey, CASE WHEN regexp_matches(cleaned, '.+ (RED|BLUE)$') THEN regexp_replace(cleaned, ' (RED|BLUE)$', '') END AS model, CASE WHEN regexp_matches(cleaned, '.+ (RED|BLUE)$') THEN regexp_extract(cleaned, '(RED|BLUE)$', 1) END AS colour FROM prep""")
def colour_suffix(t: Tables):
    model, colour = cat.split_colour(F.col("cleaned"), RULES.colours)
    return prepared(t).select("p_partkey", model.alias("model"), colour.alias("colour"))


LEARN_SQL = """
tx AS (SELECT cleaned, min(len(problems)) AS np, min(len(list_filter(problems, lambda x: x <> 'MULTIPLE_PRESENTATION_LITERALS'))) AS nb FROM prb GROUP BY cleaned),
mdl AS (SELECT DISTINCT regexp_replace(cleaned, ' (RED|BLUE)$', '') AS model FROM tx WHERE nb = 0 AND regexp_matches(cleaned, '.+ (RED|BLUE)$')),
okm AS (SELECT model FROM mdl WHERE NOT regexp_matches(model, '[0-9()/]')),
sfx AS (SELECT cleaned, arg_max(trim(substr(cleaned, length(model) + 1)), length(model)) AS s FROM tx JOIN okm ON starts_with(cleaned, model || ' ') WHERE np = 0 GROUP BY cleaned),
lrn AS (SELECT 'RED' AS colour, 'SEED' AS source UNION ALL SELECT 'BLUE', 'SEED' UNION ALL SELECT DISTINCT s, 'CORPUS_CONTRAST' FROM sfx WHERE s NOT IN ('RED', 'BLUE') AND NOT regexp_matches(s, '[0-9()/]') AND NOT regexp_matches(s, '\\b(COLD|MEDIUM)\\b') AND len(string_split(s, ' ')) <= 4)
"""


def colours(t: Tables):
    texts = prepared(t).select(
        "cleaned", F.size("problems").alias("n_problems"), F.size(F.array_remove("problems", "MULTIPLE_PRESENTATION_LITERALS")).alias("n_barred")
    )
    # seed colours are those that occur as an adjective of a part name
    seeds = t.read("part").select(F.upper(F.split("p_name", " ")[0]).alias("colour")).filter(F.col("colour").isin("RED", "BLUE")).distinct()
    return cat.learn_colours(texts, seeds, RULES)


@query("q14_learned_colours", with_(DESC_SQL, LEARN_SQL) + "SELECT colour, source FROM lrn")
def learned_colours(t: Tables):
    return colours(t).select("colour", "source")


PROP_SQL = """
spl AS (SELECT b.p_partkey, arg_max(l.colour, length(l.colour)) AS colour FROM prb b JOIN lrn l ON ends_with(b.cleaned, ' ' || l.colour) GROUP BY b.p_partkey),
prop AS (SELECT b.p_partkey, regexp_extract(k, '\\b(RING|WIDGET|BOLT|GEAR|GIZMO|PLATE|ANVIL|ROD)\\b', 1) AS product_type, CASE WHEN s.colour IS NOT NULL THEN substr(cleaned, 1, length(cleaned) - length(s.colour) - 1) END AS model, s.colour,
   CASE WHEN len(pres) = 1 THEN pres[1] END AS size, concat_ws(',', CASE WHEN len(problems) > 0 THEN list_aggregate(problems, 'string_agg', ',') END, CASE WHEN s.colour IS NULL THEN 'COLOUR_UNKNOWN' END) AS reasons, p_brand, b.p_size FROM prb b LEFT JOIN spl s USING (p_partkey))
"""
PROP = with_(DESC_SQL, LEARN_SQL, PROP_SQL)


def proposals(t: Tables):
    base = prepared(t)
    split = cat.split_colour_by(base.select("cleaned").distinct(), colours(t))
    joined = base.join(split, "cleaned", "left")
    reasons = F.concat_ws(",", F.array_join("problems", ","), F.when(F.col("colour").isNull(), "COLOUR_UNKNOWN"))
    reasons = F.regexp_replace(reasons, "^,", "")
    return joined.select(
        "p_partkey", F.col("type").alias("product_type"), "model", "colour", F.when(F.size("presentations") == 1, F.col("presentations")[0]).alias("size"),
        reasons.alias("reasons"), "p_brand", "p_size",
    )


@query("q15_classification_proposal", PROP + "SELECT p_partkey, product_type, model, colour, size, reasons FROM prop")
def classification_proposal(t: Tables):
    return proposals(t).select("p_partkey", "product_type", "model", "colour", "size", "reasons")


@query("q16_display_merge", PROP + """
SELECT p_partkey, CASE WHEN p_size > 25 THEN 'APPROVED' ELSE 'PROPOSED' END AS status, CASE WHEN p_size > 25 THEN upper(p_brand) ELSE coalesce(model, '?') END AS model, substr(sha256(CASE WHEN p_size > 25 THEN upper(p_brand) ELSE coalesce(model, '?') END), 1, 16) AS model_id FROM prop""")
def display_merge(t: Tables):
    approved = t.read("part").filter("p_size > 25").select("p_partkey", F.upper("p_brand").alias("approved_model"))
    model = F.coalesce("approved_model", "model", F.lit("?"))
    return proposals(t).join(approved, "p_partkey", "left").select(
        "p_partkey", F.when(F.col("approved_model").isNotNull(), "APPROVED").otherwise("PROPOSED").alias("status"), model.alias("model"),
        F.substring(F.sha2(model, 256), 1, 16).alias("model_id"),
    )


@query("g43_catalogue_inventory", PROP + """
SELECT 'model' AS field, coalesce(model, '?') AS label, count(*) AS products, count(DISTINCT p_brand) AS brands FROM prop GROUP BY 2
UNION ALL SELECT 'reason', reason, count(*), count(DISTINCT p_brand) FROM (SELECT p_brand, unnest(string_split(reasons, ',')) AS reason FROM prop WHERE reasons <> '') GROUP BY 2""")
def catalogue_inventory(t: Tables):
    p = proposals(t)
    labels = p.select(F.lit("model").alias("field"), F.coalesce("model", F.lit("?")).alias("label"), "p_brand")
    reasons = p.filter("reasons <> ''").select(F.lit("reason").alias("field"), F.explode(F.split("reasons", ",")).alias("label"), "p_brand")
    return labels.unionByName(reasons).groupBy("field", "label").agg(F.count(F.lit(1)).alias("products"), F.count_distinct("p_brand").alias("brands"))


@query("g44_identifier_collisions", """
SELECT kind, value, count(DISTINCT p_partkey) AS products FROM (SELECT p_partkey, 'code' AS kind, CAST(p_partkey % 997 AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'name', p_name || '/' || p_brand FROM part) GROUP BY ALL HAVING count(DISTINCT p_partkey) > 1""")
def identifier_collisions(t: Tables):
    ids = t.read("part").select(
        "p_partkey", (F.col("p_partkey") % 997).cast("string").alias("code"), F.concat_ws("/", "p_name", "p_brand").alias("name")
    )
    return ids.unpivot("p_partkey", ["code", "name"], "kind", "value").groupBy("kind", "value").agg(
        F.count_distinct("p_partkey").alias("products")
    ).filter("products > 1")


@query("p18_attribute_value", PROP + """
SELECT p_partkey, coalesce(model, '__UNKNOWN__') AS model, CASE WHEN colour IS NOT NULL THEN colour WHEN p_size % 2 = 0 THEN '__NOT_APPLICABLE__' ELSE '__UNKNOWN__' END AS colour FROM prop""")
def attribute_value(t: Tables):
    na = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("colour")))
    return proposals(t).select(
        "p_partkey", cat.attribute(F.col("model"), "model", na).alias("model"), cat.attribute(F.col("colour"), "colour", na).alias("colour")
    )


def facets(t: Tables):
    return proposals(t).withColumn("status", F.when(F.col("p_size") > 25, "APPROVED").otherwise("PROPOSED"))


@query("p19_facet_filter", PROP + "SELECT p_partkey FROM prop WHERE product_type IN ('RING', 'BOLT') AND size = 'GRANDE'")
def facet_filter(t: Tables):
    return facets(t).filter(cat.facet_match({"product_type": ["RING", "BOLT"], "size": "GRANDE", "colour": None})).select("p_partkey")


@query("g34_facet_counts", PROP + """
SELECT product_type AS option, count(*) AS products, bool_or(p_size <= 25) AS pending, list_aggregate(list_sort(list(DISTINCT CASE WHEN p_size > 25 THEN 'APPROVED' ELSE 'PROPOSED' END)), 'string_agg', ',') AS statuses FROM prop WHERE size = 'GRANDE' GROUP BY ALL""")
def facet_counts(t: Tables):
    return cat.facet_options(facets(t), "product_type", {"product_type": ["RING"], "size": "GRANDE"})


@query("p20_catalogue_search", """
SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type, CAST(p_partkey AS VARCHAR))), 'ring')""")
def catalogue_search(t: Tables):
    text = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_partkey").cast("string")))
    return t.read("part").filter(F.contains(text, F.lit("ring"))).select("p_partkey")


@query("g33_model_coverage", with_(BASE, DESC_SQL, LEARN_SQL, PROP_SQL) + """
SELECT coalesce(model, '?') AS model, count(*) AS total, count(c.part_id) AS calculated, count(*) - count(c.part_id) AS pending, count(d.part_id) AS decided, count(*) - count(d.part_id) AS undecided FROM prop
LEFT JOIN (SELECT DISTINCT part_id FROM lines WHERE o_orderstatus = 'F' AND l_returnflag = 'A' AND qty > 40) c ON c.part_id = p_partkey LEFT JOIN (SELECT DISTINCT part_id FROM lines WHERE o_orderstatus = 'P' AND qty > 48) d ON d.part_id = p_partkey GROUP BY 1""")
def model_coverage(t: Tables):
    mark = lambda cond, name: t.lines.filter(cond).select(F.col("part_id").alias("p_partkey")).distinct().withColumn(name, F.lit(True))
    calc = mark("o_orderstatus = 'F' AND l_returnflag = 'A' AND qty > 40", "calc")
    done = mark("o_orderstatus = 'P' AND qty > 48", "done")
    rows = proposals(t).join(calc, "p_partkey", "left").join(done, "p_partkey", "left")
    n, c, d = F.count(F.lit(1)), F.count("calc"), F.count("done")
    return rows.groupBy(F.coalesce("model", F.lit("?")).alias("model")).agg(
        n.alias("total"), c.alias("calculated"), (n - c).alias("pending"), d.alias("decided"), (n - d).alias("undecided")
    )


# Dimension joins ----------------------------------------------------------------------------

@query("j01_fact_dimensions", """
SELECT c_mktsegment AS chain_id, p_brand AS product_id, count(*) AS n_lines, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus IN ('F', 'P') GROUP BY ALL""")
def fact_dimensions(t: Tables):
    return t.lines.filter(F.col("o_orderstatus").isin("F", "P")).groupBy("chain_id", "product_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("qty").alias("qty"))


@query("w02_latest_imported", with_(BASE) + f"""
SELECT chain_id, product_id, {ym('ship_m')} AS period, l_orderkey AS version_no, qty AS value FROM lines WHERE o_orderstatus IN ('F', 'P')
QUALIFY row_number() OVER (PARTITION BY chain_id, product_id, ship_m ORDER BY l_orderkey DESC, l_linenumber DESC, qty DESC) = 1""")
def latest_imported(t: Tables):
    rows = t.lines.filter(F.col("o_orderstatus").isin("F", "P")).select("chain_id", "product_id", "ship_m", "l_orderkey", "l_linenumber", "qty")
    return vs.latest(rows, ["chain_id", "product_id", "ship_m"], ["l_orderkey", "l_linenumber", "qty"]).select(
        "chain_id", "product_id", pr.label("ship_m").alias("period"), F.col("l_orderkey").alias("version_no"), F.col("qty").alias("value")
    )


@query("j02_dimension_attach", """
SELECT status, count(*) AS n FROM (SELECT CASE WHEN n_nationkey IS NULL THEN 'scope_mismatch' ELSE 'attached' END AS status FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 4) ON c_nationkey = n_nationkey) GROUP BY status""")
def dimension_attach(t: Tables):
    nation = t.read("nation").filter("n_regionkey <> 4").select("n_nationkey")
    rows = t.read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy(F.when(F.col("n_nationkey").isNull(), "scope_mismatch").otherwise("attached").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("q04_lineage_consistency", """
SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphan_lines, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate) AS shipped_before_order, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphan_orders""")
def lineage_consistency(t: Tables):
    li, o, c = t.read("lineitem"), t.read("orders"), t.read("customer")
    tag = lambda df, n: df.select(F.lit(n).alias("k"))
    orphan = tag(li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"), "a")
    early = tag(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate < o_orderdate"), "b")
    lost = tag(o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "c")
    return orphan.unionByName(early).unionByName(lost).agg(
        F.count_if(F.col("k") == "a").alias("orphan_lines"), F.count_if(F.col("k") == "b").alias("shipped_before_order"), F.count_if(F.col("k") == "c").alias("orphan_orders")
    )


@query("w04_current_classification", with_(BASE) + """
SELECT p_partkey, c.l_orderkey AS classification_version, CASE WHEN c.part_id IS NULL THEN 'PENDING_CLASSIFICATION' WHEN c.snap IS DISTINCT FROM p_size THEN 'STALE' ELSE 'CURRENT' END AS status FROM part
LEFT JOIN (SELECT part_id, l_orderkey, CAST(qty AS INTEGER) AS snap FROM lines WHERE l_returnflag = 'A' AND o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, qty DESC) = 1) c ON c.part_id = p_partkey""")
def current_classification(t: Tables):
    rows = t.lines.filter("l_returnflag = 'A' AND o_orderstatus = 'F'").select("part_id", "l_orderkey", "l_shipdate", "l_linenumber", "qty")
    latest = vs.latest(rows, ["part_id"], ["l_shipdate", "l_orderkey", "l_linenumber", "qty"]).select("part_id", "l_orderkey", F.col("qty").cast("int").alias("snap"))
    j = t.read("part").join(latest, F.col("p_partkey") == F.col("part_id"), "left")
    status = F.when(F.col("part_id").isNull(), "PENDING_CLASSIFICATION").when(~F.col("snap").eqNullSafe(F.col("p_size")), "STALE").otherwise("CURRENT")
    return j.select("p_partkey", F.col("l_orderkey").alias("classification_version"), status.alias("status"))
