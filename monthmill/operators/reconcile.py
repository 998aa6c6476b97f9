"""Conflicting source claims -> one decision per fact key.

Every step is a grouped aggregate with map-side combine over
(key, cutoff, source) -> (key, cutoff) -> key. Nothing collects the claims of a
key: the only array kept is one value per snapshot cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from monthmill.operators.intervals import matches
from monthmill.operators.skew import lookup
from monthmill.session import cut_lineage

KEY = ["chain_id", "product", "period", "metric"]


def identity_bridge(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Item -> UPC over all periods and per observed period."""
    known = candidates.filter(F.col("upc").isNotNull())
    overall = known.groupBy("chain_id", "item").agg(F.min("upc").alias("only_upc"), F.count_distinct("upc").alias("n_upc"))
    by_period = known.groupBy("chain_id", "item", "period").agg(
        F.min("upc").alias("period_upc"), F.count_distinct("upc").alias("n_period_upc")
    )
    return overall, by_period


def canonical_product(candidates: DataFrame) -> DataFrame:
    """Adds `product` and `ambiguous`; a UPC is never extrapolated beyond its observed months."""
    overall, by_period = identity_bridge(candidates)
    joined = lookup(candidates, overall, ["chain_id", "item"], "left").join(by_period, ["chain_id", "item", "period"], "left")
    several = F.col("upc").isNull() & (F.col("n_upc") > 1)
    product = (
        F.when(F.col("upc").isNotNull(), F.col("upc")).when(F.col("n_upc") == 1, F.col("only_upc"))
        .when(several & (F.col("n_period_upc") == 1), F.col("period_upc")).when(several, F.lit(None)).otherwise(F.col("item"))
    )
    return joined.withColumn("product", product).withColumn("ambiguous", F.coalesce(several & F.col("product").isNull(), F.lit(False))).drop(
        "only_upc", "n_upc", "period_upc", "n_period_upc"
    )


def row_exclusions(rows: DataFrame) -> DataFrame:
    """Adds `reason` for rows that never reach value comparison (null otherwise)."""
    reason = (
        F.when(~F.col("fact_eligible"), "WRONG_GRAIN_EXCLUDED")
        .when(F.col("formula") | (F.col("level") == "D"), "FORMULA_UNVERIFIED")
        .when(F.col("literal_class") == "MISSING", "MISSING")
        .when(F.col("literal_class") == "INVALID", "INVALID_VALUE")
        .when(F.col("ambiguous"), "ITEM_ONLY_AMBIGUOUS")
        .when(F.col("product").isNull(), "INSUFFICIENT_EVIDENCE")
    )
    return rows.withColumn("reason", reason)


def activation(rows: DataFrame) -> DataFrame:
    """First month with a positive direct value per product."""
    positive = F.when((F.col("level") == "A") & (F.col("value") > 0), F.col("period"))
    return rows.groupBy("chain_id", "product").agg(F.min(positive).alias("first_active"))


def zero_exclusions(rows: DataFrame) -> DataFrame:
    """Zeros before the first sale are not demand; zeros of a never-active product are unproven."""
    joined = lookup(rows, activation(rows), ["chain_id", "product"])
    start = F.col("first_active")
    zero = F.col("value") == 0
    return joined.withColumn(
        "reason", F.when(zero & start.isNull(), "UNPROVEN_ZERO").when(zero & (F.col("period") < start), "PRE_LAUNCH_ZERO")
    ).drop("first_active")


def resolve(rows: DataFrame) -> DataFrame:
    """One decision per key."""
    v = F.col("value")
    direct = (F.col("level") == "A") & ~F.col("formula")
    primary = direct & (F.col("role") == "PRIMARY")
    sets = {"d": direct, "p": primary}

    def span(prefix: str, cond: Column) -> list[Column]:
        inside = F.when(cond, v)
        stable = F.when(cond, F.struct("source", "sheet"))
        return [
            F.min(inside).alias(f"{prefix}_min"), F.max(inside).alias(f"{prefix}_max"), F.count(inside).alias(f"{prefix}_n"),
            F.min_by(inside, stable).alias(f"{prefix}_first"),
            F.min(stable).alias(f"{prefix}_locator"),
            F.count_if(cond & F.col("sequence").isNull()).alias(f"{prefix}_unproven"),
            F.min(F.when(cond, F.col("sequence"))).alias(f"{prefix}_seq_lo"), F.max(F.when(cond, F.col("sequence"))).alias(f"{prefix}_seq_hi"),
        ]

    by_source = rows.groupBy(*KEY, "cutoff", "source").agg(
        *[c for p, cond in sets.items() for c in span(p, cond)],
        F.count_if(direct & ~F.col("role").isin("PRIMARY", "SECONDARY_CONTROL")).alias("others"),
        F.count(F.lit(1)).alias("n"), F.min(v).alias("all_min"), F.max(v).alias("all_max"),
    )

    def merged(p: str, conflict: Column) -> list[Column]:
        return [
            F.min(f"{p}_min").alias(f"{p}_min"), F.max(f"{p}_max").alias(f"{p}_max"), F.sum(f"{p}_n").alias(f"{p}_n"),
            F.min_by(f"{p}_first", f"{p}_locator").alias(f"{p}_first"), F.min(f"{p}_locator").alias(f"{p}_locator"),
            F.sum(f"{p}_unproven").alias(f"{p}_unproven"), F.min(f"{p}_seq_lo").alias(f"{p}_seq_lo"), F.max(f"{p}_seq_hi").alias(f"{p}_seq_hi"),
            F.max(conflict).alias(f"{p}_internal"),
        ]

    common = [
        F.sum("others").alias("others"), F.sum("n").alias("n"), F.min("all_min").alias("all_min"), F.max("all_max").alias("all_max"),
    ]
    differs = lambda p: F.coalesce(F.col(f"{p}_min") < F.col(f"{p}_max"), F.lit(False))
    by_cutoff = by_source.groupBy(*KEY, "cutoff").agg(*[c for p in sets for c in merged(p, differs(p))], *common)
    by_key = by_cutoff.groupBy(*KEY).agg(
        *[c for p in sets for c in merged(p, F.col(f"{p}_internal"))],
        *[F.max(differs(p)).alias(f"{p}_snapshot") for p in sets],
        *[
            F.array_sort(F.collect_list(F.when(F.col(f"{p}_n") > 0, F.struct("cutoff", F.col(f"{p}_first").alias("value"))))).alias(f"{p}_by_cutoff")
            for p in sets
        ],
        *common,
    )
    authority = (F.col("p_n") > 0) & (F.col("others") == 0)
    fields = ["min", "max", "first", "unproven", "seq_lo", "seq_hi", "internal", "snapshot", "by_cutoff"]
    eff = by_key.select(
        *KEY, "n", "d_n", "all_min", "all_max", authority.alias("authority"),
        *[F.when(authority, F.col(f"p_{f}")).otherwise(F.col(f"d_{f}")).alias(f) for f in fields],
    )
    single = F.col("min") == F.col("max")
    uneven = (F.col("all_min") != F.col("min")) | (F.col("all_max") != F.col("min"))
    safe = (F.col("unproven") == 0) & (F.col("seq_lo") == F.col("seq_hi"))
    reason = (
        F.when(F.col("d_n") == 0, "INSUFFICIENT_EVIDENCE").when(F.col("internal"), "INTERNAL_SOURCE_DUPLICATE")
        .when(single & uneven & F.col("authority"), "SOURCE_AUTHORITY").when(single & uneven, "DIRECT_VS_SUMMARY")
        .when(single & (F.col("n") > 1), "EQUIVALENT_DUPLICATE").when(single & (F.col("min") == 0), "CONFIRMED_ZERO")
        .when(single, "DIRECT_FACT").when(F.col("snapshot"), "SAME_SNAPSHOT_CONFLICT").when(safe, "VALIDATED_REVISION")
        .otherwise("CROSS_SOURCE_CONFLICT")
    )
    changes = F.expr(
        "size(filter(transform(by_cutoff, (x, i) -> i = 0 or x.value <> by_cutoff[greatest(i - 1, 0)].value), c -> c))"
    )
    out = eff.withColumn("reason", reason)
    blocked = F.col("reason").isin("INTERNAL_SOURCE_DUPLICATE", "SAME_SNAPSHOT_CONFLICT", "CROSS_SOURCE_CONFLICT")
    revised = F.col("reason") == "VALIDATED_REVISION"
    fact = ~blocked & (F.col("reason") != "INSUFFICIENT_EVIDENCE")
    return out.select(
        *KEY, "reason", classification(F.col("reason")).alias("classification"), blocked.alias("blocking"), F.col("n").alias("claims"),
        F.when(revised, F.element_at("by_cutoff", -1)["value"]).when(fact, F.col("first")).alias("value"),
        F.when(revised, changes).when(fact, 1).alias("version_no"),
    )


def classification(reason: Column) -> Column:
    return (
        F.when(reason.isin("INTERNAL_SOURCE_DUPLICATE", "SAME_SNAPSHOT_CONFLICT", "CROSS_SOURCE_CONFLICT"), "VALUE_BLOCKED")
        .when(reason == "ITEM_ONLY_AMBIGUOUS", "IDENTITY_BLOCKED").when(reason == "VALIDATED_REVISION", "RESOLVABLE_AS_REVISION")
        .when(
            reason.isin("SOURCE_AUTHORITY", "DIRECT_VS_SUMMARY", "EQUIVALENT_DUPLICATE", "CONFIRMED_ZERO", "DIRECT_FACT"), "AUTO_RESOLVABLE"
        )
        .otherwise("EXCLUDED_NON_FACT")
    )


def ledger(candidates: DataFrame) -> DataFrame:
    """Excluded rows and resolved keys in one table. The rows of either check are read several times, so they are written."""
    checked = cut_lineage(row_exclusions(canonical_product(candidates)))
    excluded = checked.filter(F.col("reason").isNotNull())
    zeros = cut_lineage(zero_exclusions(checked.filter(F.col("reason").isNull())))
    excluded_zero = zeros.filter(F.col("reason").isNotNull())
    resolved = resolve(zeros.filter(F.col("reason").isNull()))
    shape = lambda d: d.select(
        "chain_id", F.coalesce("product", "item").alias("product"), "period", "metric", "reason",
        classification(F.col("reason")).alias("classification"), (F.col("reason") == "ITEM_ONLY_AMBIGUOUS").alias("blocking"),
        F.lit(1).cast("bigint").alias("claims"),
    )
    return shape(excluded).unionByName(shape(excluded_zero)).unionByName(resolved, allowMissingColumns=True)


def simple_reconcile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Conflict when values differ, else the latest non-formula claim."""
    order = F.struct(F.col("cutoff"), ~F.col("formula"), F.col("source"), F.col("sheet"))
    g = rows.groupBy(*keys).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("claims"),
        F.max_by(F.struct("source", "sheet"), order).alias("w"),
    )
    conflict = F.col("lo") != F.col("hi")
    return g.select(
        *keys, conflict.alias("conflict"), "claims", F.when(~conflict, F.col("lo")).alias("value"),
        F.when(~conflict, F.col("w.source")).alias("source"), F.when(~conflict, F.col("w.sheet")).alias("sheet"),
    )


def pareto(clusters: DataFrame, count: str, thresholds: tuple[int, ...] = (80, 90, 95, 100)) -> DataFrame:
    """How many of the largest clusters cover each share of all members.

    Clusters of equal size are interchangeable, so the running sum runs over the
    distinct sizes: with n members there are at most about sqrt(2n) of them.
    """
    sizes = cut_lineage(clusters.groupBy(F.col(count).alias("size")).agg(F.count(F.lit(1)).alias("k")))
    # running sums in blocks of sizes, so that no task orders all of them
    block = F.floor(F.log2(F.col("size").cast("double")) * 8)
    tagged = sizes.withColumn("block", block).withColumn("members", F.col("size") * F.col("k"))
    blocks = tagged.groupBy("block").agg(F.sum("members").alias("bm"), F.sum("k").alias("bk"))
    w = Window.orderBy(F.desc("block"))
    offsets = blocks.select(
        "block", (F.sum("bm").over(w) - F.col("bm")).alias("m0"), (F.sum("bk").over(w) - F.col("bk")).alias("k0"),
        F.sum("bm").over(Window.partitionBy()).alias("total"),
    )
    inner = Window.partitionBy("block").orderBy(F.desc("size"))
    running = tagged.join(offsets, "block").select(
        "size", "k", "total", (F.col("m0") + F.sum("members").over(inner) - F.col("members")).alias("before"),
        (F.col("k0") + F.sum("k").over(inner) - F.col("k")).alias("rank0"), "members",
    )
    need = F.ceil((F.col("total") * F.col("threshold") / 100 - F.col("before")) / F.col("size"))
    return (
        running.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
        .filter((F.col("before") + F.col("members")) * 100 >= F.col("total") * F.col("threshold"))
        .groupBy("threshold")
        .agg(F.min(F.col("rank0") + F.greatest(F.lit(1), need)).alias("clusters"))
    )


def compare_keys(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """equal / changed / missing / new per key of two fact sets."""
    a = left.select(*keys, F.col(value).alias("old"), F.lit(True).alias("in_old"))
    b = right.select(*keys, F.col(value).alias("new"), F.lit(True).alias("in_new"))
    status = (
        F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "missing")
        .when(F.col("old").eqNullSafe(F.col("new")), "equal").otherwise("changed")
    )
    return a.join(b, keys, "full").withColumn("status", status).drop("in_old", "in_new")


def classify_incoming(incoming: DataFrame, accepted: DataFrame, backlog: DataFrame, keys: list[str]) -> DataFrame:
    """NEW / SAME / REVISION / CONFLICT / RESOLVES_BACKLOG; `reviewed` marks approved changes."""
    known = accepted.select(*keys, F.col("value").alias("accepted_value"), F.lit(True).alias("known"))
    pending = backlog.select(*keys).distinct().withColumn("pending", F.lit(True))
    joined = incoming.join(known, keys, "left").join(pending, keys, "left")
    reviewed = F.when(F.col("reviewed"), F.when(F.col("pending"), "RESOLVES_BACKLOG").otherwise("REVISION")).otherwise("CONFLICT")
    kind = (
        F.when(F.col("pending"), reviewed).when(F.col("known").isNull(), "NEW")
        .when(F.col("value") == F.col("accepted_value"), "SAME").otherwise(reviewed)
    )
    return joined.withColumn("kind", kind)


# Routing of rows to commercial units ----------------------------------------------------

def route_memberships(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Unit and identity of each row from memberships observed in the same source and month.

    rows: source, item, upc (nullable), period, explicit_unit (nullable).
    members: source, item, upc (nullable), unit, period.
    """
    def summary(keys: list[str], prefix: str) -> DataFrame:
        return members.groupBy(*keys).agg(
            F.count_distinct("unit").alias(f"{prefix}_units"), F.min("unit").alias(f"{prefix}_unit"),
            F.count_distinct("upc").alias(f"{prefix}_upcs"), F.min("upc").alias(f"{prefix}_upc"),
        )

    by_item = summary(["source", "item", "period"], "i")
    # rows without a code match nothing; a key of their item keeps them from meeting in one task
    by_upc = summary(["source", "upc", "period"], "u").filter(F.col("upc").isNotNull()).withColumnRenamed("upc", "_upc")
    coded = rows.withColumn("_upc", F.coalesce("upc", F.concat(F.lit("\0"), F.coalesce(F.col("item").cast("string"), F.lit("")))))
    in_unit = (
        members.groupBy("source", "item", "period", F.col("unit").alias("explicit_unit"))
        .agg(F.count_distinct("upc").alias("e_upcs"), F.min("upc").alias("e_upc"))
    )
    known = members.filter(F.col("upc").isNotNull()).select(F.col("unit").alias("final_unit"), "item").distinct().withColumn("known", F.lit(True))
    j = (
        coded.join(by_item, ["source", "item", "period"], "left").join(by_upc, ["source", "_upc", "period"], "left")
        .join(in_unit, ["source", "item", "period", "explicit_unit"], "left")
    )
    has_upc, explicit = F.col("upc").isNotNull(), F.col("explicit_unit").isNotNull()
    units = F.coalesce(F.when(has_upc, F.col("u_units")).otherwise(F.col("i_units")), F.lit(0))
    unit = F.when(has_upc, F.col("u_unit")).otherwise(F.col("i_unit"))
    j = j.withColumn("final_unit", F.when(explicit, F.col("explicit_unit")).when(units == 1, unit)).withColumn("units", units)
    options = F.coalesce(F.when(explicit, F.col("e_upcs")).otherwise(F.col("i_upcs")), F.lit(0))
    option = F.when(explicit, F.col("e_upc")).otherwise(F.col("i_upc"))
    j = j.join(known, ["final_unit", "item"], "left")
    unsure = F.col("final_unit").isNotNull() & ~has_upc & ((options > 1) | ((options == 0) & F.col("known").isNotNull()))
    resolution = (
        F.when(unsure, "INSUFFICIENT_IDENTITY").when(explicit, "RESOLVED_EXPLICIT_ROW_CHAIN")
        .when(F.col("units") > 1, "MULTIPLE_COMMERCIAL_MEMBERSHIP").when(F.col("units") == 1, "RESOLVED_UNIQUE_ITEM_UPC")
        .otherwise("NO_COMMERCIAL_MEMBERSHIP")
    )
    return j.select(
        *rows.columns, F.when(~unsure, F.col("final_unit")).alias("unit"),
        F.coalesce("upc", F.when((options == 1) & F.col("final_unit").isNotNull(), option)).alias("mapped_upc"),
        resolution.alias("resolution"),
    )


def apply_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Interval rules (source, metric, valid_from..valid_to): matched rule and how many overlap.

    Rules meet the distinct months of a source and metric through their interval nodes; the outcome, one row for each
    of these, is then looked up by the rows. Rows without a rule are kept; overlaps are counted for a guard.
    """
    keys = ["source", "metric"]
    per_month = matches(rows, rules, keys, "period", "valid_from", "valid_to").groupBy(*keys, "period").agg(
        F.count(F.lit(1)).alias("matches"), F.min("rule_id").alias("rule_id"), F.min("authority_role").alias("authority_role")
    )
    return rows.join(per_month, [*keys, "period"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
