"""Launch forecasts from comparable products.

Targets that share chain, category, term set and age share their peers and their
backtest, so everything expensive is done once per such group, never per pair of
products. A group has at most twelve peers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from monthmill.functions.numbers import rounded

MAX_PEERS, MIN_PEERS, MIN_MONTHS, MAX_AGE = 12, 3, 18, 5
MAX_BIAS_DETERIORATION = 5.0
STEPS = 12
SCOPE = ["chain_id", "category_id"]


def level(values: Column) -> Column:
    """Mean of the last three values, at least one; one without values."""
    tail = F.slice(values, F.greatest(F.size(values) - 2, F.lit(1)), F.lit(3))
    mean = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail)
    return F.when(F.size(values) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), mean))


def median(values: Column) -> Column:
    """Median of a short array."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    return (F.get(ordered, ((n - 1) / 2).cast("int")) + F.get(ordered, (n / 2).cast("int"))) / 2


def target_groups(targets: DataFrame) -> DataFrame:
    """Distinct (scope, terms, age) with an id; targets carry chain_id, category_id, terms, values."""
    keyed = targets.withColumn("age", F.size("values")).withColumn("term_key", F.array_join(F.array_sort("terms"), " "))
    return keyed.withColumn("group_id", F.sha2(F.concat_ws("|", *SCOPE, "term_key", F.col("age").cast("string")), 256))


def select_peers(groups: DataFrame, peers: DataFrame) -> DataFrame:
    """At most twelve peers per group: by shared terms, then id; without terms when fewer than three share one.

    Peers with the same term set in a scope rank the same but for their id, so
    only the twelve smallest ids of each term set can ever be chosen. What is
    joined is term sets that share a term, not products with products. Every
    target age here is below the peers' minimum history, so ages share peers.
    """
    g = groups.select("group_id", *SCOPE, "term_key", "terms", "age").dropDuplicates(["group_id"])
    sigs = g.select(*SCOPE, "term_key", "terms").dropDuplicates([*SCOPE, "term_key"])
    p = peers.filter(F.size("values") >= max(MIN_MONTHS, MAX_AGE + STEPS)).select(
        *SCOPE, F.col("product_id").alias("peer_id"), F.array_sort("terms").alias("peer_terms"), F.col("values").alias("history")
    )
    per_set = Window.partitionBy(*SCOPE, "peer_terms").orderBy("peer_id")
    usable = p.select(*SCOPE, "peer_id", "peer_terms").withColumn("pos", F.row_number().over(per_set)).filter(F.col("pos") <= MAX_PEERS)
    sets = usable.groupBy(*SCOPE, "peer_terms").agg(F.sort_array(F.collect_list("peer_id")).alias("ids"))
    by_term = sets.select(*SCOPE, "ids", F.explode("peer_terms").alias("term"))
    key = [*SCOPE, "term_key"]
    shared = (
        sigs.select(*key, F.explode("terms").alias("term")).join(by_term, [*SCOPE, "term"])
        .select(*key, F.explode("ids").alias("peer_id"))
        .groupBy(*key, "peer_id").agg(F.count(F.lit(1)).alias("similarity"))
    )
    order = Window.partitionBy(*key).orderBy(F.desc("similarity"), "peer_id")
    best = shared.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MAX_PEERS)
    enough = best.filter(F.col("rank") == MIN_PEERS).select(*key)
    chosen = best.join(enough, key, "left_semi")
    # fallback: the related ones, then the smallest ids of the scope
    open_sigs = sigs.select(*key).join(enough, key, "left_anti")
    scope_order = Window.partitionBy(*SCOPE).orderBy("peer_id")
    smallest = p.select(*SCOPE, "peer_id").withColumn("pos", F.row_number().over(scope_order)).filter(F.col("pos") <= MAX_PEERS).drop("pos")
    few = best.join(enough, key, "left_anti").select(*key, "peer_id", "similarity")
    filled = (
        open_sigs.join(smallest, SCOPE).select(*key, "peer_id", F.lit(0).cast("bigint").alias("similarity")).unionByName(few)
        .groupBy(*key, "peer_id").agg(F.max("similarity").alias("similarity"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MAX_PEERS)
    )
    picked = chosen.select(*key, "peer_id", "similarity", "rank").unionByName(filled.select(*key, "peer_id", "similarity", "rank"))
    with_history = picked.join(p.select(*SCOPE, "peer_id", "history"), [*SCOPE, "peer_id"])
    return g.select("group_id", *key, "age").join(with_history, key).drop("term_key")


def peer_ratios(picked: DataFrame) -> DataFrame:
    """Per group, peer and step: the peer's value, its level at that age and their ratio; at age 0 the level is one."""
    prefix = F.slice("history", F.lit(1), F.col("age"))
    leveled = picked.withColumn("peer_level", level(prefix))
    return leveled.select(
        "group_id", "peer_id", "age", "peer_level",
        F.posexplode(F.slice("history", F.col("age") + 1, F.lit(STEPS))).alias("pos", "actual"),
    ).select("group_id", "peer_id", "age", "peer_level", (F.col("pos") + 1).alias("step"), "actual", (F.col("actual") / F.col("peer_level")).alias("ratio"))


def leave_one_out(ratios: DataFrame) -> DataFrame:
    """WAPE and bias of both methods and the typical ratio per step, each peer against the others.

    With history: the level times the others' mean ratio (the sum minus the held-out peer), against the flat level.
    Without: the others' median month, against their flat median first month. A group has at most twelve peers.
    """
    w, group = Window.partitionBy("group_id", "step"), Window.partitionBy("group_id")
    n, total = F.count(F.lit(1)).over(w), F.sum("ratio").over(w)
    one = F.struct("peer_id", F.col("ratio").alias("v"))
    held = ratios.withColumns(
        {"n": n, "total": total, "month": F.collect_list(one).over(w), "launch": F.collect_list(F.when(F.col("step") == 1, one)).over(group)}
    ).filter("n >= 3")

    def others(values: str) -> Column:
        return median(F.transform(F.filter(values, lambda x: x["peer_id"] != F.col("peer_id")), lambda x: x["v"]))

    new = F.col("age") == 0
    held = held.withColumns({
        "analog": F.when(new, others("month")).otherwise(F.col("peer_level") * (F.col("total") - F.col("ratio")) / (F.col("n") - 1)),
        "flat": F.when(new, others("launch")).otherwise(F.col("peer_level")),
        "mean_ratio": F.when(new, median(F.col("month.v"))).otherwise(F.col("total") / F.col("n")),
    })
    a = F.sum("actual")

    def rates(pred: str, prefix: str) -> list[Column]:
        e = F.col(pred) - F.col("actual")
        return [
            rounded(F.when(a > 0, 100 * F.sum(F.abs(e)) / a), 2).alias(f"{prefix}_wape"),
            rounded(F.when(a > 0, 100 * F.sum(e) / a), 2).alias(f"{prefix}_bias"),
        ]

    return held.groupBy("group_id").agg(
        *rates("analog", "analog"), *rates("flat", "baseline"), F.count_if(F.col("step") == 1).alias("peers"),
        F.array(*[F.max(F.when(F.col("step") == h, F.col("mean_ratio"))) for h in range(1, STEPS + 1)]).alias("curve"),
    )


def choose_method(scores: DataFrame) -> DataFrame:
    safe = F.abs("analog_bias") <= F.abs("baseline_bias") + MAX_BIAS_DETERIORATION
    better = F.col("analog_wape") < F.col("baseline_wape")
    return scores.withColumn("model", F.when(safe & better, "analog").otherwise("baseline"))


def launch_forecasts(targets: DataFrame, peers: DataFrame) -> DataFrame:
    """Twelve provisional months per target: level times the peers' typical ratio, or a flat level.

    A target without history has level one and the peers' months for ratios; its flat level is their first month.
    """
    grouped = target_groups(targets.filter(F.size("values") <= MAX_AGE))
    ratios = peer_ratios(select_peers(grouped, peers))
    method = choose_method(leave_one_out(ratios)).select("group_id", "model", "peers", "analog_wape", "baseline_wape", "curve")
    rows = grouped.drop("terms").withColumn("target_level", level(F.col("values"))).drop("values")
    rows = rows.join(method, "group_id").withColumn(
        "flat", F.when(F.col("age") == 0, F.col("curve")[0]).otherwise(F.col("target_level"))
    )
    steps = rows.select("*", F.posexplode("curve").alias("pos", "ratio"))
    out = steps.withColumn("step", F.col("pos") + 1).drop("curve", "pos")
    return out.withColumn(
        "forecast", F.when(F.col("model") == "analog", F.col("target_level") * F.col("ratio")).otherwise(F.col("flat"))
    )
