"""The fourteen per-series forecast models as JVM expressions.

Every recurrence is one left-to-right scan over a series that keeps the state
after each month, so the forecast of *any* origin is a lookup and a rolling
backtest costs one pass per model instead of one pass per origin. A series is
bounded by the calendar; Spark parallelises over series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STEPS = 12

# Published model names, in registry order (the order breaks ties).
MODEL_NAMES = [
    "Naive", "Naive estacional", "Media móvil 3", "Media móvil 6", "Media móvil 12",
    "Media móvil ponderada", "SES", "Holt", "Holt-Winters", "Tendencia lineal",
    "Tendencia polinómica", "Croston", "SBA", "TSB",
]
# Months of history each model needs.
REQUIREMENTS = {
    "Naive": 1, "Naive estacional": 12, "Media móvil 3": 3, "Media móvil 6": 6, "Media móvil 12": 12,
    "Media móvil ponderada": 3, "SES": 1, "Holt": 3, "Holt-Winters": 24, "Tendencia lineal": 3,
    "Tendencia polinómica": 4, "Croston": 1, "SBA": 1, "TSB": 1,
}
# Models tried on intermittent demand.
INTERMITTENT_MODELS = ["Naive", "Media móvil 3", "SES", "Croston", "SBA", "TSB"]


def ses_states(alpha: str = "0.35D", v: str = "values") -> Column:
    return F.expr(
        f"aggregate(slice({v}, 2, size({v})), array({v}[0]), "
        f"(s, x) -> concat(s, array({alpha} * x + (1D - {alpha}) * element_at(s, -1))))"
    )


def holt_states(alpha: str = "0.35D", beta: str = "0.15D", v: str = "values") -> Column:
    return F.expr(
        f"""aggregate(slice({v}, 2, size({v})),
              array(named_struct('level', {v}[0], 'trend', try_element_at({v}, 2) - {v}[0])),
              (s, x) -> concat(s, transform(
                array(named_struct('p', element_at(s, -1), 'l',
                  {alpha} * x + (1D - {alpha}) * (element_at(s, -1).level + element_at(s, -1).trend))),
                q -> named_struct('level', q.l, 'trend', {beta} * (q.l - q.p.level) + (1D - {beta}) * q.p.trend))))"""
    )


def holt_winters_states(alpha: str = "0.3D", beta: str = "0.1D", gamma: str = "0.2D", v: str = "values") -> Column:
    """State after k months at position k+1; null under two full years."""
    mean = "aggregate(slice({v}, {a}, 12), 0D, (a, x) -> a + x) / 12D"
    first, second = mean.format(v=v, a=1), mean.format(v=v, a=13)
    return F.expr(
        f"""if(size({v}) >= 24, aggregate(
              transform({v}, (x, i) -> named_struct('x', x, 'slot', cast(i % 12 as int))),
              transform(array({first}), m -> named_struct('level', m, 'trend', ({second} - m) / 12D,
                'seasonal', transform(slice({v}, 1, 12), x -> x - m))),
              (s, p) -> concat(s, transform(
                array(named_struct('q', element_at(s, -1), 'l',
                  {alpha} * (p.x - element_at(s, -1).seasonal[p.slot])
                  + (1D - {alpha}) * (element_at(s, -1).level + element_at(s, -1).trend))),
                t -> named_struct('level', t.l, 'trend', {beta} * (t.l - t.q.level) + (1D - {beta}) * t.q.trend,
                  'seasonal', transform(t.q.seasonal, (c, j) ->
                     if(j = p.slot, {gamma} * (p.x - t.l) + (1D - {gamma}) * c, c)))))), null)"""
    )


def intermittent_states(alpha: str = "0.1D", beta: str = "0.1D", v: str = "values") -> Column:
    """Demand size, interval, running gap and demand probability after each month."""
    return F.expr(
        f"""slice(aggregate(
              transform({v}, (x, i) -> named_struct('x', x, 'pos', cast(i + 1 as double))),
              array(named_struct('seen', false, 'size', 0D, 'interval', 0D, 'gap', 1D, 'p', 0D)),
              (s, e) -> concat(s, transform(array(element_at(s, -1)), q -> named_struct(
                'seen', q.seen or e.x > 0,
                'size', case when not q.seen then if(e.x > 0, e.x, 0D)
                             when e.x > 0 then {alpha} * e.x + (1D - {alpha}) * q.size else q.size end,
                'interval', case when not q.seen then if(e.x > 0, e.pos, 0D)
                             when e.x > 0 then {beta} * q.gap + (1D - {beta}) * q.interval else q.interval end,
                'gap', if(not q.seen or e.x > 0, 1D, q.gap + 1D),
                'p', case when not q.seen then if(e.x > 0, 1D / e.pos, 0D)
                          else {beta} * if(e.x > 0, 1D, 0D) + (1D - {beta}) * q.p end)))),
            2, size({v}))"""
    )


def power_sums(v: str = "values") -> Column:
    """Running sums of y, xy and x²y with x counted from zero."""
    return F.expr(
        f"""slice(aggregate(
              transform({v}, (x, i) -> named_struct('y', x, 'x', cast(i as double))),
              array(named_struct('sy', 0D, 'sxy', 0D, 'sxxy', 0D)),
              (s, e) -> concat(s, array(named_struct(
                'sy', element_at(s, -1).sy + e.y, 'sxy', element_at(s, -1).sxy + e.x * e.y,
                'sxxy', element_at(s, -1).sxxy + e.x * e.x * e.y)))),
            2, size({v}))"""
    )


def _moving(width: int, step: str) -> Column:
    """Recursive average: each forecast joins the window of the next one."""
    return F.expr(
        f"""if(origin >= {width}, slice(aggregate(sequence(1, {STEPS}), slice(tail, -{width}, {width}),
              (b, i) -> concat(b, array({step}))), {width + 1}, {STEPS}), null)"""
    )


def moving_average(width: int) -> Column:
    return _moving(width, f"aggregate(slice(b, -{width}, {width}), 0D, (a, x) -> a + x) / {width}D")


def weighted_moving_average() -> Column:
    return _moving(3, "0.2D * element_at(b, -3) + 0.3D * element_at(b, -2) + 0.5D * element_at(b, -1)")


def _flat(value: str) -> Column:
    return F.expr(f"array_repeat({value}, {STEPS})")


def _trend(kind: str) -> Column:
    n = "cast(origin as double)"
    sx, sxx = f"({n} * ({n} - 1D) / 2D)", f"(({n} - 1D) * {n} * (2D * {n} - 1D) / 6D)"
    if kind == "linear":
        slope = f"(({n} * sums.sxy - {sx} * sums.sy) / ({n} * {sxx} - {sx} * {sx}))"
        return F.expr(
            f"if(origin >= 3, transform(array({slope}), b -> transform(sequence(1, {STEPS}), h -> "
            f"(sums.sy - b * {sx}) / {n} + b * ({n} + h - 1)))[0], null)"
        )
    sx3 = f"({sx} * {sx})"
    sx4 = f"(({n} - 1D) * {n} * (2D * {n} - 1D) * (3D * {n} * {n} - 3D * {n} - 1D) / 30D)"
    moments = f"named_struct('n', {n}, 's1', {sx}, 's2', {sxx}, 's3', {sx3}, 's4', {sx4})"
    det = "(m.n * (m.s2 * m.s4 - m.s3 * m.s3) - m.s1 * (m.s1 * m.s4 - m.s3 * m.s2) + m.s2 * (m.s1 * m.s3 - m.s2 * m.s2))"
    a = "(sums.sy * (m.s2 * m.s4 - m.s3 * m.s3) - m.s1 * (sums.sxy * m.s4 - m.s3 * sums.sxxy) + m.s2 * (sums.sxy * m.s3 - m.s2 * sums.sxxy))"
    b = "(m.n * (sums.sxy * m.s4 - m.s3 * sums.sxxy) - sums.sy * (m.s1 * m.s4 - m.s3 * m.s2) + m.s2 * (m.s1 * sums.sxxy - sums.sxy * m.s2))"
    c = "(m.n * (m.s2 * sums.sxxy - sums.sxy * m.s3) - m.s1 * (m.s1 * sums.sxxy - sums.sxy * m.s2) + sums.sy * (m.s1 * m.s3 - m.s2 * m.s2))"
    return F.expr(
        f"""if(origin >= 4, transform(transform(array({moments}), m ->
              named_struct('n', m.n, 'a', {a} / {det}, 'b', {b} / {det}, 'c', {c} / {det})),
              k -> transform(sequence(1, {STEPS}), h ->
                k.a + k.b * (k.n + h - 1) + k.c * (k.n + h - 1) * (k.n + h - 1)))[0], null)"""
    )




def model_paths() -> dict[str, Column]:
    demand = "if(demand.seen, demand.size / greatest(demand.interval, 1e-9D), 0D)"
    return {
        "Naive": _flat("element_at(tail, -1)"),
        "Naive estacional": F.expr(
            f"if(origin >= 12, transform(sequence(1, {STEPS}), h -> element_at(tail, (h - 1) % 12 + 1)), null)"
        ),
        "Media móvil 3": moving_average(3),
        "Media móvil 6": moving_average(6),
        "Media móvil 12": moving_average(12),
        "Media móvil ponderada": weighted_moving_average(),
        "SES": _flat("level"),
        "Holt": F.expr(f"if(origin >= 3, transform(sequence(1, {STEPS}), h -> holt.level + holt.trend * h), null)"),
        "Holt-Winters": F.expr(
            f"if(origin >= 24, transform(sequence(1, {STEPS}), h -> "
            "hw.level + hw.trend * h + hw.seasonal[cast((origin + h - 1) % 12 as int)]), null)"
        ),
        "Tendencia lineal": _trend("linear"),
        "Tendencia polinómica": _trend("quadratic"),
        "Croston": _flat(demand),
        "SBA": _flat(f"{demand} * 0.95D"),
        "TSB": _flat("if(demand.seen, demand.p * demand.size, 0D)"),
    }


# What each state column costs, the field that carries it at an origin, and the models that read it.
STATES = {
    "level": (ses_states, "{s}[o - 1]", ("SES",)), "holt": (holt_states, "{s}[o - 1]", ("Holt",)),
    "hw": (holt_winters_states, "if({s} is not null, {s}[o], null)", ("Holt-Winters",)),
    "demand": (intermittent_states, "{s}[o - 1]", ("Croston", "SBA", "TSB")),
    "sums": (power_sums, "{s}[o - 1]", ("Tendencia lineal", "Tendencia polinómica")),
}


def prefix_states(
    series: DataFrame, keys: list[str], origins: str = "sequence(1, size(values))", extra: list[str] | None = None,
    models: list[str] | None = None,
) -> DataFrame:
    """One row per series and origin (months of history): the states that the models need and the months that follow."""
    needed = [n for n, (_, _, users) in STATES.items() if models is None or set(users) & set(models)]
    scanned = series.select(
        *keys, "values", "periods", *[c for c in (extra or []) if c != "values"], *[STATES[n][0]().alias(f"{n}_s") for n in needed],
    )
    fields = "".join(f", '{n}', {STATES[n][1].format(s=f'{n}_s')}" for n in needed)
    return scanned.select(
        *keys, F.size("values").alias("n"), *[c for c in (extra or []) if c != "positions"],
        F.expr(
            f"""inline(transform({origins}, o -> named_struct(
                'origin', o, 'origin_period', periods[o - 1], 'ahead', slice(values, o + 1, 12),
                'tail', slice(values, greatest(o - 11, 1), least(o, 12)){fields})))"""
        ),
    )


def forecast_paths(
    series: DataFrame,
    keys: list[str],
    origins: str = "sequence(1, size(values))",
    models: list[str] | None = None,
    allowed: str | None = None,
) -> DataFrame:
    """Long rows (keys, origin, model, path): twelve raw steps per origin and model.

    `allowed` names an array column of model names; other models are not computed.
    """
    extra = [allowed] if allowed else []
    states = prefix_states(series, keys, origins, extra, models)
    paths = model_paths()
    names = models or MODEL_NAMES

    def path(name: str) -> Column:
        return F.when(F.array_contains(allowed, name), paths[name]) if allowed else paths[name]

    return (
        states.select(
            *keys, "n", "origin", "origin_period", "ahead",
            F.inline(F.array(*[F.struct(F.lit(n).alias("model"), path(n).alias("path")) for n in names])),
        )
        .filter(F.col("path").isNotNull())
    )


LAST_ORIGIN = "array(size(values))"


def classify(series: DataFrame, keys: list[str]) -> DataFrame:
    """Demand class and its diagnostics from a series' value array."""
    v = F.col("values")
    n = F.size(v)
    npos = F.size(F.filter(v, lambda x: x > 0))

    def total(arr):
        return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)

    base = series.select(
        *keys, "values", n.cast("double").alias("n"), npos.alias("n_pos"), total(v).alias("sum"),
        F.expr("aggregate(values, 0D, (a, x) -> a + x * x)").alias("sum_sq"),
        F.expr(
            "aggregate(transform(values, (x, i) -> (i + 1) * x), 0D, (a, x) -> a + x)"
        ).alias("sum_xy"),
        F.when(n >= 24, F.expr("slice(values, 13, size(values))")).alias("later"),
        F.when(n >= 24, F.expr("slice(values, 1, size(values) - 12)")).alias("earlier"),
    )
    mean = "aggregate({a}, 0D, (s, x) -> s + x) / size({a})"
    centred = base.withColumns(
        {"mean_later": F.expr(mean.format(a="later")), "mean_earlier": F.expr(mean.format(a="earlier"))}
    )
    spread = "aggregate({a}, 0D, (s, x) -> s + (x - mean_{a}) * (x - mean_{a}))"
    count, sum_x, sum_xx = F.col("n"), F.expr("n * (n + 1D) / 2D"), F.expr("n * (n + 1D) * (2D * n + 1D) / 6D")
    slope = (count * F.col("sum_xy") - sum_x * F.col("sum")) / (count * sum_xx - sum_x * sum_x)
    stats = centred.withColumns(
        {
            "adi": F.when(F.col("n_pos") > 0, F.col("n") / F.col("n_pos")),
            "cv2": F.when(
                F.col("n_pos") > 1,
                (F.col("n_pos") * F.col("sum_sq") - F.col("sum") * F.col("sum")) / (F.col("sum") * F.col("sum")),
            ).otherwise(0.0),
            "trend_strength": F.when(
                (F.col("sum") > 0) & (F.col("n") > 4), F.abs(slope) / (F.col("sum") / F.col("n"))
            ).otherwise(0.0),
            "seasonal_corr": F.coalesce(
                F.try_divide(
                    F.expr(
                        "aggregate(zip_with(later, earlier, (x, y) -> (x - mean_later) * (y - mean_earlier)), 0D, (a, x) -> a + x)"
                    ),
                    F.sqrt(F.expr(spread.format(a="later")) * F.expr(spread.format(a="earlier"))),
                ),
                F.lit(0.0),
            ),
        }
    )
    # Demand class names and their thresholds.
    demand_class = (
        F.when((F.col("n_pos") == 0) | (F.col("adi") >= 3.0), "Altamente intermitente")
        .when(F.col("adi") >= 1.32, "Intermitente")
        .when((F.col("seasonal_corr") >= 0.55) & (F.col("trend_strength") < 0.03), "Estacional")
        .when(F.col("trend_strength") >= 0.035, "Tendencia")
        .when(F.col("cv2") >= 0.49, "Irregular")
        .otherwise("Regular")
    )
    return stats.select(
        *keys, "values", F.col("n").cast("int").alias("n"), demand_class.alias("demand_class"),
        F.coalesce("adi", F.lit(999.0)).alias("adi"), "cv2", "trend_strength", "seasonal_corr",
    )


# Smoothing grids per model family, in search order.
GRIDS: dict[str, list[dict[str, float]]] = {
    "SES": [{"alpha": a} for a in (0.15, 0.35, 0.65, 0.85)],
    "Holt-Winters": [{"alpha": a, "beta": b, "gamma": g} for a in (0.2, 0.5) for b in (0.1, 0.3) for g in (0.1, 0.3)],
    **{
        name: [{"alpha": a, "beta": b} for a in (0.2, 0.5, 0.8) for b in (0.1, 0.3)]
        for name in ("Holt", "Croston", "SBA", "TSB")
    },
}


def _one_step(name: str) -> str:
    """Forecast of the next month from the state after o months, with columns alpha, beta, gamma."""
    demand = "if(s[o - 1].seen, s[o - 1].size / greatest(s[o - 1].interval, 1e-9D), 0D)"
    return {
        "SES": "s[o - 1]",
        "Holt": "if(o >= 3, s[o - 1].level + s[o - 1].trend, null)",
        "Holt-Winters": "if(o >= 24, s[o].level + s[o].trend + s[o].seasonal[cast(o % 12 as int)], null)",
        "Croston": demand,
        "SBA": f"{demand} * (1D - beta / 2D)",
        "TSB": "if(s[o - 1].seen, s[o - 1].p * s[o - 1].size, 0D)",
    }[name]


def tune(series: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Smoothing parameters with the least one-step error over the last five months of the series."""
    states = {
        "SES": lambda: ses_states("alpha"),
        "Holt": lambda: holt_states("alpha", "beta"),
        "Holt-Winters": lambda: holt_winters_states("alpha", "beta", "gamma"),
    }.get(name, lambda: intermittent_states("alpha", "beta"))
    grid = F.array(
        *[
            F.struct(F.lit(i).alias("g"), *[F.lit(v).alias(k) for k, v in params.items()])
            for i, params in enumerate(GRIDS[name])
        ]
    )
    fields = list(GRIDS[name][0])
    tried = series.filter(F.size("values") > 6).select(*keys, "values", F.inline(grid))
    scanned = tried.select(*keys, "values", "g", *fields, states().alias("s"))
    errors = F.expr(
        "filter(transform(sequence(greatest(6, size(values) - 5), size(values) - 1), o -> "
        f"abs(values[o] - greatest(0D, {_one_step(name)}))), e -> e is not null)"
        if name != "Holt-Winters"
        else "if(s is null, array(), filter(transform(sequence(greatest(6, size(values) - 5), size(values) - 1), o -> "
        f"if(o >= 24, abs(values[o] - greatest(0D, {_one_step(name)})), null)), e -> e is not null))"
    )
    scored = scanned.withColumn("errors", errors).filter(F.size("errors") > 0).withColumn(
        "mae", F.expr("aggregate(errors, 0D, (a, e) -> a + e) / size(errors)")
    )
    return scored.groupBy(*keys).agg(
        F.min_by(F.struct(*fields), F.struct("mae", "g")).alias("params"), F.min("mae").alias("mae")
    )


def tuned_paths(series: DataFrame, tuned: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, path: twelve raw steps after the last month, with the parameters that `tune` chose for each series."""
    fields = list(GRIDS[name][0])
    rows = series.join(tuned.select(*keys, *[F.col(f"params.{f}").alias(f) for f in fields]), keys)
    demand = "if(s[size(s) - 1].seen, s[size(s) - 1].size / greatest(s[size(s) - 1].interval, 1e-9D), 0D)"
    states, step = {
        "SES": (lambda: ses_states("alpha"), "element_at(s, -1)"),
        "Holt": (lambda: holt_states("alpha", "beta"), "element_at(s, -1).level + element_at(s, -1).trend * h"),
        "Holt-Winters": (
            lambda: holt_winters_states("alpha", "beta", "gamma"),
            "element_at(s, -1).level + element_at(s, -1).trend * h + element_at(s, -1).seasonal[cast((size(values) + h - 1) % 12 as int)]"),
        "Croston": (lambda: intermittent_states("alpha", "beta"), demand),
        "SBA": (lambda: intermittent_states("alpha", "beta"), f"{demand} * (1D - beta / 2D)"),
        "TSB": (lambda: intermittent_states("alpha", "beta"), "if(element_at(s, -1).seen, element_at(s, -1).p * element_at(s, -1).size, 0D)"),
    }[name]
    scanned = rows.select(*keys, "values", *fields, states().alias("s")).filter(F.size("values") >= REQUIREMENTS[name])
    return scanned.select(*keys, F.expr(f"transform(sequence(1, {STEPS}), h -> {step})").alias("path"))
