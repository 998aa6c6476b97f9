"""Small fixtures for versions, joins under skew, reconciliation, intake, pooled models and streams."""

import datetime as dt
import json
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthmill.operators import coldstart as cs, decisions as dc, hierarchy, pooled as po, quality as ql, reconcile as rc, versions as vs
from monthmill.operators.skew import lookup
from monthmill.sources import cells, monthly_files as mf
from monthmill.streaming import jobs


def ts(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_cutoff_filters_before_ranking(spark):
    rows = spark.createDataFrame(
        [(1, "a", ts(1), 5.0), (2, "a", ts(3), 6.0), (3, "a", ts(9), 7.0), (4, "b", None, 1.0)], "id long, k string, at timestamp, v double"
    )
    got = {r["id"]: r["status"] for r in vs.as_of(rows, ["k"], "id", "at", "id", F.lit(ts(5))).collect()}
    assert got == {1: "superseded_as_of_cutoff", 2: "selected", 3: "available_after_cutoff", 4: "availability_unknown"}


def test_change_log_crosses_chunks(spark):
    rows = spark.createDataFrame(
        [("a", i, v, i // 3) for i, v in enumerate([1.0, 1.0, 2.0, 2.0, 3.0, 3.0, 3.0, 1.0])], "k string, o int, v double, c int"
    )
    got = [(r["o"], r["previous"]) for r in vs.change_log(rows, ["k"], "o", "v", "c").orderBy("o").collect()]
    assert got == [(0, None), (2, 1.0), (4, 2.0), (7, 3.0)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_lookup_equals_join(spark, how):
    rows = spark.createDataFrame([("hot", i) for i in range(200)] + [("cold", 1), ("none", 2)], "k string, v int")
    table = spark.createDataFrame([("hot", "x"), ("cold", "y"), ("cold", "z")], "k string, t string")
    a = sorted(map(tuple, lookup(rows, table, ["k"], how).collect()), key=str)
    assert a == sorted(map(tuple, rows.join(table, ["k"], how).collect()), key=str)


def claim(**kw):
    base = dict(chain_id="C", item="I", upc="U", period=dt.date(2024, 1, 1), metric="SALES", source="S1", sheet="A", value=5.0, level="A",
                formula=False, role="", cutoff=1, sequence=None, literal_class="VALUE", fact_eligible=True)
    return {**base, **kw}


CLAIMS = ("chain_id string, item string, upc string, period date, metric string, source string, sheet string, value double, level string, "
          "formula boolean, role string, cutoff int, sequence string, literal_class string, fact_eligible boolean")


def decide(spark, claims):
    df = spark.createDataFrame(claims, CLAIMS).withColumn("product", F.col("upc"))
    return rc.resolve(df).first()


@pytest.mark.parametrize(
    "claims,reason,value,version",
    [
        ([claim()], "DIRECT_FACT", 5.0, 1),
        ([claim(value=0.0)], "CONFIRMED_ZERO", 0.0, 1),
        ([claim(), claim(source="S2")], "EQUIVALENT_DUPLICATE", 5.0, 1),
        ([claim(), claim(sheet="B", value=6.0)], "INTERNAL_SOURCE_DUPLICATE", None, None),
        ([claim(), claim(source="S2", value=6.0)], "SAME_SNAPSHOT_CONFLICT", None, None),
        ([claim(), claim(source="S2", value=6.0, cutoff=2)], "CROSS_SOURCE_CONFLICT", None, None),
        ([claim(sequence="Q"), claim(source="S2", value=6.0, cutoff=2, sequence="Q"), claim(source="S3", value=6.0, cutoff=3, sequence="Q")], "VALIDATED_REVISION", 6.0, 2),
        ([claim(level="C")], "INSUFFICIENT_EVIDENCE", None, None),
        ([claim(), claim(source="S2", level="C", value=9.0)], "DIRECT_VS_SUMMARY", 5.0, 1),
        ([claim(role="PRIMARY"), claim(source="S2", role="SECONDARY_CONTROL", value=8.0)], "SOURCE_AUTHORITY", 5.0, 1),
    ],
)
def test_resolution_ladder(spark, claims, reason, value, version):
    got = decide(spark, claims)
    assert (got["reason"], got["value"], got["version_no"]) == (reason, value, version)


def test_item_with_two_upcs_is_resolved_by_month_only(spark):
    jan, feb, mar = (dt.date(2024, m, 1) for m in (1, 2, 3))
    rows = [claim(upc="U0", period=jan), claim(upc="U1", period=feb), claim(upc=None, period=jan, source="S2"), claim(upc=None, period=mar, source="S2")]
    got = {(r["period"], r["source"]): (r["product"], r["ambiguous"]) for r in rc.canonical_product(spark.createDataFrame(rows, CLAIMS)).collect()}
    assert got[(jan, "S2")] == ("U0", False) and got[(mar, "S2")] == (None, True)


def test_pareto_against_brute_force(spark):
    sizes = [40, 25, 10, 10, 5, 5, 2, 1, 1, 1]
    got = {r["threshold"]: r["clusters"] for r in rc.pareto(spark.createDataFrame([(s,) for s in sizes], "n long"), "n").collect()}
    total, want = sum(sizes), {}
    for t in (80, 90, 95, 100):
        run = 0
        for i, s in enumerate(sorted(sizes, reverse=True), 1):
            run += s
            if run * 100 >= total * t:
                want[t] = i
                break
    assert got == want


def test_incoming_kinds(spark):
    inc = spark.createDataFrame([("a", 1.0, False), ("b", 2.0, False), ("c", 3.0, True), ("d", 3.0, False), ("e", 1.0, True)], "k string, value double, reviewed boolean")
    acc = spark.createDataFrame([("b", 2.0), ("c", 9.0), ("d", 9.0)], "k string, value double")
    got = {r["k"]: r["kind"] for r in rc.classify_incoming(inc, acc, spark.createDataFrame([("e",)], "k string"), ["k"]).collect()}
    assert got == {"a": "NEW", "b": "SAME", "c": "REVISION", "d": "CONFLICT", "e": "RESOLVES_BACKLOG"}


def test_leaves_and_cycles(spark):
    edges = spark.createDataFrame([("c1", "n1"), ("c2", "n1"), ("n1", "r"), ("n2", "r")], "scope string, parent string")
    sel = spark.createDataFrame([("c1",), ("n1",), ("n2",), ("r",)], "scope string")
    assert sorted(r[0] for r in hierarchy.leaf_scopes(edges, sel, 3).collect()) == ["c1", "n2"]
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "scope string, parent string")
    assert hierarchy.cycles(loop, loop.select("scope"), 3).count() == 2


def test_lookup_formula(spark):
    df = spark.createDataFrame([("=XLOOKUP(A7,'Base'!A:A,'Base'!C:C)",), ("=IFERROR(XLOOKUP(A7,'Base'!A:A,'Base'!D:D),0)",), ("=SUM(A:A)",)], "f string")
    got = [r[0] for r in df.select(cells.lookup_reference(F.col("f"))).collect()]
    assert [g and (g["sheet"], g["value_column"]) for g in got] == [("Base", "C"), ("Base", "D"), None]


def test_guard_raises(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(ql.RuleViolation):
        ql.require_none(ql.duplicate_keys(df, ["k"]), "duplicate")
    ql.require_none(ql.duplicate_keys(df, ["k", "v"]), "duplicate")


def test_adjustments(spark):
    df = spark.createDataFrame([("none", 9.0), ("absolute", 5.0), ("percentage", 10.0), ("final_value", 7.0)], "m string, v double")
    assert [r[0] for r in df.select(dc.adjusted_value(F.lit(100.0), F.col("m"), F.col("v"))).collect()] == pytest.approx([100.0, 105.0, 110.0, 7.0])


# Sources and sinks ------------------------------------------------------------------------

def test_csv_facts_keep_missing_apart_from_zero(spark):
    folder = tempfile.mkdtemp(prefix="monthmill-test-")
    text = "canonical_product_id,description,objective,period,value,is_missing,source_file,source_row\n" + "\n".join(
        ["p,x,Venta,2024-01,0,false,f,1", "p,x,Venta,2024-02, ,false,f,2", "p,x,Venta,2024-03,5,TRUE,f,3", "p,x,Venta,2024-04,5,false,f,4", "p,x,Venta,2024-04,6,false,f,5", "p,x,Pedido,2024-01,9,false,f,6"]
    )
    with open(f"{folder}/facts.csv", "w") as handle:
        handle.write(text)
    rows = mf.read_fact_csv(spark, f"{folder}/facts.csv").withColumn("n", F.col("source_row").cast("int"))
    got = {r["period"]: r["value"] for r in mf.normalise_facts(rows, F.lit("venta"), ["canonical_product_id", "period"], ["n"]).collect()}
    assert got == {"2024-01": 0.0, "2024-02": None, "2024-03": None, "2024-04": 6.0}


def test_append_is_idempotent_and_json_roundtrip(spark):
    folder = tempfile.mkdtemp(prefix="monthmill-test-")
    rows = spark.createDataFrame([(1, "2024-01", 5.0), (2, "2024-02", 6.0)], "id long, period string, v double")
    mf.append_new(rows, f"{folder}/facts", ["id"], ["period"])
    more = rows.union(spark.createDataFrame([(3, "2024-02", 7.0)], rows.schema))
    mf.append_new(more, f"{folder}/facts", ["id"], ["period"])
    stored = spark.read.parquet(f"{folder}/facts")
    assert sorted(r["id"] for r in stored.collect()) == [1, 2, 3]
    mf.write_json(rows, f"{folder}/json")
    assert spark.read.json(f"{folder}/json").count() == 2


def test_file_copies_are_found(spark):
    folder = tempfile.mkdtemp(prefix="monthmill-test-")
    for name, body in (("a.csv", "x"), ("b.csv", "x"), ("c.csv", "y")):
        with open(f"{folder}/{name}", "w") as handle:
            handle.write(body)
    got = sorted(r["copies"] for r in mf.distinct_files(mf.read_files(spark, folder), "content", "path").collect())
    assert got == [1, 2]


def test_stream_keeps_every_version_and_is_idempotent(spark):
    folder = tempfile.mkdtemp(prefix="monthmill-test-")
    schema = "id string, sku string, txt string, mon string, qty string"
    files = [
        [("1", "A1", "towel", "2024-01", "5"), ("2", "A1", "towel", "2024-02", "x"), ("3", "B2", "", "2024-01", "4"), ("4", "C3", "mat", "2024-01", "2")],
        [("5", "A1", "towel", "2024-03", "8")],
        [("6", "A1", "towel", "2024-01", "7"), ("7", "A1", "towel", "2024-01", "9")],  # a late correction, twice in one file
    ]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)
    profile = {"product_code": "sku", "description": "txt", "period": "mon", "sales": "qty"}
    want = [("A1", "2024-01", 1, 5.0), ("A1", "2024-01", 2, 7.0), ("A1", "2024-01", 3, 9.0), ("A1", "2024-03", 1, 8.0), ("C3", "2024-01", 1, 2.0)]
    for run in ("one", "two"):  # the second run replays the files from the start
        stream = jobs.file_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, per_trigger=1)
        jobs.ingest_monthly(stream, profile, f"{folder}/facts", f"{folder}/rejects-{run}", ["product_code", "period"], ["id"]).option(
            "checkpointLocation", f"{folder}/state-{run}"
        ).trigger(availableNow=True).start().awaitTermination()
        stored = spark.read.parquet(f"{folder}/facts").collect()
        assert sorted((r["product_code"], str(r["period"]), r["version_no"], r["sales"]) for r in stored) == want


def test_catalogue_with_accents_brands_and_overlaps(spark):
    from monthmill.operators import catalogue as ct

    rules = ct.Rules(
        types=["TOALLA", "BATA"], leading=["TOALLA", "BATA"], presentations={"MEDIO BAÑO": ["MEDIO BAÑO", "MB"], "BAÑO": ["BAÑO"]},
        unresolved=["GG"], colours=["AZUL", "ORQUÍDEA", "GRIS"], brands=["Casa Añil"], apparel=["BATA"], apparel_sizes=["GG", "CH"], descriptors=["DE BAÑO", "BAÑO"],
    )
    texts = ["TOALLA MEDIO BAÑO FLORES AZUL", "toalla casa añil baño rosas orquídea", "BATA DE BAÑO LISA GG GRIS", "TOALLA LISA GG GRIS", "TOALLA BAÑO 2010 x 90 cm LUNA AZUL"]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    d = F.col("d")
    model, colour = ct.split_colour(ct.cleaned(d, rules), rules.colours)
    got = [tuple(r) for r in df.select(ct.presentations(d, rules), model, colour, ct.problems(d, rules)).collect()]
    assert got == [
        (["MEDIO BAÑO"], "FLORES", "AZUL", []), (["BAÑO"], "ROSAS", "ORQUIDEA", []), (["GG"], "LISA", "GRIS", []),
        ([], "LISA GG", "GRIS", ["UNRESOLVED_ABBREVIATION"]), (["2010 X 90 CM", "BAÑO"], "LUNA", "AZUL", ["MULTIPLE_PRESENTATION_LITERALS"]),
    ]


def test_long_colours_are_found(spark):
    from monthmill.operators import catalogue as ct

    texts = spark.createDataFrame([("RIVERA AZUL MAR DEL SUR PROFUNDO",), ("RIVERA PROFUNDO",), ("SOLO",)], "cleaned string")
    colours = spark.createDataFrame([("AZUL MAR DEL SUR PROFUNDO",), ("PROFUNDO",)], "colour string")
    got = {r["cleaned"]: (r["model"], r["colour"]) for r in ct.split_colour_by(texts, colours).collect()}
    assert got == {
        "RIVERA AZUL MAR DEL SUR PROFUNDO": ("RIVERA", "AZUL MAR DEL SUR PROFUNDO"), "RIVERA PROFUNDO": ("RIVERA", "PROFUNDO"),
    }


def test_pairs_and_samples_cover_twelve_horizons():
    from monthmill.operators import pairs

    assert pairs.HORIZONS == po.HORIZONS == tuple(range(1, 13))


# Pooled models ------------------------------------------------------------------------------

def test_ridge_with_thousands_of_series(spark):
    """More one-hot columns than the normal equations take: each series' coefficient is its shrunken mean."""
    from pyspark.ml.linalg import Vectors

    n = po.NORMAL_WIDTH + 104
    rows = [(Vectors.sparse(n, {i: 1.0}), float(i % 5 + k)) for i in range(n) for k in (0, 1)]
    model = po.linear(spark.createDataFrame(rows, ["features", "label"]))
    want = {v: 2 * ((v + 0.5) - model.intercept) / (2 + po.RIDGE) for v in range(5)}
    assert all(abs(c - want[i % 5]) < 1e-3 for i, c in enumerate(model.coefficients))


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    y = 4 + x @ np.array([2.0, -1.0, 0.5]) + rng.normal(scale=0.1, size=60)
    design = np.column_stack((np.ones(60), x))
    penalty = np.eye(4) * po.RIDGE
    penalty[0, 0] = 0
    want = np.linalg.solve(design.T @ design + penalty, design.T @ y)
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(float(a), float(b), float(c), float(l)) for (a, b, c), l in zip(x, y)], "a double, b double, c double, label double")
    model = po.linear(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df))
    assert model.intercept == pytest.approx(want[0], abs=1e-6)
    assert list(model.coefficients) == pytest.approx(list(want[1:]), abs=1e-6)


def test_preprocessing_moments(spark):
    values = [1.0, None, 3.0, 10.0, None, 2.0]
    df = spark.createDataFrame([(v, 7.0) for v in values], "a double, b double")
    got = {r["feature"]: r for r in po.preprocessing_table(df, ["a", "b"]).collect()}
    filled = np.array([2.5 if v is None else v for v in values])
    assert got["a"]["median"] == 2.5
    assert got["a"]["mean"] == pytest.approx(filled.mean()) and got["a"]["std"] == pytest.approx(filled.std())
    assert got["b"]["std"] == 1.0


def test_folds_never_see_the_future(spark):
    months = [dt.date(2020 + i // 12, i % 12 + 1, 1) for i in range(30)]
    rows = [("c", f"p{p}", "k", i + 1, months[i], float(20 + 3 * p + i % 5)) for p in range(3) for i in range(30)]
    panel = spark.createDataFrame(rows, "chain_id string, product_id string, category_id string, idx int, period date, sales double")
    keys = ["chain_id", "product_id", "category_id"]

    def run(df):
        s, _ = po.encode_products(po.samples(df, keys, "sales", (1,)).withColumn("series_key", F.col("product_id")), "series_key")
        first = po.temporal_backtest(s, "linear", keys, last=2, horizons=(1,)).filter(F.col("target_period") == F.lit(months[28]))
        return {r["product_id"]: r["pred"] for r in first.collect()}

    changed = panel.withColumn("sales", F.when(F.col("period") >= months[28], 999.0).otherwise(F.col("sales")))
    a, b = run(panel), run(changed)
    assert a == pytest.approx(b)


# Cold start ------------------------------------------------------------------------------------

def test_cold_start_against_loops(spark):
    hist = {f"B{i}": [float(10 + i + (j * (i + 1)) % 7) for j in range(30)] for i in range(5)}
    words = {"B0": ["red", "ring"], "B1": ["red", "bolt"], "B2": ["blue", "ring"], "B3": ["cold", "gear"], "B4": ["red", "gear"]}
    peers = spark.createDataFrame([("c", "k", p, words[p], v) for p, v in hist.items()], "chain_id string, category_id string, product_id string, terms array<string>, values array<double>")
    targets = spark.createDataFrame(
        [("c", "k", "t1", ["red", "ring"], [4.0, 6.0]), ("c", "k", "t2", ["hot", "gear"], [3.0])], "chain_id string, category_id string, part_id string, terms array<string>, values array<double>"
    )
    groups = cs.target_groups(targets)
    ids = {r["term_key"]: r["group_id"] for r in groups.collect()}
    picked = {}
    for r in cs.select_peers(groups, peers).collect():
        picked.setdefault(r["group_id"], []).append((r["rank"], r["peer_id"]))
    assert [p for _, p in sorted(picked[ids["red ring"]])] == ["B0", "B1", "B2", "B4"]
    assert [p for _, p in sorted(picked[ids["gear hot"]])] == ["B3", "B4", "B0", "B1", "B2"]

    def lvl(v):
        return max(1.0, sum(v[-3:]) / len(v[-3:]))

    for part, terms, own in (("t1", ["B0", "B1", "B2", "B4"], [4.0, 6.0]), ("t2", list(hist), [3.0])):
        age = len(own)
        actual, analog, base = [], [], []
        for held in terms:
            others = [p for p in terms if p != held]
            for h in range(12):
                ratio = sum(hist[p][age + h] / lvl(hist[p][:age]) for p in others) / len(others)
                actual.append(hist[held][age + h])
                analog.append(lvl(hist[held][:age]) * ratio)
                base.append(lvl(hist[held][:age]))
        wape = lambda f: round(100 * sum(abs(x - y) for x, y in zip(actual, f)) / sum(actual), 2)
        row = [r for r in cs.launch_forecasts(targets, peers).collect() if r["part_id"] == part]
        assert len(row) == 12
        assert row[0]["analog_wape"] == pytest.approx(wape(analog), abs=0.011) and row[0]["baseline_wape"] == pytest.approx(wape(base), abs=0.011)


def test_cold_start_without_history(spark):
    hist = {f"B{i}": [float(10 * (i + 1) + (j * (i + 2)) % 9) for j in range(30)] for i in range(4)}
    kind = "chain_id string, category_id string, {} string, terms array<string>, values array<double>"
    peers = spark.createDataFrame([("c", "k", p, ["red"], v) for p, v in hist.items()], kind.format("product_id"))
    rows = cs.launch_forecasts(spark.createDataFrame([("c", "k", "new", ["red"], [])], kind.format("part_id")), peers).collect()
    actual, analog, base = [], [], []
    for held in hist:
        rest = [v for p, v in hist.items() if p != held]
        for h in range(12):
            actual.append(hist[held][h])
            analog.append(float(np.median([v[h] for v in rest])))
            base.append(float(np.median([v[0] for v in rest])))
    wape = lambda f: 100 * sum(abs(a - b) for a, b in zip(actual, f)) / sum(actual)
    assert rows[0]["analog_wape"] == pytest.approx(wape(analog), abs=0.011) and rows[0]["baseline_wape"] == pytest.approx(wape(base), abs=0.011)
    curve = [float(np.median([v[h] for v in hist.values()])) for h in range(12)]
    want = curve if rows[0]["model"] == "analog" else [curve[0]] * 12
    assert [r["forecast"] for r in sorted(rows, key=lambda r: r["step"])] == pytest.approx(want)


def test_nested_document(spark):
    doc = json.dumps({"horizons": [{"horizon": 1, "value": 2.5}, {"horizon": 2, "value": None}]})
    df = spark.createDataFrame([("v1", doc)], "id string, d string")
    got = mf.explode_document(df, "d", "horizons array<struct<horizon int, value double>>", "horizons", ["id"]).collect()
    assert [(r["horizon"], r["value"]) for r in got] == [(1, 2.5), (2, None)]


def test_importance_names_products(spark):
    """A product that decides the label ranks first under its own name; shares are of all columns."""
    from pyspark.sql import functions as F

    from monthmill.operators import pooled

    raw = [(f"s{i % 6}", float(i % 7), None if i % 11 == 0 else float(i % 5), 100.0 if i % 6 == 4 else 1.0) for i in range(240)]
    rows = spark.createDataFrame(raw, "key string, u double, v double, label double")
    rows, _ = pooled.encode_products(rows, "key", keep_index=True)
    prep = pooled.fit_preprocessor(rows, ["u", "v"])
    assert prep.columns == ["z_u", "z_v", "m_u", "m_v"]
    data = pooled.assemble(rows, prep, ["series_vec"])
    for fit in (pooled.forest, pooled.boosting, pooled.linear):
        out = pooled.importance(fit(data), pooled.column_names(rows, ["u", "v"], "key")).orderBy(F.desc("importance"), "feature").collect()
        assert {r.feature for r in out} == {"u", "v", *[f"product:s{i}" for i in range(6)]}
        assert out[0].feature == "product:s4" and 0 < sum(r.importance for r in out) <= 1 + 1e-9


def test_late_versions_are_retracted(spark, tmp_path):
    """Files in any order, one late, one repeated, the stream stopped in between: sums equal those of the latest versions."""
    import random

    from monthmill.streaming import jobs

    rng = random.Random(4)
    kind = "scope string, fact string, ts timestamp, id long, cents long"
    rows = [(f"s{i % 3}", f"f{rng.randrange(12)}", dt.datetime(2024, 1, 1 + rng.randrange(20)), i, rng.randrange(1000)) for i in range(150)]
    newest, oldest = [r for r in rows if r[2].day > 12], [r for r in rows if r[2].day <= 5]
    middle = [r for r in rows if 5 < r[2].day <= 12]
    forecasts = spark.createDataFrame([("s0", 400), ("s1", 10)], "scope string, forecast long")  # s2 has none
    schema = spark.createDataFrame([], kind).schema

    def arrive(part):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def drain():
        stream = jobs.file_stream(spark, f"{tmp_path}/in", schema, per_trigger=1)
        writer = jobs.rescore(stream, ["scope", "fact"], "ts", "id", "cents", forecasts, ["scope"], "forecast", f"{tmp_path}/out")
        writer.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return {r["scope"]: (r["facts"], r["versions"], r["actual"], r["error"], r["bias"]) for r in jobs.scores(spark, f"{tmp_path}/out", ["scope"]).collect()}

    def batch(known):
        latest = {}
        for s, f, ts, i, cents in known:
            latest[s, f] = max(latest.get((s, f), (dt.datetime.min, -1, 0)), (ts, i, cents))
        out = {}
        for s, forecast in (("s0", 400), ("s1", 10)):
            v = [c for (x, _), (_, _, c) in latest.items() if x == s]
            out[s] = (len(v), sum(r[0] == s for r in known), sum(v), sum(abs(c - forecast) for c in v), sum(c - forecast for c in v))
        return out

    arrive(middle)
    assert drain() == batch(middle)
    arrive(newest)
    arrive(middle)  # the same file again
    assert drain() == batch(middle + newest)
    arrive(oldest)  # older than what is in force: nothing to retract, but versions count
    arrive(oldest)
    assert drain() == batch(rows)


def test_a_bucket_takes_all_versions_of_its_facts_at_once():
    """Three loads of one bucket, with null and repeated keys and versions of equal time, against a loop."""
    import random

    import pandas as pd

    from monthmill.streaming import jobs

    rng, keys = random.Random(8), ["scope", "fact"]
    empty = pd.DataFrame({"scope": pd.Series(dtype=str), "fact": pd.Series(dtype=str), "_at": pd.Series(dtype="datetime64[us]"), "_id": pd.Series(dtype="int64"), "_value": pd.Series(dtype="int64")})
    facts, seen = empty, pd.DataFrame({"_fact": pd.Series(dtype="int64"), "_id": pd.Series(dtype="int64")})
    best, ids = {}, set()
    for load in range(3):
        rows = [(rng.choice(["a", None]), rng.choice(["1", "2", "3", None]), dt.datetime(2024, 1, 1 + rng.randrange(4)), rng.randrange(60), 2 ** 60 + rng.randrange(9)) for _ in range(40)]
        facts, seen = jobs.unpacked(jobs.packed(facts)), jobs.unpacked(jobs.packed(seen))
        arrived = pd.DataFrame(rows, columns=empty.columns).astype({"_at": "datetime64[us]"})
        facts, seen, touched = jobs.take_versions(facts, seen, arrived, keys)
        before, added = dict(best), {}
        for scope, fact, at, number, value in rows:
            key = scope, fact
            if (key, number) not in ids:
                ids.add((key, number))
                added[key] = added.get(key, 0) + 1
                best[key] = max(best.get(key, (dt.datetime.min, -1, 0)), (at, number, value), key=lambda v: v[:2])
        none = lambda v: None if pd.isna(v) else v
        got = {(none(r.scope), none(r.fact)): (none(r.old), r.new, r.added) for r in touched.itertuples()}
        assert got == {k: (before[k][2] if k in before else None, best[k][2], n) for k, n in added.items()}
        assert len(facts) == len(best) and len(seen) == len(ids)
        assert not len(jobs.take_versions(facts, seen, arrived, keys)[2])


def test_interval_nodes_hold_every_month_once(spark):
    """Ranges of any length, open ends and empty ones: a month meets exactly the ranges that hold it, each once."""
    import random

    from monthmill.operators import intervals

    rng = random.Random(7)
    month = lambda i: dt.date(1990 + i // 12, i % 12 + 1, 1)
    ranges = []
    for i in range(300):
        a, b = rng.randrange(240), rng.randrange(240)
        ranges.append((f"k{i % 3}", i, None if i % 17 == 0 else month(min(a, b) if i % 11 else max(a, b)), None if i % 19 == 0 else month(max(a, b) if i % 11 else min(a, b))))
    df = spark.createDataFrame(ranges, "k string, rule long, valid_from date, valid_to date")
    points = spark.createDataFrame([(f"k{i % 4}", month(i)) for i in range(0, 240, 3)] * 2, "k string, period date")
    got = sorted((r["k"], r["period"], r["rule"]) for r in intervals.matches(points, df, ["k"], "period", "valid_from", "valid_to").collect())
    want = sorted({(k, p, rule) for k, p in ((r["k"], r["period"]) for r in points.collect()) for kk, rule, a, b in ranges
                   if k == kk and (a is None or a <= p) and (b is None or p <= b)})
    assert got == want and len(want) > 1000
    nodes = df.select(F.size(intervals.cover(F.col("valid_from"), F.col("valid_to"))).alias("n")).agg(F.max("n")).first()[0]
    assert nodes <= 2 * intervals.LEVELS


def test_many_rules_of_one_source_stay_linear(spark):
    """The join carries the matches and the nodes, not every pair of a month and a rule."""
    from monthmill.operators import intervals, reconcile

    month = lambda i: dt.date(1990 + i // 12, i % 12 + 1, 1)
    n = 10_000
    rules = spark.createDataFrame([("S", "M", f"R{i:05d}", month(i % 600), month(i % 600), "PRIMARY") for i in range(n)], "source string, metric string, rule_id string, valid_from date, valid_to date, authority_role string")
    rows = spark.createDataFrame([(i, "S", "M", month(i % 600)) for i in range(1200)], "row_id long, source string, metric string, period date")
    out = reconcile.apply_rules(rows, rules).collect()
    assert len(out) == 1200 and all(r["matches"] == len(range((r["row_id"] % 600), n, 600)) for r in out)
    assert intervals.matches(rows, rules, ["source", "metric"], "period", "valid_from", "valid_to").count() == n


def test_snapshots_tell_what_differs_and_join_no_more(spark):
    from monthmill.operators import snapshots as sn

    rows = [(f"k{i}", i % 5, float(i)) for i in range(3000)] + [(None, 1, 2.0), ("dup", 1, 1.0), ("dup", 1, 2.0), ("none", 2, None)]
    other = [(k, g, v + 1 if k in ("k17", "k900") else v) for k, g, v in rows if k not in ("k5", "k6")] + [("new", 3, 1.0)]
    other = [r for r in other if r != ("dup", 1, 2.0)] + [("dup", 1, 3.0)]
    kind = "k string, g int, v double"
    left, right = (sn.snapshot(spark.createDataFrame(r, kind), ["k", "g"], "v") for r in (rows, other))
    found = {(r["k"], r["status"]): (r["old"], r["new"]) for r in sn.differences(left, right).collect()}
    assert found == {("k17", "changed"): (17.0, 18.0), ("k900", "changed"): (900.0, 901.0), ("k5", "missing"): (5.0, None), ("k6", "missing"): (6.0, None),
                     ("new", "new"): (None, 1.0), ("dup", "changed"): (1.0, 1.0)}
    parts, buckets = sn.differing(left, right)
    assert len(buckets) <= 6 and len(parts) <= 6
    counts = {(r["g"], r["status"]): r["n"] for r in sn.summary(left, right, ["g"]).collect()}
    assert sum(n for (_, s), n in counts.items() if s == "equal") == 3003 - 5 and counts[0, "missing"] == 1 and counts[3, "new"] == 1
    again = sn.snapshot(spark.createDataFrame(rows[::-1], kind).repartition(7), ["k", "g"], "v")
    assert sn.differing(left, again) == ([], []) and sn.differences(left, again).count() == 0
    empty = sn.snapshot(spark.createDataFrame([], kind), ["k", "g"], "v")
    assert sn.differences(left, empty).count() == 3003 and sn.differences(empty, empty).count() == 0


def test_lookup_repeats_the_table_for_hot_keys_only(spark):
    from monthmill.operators.skew import hot_keys, lookup

    rows = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(900)] + [(None, 1)], "k string, v int")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", 2) for i in range(0, 900, 2)], "k string, w int")
    assert [r["k"] for r in hot_keys(rows, ["k"]).collect()] == ["hot"]
    assert lookup(rows, table, ["k"]).count() == 900 + 450 and lookup(rows, table, ["k"], "left").count() == 1801
    assert lookup(rows, table, ["k"], "left_semi").count() == 1350 and lookup(rows, table, ["k"], "left_anti").count() == 451
    assert lookup(rows.limit(0), table, ["k"]).count() == 0


def test_governance_alerts_and_roles(spark):
    from monthmill.operators import decisions as dcs

    kind = "k string, horizon int, base double, p10 double, p90 double, p95 double, role string"
    points = spark.createDataFrame([(k, 1, 100.0, 60.0, 140.0, 160.0, r) for k, r in (("a", "manager"), ("b", "editor"), ("c", "editor"), ("d", None), ("e", "editor"))], kind)
    proposals = spark.createDataFrame(
        [("a", 1, "final_value", 170.0, "promotion", "x"), ("b", 1, "final_value", 170.0, "promotion", "x"), ("c", 1, "absolute", 10.0, "promotion", "x"),
         ("d", 1, "absolute", -50.0, "promotion", "x")], "k string, horizon int, method string, proposed double, reason string, explanation string")
    out = {r["k"]: (r["alerts"], r["blockers"]) for r in dcs.decide(points, proposals, ["k", "horizon"], "role").collect()}
    both = "outside_probability_range,significant_adjustment"
    assert out == {"a": (both, ""), "b": (both, "outside_band_authorization_required"), "c": ("", ""), "d": (both, "outside_band_authorization_required"), "e": ("", "")}
    rows = spark.createDataFrame([("p", dt.date(2024, 5, 1), i) for i in (3, 1, 2)] + [("q", dt.date(2024, 6, 1), 9)], "product string, period date, seq int")
    chain = {(r["product"], r["seq"]): (r["version"], r["previous_version"]) for r in dcs.version_chain(rows, ["product", "period"], ["seq"], "DEC-", "period").collect()}
    assert chain == {("p", 1): ("DEC-2024-05-V01", None), ("p", 2): ("DEC-2024-05-V02", "DEC-2024-05-V01"), ("p", 3): ("DEC-2024-05-V03", "DEC-2024-05-V02"), ("q", 9): ("DEC-2024-06-V01", None)}


def test_duplicate_observations_stop_the_history_reader(spark):
    from monthmill.plans.intake import read_history

    kind = "chain_id string, product_id string, metric_code string, period date, value double, available_at date"
    d = lambda m: dt.date(2024, m, 1)
    rows = [("a", "p", "SALES", d(1), 1.0, d(2)), ("a", "p", "SALES", d(2), 2.0, d(5)), ("a", "p", "SALES", d(3), 3.0, None), ("a", "q", "SALES", d(1), 4.0, d(2)),
            ("a", "p", "ORDER", d(1), 9.0, d(2)), ("b", "p", "SALES", d(1), 9.0, d(2)), ("a", "p", "SALES", d(9), 9.0, d(9))]
    facts = spark.createDataFrame(rows, kind)
    at = F.lit(d(6))
    assert sorted((r["product_id"], r["value"]) for r in read_history(facts, "a", "SALES", at).collect()) == [("p", 1.0), ("p", 2.0), ("p", 3.0), ("q", 4.0)]
    assert [r["value"] for r in read_history(facts, "a", "SALES", at, F.lit(d(3)), "p").collect()] == [1.0]
    with pytest.raises(Exception, match="duplicate observation"):
        read_history(facts.union(facts), "a", "SALES", at).collect()


def test_three_cold_start_methods(spark):
    """Flat level and analog agree with the column expressions; the forest is scored beside them and its choice follows the rules."""
    from monthmill.operators import launchforest as lf

    rng = np.random.default_rng(3)
    hist = {f"B{i}": [float(20 + 5 * i + 12 * np.sin((j + i) / 2) + rng.integers(0, 4)) for j in range(30)] for i in range(5)}
    kind = "chain_id string, category_id string, {} string, terms array<string>, values array<double>"
    peers = spark.createDataFrame([("c", "k", p, ["red"], v) for p, v in hist.items()], kind.format("product_id"))
    targets = spark.createDataFrame([("c", "k", f"t{i}{a}", ["red"] if i else ["red", "ring"], [3.0 + i] * a) for i in range(2) for a in range(6)], kind.format("part_id"))
    groups, sets = lf.peer_sets(targets, peers)
    assert groups.count() == 12 and sets.count() == 6  # one fit for each age: the peers are the same
    scores = lf.scored(sets)
    chosen = {r["set_id"]: r for r in lf.choose(scores).collect()}
    members = {r["group_id"]: r["set_id"] for r in groups.collect()}
    for r in cs.leave_one_out(cs.peer_ratios(cs.select_peers(cs.target_groups(targets), peers))).collect():
        c = chosen[members[r["group_id"]]]
        for name in ("analog", "baseline"):
            assert c[f"{name}_wape"] == pytest.approx(r[f"{name}_wape"], abs=0.011) and c[f"{name}_bias"] == pytest.approx(r[f"{name}_bias"], abs=0.011)
    for c in chosen.values():
        allowed = [(c[f"{m}_wape"], i, n) for i, (m, n) in enumerate((("analog", "analog"), ("ml", "ml_random_forest"))) if abs(c[f"{m}_bias"]) <= abs(c["baseline_bias"]) + 5]
        best = min(allowed)[2] if allowed and min(allowed)[0] < c["baseline_wape"] else "baseline"
        assert c["model"] == best
    by_horizon = scores.filter("horizon > 0").collect()
    assert len(by_horizon) == 6 * 3 * 4
    # the forest of a set, by hand
    ages = {r["set_id"]: r["age"] for r in sets.collect()}
    for set_id, age in ages.items():
        actual, guess = [], []
        for p in sorted(hist):
            others = [hist[q] for q in sorted(hist) if q != p]
            on = lf.level(hist[p][:age]) if age else float(np.median([lf.level(o[:3]) for o in others]))
            actual += hist[p][age:age + 12]
            guess += list(lf.predict(lf.forest(others, age), hist[p][:age], age, on))
        assert chosen[set_id]["ml_wape"] == pytest.approx(100 * sum(abs(a - g) for a, g in zip(actual, guess)) / sum(actual), abs=0.006)
    out = lf.launch(targets, peers, lf.choose(scores), groups).collect()
    assert len(out) == 144 and all(r["forecast"] >= 0 for r in out)
    for r in out:
        if r["model"] == "baseline" and r["age"]:
            assert r["forecast"] == pytest.approx(lf.level([3.0 + int(r["part_id"][1])] * r["age"]))


def test_launch_trees_split_where_the_error_falls_most():
    from monthmill.operators import launchforest as lf

    x = np.array([[i / 12, 0.2, 0.0, 0.0] for i in range(1, 13)] * 6)
    y = np.where(x[:, 0] > 0.66, 9.0, 1.0)
    trees = [lf.grow(x, y, np.random.default_rng(s)) for s in range(40)]
    assert max(abs(lf.walk(t, x) - y).max() for t in trees if len(t) == 4 and t[0] == 0) < 8
    assert any(len(t) == 4 and t[0] == 0 and abs(t[1] - np.quantile(x[:, 0], 0.66)) < 1e-9 for t in trees)
    assert lf.grow(x[:8], y[:8], np.random.default_rng(0)) == [float(y[:8].mean())]


def test_claims_are_derived_from_the_lines_once(spark, root):
    """Claims, products and ledger are written: no query of the decisions reads the order lines in its own plan."""
    from monthmill.plans.catalog import QUERIES

    for name in ("u07_incoming_classification", "q12_availability_backfill", "u03_key_intersection", "j11_backlog_anti_join", "j22_baseline_trace",
                 "u01_ledger_union", "g24_ledger_summary", "g25_conflict_clusters", "g21_resolution"):
        assert not any("lineitem" in f for f in QUERIES[name](spark, root).inputFiles()), name


def test_lines_are_dealt_to_tasks_of_bounded_size(spark, root, monkeypatch):
    """Beyond the usual number of tasks lines are dealt by order, and grouping single lines needs no further shuffle."""
    from monthmill.sources import tables as tb

    whole = tb.Tables(spark, root)
    assert whole.line_tasks == 1 and whole.dealt(whole.lines, "l_orderkey") is whole.lines
    monkeypatch.setattr(tb, "ROWS_PER_TASK", 100)
    t = tb.Tables(spark, root)
    assert t.line_tasks == whole.read("lineitem").count() // 100 + 1
    assert t.lines.rdd.getNumPartitions() == t.line_tasks
    assert t.dealt_to("part", t.read("part"), "p_partkey").rdd.getNumPartitions() == t.line_tasks
    # the same rows, as many times
    assert t.lines.exceptAll(whole.lines).count() == 0 and whole.lines.exceptAll(t.lines).count() == 0


def test_a_forest_is_walked_once_for_all_targets_of_a_set():
    import random

    import numpy as np

    from monthmill.operators import launchforest as lf

    rng = random.Random(3)
    peers = [[float(rng.randint(0, 40)) for _ in range(20)] for _ in range(6)]
    for age in (0, 1, 4):
        trees = lf.forest(peers, age)
        prefixes = [[float(rng.randint(0, 40)) for _ in range(age)] for _ in range(7)]
        on = [lf.scale(peers, p) for p in prefixes]
        alone = [lf.predict(trees, p, age, o) for p, o in zip(prefixes, on)]
        assert np.array_equal(lf.forest_paths(trees, prefixes, age, on), np.array(alone))
