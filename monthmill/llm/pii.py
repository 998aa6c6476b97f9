"""Personal data: pattern spans, and terms that disclose a protected value by co-occurrence.

Values found by the patterns are the protected entities. For an entity c and a term t near it, the corpus gives the
documents with c, with t, and with t near c; their pointwise mutual information as a share of the information content
of c says how much of c the term gives away (1: whoever reads t knows c). Terms above a threshold are generalised,
above a higher one removed, near that entity. Everything here is DataFrame functions.
"""

from __future__ import annotations

import operator
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from monthmill.llm.common import packed, query, stored, table, texts, unpacked

# Fixed patterns, in the order in which spans are listed. Possessive, since nothing follows that could need a retry;
# the look-behind skips starts that can only fail like the start of their run, and \G allows one after a match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{4,}"
REACH, SUPPORT, GENERALISE, REMOVE = 120, 3, 0.8, 0.95
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
ROW = ["r1", "r2"]


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the sum of the digits, every second from the right doubled and reduced, is a multiple of ten."""
    values = F.transform(
        F.split(F.reverse(number), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + (d.cast("int") / 5).cast("int")),
    )
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        def small(part):
            short = F.regexp_replace(part, "^0+", "")
            return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))

        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(digits(value)).between(16, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def _valid_span(kind: str, span: Column) -> Column:
    return valid(kind, span["value"])


def located(hits: Column, gaps: Column, kind: str) -> Column:
    """Spans in code points from the matches of a pattern and the texts between them."""
    steps = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("v"), F.length(g).alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPANS})").alias("out"))

    def step(a, s):
        begin, end = a["at"] + s["g"], a["at"] + s["g"] + F.length(s["v"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), s["v"].alias("value"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    return F.when(F.size(hits) > 0, F.aggregate(steps, start, step, lambda a: a["out"])).otherwise(
        F.expr(f"cast(array() as {SPANS})")
    )


def find(text: str, patterns: dict[str, str]):
    """Two projections: matches first, so that texts without any are split by no pattern."""

    def add(rows: DataFrame) -> DataFrame:
        every = [F.col(c) for c in rows.columns]
        rows = rows.select(*every, *[
            F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_hits_{k}") for k, p in patterns.items()
        ])
        spans = [
            F.filter(located(F.col(f"_hits_{k}"), F.split(text, p, -1), k), partial(_valid_span, k))
            for k, p in patterns.items()
        ]
        return rows.select(*every, *[s.alias(f"_spans_{k}") for s, k in zip(spans, patterns)])

    return add


def row_key(rows: DataFrame) -> DataFrame:
    """128 bits that stand for a document: rows with equal id and text are one."""
    return rows.withColumns({
        "r1": F.xxhash64("doc_id", "text"), "r2": F.xxhash64(F.lit(1), F.col("doc_id"), F.col("text")),
    })


def base_spans(rows: DataFrame) -> DataFrame:
    """Adds base: the valid spans of all kinds by kind, then start."""
    found = find("text", PATTERNS)(rows)
    return found.withColumn("base", F.concat(*[F.col(f"_spans_{k}") for k in PATTERNS])).select(*rows.columns, "base")


def entity_key() -> tuple[Column, Column]:
    """e1 and e2, 128 bits that stand for the value of the span s."""
    number = F.concat(F.col("s.kind"), F.lit(":"), digits(F.col("s.value")))
    entity = F.when(F.col("s.kind") == "email", F.concat(F.lit("email:"), F.lower("s.value")))
    entity = entity.when(F.col("s.kind") == "ip", F.concat(F.lit("ip:"), F.col("s.value"))).otherwise(number)
    return F.xxhash64(entity).alias("e1"), F.xxhash64(F.lit(1), entity).alias("e2")


def mentions(rows: DataFrame, reach: int) -> DataFrame:
    """One row for each term within `reach` code points of a base span: document, entity, term and place."""
    at = rows.select(*ROW, "text", "base", F.explode("base").alias("s"))
    low = F.greatest(F.col("s.start") - reach, F.lit(0))
    at = at.select(
        *ROW, "base", *entity_key(),
        F.inline(F.array(
            F.struct(low.alias("at"), F.substring("text", low + 1, F.col("s.start") - low).alias("near"),
                     (low > 0).alias("cut_left"), F.lit(False).alias("cut_right")),
            F.struct(F.col("s.end").alias("at"), F.substring("text", F.col("s.end") + 1, F.lit(reach)).alias("near"),
                     F.lit(False).alias("cut_left"), (F.col("s.end") + reach < F.length("text")).alias("cut_right")),
        )),
    )
    terms = find("near", {"term": TERM})(at).withColumn("long", F.length("near"))
    terms = terms.select(*ROW, "base", "e1", "e2", "at", "cut_left", "cut_right", "long", F.explode("_spans_term").alias("t"))
    whole = ~(F.col("cut_left") & (F.col("t.start") == 0)) & ~(F.col("cut_right") & (F.col("t.end") == F.col("long")))
    terms = terms.filter(whole).select(
        *ROW, "base", "e1", "e2", F.lower("t.value").alias("term"),
        (F.col("at") + F.col("t.start")).alias("start"), (F.col("at") + F.col("t.end")).alias("end"),
    )
    covered = F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    return terms.filter(~covered).drop("base")


def disclosing(near: DataFrame, found: DataFrame, rows: DataFrame, support: int, threshold: float) -> DataFrame:
    """(e1, e2, term, share): pairs near each other in `support` documents whose information share reaches the threshold."""
    pairs = (
        near.select(*ROW, "e1", "e2", "term").distinct().groupBy("e1", "e2", "term")
        .agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= support)
    )
    # every document with the value, whether or not it has a term near it
    values_ = found.select(*ROW, F.explode("base").alias("s")).select(*ROW, *entity_key())
    entities = values_.distinct().groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n_c"))
    words = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    terms = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = rows.count()
    share = 1 - F.log(F.greatest(F.col("n_t") / F.col("both"), F.lit(1.0))) / F.log(F.lit(float(total)) / F.col("n_c"))
    return (
        pairs.join(entities, ["e1", "e2"]).filter(F.col("n_c") < total).join(terms, "term")
        .withColumn("share", share).filter(F.col("share") >= threshold).select("e1", "e2", "term", "share")
    )


def sanitise(
    docs: DataFrame, reach: int = REACH, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """All input columns, plus _base and _terms (arrays of kind, start, end, value in code points) and _clean, which
    replace input columns so named.

    _base holds the pattern spans by kind (email, ip, card, phone), then start; _terms the disclosing terms by start,
    with value `generalise` or `remove`. _clean is the text with base spans replaced by their kind in angle brackets,
    generalised terms by <term>, removed ones by nothing; where spans overlap, the first replaces what they cover.
    A null text counts as empty: no spans, and _clean is empty. A value in every document has no information to
    disclose. Rows that repeat a doc_id and text count as separate documents in term counts, as one in entity counts,
    and get the same spans. A null doc_id is a value like any other. An empty table gives no rows.
    """
    rows = row_key(texts(docs))
    found = stored(base_spans(rows).filter(F.size("base") > 0).dropDuplicates(ROW), "base")
    near = stored(mentions(found, reach), "mentions")
    told = disclosing(near, found, rows, support, generalise)
    spans = (
        near.join(told, ["e1", "e2", "term"]).groupBy(*ROW, "start", "end").agg(F.max("share").alias("share"))
        .groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct(
            "start", "end", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("value")
        ))).alias("terms"))
        .select(*ROW, F.transform("terms", lambda t: F.struct(
            F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value")
        )).alias("_terms"))
    )
    marks = found.select(*ROW, F.col("base").alias("_base")).join(spans, ROW, "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = packed(docs).select("*", F.xxhash64(F.col("doc_id"), text).alias("_k1"),
                        F.xxhash64(F.lit(1), F.col("doc_id"), text).alias("_k2"))
    joined = keyed.join(marks, (F.col("_k1") == F.col("r1")) & (F.col("_k2") == F.col("r2")), "left")
    none = F.expr(f"cast(array() as {SPANS})")
    out = joined.select(
        "doc_id", "text", "rest", F.coalesce("_base", none).alias("_base"), F.coalesce(F.col("_terms").cast(SPANS), none).alias("_terms")
    )
    out = out.withColumn("_clean", cleaned(text, F.col("_base"), F.col("_terms")))
    return out.select(*unpacked(docs, "_base", "_terms", "_clean"), "_base", "_terms", "_clean")


def cleaned(text: Column, base: Column, terms: Column) -> Column:
    spans = F.array_sort(F.transform(F.concat(base, terms), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.when(s["value"].eqNullSafe("remove") & (s["kind"] == "term"), "")
        .otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">"))).alias("tag"),
    )))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, s):
        piece = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["tag"])
        return F.when(
            s["start"] >= a["at"], F.struct(s["end"].alias("at"), piece.alias("out"))
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))

    rest = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op9_pii")
def op9_pii(spark: SparkSession, root: str) -> DataFrame:
    out = sanitise(table(spark, root, "documents"))
    number = [
        F.size(F.filter(F.col("_base.kind"), partial(operator.eq, k))).cast("long").alias(f"n_{k}") for k in PATTERNS
    ]
    return out.select(
        "doc_id", *number, F.sha2(listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("_base", "_terms")).alias("spans"),
    )
