"""Description texts -> product type, presentation, model, colour, quality flags."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from monthmill.functions.text import comparison_key


@dataclass(frozen=True)
class Rules:
    """Vocabularies a user supplies; all matching is on comparison keys, so accents and case do not matter.

    In texts with a word of `apparel`, sizes are `apparel_sizes` instead of presentations, and `descriptors` right after
    the word describe the product, not its size.
    """

    types: list[str]
    leading: list[str]
    presentations: dict[str, list[str]]
    unresolved: list[str]
    colours: list[str]
    suffix_stop: list[str] = field(default_factory=list)
    brands: list[str] = field(default_factory=list)
    apparel: list[str] = field(default_factory=list)
    apparel_sizes: list[str] = field(default_factory=list)
    descriptors: list[str] = field(default_factory=list)


DIMENSIONS = "(?<!\\w)[0-9]+(?:[.,][0-9]+)?\\s*[X×]\\s*[0-9]+(?:[.,][0-9]+)?\\s*(?:CM|MM|M)(?!\\w)"
SEASON = "(?<!\\w)(?:SS|FW|AW|SP)[0-9]{2}(?!\\w)|\\b20[0-9]{2}\\b"


def key(word: str) -> str:
    """The comparison key of a vocabulary entry."""
    plain = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return " ".join(plain.upper().split())


def choice(words: list[str]) -> str:
    ordered = sorted({key(w) for w in words}, key=lambda w: (-len(w), w))
    return "(" + "|".join(re.escape(w).replace("\\ ", "\\s+") for w in ordered) + ")"


def alternation(words: list[str]) -> str:
    """Whole words, longest first."""
    return "(?<!\\w)" + choice(words) + "(?!\\w)"


def product_type(description: Column, category: Column, rules: Rules) -> Column:
    """Single distinct type word of the description, else of the category; several are ambiguous."""
    pattern = alternation(rules.types)

    def found(text: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(comparison_key(text), F.lit(pattern), 1))

    d, c = found(description), found(category)
    return (
        F.when(F.size(d) > 1, "AMBIGUOUS").when(F.size(d) == 1, d[0])
        .when(F.size(c) > 1, "AMBIGUOUS").when(F.size(c) == 1, F.try_element_at(c, F.lit(1)))
    )


def sized(description: Column, rules: Rules) -> tuple[Column, list[Column]]:
    """The text with sizes blanked out, and each size if it was there.

    Groups are taken in order, the longest spelling first, and what one has matched is gone for the next.
    """
    text = comparison_key(description)
    worn = text.rlike(alternation(rules.apparel)) if rules.apparel else F.lit(False)
    if rules.apparel and rules.descriptors:
        text = F.regexp_replace(text, alternation(rules.apparel) + "\\s+" + choice(rules.descriptors) + "(?!\\w)", "$1 ")
    found = []
    for name, literals in rules.presentations.items():
        pattern = alternation(literals)
        found.append(F.when(~worn & text.rlike(pattern), F.lit(name)))
        text = F.when(worn, text).otherwise(F.regexp_replace(text, pattern, " "))
    for size in rules.apparel_sizes:
        pattern = alternation([size])
        found.append(F.when(worn & text.rlike(pattern), F.lit(size)))
        text = F.when(worn, F.regexp_replace(text, pattern, " ")).otherwise(text)
    return text, found


def presentations(description: Column, rules: Rules) -> Column:
    """Homologated sizes and literal dimensions found in a description, sorted."""
    text, found = sized(description, rules)
    named = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(named, F.regexp_extract_all(text, F.lit(DIMENSIONS), 0))))


def blanked(description: Column, rules: Rules) -> Column:
    """The text without sizes, dimensions, and leading generic and brand words."""
    text = F.regexp_replace(sized(description, rules)[0], DIMENSIONS, " ")
    return F.regexp_replace(text, f"^([\\s-]*{choice(rules.leading + rules.brands)}(?!\\w))+", "")


def cleaned(description: Column, rules: Rules) -> Column:
    """The blanked text as one phrase."""
    return F.regexp_replace(F.regexp_replace(blanked(description, rules), "\\s+", " "), "^[ -]+|[ -]+$", "")


def problems(description: Column, rules: Rules) -> Column:
    """Quality flags of what is left of the text."""
    text = blanked(description, rules)
    return F.array_sort(
        F.array_compact(
            F.array(
                F.when(text.rlike(alternation(rules.unresolved)), "UNRESOLVED_ABBREVIATION"),
                F.when(text.rlike(SEASON), "SEASON_CODE_UNVALIDATED"),
                F.when(F.contains(text, F.lit("(")) | F.contains(text, F.lit(")")), "LEGACY_OR_PARENTHETICAL_NAME"),
                F.when(F.size(presentations(description, rules)) > 1, "MULTIPLE_PRESENTATION_LITERALS"),
            )
        )
    )


def split_colour(text: Column, colours: list[str]) -> tuple[Column, Column]:
    """(model, colour) by the longest colour of a fixed vocabulary at the end of the text."""
    pattern = "^(.*?)[ -]+" + choice(colours) + "$"
    model = F.regexp_replace(F.regexp_extract(text, pattern, 1), "^[ -]+|[ -]+$", "")
    has = model != ""
    return F.when(has, model), F.when(has, F.regexp_extract(text, pattern, 2))


def split_colour_by(texts: DataFrame, colours: DataFrame) -> DataFrame:
    """The same against a colour table of any size: all ending word groups are joined, the longest wins."""
    tokens = texts.withColumn("tok", F.split("cleaned", "[\\s-]+")).filter(F.size("tok") > 1)
    ends = tokens.select("cleaned", "tok", F.explode(F.sequence(F.lit(1), F.size("tok") - 1)).alias("k"))
    ends = ends.select("cleaned", "k", F.array_join(F.expr("slice(tok, -k, k)"), " ").alias("colour"), F.array_join(F.expr("slice(tok, 1, size(tok) - k)"), " ").alias("model"))
    hit = ends.join(colours.select("colour"), "colour")
    return hit.groupBy("cleaned").agg(F.max_by(F.struct("model", "colour"), F.struct(F.length("colour"), "k")).alias("m")).select("cleaned", "m.*")


def learn_colours(texts: DataFrame, seeds: DataFrame, rules: Rules, passes: int = 2) -> DataFrame:
    """Contrastive suffixes: what follows a model already seen with a known colour.

    texts: cleaned, n_problems, n_barred (problems that bar a model). Candidate models are found by joining each text's
    leading word groups, so no text is compared with another.
    """
    colours = seeds.select("colour", F.lit("SEED").alias("source"))
    stop = alternation((rules.suffix_stop + rules.unresolved) or ["\u0000"])
    barred = alternation(rules.types + rules.suffix_stop)
    distinct = texts.groupBy("cleaned").agg(F.min("n_problems").alias("n_problems"), F.min("n_barred").alias("n_barred"))
    for _ in range(passes):
        known = split_colour_by(distinct.filter("n_barred = 0"), colours).select("model").distinct().filter(
            ~F.col("model").rlike("[0-9()/]") & ~F.col("model").rlike(barred)
        )
        tokens = distinct.filter("n_problems = 0").withColumn("tok", F.split("cleaned", "[\\s-]+"))
        heads = tokens.filter(F.size("tok") > 1).select("cleaned", "tok", F.explode(F.sequence(F.lit(1), F.size("tok") - 1)).alias("k"))
        heads = heads.select("cleaned", "tok", "k", F.array_join(F.expr("slice(tok, 1, k)"), " ").alias("model"))
        longest = heads.join(known, "model").groupBy("cleaned").agg(F.max_by(F.expr("slice(tok, k + 1, size(tok))"), F.col("k")).alias("rest"))
        suffix = longest.filter(F.size("rest") <= 4).select(F.array_join("rest", " ").alias("colour"))
        found = suffix.filter((F.col("colour") != "") & ~F.col("colour").rlike("[0-9()/]") & ~F.col("colour").rlike(stop)).distinct()
        fresh = found.join(colours.select("colour"), "colour", "left_anti").select("colour", F.lit("CORPUS_CONTRAST").alias("source"))
        colours = colours.unionByName(fresh)
    return colours


def facet_match(filters: dict[str, list[str] | str | None], excluded: str | None = None) -> Column:
    """Conjunction over the set facets, leaving one out for its own counts."""
    out = F.lit(True)
    for name, wanted in filters.items():
        if name == excluded or wanted is None:
            continue
        out = out & (F.col(name).isin(*wanted) if isinstance(wanted, list) else (F.col(name) == wanted))
    return out


def attribute(value: Column, field_name: str, not_applicable: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), value).when(
        F.array_contains(F.coalesce(not_applicable, F.array().cast("array<string>")), field_name), "__NOT_APPLICABLE__"
    ).otherwise("__UNKNOWN__")


def facet_options(products: DataFrame, facet: str, filters: dict) -> DataFrame:
    """Counts, pending flag and statuses of a facet's values under the other filters."""
    return (
        products.filter(facet_match(filters, excluded=facet)).groupBy(F.col(facet).alias("option"))
        .agg(
            F.count(F.lit(1)).alias("products"), F.bool_or(F.col("status") != "APPROVED").alias("pending"),
            F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"),
        )
    )
