"""Identifier, label and literal cleaning as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# Spreadsheet error tokens and non-identifiers.
ERROR_TOKENS = ["#N/A", "#DIV/0!", "#REF!", "#VALUE!", "#NAME?", "#NUM!", "#NULL!"]
NOT_A_CODE = ["none", "nan", "item", "total", "-"]


def accent_pairs() -> tuple[str, str]:
    """Every composed Latin letter (up to U+024F, U+1E00 block) and its base letter."""
    source, target = [], []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFKD", chr(point))
        base = [c for c in parts if not unicodedata.combining(c)]
        if len(parts) > 1 and len(base) == 1:
            source.append(chr(point))
            target.append(base[0])
    return "".join(source), "".join(target)


_FROM, _TO = accent_pairs()


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _FROM, _TO), "[\\u0300-\\u036f]", "")


def comparison_key(text: Column) -> Column:
    """No accents, upper case, single blanks."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(F.coalesce(text, F.lit("")))), "\\s+", " "))


def display_key(text: Column) -> Column:
    """Upper case with accents kept."""
    return F.upper(F.trim(F.regexp_replace(text, "\\s+", " ")))


def fold(text: Column) -> Column:
    return F.lower(strip_accents(text))


def clean_code(number: Column, text: Column) -> Column:
    """Whole numbers lose their decimals; placeholders become empty."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return F.when(number.isNotNull() & (number == F.floor(number)), number.cast("bigint").cast("string")).otherwise(
        F.when(F.lower(trimmed).isin(*NOT_A_CODE), "").otherwise(trimmed)
    )


def is_formula(text: Column) -> Column:
    return F.coalesce(text.startswith("="), F.lit(False))


def identifier(number: Column, text: Column, upc: bool = False) -> Column:
    code = clean_code(number, text)
    good = ~is_formula(text) & code.rlike("^[A-Za-z0-9_-]+$") & code.rlike("[0-9]") & ~code.rlike("^0+$")
    if upc:
        good = good & code.rlike("^[0-9]{8,14}$")
    return F.when(good, code).otherwise("")


def literal_class(text: Column) -> Column:
    raw = F.trim(F.coalesce(text, F.lit("")))
    value = literal_value(text)
    return (
        F.when(raw == "", "MISSING")
        .when(F.upper(raw).isin(*ERROR_TOKENS), "INVALID")
        .when(value.isNull(), "INVALID")
        .otherwise("VALUE")
    )


def literal_value(text: Column) -> Column:
    """Canonical decimal of a literal; separators only in groups of three; no negatives."""
    raw = F.trim(text)
    grouped = ~F.contains(raw, F.lit(",")) | raw.rlike("^[0-9]{1,3}(,[0-9]{3})+(\\.[0-9]+)?$")
    shape = raw.rlike("^[+-]?[0-9,]*\\.?[0-9]+([eE][+-]?[0-9]+)?$|^[+-]?[0-9,]+\\.$")
    value = F.regexp_replace(raw, ",", "").try_cast("decimal(38,6)")
    return F.when(grouped & shape & (value >= 0), value)


def unit_key(parent: Column, fmt: Column) -> Column:
    p, f = F.trim(parent), F.trim(F.coalesce(fmt, F.lit("")))
    return F.when(p == "", "").when((f != "") & (f != p), F.concat_ws("::", p, f)).otherwise(p)


def scope_token(text: Column) -> Column:
    token = F.regexp_replace(F.upper(F.coalesce(text, F.lit("ALL"))), "[^A-Z0-9]+", "-")
    token = F.regexp_replace(token, "^-+|-+$", "")
    return F.when(token == "", "ALL").otherwise(token)


def run_id(scope: Column, period: Column, sequence: Column) -> Column:
    return F.format_string("RUN-%s-%s-%03d", scope_token(scope), period, sequence)


def model_version(kind: Column | str, scope: Column, period: Column, sequence: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.format_string("%s-%s-%s-V%02d", kind, scope_token(scope), F.regexp_replace(period, "-", ""), sequence)


def fingerprint(*columns: Column) -> Column:
    """Hash of the fields in the given order; null is distinct from empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("∅")) for c in columns]), 256)


def missing_flag(text: Column) -> Column:
    """true/false markers; anything else is null and must be rejected by a rule."""
    return F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true")


def utc_instant(text: Column) -> Column:
    """ISO timestamps in UTC; a bare date is midnight."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def terms(text: Column, stop_words: list[str]) -> Column:
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.array_distinct(
        F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: (F.length(x) > 2) & ~F.array_contains(stop, x))
    )
