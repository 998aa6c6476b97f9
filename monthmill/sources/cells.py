"""Spreadsheet content as a long `cells` table: (source, sheet, row_no, column, raw_text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from monthmill.functions import text as tx

# Header shape "YYYY/MM label" and the label fragments of each metric.
HEADER = "([0-9]{4})/(0[1-9]|1[0-2])\\s+(.+)"
METRIC_LABELS = {"POS Qty": "SALES", "Total Eaches Str Ordered": "ORDER", "Total Eaches Str Received": "DELIVERY"}


def header_fields(headers: DataFrame) -> DataFrame:
    """(source, sheet, column) with metric and period for headers that name both."""
    label = F.regexp_extract("header", HEADER, 3)
    metric = F.lit(None).cast("string")
    for fragment, code in METRIC_LABELS.items():
        metric = F.when(F.contains(label, F.lit(fragment)), code).otherwise(metric)
    period = F.concat_ws("-", F.regexp_extract("header", HEADER, 1), F.regexp_extract("header", HEADER, 2))
    return headers.withColumn("metric", metric).withColumn("period", period).filter(
        F.col("metric").isNotNull() & F.col("header").rlike(HEADER)
    ).select("source", "sheet", "column", "metric", "period")


def wide_rows(cells: DataFrame, headers: DataFrame, item_column: int) -> DataFrame:
    """Long facts of a sheet whose metric columns are found by their header."""
    items = cells.filter(F.col("column") == item_column).select("source", "sheet", "row_no", F.trim("raw_text").alias("item"))
    return (
        cells.join(header_fields(headers), ["source", "sheet", "column"])
        .join(items, ["source", "sheet", "row_no"])
        .select("source", "sheet", "row_no", "column", "item", "period", "metric", "raw_text", tx.literal_class(F.col("raw_text")).alias("literal_class"))
    )


def block_rows(cells: DataFrame, item_column: int, year: Column, first_column: int = 2) -> DataFrame:
    """Three blocks of twelve months: sales, orders, deliveries, by column position."""
    offset = F.col("column") - first_column
    metric = F.element_at(F.array(F.lit("SALES"), F.lit("ORDER"), F.lit("DELIVERY")), F.floor(offset / 12).cast("int") + 1)
    items = cells.filter(F.col("column") == item_column).select("source", "sheet", "row_no", F.trim("raw_text").alias("item"))
    data = cells.filter((offset >= 0) & (offset < 36))
    period = F.format_string("%04d-%02d", year.cast("int"), (offset % 12 + 1).cast("int"))
    return data.join(items, ["source", "sheet", "row_no"]).select(
        "source", "sheet", "row_no", "item", metric.alias("metric"), period.alias("period"), "raw_text"
    )


def profile_rows(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """Cells named by a sheet profile: equal column, row inside the field's range."""
    return cells.join(fields, ["source", "sheet", "column"]).filter(
        (F.col("row_no") >= F.col("row_from")) & (F.col("row_no") <= F.col("row_to"))
    )


LOOKUP = "=(?:IFERROR\\()?XLOOKUP\\([^,]+,'([^']+)'!\\$?([A-Z]+):\\$?[A-Z]+,'([^']+)'!\\$?([A-Z]+):\\$?[A-Z]+"


def lookup_reference(formula: Column) -> Column:
    """Sheet and columns a direct exact lookup depends on; null for any other shape."""
    same = F.regexp_extract(formula, LOOKUP, 1) == F.regexp_extract(formula, LOOKUP, 3)
    return F.when(
        formula.rlike(LOOKUP) & same,
        F.struct(
            F.regexp_extract(formula, LOOKUP, 1).alias("sheet"), F.regexp_extract(formula, LOOKUP, 2).alias("item_column"),
            F.regexp_extract(formula, LOOKUP, 4).alias("value_column"),
        ),
    )
