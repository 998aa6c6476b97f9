"""Readers for the star-schema tables and the monthly facts derived from them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from monthmill.functions.periods import month
from monthmill.session import cut_lineage

# Issue month used by the registered queries: the last month in which all three
# metrics are complete in the test tables. A parameter everywhere else.
ISSUE = dt.date(2001, 7, 1)
SERIES = ["chain_id", "product_id", "category_id"]
METRICS = ["SALES", "ORDER", "DELIVERY"]
ROWS_PER_TASK = 500_000


class Tables:
    """Lazy access to one folder of parquet tables."""

    # what was written to the checkpoint folder of this application: (application, folder, name) to its rows
    stored: dict[tuple[str, str, str], DataFrame] = {}
    # number of rows: (application, folder, table) to it
    counted: dict[tuple[str, str, str], int] = {}

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Rows that several queries read, written once per application and folder; the tables are taken as unchanging."""
        key = (self.spark.sparkContext.applicationId, self.root, name)
        if key not in self.stored:
            self.stored[key] = build()
        return self.stored[key]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def size(self, name: str) -> int:
        """Rows of a table, counted once per application and folder."""
        key = (self.spark.sparkContext.applicationId, self.root, name)
        if key not in self.counted:
            self.counted[key] = self.read(name).count()
        return self.counted[key]

    @cached_property
    def line_tasks(self) -> int:
        """How many tasks give each at most ROWS_PER_TASK order lines."""
        return self.size("lineitem") // ROWS_PER_TASK + 1

    def dealt(self, rows: DataFrame, *keys: str) -> DataFrame:
        """Rows as many as the order lines, by key into more tasks than usual where those would get too many of them.

        The memory of a task that sorts or groups single lines then stays the same however many lines there are.
        """
        usual = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(self.line_tasks, *keys) if self.line_tasks > usual else rows

    def dealt_to(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """Rows dealt to meet a table, unless that has at most ROWS_PER_TASK rows: it may be sent to all tasks instead."""
        return self.dealt(rows, key) if self.line_tasks > 1 and self.size(name) > ROWS_PER_TASK else rows

    @cached_property
    def lines(self) -> DataFrame:
        """Order lines with their chain (segment), product (brand) and months."""
        li = self.read("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate",
        )
        orders = self.read("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
        customer = self.read("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        part = self.read("part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size")
        # orders get their customer before they meet the lines, which are thus shuffled twice, not three times; the lines
        # come out dealt by order
        placed = self.dealt_to("customer", orders, "o_custkey").join(customer, F.col("o_custkey") == customer.c_custkey)
        return (
            self.dealt(self.dealt_to("part", li, "l_partkey").join(part, F.col("l_partkey") == part.p_partkey), "l_orderkey")
            .join(self.dealt(placed, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("c_mktsegment").alias("chain_id"),
                F.col("p_brand").alias("product_id"),
                category(F.col("p_brand")).alias("category_id"),
                F.col("l_partkey").alias("part_id"),
                F.col("l_quantity").alias("qty"),
                month(F.col("l_shipdate")).alias("ship_m"),
                month(F.col("o_orderdate")).alias("order_m"),
                "l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus",
                "l_shipdate", "o_orderdate", "o_orderstatus", "o_custkey", "c_nationkey",
                "p_name", "p_type", "p_size", "l_extendedprice", "l_discount",
            )
        )

    def monthly_by(self, keys: list[str], source: DataFrame | None = None) -> DataFrame:
        """Sums per key and month; a month with only returned lines is an observed zero."""
        rows = (source if source is not None else self.lines).select(
            *keys,
            F.inline(
                F.array(
                    F.struct(
                        F.col("ship_m").alias("period"),
                        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("qty")).alias("sales"),
                        F.lit(None).cast("double").alias("orders"),
                        F.col("qty").alias("delivery"),
                    ),
                    F.struct(
                        F.col("order_m").alias("period"),
                        F.lit(None).cast("double").alias("sales"),
                        F.col("qty").alias("orders"),
                        F.lit(None).cast("double").alias("delivery"),
                    ),
                )
            ),
        )
        return rows.groupBy(*keys, "period").agg(
            F.sum("sales").alias("sales"), F.sum("orders").alias("orders"), F.sum("delivery").alias("delivery")
        )

    @cached_property
    def monthly(self) -> DataFrame:
        """One row per series and month with the three metrics side by side; written once, as most queries read it often."""
        return self.kept("monthly", lambda: cut_lineage(self.monthly_by(SERIES)))

    @cached_property
    def facts(self) -> DataFrame:
        """The long form: one row per series, month and metric that has a value."""
        return (
            self.monthly.unpivot(
                [*SERIES, "period"], ["sales", "orders", "delivery"], "metric", "value"
            )
            .filter(F.col("value").isNotNull())
            .select(
                *SERIES, "period",
                F.when(F.col("metric") == "sales", "SALES").when(F.col("metric") == "orders", "ORDER")
                .otherwise("DELIVERY").alias("metric_code"),
                "value",
            )
        )

    @cached_property
    def series(self) -> DataFrame:
        """One row per series: calendar-complete months up to ISSUE; the array is as long as the calendar."""
        from monthmill.operators.series import dense_series

        return dense_series(self.monthly, SERIES, ["sales", "orders", "delivery"], ISSUE)

    @cached_property
    def panel(self) -> DataFrame:
        from monthmill.operators.series import explode_series

        return explode_series(self.series, SERIES)

    @cached_property
    def brand_values(self) -> DataFrame:
        """Observed sales per series from the first positive month to ISSUE."""
        from monthmill.operators.series import observed_values, spread

        return spread(observed_values(self.monthly.filter(F.col("period") <= F.lit(ISSUE)), SERIES, "sales"), SERIES)

    @cached_property
    def part_values(self) -> DataFrame:
        """The same per part: sparse demand with real zeros."""
        from monthmill.operators.series import observed_values, spread

        return spread(observed_values(self.monthly_by(["part_id"]), ["part_id"], "sales"), ["part_id"])

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")


def category(brand):
    """Five categories by brand number."""
    return F.concat(F.lit("C"), (F.substring(brand, 7, 9).cast("int") % 5).cast("string"))
