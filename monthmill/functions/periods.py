"""Month arithmetic on dates truncated to the first of the month."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def month(ts: Column) -> Column:
    return F.trunc(ts, "month")


def label(period: Column) -> Column:
    return F.date_format(period, "yyyy-MM")


def shift(period: Column, months: Column | int) -> Column:
    return F.add_months(period, months)


def month_index(period: Column) -> Column:
    """Months since year 0; the difference of two is the month distance."""
    return F.year(period) * 12 + F.month(period) - 1


def month_end(period: Column) -> Column:
    return F.last_day(period)


def distance(start: Column, end: Column) -> Column:
    return month_index(end) - month_index(start)


def spine(start: Column, end: Column) -> Column:
    return F.sequence(start, end, F.expr("interval 1 month"))


def in_range(period: Column, start: Column, end: Column) -> Column:
    """Both ends may be open (null)."""
    return (start.isNull() | (period >= start)) & (end.isNull() | (period <= end))
