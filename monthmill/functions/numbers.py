"""Scalar number helpers built from JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded(value: Column, digits: int = 4) -> Column:
    """Half-up rounding by plain double arithmetic, so every engine gives the same digits."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def snapped(value: Column) -> Column:
    """Drops the noise of the last bits, so that exact halves round the same way everywhere."""
    return F.rint(value * F.lit(1e7)) / F.lit(1e7)


def hundredths(value: Column) -> Column:
    """The value in whole hundredths; sums of these are exact in any order."""
    return F.floor(value * F.lit(100.0) + F.lit(0.5))


def safe_div(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def amount(text: Column) -> Column:
    """Finite and not negative, else null."""
    value = text.try_cast("double")
    return F.when((value >= 0) & ~F.isnan(value) & (value < F.lit(float("inf"))), value)


def non_negative(value: Column, digits: int = 2) -> Column:
    return rounded(F.greatest(F.lit(0.0), value), digits)
