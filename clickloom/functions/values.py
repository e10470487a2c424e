"""Money, ratios and untrusted values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.schemas import MONEY


def money(amount: Column) -> Column:
    """Exact cents: sums stay decimal, so no order of addition changes them."""
    return amount.cast(MONEY)


def money_out(amount: Column) -> Column:
    """Rounded half away from zero on the decimal, then a double for the reader."""
    return F.round(amount, 2).cast("double")


def whole_divide(numerator: Column, denominator: Column) -> Column:
    return F.call_function("div", numerator, denominator)


def rounded_mean(total: Column, count: Column) -> Column:
    """total / count to two places, half up, in whole numbers until the last step."""
    hundredths = whole_divide(total * 200 + count, count * 2)
    return (hundredths / F.lit(100)).cast("double")


def rounded_percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to the nearest whole number, half up."""
    return whole_divide(part * 200 + whole, whole * 2)


def number_or_null(value: Column) -> Column:
    """Not-a-number becomes null."""
    return F.when(~F.isnan(value), value)


def id_or_null(value: Column) -> Column:
    """Text to a whole number, `11.0` included; null where it is not one."""
    exact = value.try_cast("decimal(38,6)")
    return F.when(exact == F.floor(exact), exact).try_cast("long")


def text_or(value: Column, default: Column) -> Column:
    """The default where the text is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), default)
