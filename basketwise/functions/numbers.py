"""Money and number expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def round2(amount: Column) -> Column:
    """Two decimals, halves towards plus infinity."""
    return F.floor(amount * 100 + F.lit(0.5)) / F.lit(100.0)


def cents(price: Column) -> Column:
    """Price as a whole number of cents, kept in a double.

    Sums of whole doubles are exact up to 2^53, so totals do not depend on the order
    in which tasks add them up.
    """
    return F.floor(price * 100 + F.lit(0.5)).cast("double")


def from_cents(amount: Column) -> Column:
    """Cents, possibly fractional, rounded once to money."""
    return F.floor(amount + F.lit(0.5)) / F.lit(100.0)


def percent(part: Column, whole: Column) -> Column:
    """Whole percentage, halves up; 0 when there is nothing to compare with."""
    return F.when(whole > 0, F.floor(part / whole * 100 + F.lit(0.5))).otherwise(F.lit(0)).cast("bigint")


def number(text: Column) -> Column:
    """Number written in a text, null when the whole text is not one."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def price_in_text(text: Column) -> Column:
    """Price left after dropping everything but digits and dots; null unless positive."""
    value = number(F.regexp_replace(text, r"[^0-9.]", ""))
    return F.when(value > 0, value)


def is_usable(price: Column) -> Column:
    """A price that exists, is finite and is above zero."""
    return price.isNotNull() & ~F.isnan(price) & (price > 0) & (price < F.lit(float("inf")))


def plain_number(value: Column) -> Column:
    """Number as people write it: no decimals when whole."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
