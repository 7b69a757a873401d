"""Number cleaning, rounding and number text as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(28, 2)

LIMIT = 1e25  # of one amount, so that the sum of a row's amounts fits as well

# Fixed value: the distance from 1.0 to the next double, added before rounding.
EPSILON = 2.220446049250313e-16

_PLAIN_NUMBER = r"^-?[0-9]+(\.[0-9]*)?$"
_NUMBER_PREFIX = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)"


def parse_number(value: Column, default: float = 0.0) -> Column:
    """Number held in dirty text: keep digits, dot and minus, then read the longest number prefix."""
    text = value.cast("string")
    # Most cells are plain numbers and need no cleaning. The others are cleaned to a valid number or to nothing,
    # so no cast ever has to fail.
    kept = F.regexp_replace(text, "[^0-9.-]+", "")
    prefix = F.regexp_extract(kept, _NUMBER_PREFIX, 0)
    # Cells without a digit are told first: the cast of an empty prefix would raise, and catch, an exception for each.
    number = F.when(text.rlike(_PLAIN_NUMBER), text.cast("double")).when(text.rlike("[0-9]"), prefix.try_cast("double"))
    return F.coalesce(number, F.lit(float(default)))


def parse_prefix_number(value: Column, default: float = 0.0) -> Column:
    """Number at the start of a text, without removing anything first."""
    text = F.regexp_extract(value.cast("string"), r"^\s*([-+]?([0-9]+\.?[0-9]*|\.[0-9]+))", 1)
    return F.coalesce(F.nullif(text, F.lit("")).cast("double"), F.lit(float(default)))


def parse_int(value: Column) -> Column:
    """Truncating integer prefix of a text; null when there is none."""
    text = F.regexp_extract(value.cast("string"), r"^\s*([-+]?[0-9]+)", 1)
    return F.nullif(text, F.lit("")).try_cast("int")


def _whole(value: Column, rounded: Column) -> Column:
    """The rounded value; doubles from 2**52 on are whole already, and too large for Spark's integer rounding."""
    return F.when(F.abs(value) < F.lit(float(2**52)), rounded.cast("double")).otherwise(value)


def cents(value: Column) -> Column:
    """A hundred times the value rounded to two decimals, halves toward positive infinity. Whole numbers, so that a shuffle, which
    compresses rows, moves fewer bytes than of the rounded value."""
    exact = (value + F.lit(EPSILON)) * 100
    return _whole(exact, F.floor(exact + F.lit(0.5)))


def round2(value: Column) -> Column:
    """Two decimals, halves toward positive infinity."""
    return cents(value) / 100


def round_up(value: Column, digits: int = 0) -> Column:
    """Ceiling at the given number of digits, also for negative values."""
    base = 10**digits
    return _whole(value * base, F.ceil(value * base)) / base


def money(value: Column) -> Column:
    """Cast to the money type, which holds numbers below 1e26. Rows with larger ones belong to the rejects: see fits."""
    return value.try_cast(MONEY)


def fits(*values: Column) -> Column:
    """True when no number is too large for the money type; an empty value is not too large."""
    small = F.lit(True)
    for value in values:
        small = small & F.coalesce(F.abs(value) < F.lit(LIMIT), value.isNull())
    return small


def clean_money(value: Column) -> Column:
    """Dirty text to money."""
    return money(round2(parse_number(value)))


def sum_cleaned(*values: Column) -> Column:
    """Sum of cells, each cleaned, added from left to right."""
    return reduce(lambda a, b: a + b, (parse_number(v) for v in values), F.lit(0.0))


def or_zero(value: Column) -> Column:
    """Null and NaN count as zero."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def money_or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast(MONEY))


def export_text(value: Column) -> Column:
    """Integers bare, everything else with two decimals; takes money values."""
    return F.when(value == F.floor(value), value.cast("decimal(36,0)").cast("string")).otherwise(
        value.cast("string")
    )


def fixed2_text(value: Column) -> Column:
    """Always two decimals."""
    return value.cast("decimal(38,2)").cast("string")


def shortest_text(value: Column) -> Column:
    """Shortest decimal text of a money value: 100.00 becomes 100, 0.50 becomes 0.5."""
    return F.rtrim(F.rtrim(value.cast(MONEY).cast("string"), F.lit("0")), F.lit("."))


def currency_text(value: Column) -> Column:
    """Thousands separators and two decimals."""
    return F.format_number(value, 2)


def number_text(value: Column) -> Column:
    """Thousands separators and up to three decimals."""
    return F.call_function("format_number", value, F.lit("#,##0.###"))


def three_segment_qty(qty: Column) -> Column:
    """Positive stays, down to above -30 counts as zero, -30 and below as one return."""
    return F.when(qty > 0, qty).when(qty > -30, F.lit(0)).otherwise(F.lit(-1))
