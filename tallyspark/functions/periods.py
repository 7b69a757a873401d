"""Dates, periods and what file names tell about them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_time(value: Column) -> Column:
    """Timestamp of a text, null when it is none."""
    return F.try_to_timestamp(value)


def year_of(value: Column) -> Column:
    return F.year(to_time(value))


def month_of(value: Column) -> Column:
    return F.month(to_time(value))


def in_period(time: Column, year: int, month: int) -> Column:
    """True when the time lies in the period; false for missing times."""
    return F.coalesce((F.year(time) == year) & (F.month(time) == month), F.lit(False))


# The ways a year and a month are written in file names.
YEAR_MONTH = r"(20[0-9]{2}|[0-9]{2})\s*年\s*(1[0-2]|0?[1-9])\s*月"
MONTH_ONLY = r"(1[0-2]|0?[1-9])\s*月"
YEAR_FOUR = r"(20[0-9]{2})"
YEAR_TWO = r"(?:^|[^0-9])([0-9]{2})(?:[^0-9]|$)"


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _full_year(text: Column) -> Column:
    return F.when(F.length(text) == 2, text.cast("int") + 2000).otherwise(text.cast("int"))


def file_period(name: Column) -> tuple[Column, Column]:
    """(year, month) written in a file name; both null unless both are found."""
    text = F.lower(name)
    together_year, together_month = _found(text, YEAR_MONTH, 1), _found(text, YEAR_MONTH, 2)
    lone_month = _found(text, MONTH_ONLY, 1)
    lone_year = F.coalesce(_found(text, YEAR_FOUR, 1), _found(text, YEAR_TWO, 1))
    year_text = F.coalesce(together_year, F.when(lone_month.isNotNull(), lone_year))
    month_text = F.coalesce(together_month, F.when(lone_year.isNotNull(), lone_month))
    return _full_year(year_text), month_text.cast("int")
