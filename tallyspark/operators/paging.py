"""Filters, ordering and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.files import PLATFORMS
from ..functions.text import like_pattern

FACT_ORDER = ("order_id", "internal_sku", "line_no", "row_key")
AGG_ORDER = ("internal_sku",)
EXPORT_ORDER = {"fact": ("internal_sku", "order_id", "line_no", "row_key"), "agg": ("internal_sku",)}


def check_request(platform: str, year: int, month: int, user: str) -> tuple[str, int, int, str]:
    """Cleaned request values; raises when one is not allowed. A tenant is always required."""
    name = str(platform).strip().lower()
    if name not in PLATFORMS:
        raise ValueError(f"unknown platform {platform!r}")
    if not user:
        raise ValueError("a user id is required")
    year, month = int(year), int(month)
    if not 1 <= month <= 12:
        raise ValueError("month must be 1 to 12")
    return name, year, month, str(user)


def of_period(table: DataFrame, platform: str, year: int, month: int, user: str) -> DataFrame:
    """Rows of one tenant's platform month; all four are partition columns, so other folders are not read."""
    platform, year, month, user = check_request(platform, year, month, user)
    return table.where(
        (F.col("user_id") == user) & (F.col("platform") == platform)
        & (F.col("year") == year) & (F.col("month") == month)
    )


def sku_like(text: str, columns: Sequence[str] = ("internal_sku",)) -> Column:
    """Case-sensitive substring search over columns, with % and _ as wildcards."""
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.col(name).like(like_pattern(text))
    return hit


def sku_contains(text: str, name: str = "internal_sku") -> Column:
    """Case-insensitive substring search without wildcards."""
    return F.lower(F.col(name)).contains(text.lower())


SEARCH_COLUMNS = ("internal_sku", "fin_code", "order_id")


def check_page(page: int, size: int) -> tuple[int, int]:
    """(offset, limit) of a page; pages start at 1 and hold 10 to 1000 rows, anything else is refused."""
    page, size = int(page), int(size)
    if page < 1 or not 10 <= size <= 1000:
        raise ValueError("pages start at 1 and hold 10 to 1000 rows")
    return (page - 1) * size, size


def _ascending(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]


def page(table: DataFrame, order: Sequence[str | Column], limit: int = 1000, offset: int = 0) -> DataFrame:
    """Rows offset+1 to offset+limit of the ordered table; missing values come last. A page far from the start keeps
    all rows before it in one task: walk with page_after instead."""
    return table.orderBy(*_ascending(order)).offset(offset).limit(limit)


def page_after(table: DataFrame, order: Sequence[str], last: Sequence, limit: int = 1000) -> DataFrame:
    """The page that follows a given row; cost does not grow with the distance from the start. Missing values come last,
    so nothing but ties follows a missing one."""
    beyond = F.lit(False)
    for i, (name, value) in enumerate(zip(order, last)):
        step = F.lit(False) if value is None else (F.col(name) > F.lit(value)) | F.col(name).isNull()
        for earlier, same in zip(order[:i], last[:i]):
            step = step & F.col(earlier).eqNullSafe(F.lit(same))
        beyond = beyond | F.coalesce(step, F.lit(False))
    return table.where(beyond).orderBy(*_ascending(order)).limit(limit)


def page_count(rows: Column, size: int) -> Column:
    return F.ceil(rows / size)


def newest_first(records: DataFrame, time: str, limit: int, offset: int = 0, tie: str = "id") -> DataFrame:
    """Page of records, newest first."""
    return page(records, [F.col(time).desc_nulls_last(), F.col(tie).asc()], limit, offset)


def sorted_by(
    table: DataFrame, name: str, descending: bool = False, locale: bool = False, ties: Sequence[str] = ()
) -> DataFrame:
    """Sort by one column; texts optionally in locale order.

    Equal values are put in the order of ``ties``, which also lets a value that fills many rows be split over
    tasks.
    """
    key = F.collate(F.col(name), "UNICODE") if locale else F.col(name)
    return table.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), *ties)


def by_id(records: DataFrame, value: str, name: str = "id") -> DataFrame:
    return records.where(F.col(name) == value)
