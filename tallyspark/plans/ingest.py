"""Facts with their stamps, ready to be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import row_hash, row_key
from ..schemas import FACT_COLUMNS, META_COLUMNS
from .formula import formula_rows
from .mapping import SHEETS, sheet_rows, tidy_douyin
from .two_file import douyin_orders, xiaohongshu_orders


def stamp(facts: DataFrame, **stamps: Column | str) -> DataFrame:
    """Add tenant, platform, upload and job where given, the row key and the content hash."""
    given = {n: v if isinstance(v, Column) else F.lit(v) for n, v in stamps.items()}
    stamped = facts.withColumns(given) if given else facts
    return stamped.withColumns(
        {
            "row_key": row_key(F.col("platform"), F.col("order_id"), F.col("internal_sku"), F.col("line_no")),
            "row_hash": row_hash(),
        }
    )


def fact_table(facts: DataFrame) -> DataFrame:
    """The 26 fact columns in order; columns a platform does not have are null, warnings are JSON."""
    empty = {n: F.lit(None).cast("string") for n in META_COLUMNS if n not in facts.columns}
    full = facts.withColumns(empty) if empty else facts
    if dict(full.dtypes)["validation_warnings"].startswith("array"):
        full = full.withColumn("validation_warnings", F.to_json("validation_warnings"))
    return full.select(*FACT_COLUMNS, *META_COLUMNS)


def two_file_facts(orders: DataFrame, other: DataFrame, platform: str, year: int, month: int) -> DataFrame:
    """Facts of orders joined with their settlement or finance file, with status and warnings, unstamped."""
    rules = {"xiaohongshu": xiaohongshu_orders, "douyin": douyin_orders}
    if platform not in rules:
        raise ValueError(f"no two-file rules for platform {platform!r}")
    facts = rules[platform](orders, other, year, month)
    unclosed = F.when(~F.col("closure_ok"), F.concat(F.lit("订单 "), F.col("order_id"), F.lit(" 的金额计算不闭环")))
    warnings = F.array_compact(F.array(F.col("unmatched_message"), unclosed))
    return facts.withColumns({
        "validation_warnings": F.when(F.size(warnings) > 0, warnings),
        "validation_status": F.when(F.size(warnings) > 0, F.lit("warn")).otherwise(F.lit("ok")),
    }).drop("matched", "unmatched_message", "closure_ok")


def settlement_rows(raw: DataFrame, platform: str, year: int | None, month: int | None) -> DataFrame:
    """Every row by the live rules of its platform, unstamped, with ``reject``: null for facts, else what is wrong."""
    if platform == "wechat_video":
        return formula_rows(raw, year, month).drop("cells")
    if platform not in SHEETS:
        raise ValueError(f"no rules for platform {platform!r}")
    return sheet_rows(tidy_douyin(raw) if platform == "douyin" else raw, platform, year, month)


def settlement_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, rejected rows as source_file, source_line and message) of written settlement rows."""
    rejects = rows.where("reject is not null").select("source_file", "source_line", F.col("reject").alias("message"))
    return rows.where("reject is null").drop("reject"), rejects
