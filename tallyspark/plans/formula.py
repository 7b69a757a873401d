"""Spreadsheet rules of the wechat_video settlement: raw lines to fact rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import cents, fits, money, parse_number, round_up, sum_cleaned
from ..functions.periods import month_of, year_of
from ..functions.text import clean_text, column, first_nonblank, left_of_dash
from ..operators.lines import number_lines, on_first_line
from ..operators.validate import row_message
from ..schemas import AMOUNTS

# Rule version, and the headers of the settlement sheet by the letter of their column.
RULE_VERSION = "wxv-2025-11-06"
ORDER = "订单号"
SETTLE_TIME = "订单完成结算时间"
SKU_HEADERS = ("SKU编码(自定义)", "商品编码(自定义)", "商品编码(平台)", "平台商品编码", "商品编码")
HEADERS = {
    "BI": "商品价格",
    "BK": "商品实际价格(总共)",
    "BN": "商品平台券优惠",
    "BT": "商品已退款金额",
    "BM": "商品数量",
    "AI": "订单运费",
    "AS": "技术服务费",
    "AT": "技术服务费（将以人气卡形式返还）",
    "AU": "运费险预计投保费用",
    "BA": "带货费用",
}
DISCOUNTS = {"AJ": "商品优惠", "AK": "跨店优惠", "AL": "商品改价", "AM": "积分抵扣"}
FAILED = "金额超出范围"
STAMPS = ("user_id", "job_id", "upload_id", "platform")


def pick_sku(columns: list[str]) -> Column:
    """First non-blank of the five code columns that exist."""
    return first_nonblank([column(h) for h in SKU_HEADERS if h in columns])


def cells(columns: list[str]) -> dict[str, Column]:
    """The cells that the formulas read, as numbers, by sheet letter. Missing columns count as zero."""

    def cell(header: str) -> Column:
        return parse_number(column(header)) if header in columns else F.lit(0.0)

    numbers = {f"_{letter}": cell(header) for letter, header in HEADERS.items()}
    numbers["_discounts"] = sum_cleaned(*[column(h) for h in DISCOUNTS.values() if h in columns])
    return numbers


def _inputs() -> dict[str, Column]:
    c = F.col
    return {
        "ratio": F.when(c("_BI") == 0, F.lit(0.0)).otherwise((c("_BK") + c("_BN") - c("_BT")) / c("_BI")),
        "customer": c("_BI") * c("_BM") - c("_BT"),
        "discounts": c("_discounts"),
        "freight": c("_AI"),
        "commission": c("_AS") + c("_AT"),
        "affiliate": c("_BA"),
        "insurance": c("_AU"),
    }


def line_amounts() -> dict[str, Column]:
    """What the formulas need of a row whatever its place in the order: quantity, and in cents the customer's part and the charges."""
    given = _inputs()
    sold = round_up(given["ratio"])
    return {
        "qty_sold": sold,
        "recv_customer": F.when(sold == 0, F.lit(0.0)).otherwise(cents(given["customer"])),
        **{f"_{name}": cents(given[name]) for name in ("freight", "commission", "affiliate", "insurance")},
    }


def amounts() -> list[dict[str, Column]]:
    """Formula columns J to O of numbered rows in cents; each step uses columns of the step before."""
    c = F.col
    parts = {
        "recv_platform": F.when(
            (c("qty_sold") > 0) & (c("line_no") == 1), cents(c("_discounts"))
        ).otherwise(cents(-c("_discounts"))),
        "extra_charge": on_first_line(c("_freight")),
        "fee_platform_comm": on_first_line(c("_commission")),
        "fee_affiliate": on_first_line(c("_affiliate")),
        "fee_other": on_first_line(c("_insurance")),
    }
    net = {
        "net_received": cents(
            c("recv_customer") / 100 + c("recv_platform") / 100 + c("extra_charge") / 100
            - c("fee_platform_comm") / 100 - c("fee_affiliate") / 100 - c("fee_other") / 100
        )
    }
    return [parts, net]


def _rows(raw: DataFrame, year: int | None, month: int | None) -> DataFrame:
    """Numbered rows with their amounts, all but the quantity in cents; _large tells which do not fit the money type, _cells holds their text."""
    period = (
        (F.lit(year), F.lit(month)) if year is not None
        else (year_of(column(SETTLE_TIME)), month_of(column(SETTLE_TIME)))
    )
    stamps = [n for n in STAMPS if n in raw.columns]
    headers = [h for h in (*HEADERS.values(), *DISCOUNTS.values()) if h in raw.columns]
    text = [x for h in headers for x in (F.lit(h), column(h).cast("string"))]
    read = raw.select(
        F.coalesce(column(ORDER).cast("string"), F.lit("")).alias("_order"),
        period[0].cast("int").alias("year"), period[1].cast("int").alias("month"),
        pick_sku(raw.columns).alias("_sku"),
        *[value.alias(name) for name, value in cells(raw.columns).items()],
        "source_path", "source_file", "source_line", "file_block", *stamps,
        (F.create_map(*text) if text else F.create_map().cast("map<string,string>")).alias("_text"),
    )
    # Only rows out of range take their text along through the shuffle.
    inside = fits(*_inputs().values())
    read = read.withColumn("_large", ~inside).withColumn("_cells", F.when(~inside, F.col("_text"))).drop("_text")
    read = read.withColumns(line_amounts()).drop(*[n for n in cells(raw.columns) if n != "_discounts"])
    rows = number_lines(read, ["_order", "source_path"], blocks=["file_block"])  # sorted by what differs most first
    for step in amounts():
        rows = rows.withColumns(step)
    return rows


def _checked(rows: DataFrame, fitting: Column | None = None) -> DataFrame:
    """Ids, amounts as money, and the row's message; of rows that may not fit only where they do."""
    def amount(name: str) -> Column:
        value = money(F.col(name) if name == "qty_sold" else F.col(name) / 100)
        return value if fitting is None else F.when(fitting, value)

    named = rows.withColumns(
        {
            "order_id": clean_text(F.col("_order")),
            "internal_sku": F.col("_sku"),
            **{n: amount(n) for n in AMOUNTS},
        }
    ).withColumn("fin_code", left_of_dash(F.col("internal_sku")))
    return named.withColumn("_message", row_message()).withColumns(
        {
            "validation_status": F.when(F.col("_message").isNotNull(), F.lit("warn")).otherwise(F.lit("ok")),
            "validation_warnings": F.when(F.col("_message").isNotNull(), F.array("_message")),
            "rule_version": F.lit(RULE_VERSION),
        }
    )


_FACT = ("year", "month", "order_id", "line_count", "line_no", "internal_sku", "fin_code", *AMOUNTS, "source_file", "source_line",
         "rule_version", "validation_status", "validation_warnings")


def formula_facts(
    raw: DataFrame, year: int | None = None, month: int | None = None, gather: Sequence[str] = (),
) -> DataFrame:
    """Numbered raw lines to facts.

    ``raw`` has the sheet headers plus source_path, source_file, source_line and file_block. The period is the requested
    one, or the month of the settlement time when none is given. Lines are grouped by file and by the order id as written,
    blanks included; the emitted id is trimmed. Rows with a number too large for the money type are counted as lines of
    their order and left to formula_rejects.

    Cells are read before lines are numbered, so the shuffle moves numbers instead of text, and of these only what the formulas
    still need, amounts as whole cents. With ``gather`` rows are gathered by these columns, to be written by them, before their
    amounts become money, which takes twice the bytes.
    """
    inside = _rows(raw, year, month).where("not _large")
    rows = _checked(inside.hint("rebalance", *gather) if gather else inside)
    return rows.select(*_FACT, *[n for n in STAMPS if n in raw.columns])


def formula_rows(raw: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """All rows in one pass, to be written and then split: those of formula_facts with ``reject`` null, those of formula_rejects
    with its message there, without amounts, and with their cells."""
    rows = _checked(_rows(raw, year, month), ~F.col("_large"))
    return rows.select(
        *_FACT, *[n for n in STAMPS if n in raw.columns], F.when(F.col("_large"), F.lit(FAILED)).alias("reject"),
        F.col("_cells").alias("cells"))


def formula_rejects(raw: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """Rows that formula_facts leaves out, with the text of their number cells by header."""
    rows = _rows(raw, year, month).where("_large")
    return rows.select(
        "year", "month", F.col("_order").alias("order_id"), "line_count", "line_no", "source_file", "source_line",
        F.lit(FAILED).alias("message"), F.col("_cells").alias("cells"), *[n for n in STAMPS if n in raw.columns])
