"""Row and aggregate checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import MONEY, shortest_text

# Messages, in the order in which a row is checked.
REQUIRED_MESSAGES = {
    "year": "缺少必要字段：年份",
    "month": "缺少必要字段：月份",
    "order_id": "缺少必要字段：订单号",
    "internal_sku": "缺少必要字段：商家编码",
    "fin_code": "缺少必要字段：财务核算编码",
    "qty_sold": "缺少必要字段：销售数量",
    "recv_customer": "缺少必要字段：应收客户",
    "recv_platform": "缺少必要字段：应收平台",
    "extra_charge": "缺少必要字段：价外收费",
    "fee_platform_comm": "缺少必要字段：平台佣金",
    "fee_affiliate": "缺少必要字段：分销佣金",
    "fee_other": "缺少必要字段：其它费用",
    "net_received": "缺少必要字段：应到账金额",
}
NUMBER_MESSAGES = {
    "qty_sold": "数量必须是数字",
    "recv_customer": "应收买家必须是数字",
    "recv_platform": "应收平台必须是数字",
    "extra_charge": "价外收费必须是数字",
    "fee_platform_comm": "平台佣金必须是数字",
    "fee_affiliate": "分销佣金必须是数字",
    "fee_other": "其他费用必须是数字",
    "net_received": "结算金额必须是数字",
}
EMPTY_MESSAGES = {"order_id": "订单号不能为空", "internal_sku": "SKU编码不能为空"}
_TEXTS = ("order_id", "internal_sku", "fin_code")

TOLERANCE = 0.02


def computed_net() -> Column:
    """I + J + K - L - M - N."""
    return (
        F.col("recv_customer") + F.col("recv_platform") + F.col("extra_charge")
        - F.col("fee_platform_comm") - F.col("fee_affiliate") - F.col("fee_other")
    )


def _missing(name: str) -> Column:
    absent = F.col(name).isNull()
    return absent | (F.col(name) == "") if name in _TEXTS else absent


def required_message(fields: Mapping[str, str] = REQUIRED_MESSAGES) -> Column:
    """Message of the first required field that is missing, else null."""
    return F.coalesce(*[F.when(_missing(name), F.lit(text)) for name, text in fields.items()])


def identity_holds(tolerance: float = TOLERANCE) -> Column:
    """Net received equals the sum of its parts, up to the tolerance."""
    gap = F.abs(computed_net() - F.col("net_received"))
    return gap <= F.lit(tolerance).cast("decimal(18,4)")


def identity_message(tolerance: float = TOLERANCE) -> Column:
    text = F.concat(
        F.lit("应到账金额计算不一致：应为"), shortest_text(computed_net()),
        F.lit("，实际为"), shortest_text(F.col("net_received")),
    )
    return F.when(~identity_holds(tolerance), text)


def row_message(tolerance: float = TOLERANCE) -> Column:
    """First failing check of a fact row, else null."""
    return F.coalesce(required_message(), identity_message(tolerance))


def closure_holds(tolerance: float = 0.01) -> Column:
    """Variant without the customer part: J + K - L - M - N equals net received."""
    net = (
        F.col("recv_platform") + F.col("extra_charge")
        - F.col("fee_platform_comm") - F.col("fee_affiliate") - F.col("fee_other")
    )
    return F.abs(net - F.col("net_received")) <= F.lit(tolerance).cast("decimal(18,4)")


def number_message() -> Column:
    """Variant that checks doubles for NaN, empty ids first; null when all is well."""
    empty = [F.when(_missing(n), F.lit(t)) for n, t in EMPTY_MESSAGES.items()]
    nan = [F.when(F.isnan(n) | F.col(n).isNull(), F.lit(t)) for n, t in NUMBER_MESSAGES.items()]
    return F.coalesce(*empty, *nan)


def computed_once(table: DataFrame) -> DataFrame:
    """The same rows, with all columns computed before later filters test them.

    A filter on a computed column is otherwise moved below the projection and repeats its whole expression.
    """
    return table.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in table.columns]))))


def line_warning(message: Column) -> Column:
    """The message with the number of its line; null without one."""
    return F.concat(F.lit("行"), F.col("source_line").cast("string"), F.lit(": "), message)


def split_valid(facts: DataFrame, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(facts that pass, warnings of those that do not); the two never share a row."""
    checked = computed_once(facts.withColumn("message", row_message(tolerance)))
    warnings = checked.where("message is not null").select(
        "source_file", "source_line", line_warning(F.col("message")).alias("message"))
    return checked.where("message is null").drop("message"), warnings


def adjusted_net() -> tuple[Column, Column]:
    """(net received, warning): a zero net takes the computed one, a differing net is kept with a warning."""
    net, computed = F.col("net_received"), computed_net()
    fill = (net == 0) & (computed != 0)
    differs = (F.abs(computed - net) > F.lit(TOLERANCE).cast("decimal(18,4)")) & (net != 0)
    warning = (
        F.when(fill, F.concat(F.lit("net_received 原值为 0，已自动调整为计算值 "), shortest_text(computed)))
        .when(differs, F.concat(
            F.lit("应到账金额计算不一致：应为"), shortest_text(computed), F.lit("，实际为"), shortest_text(net)))
    )
    return F.when(fill, computed).otherwise(net).cast(MONEY), warning


def sums_identity(tolerance: float = TOLERANCE) -> Column:
    """income - commission - other fees equals net received."""
    gap = (
        F.col("income_total_sum") - F.col("fee_platform_comm_sum")
        - F.col("fee_other_sum") - F.col("net_received_sum")
    )
    return F.abs(gap) <= F.lit(tolerance).cast("decimal(18,4)")


def duplicate_keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def missing_names(table: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that the table lacks."""
    return [name for name in required if name not in table.columns]


def missing_columns(table: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required column that the table lacks."""
    absent = missing_names(table, required)
    return table.sparkSession.createDataFrame([(name,) for name in absent], "missing string")


def record_problems(records: DataFrame, required: Sequence[str], legacy: Sequence[str], prefix: str) -> DataFrame:
    """Per record: missing required fields, present legacy fields, and whether the id has the prefix."""
    def absent(name):
        return F.col(name).isNull() if name in records.columns else F.lit(True)

    missing = F.array_compact(F.array(*[F.when(absent(n), F.lit(n)) for n in required]))
    old = [F.when(F.col(n).isNotNull(), F.lit(n)) for n in legacy if n in records.columns]
    found = F.array_compact(F.array(*old)) if old else F.array().cast("array<string>")
    return records.select(
        "id", missing.alias("missing_fields"), found.alias("legacy_fields"),
        F.coalesce(F.col("id").startswith(prefix), F.lit(False)).alias("id_ok"),
    )


def freight_conserved(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per order: allocated charges, the original positive freight, and whether they agree."""
    return facts.where("order_freight > 0").groupBy(*keys).agg(
        F.sum(F.col("extra_charge").cast("decimal(18,2)")).alias("allocated"),
        F.max(F.col("order_freight").cast("decimal(18,2)")).alias("freight"),
    ).withColumn("conserved", F.col("allocated") == F.col("freight"))


def quality_metrics(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Identity failures and the share of rows without a SKU."""
    failed = ~F.coalesce(identity_holds(), F.lit(False))
    return facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(failed).alias("identity_failures"),
        F.avg(F.when(F.coalesce(F.col("internal_sku"), F.lit("")) == "", 1.0).otherwise(0.0)).alias("empty_sku_ratio"),
    )


def consistency(totals: DataFrame, computed: Column, actual: Column, tolerance: float = TOLERANCE) -> DataFrame:
    """Add consistency_check and consistency_error to a one-row summary."""
    gap = F.abs(computed - actual)
    ok = gap <= F.lit(tolerance).cast("decimal(18,4)")
    text = F.concat(
        F.lit("金额不一致: 计算值="), shortest_text(computed), F.lit(", 实际值="), shortest_text(actual),
        F.lit(", 差异="), shortest_text(gap),
    )
    return totals.withColumns(
        {"consistency_check": ok, "consistency_error": F.when(~ok, text)}
    )


