"""Orders joined with their settlement or finance file: the earlier rule variant of each platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import money, parse_int, parse_prefix_number, round2
from ..functions.periods import in_period, to_time
from ..functions.text import column, first_filled
from ..operators.joins import join_one, known_keys
from ..operators.validate import closure_holds

# Status and expense words of the exports, and the headers each file must have.
SETTLED = "已结算"
CLOSED = {
    "wechat_video": ("已退款", "已取消"),
    "douyin": ("已取消", "已关闭", "退款成功"),
    "xiaohongshu": ("取消", "退款"),
}
COMMISSION_WORD, SERVICE_WORD = "佣金", "服务"
REQUIRED_HEADERS = {
    ("wechat_video", "statement"): (
        "交易时间", "业务流水号", "商户订单号", "交易类型", "收支类型", "收支金额(元)", "收支方式", "商品名称", "备注"),
    ("wechat_video", "order"): (
        "下单时间", "订单号", "商品ID", "商品名称", "规格", "数量", "单价(元)", "订单金额(元)", "买家实付(元)",
        "卖家实收(元)", "佣金(元)", "收支方式", "订单状态"),
    ("douyin", "order"): (
        "订单号", "子订单号", "商品ID", "商品名称", "规格", "SKU编码", "商家SKU编码", "购买数量", "商品单价",
        "订单金额", "优惠金额", "运费", "用户实付金额", "订单状态", "创建时间", "支付时间"),
    ("douyin", "finance"): (
        "订单号", "子订单号", "交易流水号", "收入类型", "支出类型", "收支金额", "收支时间", "结算状态", "商品佣金",
        "平台服务费", "其他费用"),
    ("xiaohongshu", "order"): (
        "订单编号", "商品编号", "商品名称", "商品规格", "SKU编码", "商家SKU编码", "购买数量", "订单金额", "优惠金额",
        "运费", "买家实付金额", "订单状态", "下单时间"),
    ("xiaohongshu", "settlement"): (
        "订单编号", "结算单号", "结算时间", "商品名称", "商品金额", "佣金", "结算金额", "结算状态"),
}


def is_open(status: Column, platform: str) -> Column:
    """False for cancelled and refunded orders; xiaohongshu looks for the words inside the status."""
    words = CLOSED[platform]
    if platform == "xiaohongshu":
        closed = F.lit(False)
        for word in words:
            closed = closed | status.contains(word)
    else:
        closed = status.isin(*words)
    return ~F.coalesce(closed, F.lit(False))


def order_time(platform: str) -> Column:
    """Time that places an order in a period; douyin prefers the payment over the creation."""
    if platform == "douyin":
        return to_time(first_filled([column("支付时间"), column("创建时间")]))
    return to_time(column("下单时间"))


def split_period(orders: DataFrame, platform: str, order: str, year: int, month: int) -> tuple[DataFrame, DataFrame]:
    """(open orders of the period, warnings for open orders outside of it)."""
    timed = orders.where(is_open(column("订单状态"), platform)).withColumn("_time", order_time(platform))
    inside = in_period(F.col("_time"), year, month)
    found = F.concat_ws(
        "-", F.coalesce(F.year("_time").cast("string"), F.lit("NaN")),
        F.coalesce(F.month("_time").cast("string"), F.lit("NaN")),
    )
    text = F.concat(
        F.lit("订单 "), column(order), F.lit(" 的日期 ("), found,
        F.lit(f") 与请求的处理期间 ({year}-{month}) 不匹配"),
    )
    warnings = timed.where(~inside).select(column(order).alias("order_id"), text.alias("message"))
    return timed.where(inside).drop("_time"), warnings


def _facts(rows: DataFrame, values: dict[str, Column], year: int, month: int) -> DataFrame:
    """Fact row of one line per order; closure_ok tells whether the amounts add up."""
    amounts = ("qty_sold", "recv_customer", "recv_platform", "extra_charge",
               "fee_platform_comm", "fee_affiliate", "fee_other", "net_received")
    built = rows.select(
        F.lit(year).cast("int").alias("year"), F.lit(month).cast("int").alias("month"),
        values["order_id"].alias("order_id"),
        F.lit(1).alias("line_count"), F.lit(1).alias("line_no"),
        values["internal_sku"].alias("internal_sku"), values["internal_sku"].alias("fin_code"),
        *[money(round2(values.get(name, F.lit(0.0)))).alias(name) for name in amounts],
        *[n for n in ("source_file", "source_line", "matched", "unmatched_message") if n in rows.columns],
    )
    return built.withColumn("closure_ok", F.coalesce(closure_holds(), F.lit(False)))


def wechat_orders(orders: DataFrame, year: int, month: int) -> DataFrame:
    """One file: platform receivable is the seller's share plus commission, net is the seller's share."""
    kept, _ = split_period(orders, "wechat_video", "订单号", year, month)

    def number(header: str) -> Column:
        # An empty cell counts as 0; other text that is no number leaves the amount empty.
        cell = column(header)
        return F.when(F.coalesce(F.trim(cell), F.lit("")) == "", F.lit(0.0)).otherwise(cell.try_cast("double"))

    seller, commission = number("卖家实收(元)"), number("佣金(元)")
    values = {
        "order_id": column("订单号"),
        "internal_sku": column("商品ID").cast("string"),
        "qty_sold": number("数量"),
        "recv_customer": number("买家实付(元)"),
        "recv_platform": seller + commission,
        "fee_platform_comm": commission,
        "net_received": seller,
    }
    return _facts(kept, values, year, month)


def settled_totals(settlements: DataFrame) -> DataFrame:
    """Commission and settlement amount of the settled rows, one row per order."""
    return settlements.where(column("结算状态") == SETTLED).groupBy(column("订单编号").alias("_order")).agg(
        F.lit(True).alias("_found"),
        F.sum(money(round2(parse_prefix_number(column("佣金"))))).cast("double").alias("_commission"),
        F.sum(money(round2(parse_prefix_number(column("结算金额"))))).cast("double").alias("_settled"),
    )


def xiaohongshu_orders(orders: DataFrame, settlements: DataFrame, year: int, month: int) -> DataFrame:
    """Orders with the totals of their settled rows; unsettled orders use a formula for the net amount.

    The totals hold one row per order, so a large order on the left never multiplies.
    """
    kept, _ = split_period(orders, "xiaohongshu", "订单编号", year, month)
    keyed = kept.withColumn("_order", column("订单编号"))
    missing = F.concat(F.lit("订单 "), column("订单编号"), F.lit(" 没有找到已结算的结算记录"))
    joined = join_one(keyed, settled_totals(settlements), ["_order"]).withColumns(
        {"matched": F.col("_found").isNotNull(), "unmatched_message": F.when(F.col("_found").isNull(), missing),
         "_commission": F.coalesce("_commission", F.lit(0.0)),
         "_settled": F.coalesce("_settled", F.lit(0.0))}
    )
    amount, paid = parse_prefix_number(column("订单金额")), parse_prefix_number(column("买家实付金额"))
    other = F.greatest(amount - paid - F.col("_commission"), F.lit(0.0))
    values = {
        "order_id": column("订单编号"),
        "internal_sku": first_filled([column("商家SKU编码"), column("SKU编码"), column("商品编号")]),
        "qty_sold": F.coalesce(parse_int(column("购买数量")).cast("double"), F.lit(0.0)),
        "recv_customer": paid,
        "recv_platform": amount,
        "extra_charge": parse_prefix_number(column("运费")),
        "fee_platform_comm": F.col("_commission"),
        "fee_other": other,
        "net_received": F.when(F.col("matched"), F.col("_settled")).otherwise(amount - F.col("_commission") - other),
    }
    return _facts(joined, values, year, month)


def classified_fees() -> tuple[Column, Column, Column]:
    """(commission, platform fee, other fee) of one finance row.

    The three fee columns count when any is filled, else the expense type decides where the amount goes.
    """
    def filled(header: str) -> Column:
        return F.coalesce(column(header), F.lit("")) != ""

    def size(header: str) -> Column:
        return F.abs(parse_prefix_number(column(header)))

    kind = F.coalesce(column("支出类型"), F.lit(""))
    by_column = filled("商品佣金") | filled("平台服务费") | filled("其他费用")
    is_commission = kind.contains(COMMISSION_WORD)
    is_service = ~is_commission & kind.contains(SERVICE_WORD)
    is_other = ~is_commission & ~is_service & (kind != "") & filled("收支金额")

    def fee(header: str, chosen: Column) -> Column:
        return F.when(by_column, F.when(filled(header), size(header)).otherwise(F.lit(0.0))).otherwise(
            F.when(chosen, size("收支金额")).otherwise(F.lit(0.0))
        )

    return fee("商品佣金", is_commission), fee("平台服务费", is_service), fee("其他费用", is_other)


def sub_order() -> Column:
    return F.coalesce(column("子订单号"), F.lit(""))


def finance_totals(finance: DataFrame) -> DataFrame:
    """Classified fees, one row per order and sub-order."""
    commission, platform, other = classified_fees()
    return finance.groupBy(column("订单号").alias("_order"), sub_order().alias("_sub")).agg(
        F.lit(True).alias("_found"),
        F.sum(money(round2(commission))).cast("double").alias("_commission"),
        F.sum(money(round2(platform))).cast("double").alias("_platform_fee"),
        F.sum(money(round2(other))).cast("double").alias("_other_fee"),
    )


def douyin_orders(orders: DataFrame, finance: DataFrame, year: int, month: int) -> DataFrame:
    """Orders with the classified fees of their order and sub-order."""
    kept, _ = split_period(orders, "douyin", "订单号", year, month)
    keyed = kept.withColumns({"_order": column("订单号"), "_sub": sub_order()})
    named = F.when(sub_order() != "", F.concat(F.lit("(子订单 "), sub_order(), F.lit(")"))).otherwise(F.lit(""))
    missing = F.concat(F.lit("订单 "), column("订单号"), F.lit(" "), named, F.lit(" 没有找到财务记录"))
    joined = join_one(keyed, finance_totals(finance), ["_order", "_sub"]).withColumns(
        {"matched": F.col("_found").isNotNull(), "unmatched_message": F.when(F.col("_found").isNull(), missing),
         **{n: F.coalesce(n, F.lit(0.0)) for n in ("_commission", "_platform_fee", "_other_fee")}}
    )
    paid = parse_prefix_number(column("用户实付金额"))
    sub = F.when(sub_order() != "", F.concat(F.lit("-"), sub_order())).otherwise(F.lit(""))
    values = {
        "order_id": F.concat(column("订单号"), sub),
        "internal_sku": first_filled([column("商家SKU编码"), column("SKU编码"), column("商品ID")]),
        "qty_sold": F.coalesce(parse_int(column("购买数量")).cast("double"), F.lit(0.0)),
        "recv_customer": paid,
        "recv_platform": paid,
        "extra_charge": parse_prefix_number(column("运费")),
        "fee_platform_comm": F.col("_commission"),
        "fee_other": F.col("_platform_fee") + F.col("_other_fee"),
        "net_received": paid - F.col("_commission") - F.col("_platform_fee") - F.col("_other_fee"),
    }
    return _facts(joined, values, year, month)


def order_warnings(facts: DataFrame) -> DataFrame:
    """Message rows of the facts of a two-file rule: no row in the other file, amounts that do not close."""
    unclosed = F.concat(F.lit("订单 "), F.col("order_id"), F.lit(" 的金额计算不闭环"))
    messages = [F.when(~F.col("closure_ok"), unclosed)]
    if "unmatched_message" in facts.columns:
        messages.insert(0, F.col("unmatched_message"))
    place = [n for n in ("source_file", "source_line") if n in facts.columns]
    return facts.select(*place, "order_id", F.explode(F.array_compact(F.array(*messages))).alias("message"))


def unsettled_orders(orders: DataFrame, settlements: DataFrame, year: int, month: int) -> DataFrame:
    """Open xiaohongshu orders of the period without a settled row; pending rows do not count."""
    kept, _ = split_period(orders, "xiaohongshu", "订单编号", year, month)
    settled = settlements.where(column("结算状态") == SETTLED)
    return unmatched_orders(kept, settled, {"订单编号": "订单编号"})


def without_finance(orders: DataFrame, finance: DataFrame, year: int, month: int) -> DataFrame:
    """Open douyin sub-orders of the period without a finance row."""
    kept, _ = split_period(orders, "douyin", "订单号", year, month)
    return unmatched_orders(kept, finance, {"订单号": "订单号", "子订单号": "子订单号"})


def unmatched_orders(orders: DataFrame, other: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Orders without any row in the other file; ``keys`` maps order columns to columns of the other file."""
    names = [f"_{i}" for i in range(len(keys))]
    left = orders.withColumns({n: F.coalesce(column(a), F.lit("")) for n, a in zip(names, keys)})
    right = other.select(*[F.coalesce(column(b), F.lit("")).alias(n) for n, b in zip(names, keys.values())])
    return join_one(left, known_keys(right, names), names, "left_anti").drop(*names)


def match_ratio(orders: DataFrame, other: DataFrame, key: str, other_key: str, by: list[str]) -> DataFrame:
    """Per group: orders, those without a row in the other file, and their share."""
    known = known_keys(other.select(column(other_key).alias("_key")), ["_key"]).withColumn("_found", F.lit(True))
    joined = join_one(orders.withColumn("_key", column(key)), known, ["_key"])
    missed = F.count_if(F.col("_found").isNull())
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("orders"), missed.alias("missed"),
        (missed / F.count(F.lit(1))).alias("miss_ratio"),
    )


def complete_sku(lines: DataFrame, orders: DataFrame, keys: list[str], sku: str = "internal_sku") -> DataFrame:
    """Fill missing SKUs of settlement lines from the orders; the smallest SKU wins when orders differ."""
    known = orders.where(F.coalesce(F.col(sku), F.lit("")) != "").groupBy(*keys).agg(F.min(sku).alias("_sku"))
    joined = join_one(lines, known, keys)
    return joined.withColumn(sku, F.coalesce(F.nullif(F.col(sku), F.lit("")), F.col("_sku"))).drop("_sku")
