import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import rollup, validate
from tallyspark.plans import formula, ingest, mapping, two_file
from tallyspark.schemas import AMOUNTS, FACT_COLUMNS, META_COLUMNS

H = formula.HEADERS
SHEET = [formula.ORDER, *formula.SKU_HEADERS, formula.SETTLE_TIME, *H.values(), *formula.DISCOUNTS.values()]


def sheet(spark, rows):
    """Rows as dicts of header to cell; file place is added."""
    schema = ", ".join(f"`{h}` string" for h in SHEET) + ", source_path string, source_file string, source_line long, file_block long"
    data = [tuple(r.get(h) for h in SHEET) + ("/f.csv", "f.csv", i, 0) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(data, schema)


def line(order="o1", sku="Z1-S", **cells):
    row = {formula.ORDER: order, formula.SKU_HEADERS[0]: sku}
    row.update({H.get(k, formula.DISCOUNTS.get(k)): v for k, v in cells.items()})
    return row


def facts_of(spark, rows):
    done = formula.formula_facts(sheet(spark, rows), 2024, 10).orderBy("source_line").collect()
    return [{k: (float(v) if k in AMOUNTS else v) for k, v in r.asDict().items()} for r in done]


def test_formula_letters(spark):
    a, b = facts_of(spark, [
        line(BI="¥1,000.00", BK="1900", BN="100", BT="--", BM="2", AJ="5", AK="1.5元", AI="6", AS="20", AT="1", AU="0.5", BA="9"),
        line(BI="10", BK="10", BN="0", BT="", BM="1", AJ="2", AI="6", AS="20"),
    ])
    assert [a[n] for n in AMOUNTS] == [2, 2000, 6.5, 6, 21, 9, 0.5, 1982]
    assert (a["line_no"], a["line_count"], a["year"], a["month"]) == (1, 2, 2024, 10)
    # On later lines order charges are zero and the discounts are taken off.
    assert [b[n] for n in AMOUNTS] == [1, 10, -2, 0, 0, 0, 0, 8]


def test_refunds_and_zero_price(spark):
    whole, over, zero = facts_of(spark, [
        line("a", BI="10", BK="10", BT="10", BM="1", AJ="3"),
        line("b", BI="10", BK="10", BT="35", BM="1"),
        line("c", BI="0", BK="10", BM="1"),
    ])
    assert (whole["qty_sold"], whole["recv_customer"], whole["recv_platform"]) == (0, 0, -3)
    assert (over["qty_sold"], over["recv_customer"]) == (-2, -25)
    assert (zero["qty_sold"], zero["recv_customer"]) == (0, 0)


def test_orders_group_by_the_id_as_written(spark):
    a, b, c = facts_of(spark, [line(" o1 "), line("o1"), line("o1")])
    assert [r["order_id"] for r in (a, b, c)] == ["o1"] * 3
    assert [(r["line_no"], r["line_count"]) for r in (a, b, c)] == [(1, 1), (1, 2), (2, 2)]


def test_status_of_rows(spark):
    rows = [line("a"), line("b", sku="  "), line("", sku="-9"), line("c", BI="9" * 30, BK="1", BM="1"),
            line("d", BI="1" + "0" * 17, BK="1", BM="2")]
    ok, no_sku, no_order, large = facts_of(spark, rows)
    assert (ok["validation_status"], ok["fin_code"], ok["rule_version"]) == ("ok", "Z1", formula.RULE_VERSION)
    assert no_sku["validation_warnings"] == ["缺少必要字段：商家编码"]
    assert (no_order["validation_warnings"], no_order["fin_code"]) == (["缺少必要字段：订单号"], "-9")
    assert (large["order_id"], large["qty_sold"], large["recv_customer"]) == ("d", 1, 2e17)
    rejected = formula.formula_rejects(sheet(spark, rows), 2024, 10).collect()
    assert [(r.order_id, r.source_line, r.message, r.cells[H["BI"]]) for r in rejected] == [("c", 4, formula.FAILED, "9" * 30)]


def test_lines_are_numbered_per_file(spark):
    """One order in three files: each file has its own first line, with the charges of the order."""
    frame = sheet(spark, [line("a", AI="6", BI="1", BK="1", BM="1") for _ in range(6)])
    path = F.concat(F.lit("/f"), (F.col("source_line") % 3).cast("string"))
    facts = formula.formula_facts(frame.withColumn("source_path", path), 2024, 10).orderBy("source_line").collect()
    assert [(r.line_no, r.line_count, float(r.extra_charge)) for r in facts] == [(1, 2, 6)] * 3 + [(2, 2, 0)] * 3


def test_random_rows_keep_the_identity(spark):
    rng = random.Random(1)

    def amount():
        return rng.choice(["", "--", f"{rng.uniform(-50, 900):.2f}", f"¥{rng.uniform(1000, 9e4):,.2f}", f"{rng.randrange(99)}元"])

    rows = [line(f"o{rng.randrange(40)}", f"S{rng.randrange(9)}-x", **{k: amount() for k in [*H, *formula.DISCOUNTS]})
            for _ in range(400)]
    facts = formula.formula_facts(sheet(spark, rows), 2024, 10)
    assert facts.where(~validate.identity_holds()).count() == 0
    rolled = rollup.month_sku(facts, ["internal_sku"])
    assert rolled.where(~validate.sums_identity()).count() == 0
    assert rolled.agg(F.sum("record_count")).first()[0] == 400


def test_fact_table_has_all_columns(spark):
    stamped = ingest.stamp(formula.formula_facts(sheet(spark, [line()]), 2024, 10), platform="wechat_video", user_id="u",
                           upload_id="x", job_id="j")
    table = ingest.fact_table(stamped)
    assert table.columns == [*FACT_COLUMNS, *META_COLUMNS] and len(table.columns) == 26
    assert len(table.first()["row_hash"]) == 64


SAMPLES = {
    "xiaohongshu": ("订单编号,商家编码,财务编码,数量,应收买家,应收平台,附加费用,平台佣金,分销费用,其他费用,结算金额",
                    ["A7,K1,F1,3,180.00,12.00,4.00,25.00,2.00,6.00,163.00", "A8,K2,,1,90.00,0.00,2.50,9.00,0.00,1.50,82.00",
                     "A9,,F3,1,1,0,0,0,0,0,1", "B1,K4,F4,1,70,10,0,8,2,0,61"]),
    "douyin": ("订单号,商品编码,财务编码,购买数量,买家支付金额,平台补贴,附加费用,平台服务费,达人佣金,其他费用,结算金额",
               ["C7,K1,F1,4,260.00,14.00,1.00,31.00,8.00,6.00,230.00", "C8,K2,,2,75.50,0.00,0.50,6.00,2.00,0.00,68.00",
                "C9,,F3,1,1,0,0,0,0,0,1", "E1,K4,F4,1,70,10,0,8,2,0,61"]),
}


def raw_sheet(spark, header, lines):
    names = header.split(",")
    rows = [tuple(v for v in text.split(",")) + ("f.csv", i) for i, text in enumerate(lines, 2)]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names) + ", source_file string, source_line long")


@pytest.mark.parametrize("platform", SAMPLES)
def test_alias_platforms_drop_invalid_rows(spark, platform):
    raw = raw_sheet(spark, *SAMPLES[platform])
    facts, warnings = mapping.sheet_facts(raw, platform, 2024, 10)
    rows = facts.orderBy("source_line").collect()
    assert [r["internal_sku"] for r in rows] == ["K1", "K2"]
    assert rows[1]["fin_code"] == "K2" and rows[0]["line_no"] is None
    messages = [r["message"] for r in warnings.orderBy("source_line").collect()]
    assert messages == ["行4: 缺少必要字段：商家编码", "行5: 应到账金额计算不一致：应为70，实际为61"]


def test_wechat_alias_adjusts_net(spark):
    header = "订单号,商品行数,行号,商品编码,数量,实收金额,平台补贴,附加费用,平台佣金,分销服务费,其他费用,结算金额"
    raw = raw_sheet(spark, header, ["W1,2,1,S1,1,100,0,0,15,0,2,0", "W1,2,,S2,2,200,20,0,33,0,4,183", "W2,1,1,,1,1,0,0,0,0,0,1",
                                    "W3,1,1,S3,1,100,0,0,0,0,0,90"])
    facts, rejected = mapping.adjusted_sheet(raw, 2024, 10)
    a, b, c = facts.orderBy("source_line").collect()
    assert (float(a["net_received"]), a["amount_adjustment_warning"]) == (83, "net_received 原值为 0，已自动调整为计算值 83")
    assert (b["line_no"], b["amount_adjustment_warning"]) == (0, None)
    assert float(c["net_received"]) == 90 and c["amount_adjustment_warning"] is not None
    assert rejected.first()["message"] == "解析错误 - SKU编码不能为空"


def test_sparse_cells(spark):
    raw = spark.createDataFrame([(None, "b"), ("a", "b")], "`订单编号` string, `订单号` string")
    aliases = mapping.XIAOHONGSHU["order_id"]
    assert [r[0] for r in raw.select(mapping.resolve(raw.columns, aliases)).collect()] == [None, "a"]
    assert [r[0] for r in raw.select(mapping.resolve(raw.columns, aliases, sparse=True)).collect()] == ["b", "a"]


def test_fees_by_column_or_type(spark):
    rows = [("佣金", "-10", "", "", ""), ("技术服务费", "-4", None, None, None), ("保险", "2", "", "", ""), ("", "9", "", "", ""),
            ("佣金", "-10", "3", "", "1"), ("x", "", "", "", "")]
    frame = spark.createDataFrame(rows, "`支出类型` string, `收支金额` string, `商品佣金` string, `平台服务费` string, `其他费用` string")
    got = [tuple(r) for r in frame.select(*two_file.classified_fees()).collect()]
    assert got == [(10, 0, 0), (0, 4, 0), (0, 0, 2), (0, 0, 0), (3, 0, 1), (0, 0, 0)]


def test_orders_with_settlements(spark):
    orders = spark.createDataFrame(
        [("1", "M1", "2", "100", "90", "5", "已完成", "2024-10-02 10:00:00"), ("2", "M2", "1", "50", "60", "", "已完成", "2024-10-03"),
         ("3", "M3", "1", "50", "50", "", "部分退款", "2024-10-03"), ("4", "M4", "1", "50", "50", "", "已完成", "bad")],
        "`订单编号` string, `商家SKU编码` string, `购买数量` string, `订单金额` string, `买家实付金额` string, `运费` string, `订单状态` string, `下单时间` string"
    ).withColumns({"SKU编码": F.lit(""), "商品编号": F.lit("N")})
    settled = spark.createDataFrame([("1", "3", "80", "已结算"), ("1", "2", "5", "已结算"), ("1", "9", "9", "待结算"), ("2", "1", "1", "待结算")],
                                    "`订单编号` string, `佣金` string, `结算金额` string, `结算状态` string")
    a, b = two_file.xiaohongshu_orders(orders, settled, 2024, 10).orderBy("order_id").collect()
    assert (a["matched"], float(a["fee_platform_comm"]), float(a["fee_other"]), float(a["net_received"])) == (True, 5, 5, 85)
    assert (b["matched"], float(b["fee_other"]), float(b["net_received"]), b["closure_ok"]) == (False, 0, 50, True)
    _, warned = two_file.split_period(orders, "xiaohongshu", "订单编号", 2024, 10)
    assert [r["message"] for r in warned.collect()] == ["订单 4 的日期 (NaN-NaN) 与请求的处理期间 (2024-10) 不匹配"]


def test_header_check(spark):
    frame = spark.createDataFrame([("1",)], "`订单号` string")
    missing = validate.missing_columns(frame, two_file.REQUIRED_HEADERS[("douyin", "finance")])
    assert missing.count() == 10
