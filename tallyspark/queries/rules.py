"""Sheets mapped by header aliases, filters on orders, and header checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.files import normal_platform
from ..operators.validate import identity_holds, missing_names, required_message
from ..plans import formula, mapping, two_file
from ..plans.two_file import REQUIRED_HEADERS
from ..schemas import FACT_COLUMNS
from . import duck, inputs
from .registry import query

C = inputs.cents
_NET = "l_extendedprice - l_extendedprice * 0.05 - 1.25"
# Net amounts that differ from the sum of their parts by nothing, one, two or three cents, or five.
_SETTLED = (
    f"case when l_suppkey % 5 = 4 then concat('', {C(_NET)} + cast(5 as decimal(18,2))) "
    f"else concat('', {C(_NET)} + cast(l_suppkey % 5 as decimal(18,2)) / 100) end"
)
# (header, name in SQL, expression); headers are a mix of first and later spellings.
XHS = [
    ("订单号", "order_raw", "concat(' ', l_orderkey, ' ')"),
    ("商家编码", "sku_raw", "case when l_partkey % 40 = 7 then '' else concat('P', l_partkey) end"),
    ("Fin Code", "fin_raw", "case when l_partkey % 3 = 0 then '' when l_partkey % 3 = 1 then nullif('', '') else concat('F', l_partkey) end"),
    ("数量", "qty", "concat('', cast(l_quantity as bigint))"),
    ("应收买家", "cust", f"concat('￥', {C('l_extendedprice')})"),
    ("Platform Amount", "plat", "'--'"),
    ("价外收费", "extra", "''"),
    ("平台佣金", "comm", f"concat('', {C('l_extendedprice * 0.05')})"),
    ("Affiliate Fee", "aff", "'1.00'"),
    ("其他费用", "other", "'0.25'"),
    ("结算金额", "net", _SETTLED),
]
DOUYIN = [
    ("订单号", "order_raw", "concat('', l_orderkey)"),
    ("SKU", "sku_raw", "case when l_partkey % 40 = 7 then nullif('', '') else concat('P', l_partkey) end"),
    ("财务编码", "fin_raw", "case when l_partkey % 3 = 0 then '' else concat('F', l_partkey) end"),
    ("Qty", "qty", "concat('', cast(l_quantity as bigint))"),
    ("买家支付金额", "cust", f"concat('', {C('l_extendedprice')}, '元')"),
    ("Platform Subsidy", "plat", "'0'"),
    ("附加费用", "extra", "nullif('', '')"),
    ("平台服务费", "comm", f"concat('', {C('l_extendedprice * 0.05')})"),
    ("KOL Commission", "aff", "'1.00'"),
    ("Other Fee", "other", "'0.25'"),
    ("结算金额", "net", _SETTLED),
]
WECHAT = [
    ("订单号", "order_raw", "concat('', l_orderkey)"),
    ("行数", "lc", "case when l_linenumber = 2 then '' else '3' end"),
    ("商品行号", "ln", "case when l_linenumber = 3 then nullif('', '') else concat('', l_linenumber) end"),
    ("商家编码", "sku_raw", "case when l_partkey % 40 = 7 then ' ' else concat('P', l_partkey) end"),
    ("核算编码", "fin_raw", "case when l_partkey % 3 = 0 then '' else concat('F', l_partkey) end"),
    ("商品数量", "qty", "concat('', cast(l_quantity as bigint))"),
    ("应收买家", "cust", f"concat('', {C('l_extendedprice')})"),
    ("补贴金额", "plat", "'0'"),
    ("运费", "extra", "'x'"),
    ("技术服务费", "comm", f"concat('', {C('l_extendedprice * 0.05')})"),
    ("带货费用", "aff", "'1.00'"),
    ("杂费", "other", "'0.25'"),
    ("到账金额", "net", f"case when l_suppkey % 7 = 0 then '0' else {_SETTLED} end"),
]
YEAR, MONTH = 2024, 10


def sheet(spark, sf_dir, columns):
    return inputs.derive(inputs.lineitem(spark, sf_dir), [(h, e) for h, _, e in columns])


def _mapped(columns, lines="cast(null as integer) as line_count, cast(null as integer) as line_no"):
    raw = duck.select([(n, e) for _, n, e in columns])
    cells = (("qty", "qty_sold"), ("cust", "recv_customer"), ("plat", "recv_platform"), ("extra", "extra_charge"),
             ("comm", "fee_platform_comm"), ("aff", "fee_affiliate"), ("other", "fee_other"), ("net", "net_received"))
    return f"""with raw as (select row_number() over () as source_line, {raw} from lineitem),
mapped as (select source_line, cast({YEAR} as integer) as year, cast({MONTH} as integer) as month,
  coalesce(trim(order_raw), '') as order_id, {lines}, coalesce(trim(sku_raw), '') as internal_sku,
  coalesce(trim(coalesce(nullif(fin_raw, ''), sku_raw)), '') as fin_code,
  {", ".join(f"{duck.cell(a)} as {b}" for a, b in cells)} from raw),
judged as (select *, {duck.NET} as calc, case when order_id = '' then '缺少必要字段：订单号'
  when internal_sku = '' then '缺少必要字段：商家编码' when fin_code = '' then '缺少必要字段：财务核算编码'
  when abs({duck.NET} - net_received) > 0.02 then '应到账金额计算不一致：应为' || {duck.short(duck.NET)}
    || '，实际为' || {duck.short('net_received')} end as message from mapped)"""


_VALID = f"\nselect source_line, {duck.FACT_LIST} from judged where message is null"
_WARNED = "\nselect source_line, '行' || source_line || ': ' || message as message from judged where message is not null"


def _alias_facts(platform, columns):
    def run(spark, sf_dir):
        facts, _ = mapping.sheet_facts(sheet(spark, sf_dir, columns), platform, YEAR, MONTH)
        return facts.select("source_line", *FACT_COLUMNS)
    return run


query("p2_xiaohongshu_facts", _mapped(XHS) + _VALID)(_alias_facts("xiaohongshu", XHS))
query("p3_douyin_facts", _mapped(DOUYIN) + _VALID)(_alias_facts("douyin", DOUYIN))


@query("v4_rejected_rows", _mapped(XHS) + _WARNED)
def rejected_rows(spark, sf_dir):
    _, warnings = mapping.sheet_facts(sheet(spark, sf_dir, XHS), "xiaohongshu", YEAR, MONTH)
    return warnings.select("source_line", "message")


_LINES = (
    "cast(" + duck.num("lc") + " as integer) as line_count, cast(" + duck.num("ln") + " as integer) as line_no"
)
_ADJUSTED = _mapped(WECHAT, _LINES) + f"""
select source_line, {", ".join(duck.PLAIN)}, {duck.dbl(*duck.AMOUNTS[:-1])},
  cast(case when net_received = 0 and calc <> 0 then calc else net_received end as double) as net_received,
  case when net_received = 0 and calc <> 0 then 'net_received 原值为 0，已自动调整为计算值 ' || {duck.short('calc')}
    when abs(calc - net_received) > 0.02 and net_received <> 0 then '应到账金额计算不一致：应为' || {duck.short('calc')}
    || '，实际为' || {duck.short('net_received')} end as amount_adjustment_warning
from judged where internal_sku <> ''"""


@query("p4_wechat_alias_facts", _ADJUSTED)
def wechat_alias(spark, sf_dir):
    facts, _ = mapping.adjusted_sheet(sheet(spark, sf_dir, WECHAT), YEAR, MONTH)
    return facts.select("source_line", *FACT_COLUMNS, "amount_adjustment_warning")


@query("p4_wechat_alias_rejects", _mapped(WECHAT, _LINES) +
       "\nselect source_line, '解析错误 - SKU编码不能为空' as message from judged where internal_sku = ''")
def wechat_alias_rejects(spark, sf_dir):
    _, rejected = mapping.adjusted_sheet(sheet(spark, sf_dir, WECHAT), YEAR, MONTH)
    return rejected.select("source_line", "message")


_SPARSE = [("订单编号", "a", "case when l_linenumber % 2 = 0 then concat('A', l_orderkey) else nullif('', '') end"),
           ("订单号", "b", "case when l_linenumber % 3 = 0 then concat('B', l_orderkey) else nullif('', '') end"),
           ("Order No.", "c", "concat('C', l_orderkey)")]


@query("p1_alias_resolution",
       f"with raw as (select row_number() over () as source_line, {duck.select([(n, e) for _, n, e in _SPARSE])} from lineitem)\n"
       "select source_line, a as by_column, coalesce(a, b, c) as by_cell, cast(null as varchar) as absent from raw")
def alias_resolution(spark, sf_dir):
    raw = sheet(spark, sf_dir, _SPARSE)
    aliases = mapping.XIAOHONGSHU["order_id"]
    return raw.select(
        "source_line", mapping.resolve(raw.columns, aliases).alias("by_column"),
        mapping.resolve(raw.columns, aliases, sparse=True).alias("by_cell"),
        mapping.resolve(raw.columns, mapping.XIAOHONGSHU["fee_other"]).alias("absent"))


@query("p6_sku_pick", f"with {duck.RAW}\nselect source_line, coalesce({duck.SKU}, '') as sku from raw")
def sku_pick(spark, sf_dir):
    raw = inputs.wechat_raw(spark, sf_dir)
    return raw.select("source_line", formula.pick_sku(raw.columns).alias("sku"))


_STATUS = {
    "wechat_video": "case when l_returnflag = 'R' then '已退款' when l_returnflag = 'A' and l_linestatus = 'F' then '已取消' else '已完成' end",
    "douyin": "case when l_returnflag = 'R' then '退款成功' when l_returnflag = 'A' and l_linestatus = 'F' then '已关闭' "
              "when l_linenumber = 7 then '已取消' when l_linenumber = 6 then '退款中' else '已完成' end",
    "xiaohongshu": "case when l_returnflag = 'R' then '部分退款' when l_linenumber = 7 then '用户取消' when l_linenumber = 6 then nullif('', '') else '已完成' end",
}
_CLOSED = {
    "wechat_video": "s in ('已退款', '已取消')", "douyin": "s in ('已取消', '已关闭', '退款成功')",
    "xiaohongshu": "contains(s, '取消') or contains(s, '退款')",
}


@query("p11_open_orders", " union all ".join(
    f"select '{p}' as platform, s as status, count(*) as orders from (select {_STATUS[p]} as s from lineitem) "
    f"where not coalesce({_CLOSED[p]}, false) group by s" for p in _STATUS))
def open_orders(spark, sf_dir):
    lines = inputs.read(spark, sf_dir, "lineitem")
    found = [
        lines.select(F.expr(e).alias("status")).where(two_file.is_open(F.col("status"), p))
        .groupBy("status").agg(F.count(F.lit(1)).alias("orders")).select(F.lit(p).alias("platform"), "status", "orders")
        for p, e in _STATUS.items()
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


_TIMES = [("订单号", "concat('', l_orderkey)"), ("订单状态", _STATUS["douyin"]),
          ("支付时间", "case when l_linenumber = 1 then '' when l_linenumber = 2 then nullif('', '') else concat('', cast(l_shipdate as date), ' 10:00:00') end"),
          ("创建时间", "case when l_linenumber = 1 then 'unknown' else concat('1997-05-', 10 + l_suppkey % 10, ' 08:00:00') end")]
_TIMED = ("with raw as (select row_number() over () as source_line, " + duck.select([(f'"{n}"', e) for n, e in _TIMES]) +
          " from lineitem), timed as (select *, try_cast(coalesce(nullif(\"支付时间\", ''), \"创建时间\") as timestamp) as t "
          "from raw where \"订单状态\" not in ('已取消', '已关闭', '退款成功'))")
_INSIDE = f"coalesce(year(t) = {inputs.YEAR} and month(t) = {inputs.MONTH}, false)"


def _split(spark, sf_dir):
    return two_file.split_period(
        inputs.derive(inputs.lineitem(spark, sf_dir), _TIMES), "douyin", "订单号", inputs.YEAR, inputs.MONTH)


@query("p12_orders_of_period", f"{_TIMED}\nselect source_line, \"订单号\" as order_id from timed where {_INSIDE}")
def orders_of_period(spark, sf_dir):
    return _split(spark, sf_dir)[0].select("source_line", F.col("订单号").alias("order_id"))


@query("p12_period_warnings",
       f"{_TIMED}\nselect \"订单号\" as order_id, '订单 ' || \"订单号\" || ' 的日期 (' || coalesce(year(t)::varchar, 'NaN') || '-' "
       f"|| coalesce(month(t)::varchar, 'NaN') || ') 与请求的处理期间 ({inputs.YEAR}-{inputs.MONTH}) 不匹配' as message "
       f"from timed where not {_INSIDE}")
def period_warnings(spark, sf_dir):
    return _split(spark, sf_dir)[1]


_HEADERS = {("douyin", "finance"): ["订单号", "子订单号", "收支金额"], ("xiaohongshu", "settlement"): None}


@query("p14_header_check", "select platform, role, missing, rows from (values "
       + ", ".join(f"('{p}', '{r}', '{h}')" for (p, r), given in _HEADERS.items() for h in REQUIRED_HEADERS[p, r]
                   if given is not None and h not in given)
       + ") t(platform, role, missing), (select count(*) as rows from orders)")
def header_check(spark, sf_dir):
    """Required headers that a sheet lacks, next to its rows; the second sheet has all of them."""
    orders, found = inputs.read(spark, sf_dir, "orders"), None
    for (platform, role), given in _HEADERS.items():
        names = given or REQUIRED_HEADERS[platform, role]
        sheet = orders.select(*[F.col("o_orderkey").cast("string").alias(h) for h in names])
        lacking = F.array(*map(F.lit, missing_names(sheet, REQUIRED_HEADERS[platform, role]))).cast("array<string>")
        one = sheet.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(platform).alias("platform"), F.lit(role).alias("role"), F.explode(lacking).alias("missing"), "rows")
        found = one if found is None else found.unionByName(one)
    return found


_PLATFORM = ("case when l_linenumber = 1 then ' DouYin ' when l_linenumber = 2 then 'XIAOHONGSHU' when l_linenumber = 3 then 'wechat_video' "
             "when l_linenumber = 4 then nullif('', '') else concat('shop', l_suppkey) end")


@query("p15_platform_names",
       f"select p, case when lower(trim(p)) in ('xiaohongshu', 'douyin', 'wechat_video') then lower(trim(p)) end as platform, "
       f"count(*) as rows from (select {_PLATFORM} as p from lineitem) group by all")
def platform_names(spark, sf_dir):
    raw = inputs.read(spark, sf_dir, "lineitem").select(F.expr(_PLATFORM).alias("p"))
    return raw.groupBy("p", normal_platform(F.col("p")).alias("platform")).agg(F.count(F.lit(1)).alias("rows"))


_TIDY_RAW = ("with raw as (select row_number() over () as source_line, "
             "concat('', l_orderkey) as order_id, concat('P', l_partkey) as sku, concat(' ', l_linenumber) as qty from lineitem)\n")


def _douyin_sheet(spark, sf_dir, comment):
    quantity = F.concat(F.lit(" "), F.col("l_linenumber").cast("string"))
    return inputs.lineitem(spark, sf_dir).select(
        *inputs.PLACE,
        F.concat(F.lit(" "), F.col("l_orderkey").cast("string"), F.lit(" \t")).alias("订单号"),
        F.concat(F.lit("P　"), F.col("l_partkey").cast("string"), F.lit("​")).alias("商品编码"),
        (F.when(F.col("source_line") == 2, F.lit("购买的件数")).otherwise(quantity) if comment else quantity).alias("购买数量"))


def _tidied(raw):
    tidy = mapping.tidy_douyin(raw)
    return tidy.select("source_line", F.col("订单号").alias("order_id"), F.col("商品编码").alias("sku"), F.col("购买数量").alias("qty"))


@query("p17_douyin_tidy", _TIDY_RAW + "select source_line, order_id, sku, qty from raw where source_line <> 2")
def douyin_tidy(spark, sf_dir):
    return _tidied(_douyin_sheet(spark, sf_dir, True))


@query("p17_douyin_no_comment", _TIDY_RAW + "select source_line, order_id, sku, qty from raw")
def douyin_no_comment(spark, sf_dir):
    return _tidied(_douyin_sheet(spark, sf_dir, False))


@query("v2_row_identity", _mapped(WECHAT, _LINES) +
       "\nselect source_line, abs(calc - net_received) <= 0.02 as identity_ok, abs(calc - net_received) <= 0.01 as strict_ok "
       "from judged")
def row_identity(spark, sf_dir):
    mapped = mapping.map_sheet(sheet(spark, sf_dir, WECHAT), "wechat_video", YEAR, MONTH)
    return mapped.select("source_line", identity_holds().alias("identity_ok"), identity_holds(0.01).alias("strict_ok"))


@query("v1_required_fields", _mapped(XHS) +
       "\nselect source_line, case when order_id = '' then '缺少必要字段：订单号' when internal_sku = '' then "
       "'缺少必要字段：商家编码' when fin_code = '' then '缺少必要字段：财务核算编码' end as message from judged")
def required_fields(spark, sf_dir):
    mapped = mapping.map_sheet(sheet(spark, sf_dir, XHS), "xiaohongshu", YEAR, MONTH)
    return mapped.select("source_line", required_message().alias("message"))

