"""Orders joined with settlement and finance files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.files import ROLE_PATTERNS
from ..operators.rollup import month_sku
from ..operators.versions import missing_files
from ..plans import two_file
from . import duck, inputs
from .registry import query
from .scalars import FINANCE, finance_fees

C = inputs.cents
YEAR, MONTH = inputs.YEAR, inputs.MONTH
_STATUS = "case when l_returnflag = 'R' and l_linenumber = 2 then '部分退款' when l_linenumber = 7 then '用户取消' else '已完成' end"
XHS_ORDERS = [
    ("订单编号", "concat('', l_orderkey)"),
    ("商家SKU编码", "case when l_partkey % 3 = 0 then concat('M', l_partkey) else '' end"),
    ("SKU编码", "case when l_partkey % 3 = 1 then concat('S', l_partkey) else nullif('', '') end"),
    ("商品编号", "concat('N', l_partkey)"),
    ("购买数量", "concat(cast(l_quantity as bigint), '件')"),
    ("订单金额", f"concat('', {C('l_extendedprice')})"),
    ("买家实付金额", f"concat('', {C('l_extendedprice * (1 - l_discount)')})"),
    ("运费", "case when l_linenumber = 1 then '6.00' else '' end"),
    ("订单状态", _STATUS),
    ("下单时间", "concat('', cast(l_shipdate as date), ' 12:00:00')"),
]
XHS_SETTLED = [
    ("订单编号", "concat('', l_orderkey)"),
    ("结算状态", "case when l_returnflag = 'A' then '已结算' else '待结算' end"),
    ("佣金", f"concat('', {C('l_extendedprice * 0.02')})"),
    ("结算金额", f"concat('', {C('l_extendedprice * 0.9')})"),
]
WECHAT_ORDERS = [
    ("订单号", "concat('', l_orderkey)"), ("商品ID", "concat('', l_partkey)"),
    ("数量", "concat('', cast(l_quantity as bigint))"),
    ("买家实付(元)", f"concat('', {C('l_extendedprice')})"),
    ("卖家实收(元)", f"concat('', {C('l_extendedprice * (1 - l_discount)')})"),
    ("佣金(元)", f"case when l_linenumber = 3 then '' else concat('', {C('l_extendedprice * l_discount')}) end"),
    ("订单状态", "case when l_returnflag = 'R' then '已退款' else '已完成' end"),
    ("下单时间", "concat('', cast(l_shipdate as date))"),
]
DOUYIN_ORDERS = [
    ("订单号", "concat('', l_orderkey)"),
    ("子订单号", "case when l_linenumber = 1 then nullif('', '') when l_linenumber = 2 then '' else concat('', l_linenumber) end"),
    ("商家SKU编码", "case when l_partkey % 2 = 0 then concat('M', l_partkey) else '' end"),
    ("SKU编码", "''"), ("商品ID", "concat('N', l_partkey)"),
    ("购买数量", "concat('', cast(l_quantity as bigint))"),
    ("运费", "case when l_linenumber = 4 then '3.5' else '0' end"),
    ("用户实付金额", f"concat('', {C('l_extendedprice * (1 - l_discount)')})"),
    ("订单状态", "case when l_returnflag = 'R' then '退款成功' else '已完成' end"),
    ("支付时间", "case when l_linenumber = 5 then '' else concat('', cast(l_shipdate as date), ' 09:00:00') end"),
    ("创建时间", "concat('', cast(l_shipdate as date), ' 08:00:00')"),
]


def _sql(columns, name, source="lineitem"):
    return f"{name} as (select row_number() over () as source_line, " + duck.select(
        [(f'"{n}"', e) for n, e in columns]) + f" from {source})"


def _lead(e):
    return f"coalesce(try_cast(nullif(regexp_extract({e}, '^\\s*([-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+))', 1), '') as double), 0)"


def _int(e):
    return f"coalesce(try_cast(nullif(regexp_extract({e}, '^\\s*([-+]?[0-9]+)', 1), '') as double), 0)"


def _m(e):
    return duck.money(duck.r2(e))


_OUT = ("source_line, year, month, order_id, line_count, line_no, internal_sku, fin_code, "
        + duck.dbl(*duck.AMOUNTS) + ", abs(recv_platform + extra_charge - fee_platform_comm - fee_affiliate - "
        "fee_other - net_received) <= 0.01 as closure_ok")
_HEAD = (f"cast({YEAR} as integer) as year, cast({MONTH} as integer) as month, cast(1 as integer) as line_count, "
         "cast(1 as integer) as line_no")
FACT = ("source_line", "year", "month", "order_id", "line_count", "line_no", "internal_sku", "fin_code", *duck.AMOUNTS,
        "closure_ok")


def _period(e):
    return f"year(cast({e} as timestamp)) = {YEAR} and month(cast({e} as timestamp)) = {MONTH}"


def lines(spark, sf_dir, columns):
    return inputs.derive(inputs.lineitem(spark, sf_dir), columns)


def finished(spark, sf_dir, columns):
    """The other file: lines that have been settled."""
    return inputs.derive(inputs.lineitem(spark, sf_dir).where("l_linestatus = 'F'"), columns)


@query("p13_wechat_orders", f"""with {_sql(WECHAT_ORDERS, 'o')},
v as (select *, coalesce(try_cast(nullif("佣金(元)", '') as double), 0) as c, cast("卖家实收(元)" as double) as s from o
  where "订单状态" not in ('已退款', '已取消') and {_period('"下单时间"')}),
f as (select source_line, {_HEAD}, "订单号" as order_id, "商品ID" as internal_sku, "商品ID" as fin_code,
  {_m('cast("数量" as double)')} as qty_sold, {_m('cast("买家实付(元)" as double)')} as recv_customer,
  {_m('s + c')} as recv_platform, 0::decimal(18,2) as extra_charge, {_m('c')} as fee_platform_comm,
  0::decimal(18,2) as fee_affiliate, 0::decimal(18,2) as fee_other, {_m('s')} as net_received from v)
select {_OUT} from f""")
def wechat_orders(spark, sf_dir):
    return two_file.wechat_orders(lines(spark, sf_dir, WECHAT_ORDERS), YEAR, MONTH).select(*FACT)


_XHS = f"""with {_sql(XHS_ORDERS, 'o')}, {_sql(XHS_SETTLED, 's', "lineitem where l_linestatus = 'F'")},
t as (select "订单编号" as k, cast(sum({_m(_lead('"佣金"'))}) as double) as c, cast(sum({_m(_lead('"结算金额"'))}) as double) as z
  from s where "结算状态" = '已结算' group by 1),
j as (select o.*, k, coalesce(c, 0) as c, coalesce(z, 0) as z, {_lead('"订单金额"')} as amount, {_lead('"买家实付金额"')} as paid
  from o left join t on "订单编号" = k
  where not (contains("订单状态", '取消') or contains("订单状态", '退款')) and {_period('"下单时间"')}),
g as (select *, greatest(amount - paid - c, 0) as other from j)"""


@query("j1_xiaohongshu_settlements", f"""{_XHS},
f as (select source_line, {_HEAD}, "订单编号" as order_id,
  coalesce(nullif("商家SKU编码", ''), nullif("SKU编码", ''), "商品编号") as internal_sku,
  coalesce(nullif("商家SKU编码", ''), nullif("SKU编码", ''), "商品编号") as fin_code,
  {_m(_int('"购买数量"'))} as qty_sold, {_m('paid')} as recv_customer, {_m('amount')} as recv_platform,
  {_m(_lead('"运费"'))} as extra_charge, {_m('c')} as fee_platform_comm, 0::decimal(18,2) as fee_affiliate,
  {_m('other')} as fee_other, {_m('case when k is not null then z else amount - c - other end')} as net_received,
  k is not null as matched from g)
select {_OUT}, matched from f""")
def xiaohongshu_settlements(spark, sf_dir):
    facts = two_file.xiaohongshu_orders(
        lines(spark, sf_dir, XHS_ORDERS), finished(spark, sf_dir, XHS_SETTLED), YEAR, MONTH)
    return facts.select(*FACT, "matched")


@query("e20_substitute_fee", f"""{_XHS}
select source_line, cast({_m('other')} as double) as fee_other,
  cast({_m('case when k is not null then z else amount - c - other end')} as double) as net_received from g where k is null""")
def substitute_fee(spark, sf_dir):
    facts = two_file.xiaohongshu_orders(
        lines(spark, sf_dir, XHS_ORDERS), finished(spark, sf_dir, XHS_SETTLED), YEAR, MONTH)
    return facts.where(~F.col("matched")).select("source_line", "fee_other", "net_received")


_FEES = finance_fees()


@query("j2_douyin_finance", f"""with {_sql(DOUYIN_ORDERS, 'o')}, {_sql(FINANCE, 's', "lineitem where l_linestatus = 'F'")},
t as (select "订单号" as k, coalesce("子订单号", '') as sub, cast(sum({_m(_FEES['commission'])}) as double) as c,
  cast(sum({_m(_FEES['platform_fee'])}) as double) as p, cast(sum({_m(_FEES['other_fee'])}) as double) as x from s group by 1, 2),
j as (select o.*, k, coalesce(c, 0) as c, coalesce(p, 0) as p, coalesce(x, 0) as x, {_lead('"用户实付金额"')} as paid
  from o left join t on "订单号" = k and coalesce("子订单号", '') = sub
  where "订单状态" not in ('已取消', '已关闭', '退款成功') and {_period('coalesce(nullif("支付时间", chr(0)), "创建时间")').replace('chr(0)', "''")}),
f as (select source_line, {_HEAD}, "订单号" || case when coalesce("子订单号", '') <> '' then '-' || "子订单号" else '' end as order_id,
  coalesce(nullif("商家SKU编码", ''), nullif("SKU编码", ''), "商品ID") as internal_sku,
  coalesce(nullif("商家SKU编码", ''), nullif("SKU编码", ''), "商品ID") as fin_code,
  {_m(_int('"购买数量"'))} as qty_sold, {_m('paid')} as recv_customer, {_m('paid')} as recv_platform,
  {_m(_lead('"运费"'))} as extra_charge, {_m('c')} as fee_platform_comm, 0::decimal(18,2) as fee_affiliate,
  {_m('p + x')} as fee_other, {_m('paid - c - p - x')} as net_received, k is not null as matched from j)
select {_OUT}, matched from f""")
def douyin_finance(spark, sf_dir):
    facts = two_file.douyin_orders(
        lines(spark, sf_dir, DOUYIN_ORDERS), finished(spark, sf_dir, FINANCE), YEAR, MONTH)
    return facts.select(*FACT, "matched")


@query("g2_month_sku_platform_income", f"""{_XHS},
f as (select coalesce(nullif("商家SKU编码", ''), nullif("SKU编码", ''), "商品编号") as internal_sku,
  {_m(_int('"购买数量"'))} as qty_sold, {_m('amount')} as recv_platform, {_m('c')} as fee_platform_comm, 0 as fee_affiliate,
  {_m('other')} as fee_other, {_m('case when k is not null then z else amount - c - other end')} as net_received from g),
r as (select internal_sku, {duck.sums('recv_platform')} from f group by internal_sku)
select internal_sku, {duck.dbl(*duck.SUM_NAMES)}, record_count from r""")
def platform_income(spark, sf_dir):
    facts = two_file.xiaohongshu_orders(
        lines(spark, sf_dir, XHS_ORDERS), finished(spark, sf_dir, XHS_SETTLED), YEAR, MONTH)
    return month_sku(facts, ["internal_sku"], income="platform")


@query("v7_closure", f"""{_XHS},
f as (select source_line, {_m('amount')} + {_m(_lead('"运费"'))} - {_m('c')} - {_m('other')}
  - {_m('case when k is not null then z else amount - c - other end')} as gap from g)
select source_line, abs(gap) <= 0.01 as closure_ok from f""")
def closure(spark, sf_dir):
    facts = two_file.xiaohongshu_orders(
        lines(spark, sf_dir, XHS_ORDERS), finished(spark, sf_dir, XHS_SETTLED), YEAR, MONTH)
    return facts.select("source_line", "closure_ok")


_XHS_OPEN = f"""not (contains("订单状态", '取消') or contains("订单状态", '退款')) and {_period('"下单时间"')}"""
_DOUYIN_OPEN = (f""""订单状态" not in ('已取消', '已关闭', '退款成功') and """
                + _period("coalesce(nullif(\"支付时间\", ''), \"创建时间\")"))


@query("j7_orders_without_settlement", f"""with {_sql(XHS_ORDERS, 'o')}, {_sql(XHS_SETTLED, 's', "lineitem where l_linestatus = 'F'")}
select source_line, "订单编号" as order_id from o where {_XHS_OPEN}
  and "订单编号" not in (select "订单编号" from s where "结算状态" = '已结算')""")
def without_settlement(spark, sf_dir):
    found = two_file.unsettled_orders(
        lines(spark, sf_dir, XHS_ORDERS), finished(spark, sf_dir, XHS_SETTLED), YEAR, MONTH)
    return found.select("source_line", F.col("订单编号").alias("order_id"))


@query("j7_suborders_without_finance", f"""with {_sql(DOUYIN_ORDERS, 'o')}, {_sql(FINANCE, 's', "lineitem where l_linestatus = 'F'")}
select source_line, "订单号" as order_id from o where {_DOUYIN_OPEN} and not exists (select 1 from s where s."订单号" = o."订单号"
  and coalesce(s."子订单号", '') = coalesce(o."子订单号", ''))""")
def without_finance(spark, sf_dir):
    found = two_file.without_finance(
        lines(spark, sf_dir, DOUYIN_ORDERS), finished(spark, sf_dir, FINANCE), YEAR, MONTH)
    return found.select("source_line", F.col("订单号").alias("order_id"))


@query("j1_xiaohongshu_warnings", f"""{_XHS},
f as (select source_line, "订单编号" as id, k, {_m('amount')} + {_m(_lead('"运费"'))} - {_m('c')} - {_m('other')}
  - {_m('case when k is not null then z else amount - c - other end')} as gap from g)
select source_line, '订单 ' || id || ' 没有找到已结算的结算记录' as message from f where k is null
union all select source_line, '订单 ' || id || ' 的金额计算不闭环' from f where abs(gap) > 0.01""")
def xiaohongshu_warnings(spark, sf_dir):
    facts = two_file.xiaohongshu_orders(
        lines(spark, sf_dir, XHS_ORDERS), finished(spark, sf_dir, XHS_SETTLED), YEAR, MONTH)
    return two_file.order_warnings(facts).select("source_line", "message")


@query("j2_douyin_warnings", f"""with {_sql(DOUYIN_ORDERS, 'o')}, {_sql(FINANCE, 's', "lineitem where l_linestatus = 'F'")},
t as (select "订单号" as k, coalesce("子订单号", '') as sub, cast(sum({_m(_FEES['commission'])}) as double) as c,
  cast(sum({_m(_FEES['platform_fee'])}) as double) as p, cast(sum({_m(_FEES['other_fee'])}) as double) as x from s group by 1, 2),
j as (select o.*, k, coalesce(c, 0) as c, coalesce(p, 0) as p, coalesce(x, 0) as x, {_lead('"用户实付金额"')} as paid
  from o left join t on "订单号" = k and coalesce("子订单号", '') = sub where {_DOUYIN_OPEN}),
f as (select *, {_m('paid')} + {_m(_lead('"运费"'))} - {_m('c')} - {_m('p + x')} - {_m('paid - c - p - x')} as gap,
  coalesce("子订单号", '') as sub from j)
select source_line, '订单 ' || "订单号" || ' ' || case when sub <> '' then '(子订单 ' || sub || ')' else '' end || ' 没有找到财务记录' as message
  from f where k is null
union all select source_line, '订单 ' || "订单号" || case when sub <> '' then '-' || sub else '' end || ' 的金额计算不闭环' from f where abs(gap) > 0.01""")
def douyin_warnings(spark, sf_dir):
    facts = two_file.douyin_orders(
        lines(spark, sf_dir, DOUYIN_ORDERS), finished(spark, sf_dir, FINANCE), YEAR, MONTH)
    return two_file.order_warnings(facts).select("source_line", "message")


_LINE_SKU = [("order_id", "concat('', l_orderkey)"),
             ("internal_sku", "case when l_linenumber < 4 then nullif('', '') when l_linenumber = 4 then '' else concat('P', l_partkey) end")]
_ORDER_SKU = [("order_id", "concat('', o_orderkey)"),
              ("internal_sku", "case when o_orderstatus = 'P' then '' else concat('K', o_custkey) end")]


@query("j8_complete_sku", f"""with l as (select row_number() over () as source_line, {duck.select(_LINE_SKU)} from lineitem),
o as (select order_id, min(internal_sku) as sku from (select {duck.select(_ORDER_SKU)} from orders) where internal_sku <> '' group by 1)
select source_line, l.order_id, coalesce(nullif(internal_sku, ''), sku) as internal_sku from l left join o on l.order_id = o.order_id""")
def complete_sku(spark, sf_dir):
    orders = inputs.derive(inputs.read(spark, sf_dir, "orders"), _ORDER_SKU)
    done = two_file.complete_sku(lines(spark, sf_dir, _LINE_SKU), orders, ["order_id"])
    return done.select("source_line", "order_id", "internal_sku")


_FILES = [("upload_id", "concat('u', l_orderkey)"),
          ("platform", "case when l_orderkey % 3 = 0 then 'xiaohongshu' when l_orderkey % 3 = 1 then 'douyin' else 'wechat_video' end"),
          ("file_type", "case when l_linenumber < 4 then 'settlement' else 'orders' end")]


@query("j10_missing_files", f"""with f as (select {duck.select(_FILES)} from lineitem),
need(platform, file_type) as (values ('xiaohongshu', 'settlement'), ('xiaohongshu', 'orders'), ('douyin', 'settlement'),
  ('douyin', 'orders'), ('wechat_video', 'settlement'))
select distinct f.upload_id, f.platform, need.file_type from f join need on f.platform = need.platform
where not exists (select 1 from f x where x.upload_id = f.upload_id and x.file_type = need.file_type)""")
def files_missing(spark, sf_dir):
    uploaded = inputs.read(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(n) for n, e in _FILES])
    return missing_files(uploaded, {platform: list(roles) for platform, roles in ROLE_PATTERNS.items()})



@query("g14_join_miss_ratio", f"""with {_sql(XHS_ORDERS, 'o')}, {_sql(XHS_SETTLED, 's', "lineitem where l_linestatus = 'F'")},
k as (select distinct "订单编号" as k from s where "结算状态" = '已结算')
select substr("下单时间", 1, 7) as period, count(*) as orders, count(*) - count(k) as missed,
  (count(*) - count(k)) / count(*) as miss_ratio from o left join k on "订单编号" = k group by 1""")
def join_miss_ratio(spark, sf_dir):
    orders, settled = lines(spark, sf_dir, XHS_ORDERS), finished(spark, sf_dir, XHS_SETTLED)
    return two_file.match_ratio(
        orders.withColumn("period", F.substring("下单时间", 1, 7)),
        settled.where(F.col("结算状态") == two_file.SETTLED), "订单编号", "订单编号", ["period"])
