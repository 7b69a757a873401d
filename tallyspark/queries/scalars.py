"""Column functions over text and numbers of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import files, keys, numbers, periods, text
from ..functions.periods import MONTH_ONLY, YEAR_FOUR, YEAR_MONTH, YEAR_TWO
from ..functions.text import left_of_dash
from ..plans.two_file import classified_fees
from ..operators.versions import latest_job
from . import duck, inputs
from .registry import query

# Raw cells drawn from lineitem, shared by the functions below.
_DIRTY = (
    "case when l_linenumber = 1 then concat('¥', cast(l_extendedprice as decimal(18,2)), ' 元') "
    "when l_linenumber = 2 then concat('-', l_partkey, '-', l_suppkey) when l_linenumber = 3 then '--' "
    "when l_linenumber = 4 then concat(l_partkey, '.', l_suppkey, '.5') when l_linenumber = 5 then nullif('', '') "
    "when l_linenumber = 6 then concat('.', l_suppkey) else '' end"
)
_BLANK = "case when l_linenumber < 3 then concat('  P ', l_partkey, '  ') when l_linenumber = 3 then nullif('', '') else concat('x', l_suppkey) end"


def _cells(spark, sf_dir, *columns):
    return inputs.derive(inputs.lineitem(spark, sf_dir), list(columns))


def _raw(*columns):
    return f"with c as (select row_number() over () as source_line, {duck.select(list(columns))} from lineitem)\n"


@query("e1_number_cleaning", _raw(("v", _DIRTY)) + f"select source_line, {duck.num('v')} as number from c")
def number_cleaning(spark, sf_dir):
    return _cells(spark, sf_dir, ("v", _DIRTY)).select("source_line", numbers.parse_number(F.col("v")).alias("number"))


@query("e2_text_cleaning", _raw(("v", _BLANK)) + "select source_line, coalesce(trim(v), '') as cleaned from c")
def text_cleaning(spark, sf_dir):
    return _cells(spark, sf_dir, ("v", _BLANK)).select("source_line", text.clean_text(F.col("v")).alias("cleaned"))


_SIGNED = "(l_extendedprice / l_quantity) * (case when l_linenumber % 2 = 0 then -1 else 1 end)"


@query("e3_round2", _raw(("v", _SIGNED)) + f"select source_line, {duck.r2('v')} as rounded from c")
def round2(spark, sf_dir):
    return _cells(spark, sf_dir, ("v", _SIGNED)).select("source_line", numbers.round2(F.col("v")).alias("rounded"))


@query("e4_round_up", _raw(("v", _SIGNED)) + "select source_line, ceil(v) as whole, ceil(v * 10) / 10 as tenths from c")
def round_up(spark, sf_dir):
    return _cells(spark, sf_dir, ("v", _SIGNED)).select(
        "source_line", numbers.round_up(F.col("v")).alias("whole"), numbers.round_up(F.col("v"), 1).alias("tenths"))


_TAX = "concat('税', cast(l_tax as decimal(18,2)))"


@query("e5_sum_of_cells", _raw(("a", _DIRTY), ("b", _TAX), ("c", "'-0.5'")) +
       f"select source_line, ((0::double + {duck.num('a')}) + {duck.num('b')}) + {duck.num('c')} as total from c")
def sum_of_cells(spark, sf_dir):
    cells = _cells(spark, sf_dir, ("a", _DIRTY), ("b", _TAX), ("c", "'-0.5'"))
    return cells.select("source_line", numbers.sum_cleaned(F.col("a"), F.col("b"), F.col("c")).alias("total"))


_CODE = (
    "case when l_linenumber = 1 then concat('-', l_partkey) when l_linenumber = 2 then nullif('', '') "
    "when l_linenumber = 3 then concat('', l_partkey) else concat('Z', l_partkey, '-', l_suppkey, '-S') end"
)


@query("e6_left_of_dash", _raw(("v", _CODE)) +
       "select source_line, case when strpos(v, '-') > 1 then split_part(v, '-', 1) else coalesce(v, '') end as code from c")
def code_prefix(spark, sf_dir):
    return _cells(spark, sf_dir, ("v", _CODE)).select("source_line", left_of_dash(F.col("v")).alias("code"))


_TIME = "case when l_linenumber = 3 then 'not a date' when l_linenumber = 5 then '' else concat('', cast(l_shipdate as date), ' 23:30:00') end"


@query("e7_year_month", _raw(("v", _TIME)) +
       "select source_line, cast(year(try_cast(v as timestamp)) as integer) as y, "
       "cast(month(try_cast(v as timestamp)) as integer) as m from c")
def year_month(spark, sf_dir):
    return _cells(spark, sf_dir, ("v", _TIME)).select(
        "source_line", periods.year_of(F.col("v")).alias("y"), periods.month_of(F.col("v")).alias("m"))


_OWNER = [("u", "concat('U', l_suppkey)"), ("p", "'douyin'"),
          ("y", "cast(year(l_shipdate) as integer)"), ("m", "cast(month(l_shipdate) as integer)")]


@query("e8_dataset_id", f"with c as (select distinct {duck.select(_OWNER)} from lineitem)\n"
       "select u, p, y, m, 'dataset-' || substr(sha256(concat_ws(':', u, p, y, m)), 1, 8) as id from c")
def dataset_id(spark, sf_dir):
    owners = _cells(spark, sf_dir, *_OWNER).select("u", "p", "y", "m").distinct()
    return owners.withColumn("id", keys.dataset_id(F.col("u"), F.col("p"), F.col("y"), F.col("m")))


@query("e9_three_segment_qty", _raw(("q", "l_quantity - 45 + l_linenumber")) +
       "select source_line, case when q > 0 then q when q > -30 then 0::double else -1::double end as qty from c")
def three_segments(spark, sf_dir):
    return _cells(spark, sf_dir, ("q", "l_quantity - 45 + l_linenumber")).select(
        "source_line", numbers.three_segment_qty(F.col("q")).cast("double").alias("qty"))


_KEYED = [("o", "concat('', l_orderkey)"), ("s", "concat('P', l_partkey)"),
          ("n", "case when l_linenumber = 4 then nullif(1, 1) else l_linenumber end")]


@query("e10_row_key", _raw(*_KEYED) +
       "select source_line, concat_ws(':', 'douyin', o, s, coalesce(cast(n as varchar), 'null')) as with_line, "
       "concat_ws(':', 'douyin', o, s) as without_line from c")
def row_keys(spark, sf_dir):
    c = _cells(spark, sf_dir, *_KEYED)
    return c.select(
        "source_line",
        keys.row_key(F.lit("douyin"), F.col("o"), F.col("s"), F.col("n")).alias("with_line"),
        keys.row_key(F.lit("douyin"), F.col("o"), F.col("s")).alias("without_line"))


FINANCE = [
    ("订单号", "concat('', l_orderkey)"),
    ("子订单号", "case when l_linenumber = 1 then nullif('', '') when l_linenumber = 2 then '' else concat('', l_linenumber) end"),
    ("支出类型", "case when l_partkey % 5 = 0 then '佣金' when l_partkey % 5 = 1 then '达人佣金' when l_partkey % 5 = 2 then '技术服务费' "
     "when l_partkey % 5 = 3 then '保险' else '' end"),
    ("收支金额", f"concat('-', {inputs.cents('l_extendedprice * 0.01')})"),
    ("商品佣金", f"case when l_suppkey % 3 = 0 then concat('-', {inputs.cents('l_extendedprice * 0.03')}) else '' end"),
    ("平台服务费", f"case when l_suppkey % 6 = 0 then concat('', {inputs.cents('l_extendedprice * 0.02')}) else nullif('', '') end"),
    ("其他费用", "case when l_suppkey % 9 = 0 then '1.25' else '' end"),
]


def finance_fees(prefix: str = "") -> dict[str, str]:
    """SQL of the three classified fees of a finance row."""
    def filled(c):
        return f"coalesce({prefix}\"{c}\", '') <> ''"

    def size(c):
        return f"abs(coalesce(try_cast(regexp_extract({prefix}\"{c}\", '^\\s*([-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+))', 1) as double), 0))"

    kind = f"coalesce({prefix}\"支出类型\", '')"
    any_filled = f"({filled('商品佣金')} or {filled('平台服务费')} or {filled('其他费用')})"
    is_comm = f"strpos({kind}, '佣金') > 0"
    is_serv = f"(not {is_comm} and strpos({kind}, '服务') > 0)"
    is_other = f"(not {is_comm} and strpos({kind}, '服务') = 0 and {kind} <> '' and {filled('收支金额')})"

    def fee(c, chosen):
        return (f"case when {any_filled} then case when {filled(c)} then {size(c)} else 0::double end "
                f"when {chosen} then {size('收支金额')} else 0::double end")

    return {"commission": fee("商品佣金", is_comm), "platform_fee": fee("平台服务费", is_serv),
            "other_fee": fee("其他费用", is_other)}


_QUOTED = [(f'"{n}"', e) for n, e in FINANCE]


@query("e11_fee_classes", _raw(*_QUOTED) +
       "select source_line, " + ", ".join(f"{e} as {n}" for n, e in finance_fees().items()) + " from c")
def fee_classes(spark, sf_dir):
    commission, platform, other = classified_fees()
    return _cells(spark, sf_dir, *FINANCE).select(
        "source_line", commission.alias("commission"), platform.alias("platform_fee"), other.alias("other_fee"))


_HASHED = [
    ("order_id", "concat('o\"', l_orderkey)"), ("internal_sku", "case when l_linenumber = 2 then nullif('', '') else concat('P', l_partkey) end"),
    ("line_no", "case when l_linenumber = 4 then nullif(1, 1) else l_linenumber end"),
    ("qty_sold", "cast(l_quantity as decimal(18,2))"),
    ("recv_customer", inputs.cents("l_extendedprice")), ("recv_platform", inputs.cents("l_tax * -100")),
    ("extra_charge", inputs.cents("l_discount")), ("fee_platform_comm", inputs.cents("l_tax")),
    ("fee_affiliate", "cast(0 as decimal(18,2))"), ("fee_other", "cast(0.5 as decimal(18,2))"),
    ("net_received", inputs.cents("l_extendedprice * (1 - l_discount)")),
]


@query("e12_row_hash", _raw(*_HASHED) + "select source_line, " + duck.HASH.replace(
    "to_json(internal_sku)::varchar", "coalesce(to_json(internal_sku)::varchar, 'null')") + " as row_hash from c")
def row_hashes(spark, sf_dir):
    return _cells(spark, sf_dir, *_HASHED).select("source_line", keys.row_hash().alias("row_hash"))


_NAME = (
    "case when l_linenumber = 1 then concat('微信结算', year(l_shipdate), '年', month(l_shipdate), '月.xlsx') "
    "when l_linenumber = 2 then concat('Orders ', year(l_shipdate) - 1900, '年 ', month(l_shipdate), ' 月.CSV') "
    "when l_linenumber = 3 then concat('settlement_', month(l_shipdate), '月_2025.csv') "
    "when l_linenumber = 4 then concat('a/b/结算', month(l_shipdate), '月 24.x.csv') "
    "when l_linenumber = 5 then concat('视频号 ', month(l_shipdate), '月') "
    "when l_linenumber = 6 then '2025年.xls' else concat('order', l_suppkey, '.TXT') end"
)


def _ex(pattern, group):
    return f"nullif(regexp_extract(lower(v), '{pattern}', {group}), '')"


_LONE_YEAR = f"coalesce({_ex(YEAR_FOUR, 1)}, {_ex(YEAR_TWO, 1)})"
_Y = f"coalesce({_ex(YEAR_MONTH, 1)}, case when {_ex(MONTH_ONLY, 1)} is not null then {_LONE_YEAR} end)"


@query("e13_file_period", _raw(("v", _NAME)) +
       f"select source_line, case when length({_Y}) = 2 then cast({_Y} as integer) + 2000 else cast({_Y} as integer) end as y, "
       f"cast(coalesce({_ex(YEAR_MONTH, 2)}, case when {_LONE_YEAR} is not null then {_ex(MONTH_ONLY, 1)} end) as integer) as m from c")
def file_period(spark, sf_dir):
    year, month = periods.file_period(F.col("v"))
    return _cells(spark, sf_dir, ("v", _NAME)).select("source_line", year.alias("y"), month.alias("m"))


@query("e14_file_role", _raw(("v", _NAME)) +
       "select source_line, case when contains(lower(v), 'settlement') or contains(v, '结算') then 'settlement' "
       "when contains(lower(v), 'order') or contains(v, '订单') then 'orders' end as two_files, "
       "case when contains(lower(v), 'settlement') or contains(v, '结算') or contains(v, '视频号') then 'settlement' end as one_file, "
       "regexp_matches(lower(v), '.*结算.*月') as by_glob from c")
def file_role(spark, sf_dir):
    v = F.col("v")
    return _cells(spark, sf_dir, ("v", _NAME)).select(
        "source_line", files.file_role(v, "douyin").alias("two_files"),
        files.file_role(v, "wechat_video").alias("one_file"), files.matches_glob(v, "*结算*月").alias("by_glob"))


@query("e15_file_type", _raw(("v", _NAME)) +
       "select source_line, case when lower(regexp_extract(v, '\\.([^./]+)$', 1)) = 'csv' then 'settlement' "
       "else lower(regexp_extract(v, '\\.([^./]+)$', 1)) end as file_type from c")
def file_type(spark, sf_dir):
    return _cells(spark, sf_dir, ("v", _NAME)).select("source_line", files.file_type(F.col("v")).alias("file_type"))


@query("e17_thousands_text", _raw(("v", inputs.cents("l_extendedprice"))) +
       "select source_line, format('{:,.2f}', v::double) as currency, "
       "regexp_replace(format('{:,.2f}', v::double), '\\.?0*$', '') as plain from c")
def thousands(spark, sf_dir):
    c = _cells(spark, sf_dir, ("v", inputs.cents("l_extendedprice")))
    return c.select("source_line", numbers.currency_text(F.col("v")).alias("currency"),
                    numbers.number_text(F.col("v")).alias("plain"))


_NAN = "case when l_linenumber = 1 then nullif(1.5, 1.5) when l_linenumber = 2 then cast('NaN' as double) else l_tax end"


@query("e18_null_as_zero", _raw(("v", _NAN)) +
       "select source_line, case when v is null or isnan(v) then 0::double else v end as amount from c")
def null_as_zero(spark, sf_dir):
    return _cells(spark, sf_dir, ("v", _NAN)).select("source_line", numbers.or_zero(F.col("v")).alias("amount"))


_CHAIN = [("a", "case when l_linenumber < 3 then concat('M', l_partkey) when l_linenumber = 3 then nullif('', '') else '' end"),
          ("b", "case when l_linenumber in (3, 4) then concat('S', l_suppkey) else '' end"), ("c", "concat('', l_orderkey)")]


@query("e19_first_filled", _raw(*_CHAIN).replace("with c as", "with t as") +
       "select source_line, coalesce(nullif(a, ''), nullif(b, ''), c) as sku from t")
def first_filled(spark, sf_dir):
    return _cells(spark, sf_dir, *_CHAIN).select(
        "source_line", text.first_filled([F.col("a"), F.col("b"), F.col("c")]).alias("sku"))


_INT = "case when l_linenumber = 1 then concat(l_quantity, ' pcs') when l_linenumber = 2 then 'none' when l_linenumber = 3 then concat(' -', l_suppkey, '.9') else concat('', l_partkey) end"


@query("e21_integer_prefix", _raw(("v", _INT)) +
       "select source_line, try_cast(nullif(regexp_extract(v, '^\\s*([-+]?[0-9]+)', 1), '') as integer) as qty from c")
def integer_prefix(spark, sf_dir):
    return _cells(spark, sf_dir, ("v", _INT)).select("source_line", numbers.parse_int(F.col("v")).alias("qty"))


_JOBS = [("job", "case when l_linenumber = 1 then concat('j', l_suppkey) else nullif('', '') end"),
         ("others", "case when l_linenumber = 2 then nullif('', '') else concat('a', l_partkey, ',b', l_orderkey) end")]


@query("e22_latest_job", _raw(*_JOBS) +
       "select source_line, coalesce(job, string_split(others, ',')[-1]) as latest from c")
def latest(spark, sf_dir):
    c = _cells(spark, sf_dir, *_JOBS)
    return c.select("source_line", latest_job(F.col("job"), F.split("others", ",")).alias("latest"))
