"""SQL pieces for the checks."""

from __future__ import annotations

from . import inputs as i

AMOUNTS = (
    "qty_sold", "recv_customer", "recv_platform", "extra_charge", "fee_platform_comm", "fee_affiliate",
    "fee_other", "net_received",
)
PLAIN = ("year", "month", "order_id", "line_count", "line_no", "internal_sku", "fin_code")


def num(e: str) -> str:
    """Dirty text to a double, 0 when there is no number in it."""
    kept = f"regexp_replace({e}, '[^0-9.-]', '', 'g')"
    return (
        f"coalesce(try_cast(nullif(regexp_extract({kept}, '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)'), '') as double), 0::double)"
    )


def r2(e: str) -> str:
    cents = f"((({e}) + 2.220446049250313e-16::double) * 100)"
    return f"(case when abs({cents}) < 4503599627370496 then floor({cents} + 0.5::double) else {cents} end / 100)"


def money(e: str) -> str:
    """A double as money by its shortest text, as Spark reads it."""
    return f"try_cast(cast({e} as varchar) as decimal(28,2))"


def cell(e: str) -> str:
    return money(r2(num(e)))


def short(e: str) -> str:
    return f"regexp_replace(cast({e} as varchar), '\\.?0*$', '')"


def double(name: str) -> str:
    """The double nearest to a decimal, also where its digits are more than a double holds."""
    return f"cast(cast({name} as varchar) as double)"


def dbl(*names: str) -> str:
    return ", ".join(f"{double(n)} as {n}" for n in names)


NET = "(recv_customer + recv_platform + extra_charge - fee_platform_comm - fee_affiliate - fee_other)"

HASH = (
    "sha256('[' || concat_ws(',', "
    f"{short('extra_charge')}, {short('fee_affiliate')}, {short('fee_other')}, {short('fee_platform_comm')}, "
    "to_json(internal_sku)::varchar, coalesce(cast(line_no as varchar), 'null'), "
    f"{short('net_received')}, to_json(order_id)::varchar, {short('qty_sold')}, {short('recv_customer')}, "
    f"{short('recv_platform')}) || ']')"
)


def select(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in columns)


RAW = (
    "raw as (select row_number() over () as source_line, "
    + select([(n, e) for n, _, e in i.WECHAT] + i.STAMPS)
    + " from lineitem)"
)
LINES = """lines as (select *,
  cast(row_number() over (partition by order_raw order by source_line) as integer) as line_no,
  cast(count(*) over (partition by order_raw) as integer) as line_count from raw)"""


def first_line(e: str) -> str:
    return f"case when line_no = 1 then {r2(e)} else 0::double end"


SKU = ", ".join(f"nullif(trim(sku_{k}), '')" for k in range(1, 6))
CELLS = (
    "cells as (select *, "
    + ", ".join(f"{num(n)} as v_{n}" for n in ("bi", "bk", "bn", "bt", "bm", "ai", "as_fee", "at_fee", "au", "ba"))
    + f", (((0::double + {num('aj')}) + {num('ak')}) + {num('al')}) + {num('am')} as v_disc"
    + f", coalesce({SKU}, '') as sku from lines)"
)
RATIO = "(case when v_bi = 0 then 0::double else (v_bk + v_bn - v_bt) / v_bi end)"
GIVEN = (RATIO, "v_bi * v_bm - v_bt", "v_disc", "v_ai", "v_as_fee + v_at_fee", "v_ba", "v_au")
FAILED = " or ".join(f"not coalesce(abs({e}) < 1e25::double, true)" for e in GIVEN)
PARTS = f"""parts as (select *, {FAILED} as failed, ceil({RATIO}) as h from cells),
amounts as (select *,
  case when h = 0 then 0::double else {r2('v_bi * v_bm - v_bt')} end as i,
  case when h > 0 and line_no = 1 then {r2('v_disc')} else {r2('-v_disc')} end as j,
  {first_line('v_ai')} as k, {first_line('v_as_fee + v_at_fee')} as l,
  {first_line('v_ba')} as m, {first_line('v_au')} as n from parts),
nets as (select *, {r2('i + j + k - l - m - n')} as o from amounts),
flagged as (select *, {money('h')} as d_h, {money('i')} as d_i, {money('j')} as d_j, {money('k')} as d_k,
  {money('l')} as d_l, {money('m')} as d_m, {money('n')} as d_n, {money('o')} as d_o from nets)"""


FACTS = f"""{RAW}, {LINES}, {CELLS}, {PARTS},
rows as (select cast(year(cast(settled_at as date)) as integer) as year,
  cast(month(cast(settled_at as date)) as integer) as month,
  trim(order_raw) as order_id, line_count, line_no, sku as internal_sku,
  {", ".join(f"d_{a} as {b}" for a, b in zip("hijklmno", AMOUNTS))},
  platform, upload_id, job_id, user_id, source_line from flagged where not failed),
coded as (select *, case when strpos(internal_sku, '-') > 1 then split_part(internal_sku, '-', 1)
  else internal_sku end as fin_code from rows),
checked as (select *, case when order_id = '' then '缺少必要字段：订单号'
  when internal_sku = '' then '缺少必要字段：商家编码' when fin_code = '' then '缺少必要字段：财务核算编码'
  when abs({NET} - net_received) > 0.02 then 'x' end as message from coded),
facts as (select *, concat_ws(':', platform, order_id, internal_sku, line_no) as row_key, {HASH} as row_hash,
  'wxv-2025-11-06' as rule_version,
  case when message is null then 'ok' else 'warn' end as validation_status,
  case when message is not null then '["' || message || '"]' end as validation_warnings from checked)"""

FACT_LIST = ", ".join(PLAIN) + ", " + dbl(*AMOUNTS)
META_LIST = (
    "platform, upload_id, job_id, user_id, row_key, row_hash, source_line, rule_version, validation_status, "
    "validation_warnings"
)


# Latest row per row key: what views show. These facts come from one commit.
EFFECTIVE = """effective as (select * exclude (place) from (select *, row_number() over (partition by user_id, platform, year, month,
  row_key order by source_line desc) as place from facts) where place = 1)"""


def with_facts(body: str) -> str:
    return f"with {FACTS}, {EFFECTIVE}\n{body}"


def with_versions(body: str) -> str:
    """Facts of three commits: all rows, lines of one month again by job-10, and some of those twice over by job-9, which comes
    last. ``latest`` holds what is left of each key, ``totals`` its month by SKU sums."""
    again = "row_hash || 'x' as row_hash, cast(recv_customer + 1 as decimal(28,2)) as recv_customer, cast(net_received + 1 as decimal(28,2)) as net_received"
    return f"""with {FACTS},
again as (select * replace ('job-10' as job_id, 'ULP-10' as upload_id, cast(qty_sold + 1 as decimal(28,2)) as qty_sold, {again})
  from facts where {PERIOD} and line_no = 1),
twice as (select * exclude (k) replace ('job-9' as job_id, 'ULP-9' as upload_id, cast(qty_sold + 2 + k as decimal(28,2)) as qty_sold,
  {again.replace("'x'", "'y' || k")}, source_line + {i.TWICE} * k as source_line)
  from facts, (values (0), (1)) as t(k) where {PERIOD} and line_no = 1 and cast(order_id as bigint) % 2 = 0),
versions as (select *, 1 as seq from facts union all select *, 2 from again union all select *, 3 from twice),
latest as (select * exclude (place) from (select *, row_number() over (partition by user_id, platform, year, month, row_key
  order by seq desc, source_line desc) as place from versions) where place = 1),
totals as (select user_id, platform, year, month, internal_sku, {sums()} from latest group by all)
{body}"""


def sums(income: str = "recv_customer + recv_platform + extra_charge") -> str:
    return (
        "sum(qty_sold) as qty_sold_sum, "
        f"sum({income}) as income_total_sum, sum(fee_platform_comm) as fee_platform_comm_sum, "
        "sum(fee_affiliate + fee_other) as fee_other_sum, sum(net_received) as net_received_sum, "
        "count(*) as record_count"
    )


SUM_NAMES = ("qty_sold_sum", "income_total_sum", "fee_platform_comm_sum", "fee_other_sum", "net_received_sum")
ROLLUP = (
    f"rollup_rows as (select user_id, platform, year, month, upload_id, job_id, internal_sku, {sums()} from facts "
    "group by all)"
)
PERIOD = f"user_id = '{i.USER}' and platform = '{i.PLATFORM}' and year = {i.YEAR} and month = {i.MONTH}"


def with_rollup(body: str) -> str:
    return f"with {FACTS}, {ROLLUP}\n{body}"
