"""Identifiers and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import shortest_text

# The columns the documented row hash covers, with their kind, in name order.
HASH_COLUMNS = {
    "extra_charge": "money",
    "fee_affiliate": "money",
    "fee_other": "money",
    "fee_platform_comm": "money",
    "internal_sku": "text",
    "line_no": "int",
    "net_received": "money",
    "order_id": "text",
    "qty_sold": "money",
    "recv_customer": "money",
    "recv_platform": "money",
}


def dataset_id(user: Column, platform: Column, year: Column, month: Column) -> Column:
    """Short stable id of one tenant's platform month."""
    digest = F.sha2(F.concat_ws(":", user, platform, year.cast("string"), month.cast("string")), 256)
    return F.concat(F.lit("dataset-"), F.substring(digest, 1, 8))


def row_key(platform: Column, order_id: Column, sku: Column, line_no: Column | None = None) -> Column:
    """platform:order:sku[:line]; a missing line value is written as null."""
    parts = [platform, order_id, sku]
    if line_no is not None:
        parts.append(F.coalesce(line_no.cast("string"), F.lit("null")))
    return F.concat_ws(":", *parts)


_UNESCAPED = r"^[ !#-\[\]-~]*\z"  # signs that JSON writes as they are


def _json_text(value: Column) -> Column:
    # The list brackets go; a text always stands in quotes, so its own brackets stay. Most texts need no JSON writer.
    written = F.btrim(F.to_json(F.array(value)), F.lit("[]"))
    return F.when(value.rlike(_UNESCAPED), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(written)


def _json_value(name: str, kind: str) -> Column:
    value = F.col(name)
    if kind == "text":
        text = _json_text(value)
    elif kind == "int":
        text = value.cast("string")
    else:
        text = shortest_text(value)
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def row_hash(columns: dict[str, str] | None = None) -> Column:
    """SHA-256 of the JSON list of values in column-name order."""
    chosen = columns or HASH_COLUMNS
    values = [_json_value(name, chosen[name]) for name in sorted(chosen)]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]")), 256)
