"""Columns and types of the tables."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DecimalType, IntegerType, LongType, MapType, StringType, StructField,
    StructType, TimestampType,
)

AMOUNTS = (
    "qty_sold", "recv_customer", "recv_platform", "extra_charge",
    "fee_platform_comm", "fee_affiliate", "fee_other", "net_received",
)
FACT_COLUMNS = (
    "year", "month", "order_id", "line_count", "line_no", "internal_sku", "fin_code", *AMOUNTS,
)
META_COLUMNS = (
    "platform", "upload_id", "job_id", "user_id", "row_key", "row_hash",
    "source_file", "source_line", "rule_version", "validation_status", "validation_warnings",
)
AGG_SUMS = (
    "qty_sold_sum", "income_total_sum", "fee_platform_comm_sum", "fee_other_sum", "net_received_sum",
)
AGG_COLUMNS = (
    "platform", "user_id", "upload_id", "job_id", "year", "month", "internal_sku", *AGG_SUMS, "record_count",
)
PARTITIONS = ("user_id", "platform", "year", "month", "job_id")

_MONEY = DecimalType(28, 2)
SUM_MONEY = DecimalType(38, 2)


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


FACT_TABLE = _struct(
    year=IntegerType(), month=IntegerType(), order_id=StringType(), line_count=IntegerType(),
    line_no=IntegerType(), internal_sku=StringType(), fin_code=StringType(),
    **{name: _MONEY for name in AMOUNTS},
    platform=StringType(), upload_id=StringType(), job_id=StringType(), user_id=StringType(),
    row_key=StringType(), row_hash=StringType(), source_file=StringType(), source_line=LongType(),
    rule_version=StringType(), validation_status=StringType(), validation_warnings=StringType(),
)
AGG_TABLE = _struct(
    platform=StringType(), user_id=StringType(), upload_id=StringType(), job_id=StringType(),
    year=IntegerType(), month=IntegerType(), internal_sku=StringType(),
    **{name: SUM_MONEY for name in AGG_SUMS},
    record_count=LongType(),
)

# Catalog records as they are kept in JSON.
DATASET_RECORD = _struct(
    id=StringType(), userId=StringType(), platform=StringType(), year=IntegerType(), month=IntegerType(),
    effectiveUploadId=StringType(), status=StringType(), createdAt=TimestampType(), updatedAt=TimestampType(),
    supersededAt=TimestampType(), supersededBy=StringType(),
    metadata=_struct(jobId=StringType(), jobIds=ArrayType(StringType())),
)
DATASET_ROW_RECORD = _struct(
    datasetId=StringType(), uploadId=StringType(), rowKey=StringType(), rowHash=StringType(),
    createdAt=TimestampType(), updatedAt=TimestampType(),
)
UPLOAD_RECORD = _struct(
    id=StringType(), userId=StringType(), platform=StringType(), fileType=StringType(),
    contentHash=StringType(), contenthash_old=StringType(), originalFilename=StringType(), fileName=StringType(),
    objectKey=StringType(), size=LongType(), uploadedAt=TimestampType(), isDuplicate=BooleanType(),
    datasetId=StringType(),
)
JOB_RECORD = _struct(
    id=StringType(), status=StringType(), message=StringType(), platform=StringType(), userId=StringType(),
    uploadId=StringType(), datasetId=StringType(), year=IntegerType(), month=IntegerType(),
    createdAt=TimestampType(), updatedAt=TimestampType(), completedAt=TimestampType(), progress=IntegerType(),
    fileObjects=MapType(StringType(), StringType()),
    metadata=_struct(jobId=StringType(), jobIds=ArrayType(StringType())),
)

# Relational variant of the two tables.
SMALL_MONEY = DecimalType(10, 2)
RELATIONAL_FACT = _struct(
    platform=StringType(), upload_id=StringType(), job_id=StringType(), year=IntegerType(), month=IntegerType(),
    order_id=StringType(), line_count=IntegerType(), line_no=IntegerType(), internal_sku=StringType(),
    fin_code=StringType(), qty_sold=IntegerType(),
    **{name: SMALL_MONEY for name in AMOUNTS[1:]},
    source_file=StringType(), source_line=LongType(),
)
FACT_UNIQUE = ("platform", "year", "month", "order_id", "internal_sku", "line_no")
AGG_UNIQUE = ("platform", "year", "month", "internal_sku")


# Localised headers of the exports, with the columns they show, in order.
FACT_HEADERS = {
    "年": "year",
    "月": "month",
    "订单号": "order_id",
    "订单行数": "line_count",
    "订单序位": "line_no",
    "平台商品编码": "internal_sku",
    "商品编码": "fin_code",
    "销售数量": "qty_sold",
    "应收客户": "recv_customer",
    "应收平台": "recv_platform",
    "价外收费": "extra_charge",
    "扣平台佣金用": "fee_platform_comm",
    "扣分销佣金": "fee_affiliate",
    "扣其它费用": "fee_other",
    "应到账金额": "net_received",
}
AGG_HEADERS = {
    "商品编码": "internal_sku",
    "销售数量合计": "qty_sold_sum",
    "收入总计": "income_total_sum",
    "平台佣金合计": "fee_platform_comm_sum",
    "其他费用合计": "fee_other_sum",
    "应到账金额合计": "net_received_sum",
}
INTERNAL_COLUMNS = (
    "id", "user_id", "job_id", "upload_id", "created_at", "updated_at", "row_key", "row_hash", "rule_version",
    "validation_status", "validation_warnings", "source_row", "platform", "source_file", "source_line",
)
