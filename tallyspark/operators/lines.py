"""Line numbers and counts inside orders, in file order.

An order may hold any share of all rows, so no window ever spans a whole order. Rows are numbered inside
(order, file block); orders that reach over several blocks get the row counts of the earlier blocks added.
A block holds a bounded number of rows, hence so does every window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_ROWS = 1_000_000


def with_file_position(parquet: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add source_path, source_file, source_line (from 1) and file_block to a Parquet scan.

    Names may repeat in different folders, so files are told apart by their path.
    """
    row = F.col("_metadata.row_index")
    return parquet.select(
        "*",
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_name").alias("source_file"),
        (row + 1).alias("source_line"),
        F.floor(row / block_rows).alias("file_block"),
    )


def number_lines(
    lines: DataFrame,
    keys: Sequence[str],
    blocks: Sequence[str] = ("source_path", "file_block"),
    position: str = "source_line",
    first_of: dict[str, str] | None = None,
) -> DataFrame:
    """Add line_no (from 1) and line_count per key, in (blocks, position) order: file by file, then by line.

    ``first_of`` maps new column names to columns whose value on line 1 every line of the key receives.
    Key columns must not be null.
    """
    first_of = first_of or {}
    group = [*keys, *blocks]
    in_block = Window.partitionBy(*group)
    ordered = in_block.orderBy(position)
    numbered = lines.withColumns(
        {
            "line_no": F.row_number().over(ordered),
            "line_count": F.count(F.lit(1)).over(in_block),
            **{new: F.first(old).over(ordered) for new, old in first_of.items()},
        }
    )

    firsts = [F.min_by(old, position).alias(f"_{new}") for new, old in first_of.items()]
    per_block = lines.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"), *firsts)
    of_key = Window.partitionBy(*keys)
    along = of_key.orderBy(*blocks)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    spread = per_block.select(
        *group,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(of_key).alias("_total"),
        F.count(F.lit(1)).over(of_key).alias("_blocks"),
        *[F.first(f"_{new}").over(along).alias(f"_{new}") for new in first_of],
    ).where("_blocks > 1")

    joined = numbered.join(spread, group, "left")
    over_blocks = F.col("_blocks").isNotNull()
    filled: dict[str, Column] = {
        "line_no": (F.col("line_no") + F.coalesce("_before", F.lit(0))).cast("int"),
        "line_count": F.coalesce("_total", "line_count").cast("int"),
        **{new: F.when(over_blocks, F.col(f"_{new}")).otherwise(F.col(new)) for new in first_of},
    }
    return joined.withColumns(filled).drop("_before", "_total", "_blocks", *[f"_{new}" for new in first_of])


def on_first_line(value: Column) -> Column:
    """Order-level charges count on the first line only."""
    return F.when(F.col("line_no") == 1, value).otherwise(F.lit(0.0))


def spread_freight(lines: DataFrame, keys: Sequence[str], freight: str = "freight", **where) -> DataFrame:
    """Add extra_charge: a positive order freight is split evenly over the lines of the order.

    The freight of line 1 is the freight of the order. Cents that do not divide go one each to the first lines,
    so the sum over the order equals the freight. Freight of zero or less stays as it is on each row.
    """
    numbered = number_lines(lines, keys, first_of={"order_freight": freight}, **where)
    cents = F.floor(F.col("order_freight") * 100 + F.lit(0.5))
    each = F.floor(cents / F.col("line_count"))
    rest = cents - each * F.col("line_count")
    share = (each + F.when(F.col("line_no") <= rest, 1).otherwise(0)) / 100
    return numbered.withColumn(
        "extra_charge", F.when(F.col("order_freight") > 0, share).otherwise(F.col(freight))
    )
