"""Joins against a side with at most one row per key.

One order, row key or file may hold a large share of the rows on the left. Spark splits such a key at run time,
but only where both sides of the join have just been shuffled. The one-row side usually comes out of an
aggregate and would be joined where it lies, so a bucket number computed from the keys joins along: it is equal
wherever the keys are, changes no result, and makes Spark shuffle both sides for the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

BUCKETS = 4096


def join_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join rows with their one partner; the keys have the same names and types on both sides."""
    of_left, of_right = dict(left.dtypes), dict(right.dtypes)
    for key in keys:
        if of_left[key] != of_right[key]:
            raise TypeError(f"{key} is {of_left[key]} on the left and {of_right[key]} on the right")
    bucket = F.pmod(F.hash(*keys), F.lit(BUCKETS))
    on = [*keys, "_bucket"]
    return left.withColumn("_bucket", bucket).join(right.withColumn("_bucket", bucket), on, how).drop("_bucket")


def known_keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of a table, once each; repeated ones are dropped before they are shuffled."""
    return table.select(*keys).distinct()
