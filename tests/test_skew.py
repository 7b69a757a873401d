"""A key that holds most rows must be split over tasks, and the result must stay whole."""

import re

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.joins import join_one

LOW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def low_thresholds(spark):
    before = {k: spark.conf.get(k, None) for k in LOW}
    for k, v in LOW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_large_key_is_split(spark, low_thresholds, how):
    # More than half of the rows share key 0.
    left = spark.range(0, 60000, 1, 12).selectExpr(
        "case when id % 10 < 6 then 0 else id % 5000 end as k", "id")
    left = left.withColumn("pad", F.sha2(F.col("id").cast("string"), 256))
    right = spark.range(0, 40000, 1, 6).selectExpr("id % 4000 as k").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = join_one(left, right, ["k"], how)
    rows = joined.collect()
    keys = {"left": 60000, "inner": sum(1 for i in range(60000) if key(i) < 4000)}
    keys["left_semi"], keys["left_anti"] = keys["inner"], 60000 - keys["inner"]
    assert len(rows) == keys[how] == len({r["id"] for r in rows})
    if how in ("left", "inner"):
        assert all(r["n"] == (10 if r["k"] < 4000 else None) for r in rows)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin\(skew=true\)|SortMergeJoin.*skew=true", plan), plan[:3000]


def key(i):
    return 0 if i % 10 < 6 else i % 5000


def test_key_types_must_agree(spark):
    with pytest.raises(TypeError):
        join_one(spark.range(1).selectExpr("id as k"), spark.range(1).selectExpr("cast(id as int) as k"), ["k"])
