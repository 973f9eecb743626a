"""A key with a third of all rows: joins are split at run time and no rank task gets the whole key."""

import pytest
from pyspark.sql import functions as F

from queryproof.operators.joins import outer_join
from queryproof.operators.ranking import ranked_rows

# Thresholds scaled down so that a test table counts as skewed.
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def scaled_down(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_table(spark, n=60_000):
    ids = spark.range(0, n, 1, 8)
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997)
    return ids.select(key.alias("k"), (F.col("id") % 250).alias("b"), "id", F.sha2(F.col("id").cast("string"), 256).alias("pad"))


def test_outer_join_splits_the_hot_side(scaled_down):
    many = hot_table(scaled_down)
    one = scaled_down.range(0, 1200).select(F.col("id").alias("key"), F.lit("x").alias("label"))
    joined = outer_join(one, "key", many, "k", "left", hot="right")
    assert joined.count() == 60_000 + (1200 - 997)
    joined.write.format("noop").mode("overwrite").save()
    collected = joined.select("key", "pad")
    collected.collect()
    plan = collected._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan


def test_ranking_spreads_the_hot_key(scaled_down):
    many = hot_table(scaled_down)
    ranked = ranked_rows(many, ["k"], [("b", "asc"), ("id", "asc")])
    hot = ranked.filter("k = 0").withColumn("task", F.spark_partition_id())
    rows = [r["count"] for r in hot.groupBy("task").count().collect()]
    assert sum(rows) == many.filter("k = 0").count()
    assert max(rows) < sum(rows) / 3
    checked = ranked.filter("k = 0").agg(F.min("rn"), F.max("rn"), F.count_distinct("rn")).collect()[0]
    assert tuple(checked) == (1, sum(rows), sum(rows))


def test_ranking_spreads_one_order_value_and_one_repeated_row(scaled_down):
    same = scaled_down.range(0, 20_000, 1, 8).selectExpr("0 AS k", "7 AS b", "'x' AS pad")
    for keys in (["k"], []):
        ranked = ranked_rows(same, keys, [("b", "asc")])
        tasks = [r["count"] for r in ranked.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
        assert max(tasks) < 20_000 / 2
        assert tuple(ranked.agg(F.min("rn"), F.max("rn"), F.count_distinct("rn")).collect()[0]) == (1, 20_000, 20_000)
