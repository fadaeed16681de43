"""One dominant key, no broadcast: the final plans must split it, or join nothing but counts."""

import re

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import stats
from pulsegrid.operators.aggregates import floor_rank_quantile
from pulsegrid.session import durable


@pytest.fixture
def skewed(spark):
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield spark.range(0, 400_000, 1, 8).select(
        F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id") % 97).cast("int").alias("e"), (F.xxhash64("id") % 1000 / 7.0).alias("v")
    )
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_percentile_splits_the_hot_entity(skewed):
    # one row per entity, written as the plans write it: right below the join an aggregate, or a
    # persisted frame with the same partitioning, would keep Spark from splitting the rows
    level = durable(skewed.groupBy("e").agg(F.avg("v").alias("x")))
    out = skewed.join(level, "e").groupBy("e").agg(stats.percentile_of(F.col("v"), F.col("x")).alias("p"))
    assert "skew=true" in final_plan(out)


def test_quantiles_join_counts_only(skewed):
    out = floor_rank_quantile(skewed, ["e"], "v", {"p50": 0.5})
    plan = final_plan(out)
    # whatever a join reads has been counted: no join stands directly on the rows
    assert "SortMergeJoin" in plan and re.search(r"HashAggregate", plan)
    hot = sorted(r.v for r in skewed.where("e = 1").collect())
    assert {r.e: r.p50 for r in out.collect()}[1] == hot[len(hot) // 2]
