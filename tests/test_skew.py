"""A key holding a third of all rows: results stay whole, work is split."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tessera.operators import layout, recommender

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _hot_pairs(spark, n=30000):
    # user 0 has a third of the pairs; the rest spread over 2000 users
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 2000 + 1).cast("int").alias("userId"),
        (F.col("id") % 500).cast("int").alias("movieId"),
    )


def _factors(spark, n, rank=4):
    return spark.range(n).select(
        F.col("id").cast("int").alias("id"),
        F.array(*[(F.col("id") * (k + 1) % 7).cast("float") for k in range(rank)]).alias("features"),
    )


def test_scoring_splits_a_hot_user(spark, skew_conf):
    pairs = _hot_pairs(spark)
    scored = recommender.score_vectors(pairs, _factors(spark, 2001), _factors(spark, 500))
    assert scored.count() == 30000  # whole result, nothing dropped
    buf = io.StringIO()
    scored.collect()
    with contextlib.redirect_stdout(buf):
        scored.explain()
    plan = buf.getvalue()
    assert "isFinalPlan=true" in plan
    assert "SortMergeJoin(skew=true)" in plan and "AQEShuffleRead skewed" in plan, plan


def test_hot_key_summary_is_exact(spark):
    pairs = _hot_pairs(spark)
    t = layout.skew_summary(pairs, "userId").first()
    assert t["max_records"] == 10000 and t["total_records"] == 30000


def test_partition_records_never_loses_rows(spark):
    df = spark.range(1000).groupBy((F.col("id") % 37).alias("k")).count()
    recs = layout.partition_records(df).collect()
    assert sum(r["records"] for r in recs) == 37
