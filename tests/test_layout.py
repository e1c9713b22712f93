import pytest

from tessera.operators import layout


def test_zero_row_partitions_are_reported(spark):
    df = spark.range(3).repartition(8)
    rows = layout.partition_records(df).orderBy("partition_id").collect()
    assert [r["partition_id"] for r in rows] == list(range(8))
    counts = [r["records"] for r in rows]
    assert sum(counts) == 3 and counts.count(0) == 5


def test_totals(spark):
    df = spark.range(103).repartition(10)
    t = layout.partition_totals(df).first()
    assert t["partitions"] == 10 and t["total_records"] == 103
    assert t["avg_records"] == 10
    assert t["min_records"] <= 10 <= t["max_records"]


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "records long")
    t = layout.group_summary(empty).first()
    assert t["partitions"] == 0 and t["total_records"] == 0
    assert t["min_records"] is None and t["max_records"] is None and t["avg_records"] is None


def test_repartition_skips_none_and_zero(spark):
    df = spark.range(10).coalesce(3)
    assert layout.num_partitions(layout.repartition(df, None)) == 3
    assert layout.num_partitions(layout.repartition(df, 0)) == 3
    assert layout.num_partitions(layout.repartition(df, 7)) == 7


def test_skew_summary_hot_key(spark):
    from pyspark.sql import functions as F

    # one key holds a third of the rows
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"))
    t = layout.skew_summary(df, "k").first()
    assert t["keys"] == 2001 and t["total_records"] == 3000
    assert t["max_records"] == 1000 and t["min_records"] == 1


def _jobs(spark, group, run):
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_partition_count_of_a_scan_runs_no_job_and_records_are_one_pass(spark):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.adaptive.enabled")
    n, jobs = _jobs(spark, "count-partitions", lambda: layout.num_partitions(spark.range(1000, numPartitions=6).select("id")))
    assert (n, jobs) == (6, 0)
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.adaptive.enabled"))
    df = spark.range(1000).repartition(8)
    assert layout.num_partitions(df) == 8
    rows, jobs = _jobs(spark, "partition-records", lambda: layout.partition_records(df, 8).collect())
    assert jobs <= 4  # the shuffle, the counts and their join to the ids, each once
    assert len(rows) == 8 and sum(r["records"] for r in rows) == 1000


def test_every_row_is_in_its_stated_partition(spark):
    from pyspark.sql import functions as F

    df = spark.range(500).select(F.col("id").alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("b"))
    for n in (1, 8, 100):
        dealt = layout.repartition_by_keys(df, n, ["a", "b"])
        got = dealt.select(F.spark_partition_id().alias("p"), layout.key_partition(["a", "b"], n).alias("k")).collect()
        assert all(r.p == r.k for r in got) and len(got) == 500
        rows = layout.partition_records(dealt, n).collect()
        assert sorted(r["partition_id"] for r in rows) == list(range(n))
        counts = {}
        for r in got:
            counts[r.p] = counts.get(r.p, 0) + 1
        assert {r["partition_id"]: r["records"] for r in rows if r["records"]} == counts
    with pytest.raises(ValueError):
        layout.repartition_by_keys(df, 0, ["a"])


def test_empty_partitions_are_kept(spark):
    rows = layout.partition_records(spark.range(3).repartition(8)).collect()
    assert sorted(r["partition_id"] for r in rows) == list(range(8)) and sum(r["records"] for r in rows) == 3
