"""Physical layout: repartitioning and how records spread over partitions.

A stated layout (:func:`repartition_by_keys`) puts every row into a partition that its own
columns name, so it is the same in every run and can be checked against SQL.  Counting
is an aggregate by partition id: one partial row per task moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repartition(df: DataFrame, partitions: int | None) -> DataFrame:
    """Round-robin to ``partitions``; unchanged when it is None or 0."""
    if partitions:
        return df.repartition(int(partitions))
    return df


def key_partition(keys: Sequence[str], partitions: int) -> Column:
    """The partition a row belongs to: the first 32 bits of md5('k1|k2|...') modulo ``partitions``.

    NULL keys are skipped, as in the hash split; equal keys share a partition, so give
    keys that spread."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    head = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return (head % F.lit(partitions)).cast("int")


def repartition_by_keys(df: DataFrame, partitions: int, keys: Sequence[str]) -> DataFrame:
    """``df`` with every row in the partition that :func:`key_partition` names."""
    if partitions < 1:
        raise ValueError(f"partitions must be positive, got {partitions}")
    return df.repartitionById(int(partitions), key_partition(keys, int(partitions)))


def num_partitions(df: DataFrame) -> int:
    """Partitions of ``df`` as it runs.  No job for scans and narrow steps; an adaptive plan
    with shuffles has to run those to know, so where a count was asked for, use that."""
    return df.rdd.getNumPartitions()


def partition_records(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``partition_id int, records long``, one row per partition, zeros kept.

    ``partitions`` is the number that ``df`` was dealt to; without it the plan is asked."""
    n = partitions or num_partitions(df)
    counts = df.select(F.spark_partition_id().alias("partition_id")).groupBy("partition_id").agg(F.count(F.lit(1)).alias("records"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("partition_id"))
    return every.join(counts, "partition_id", "left").select(
        "partition_id", F.coalesce("records", F.lit(0).cast("long")).alias("records")
    )


def group_summary(counts: DataFrame, count_col: str = "records", prefix: str = "") -> DataFrame:
    """Number of groups, total, min, max and floor average of a count column.

    Min, max and average are NULL when there are no groups.
    """
    c = F.col(count_col)
    n = F.count(F.lit(1))
    return counts.agg(
        n.alias(f"{prefix}groups" if prefix else "partitions"),
        F.coalesce(F.sum(c), F.lit(0).cast("long")).alias("total_records"),
        F.min(c).alias("min_records"),
        F.max(c).alias("max_records"),
        F.floor(F.sum(c) / n).alias("avg_records"),
    )


def partition_totals(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Summary of :func:`partition_records`."""
    return group_summary(partition_records(df, partitions))


def skew_summary(df: DataFrame, key: str) -> DataFrame:
    """The same summary over a data key instead of partitions.

    Counting per key uses partial aggregation before the shuffle, so a key
    holding a third of all rows costs one partial count per task, not a
    hot reducer.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("records"))
    return group_summary(per_key, prefix="key_").withColumnRenamed("key_groups", "keys")
