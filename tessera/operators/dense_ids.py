"""Dense numbers for ids of any size, for solvers that only take int ids.

The distinct ids are range-partitioned and sorted; each partition numbers its own ids,
and the counts of the partitions before it are added.  No window over all ids and
no id on the driver: only one count per partition goes there.  An id's number is its
rank, so it does not depend on how many partitions there are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import shared_path

#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
ROW_BITS = 33


def dense_index(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """``id`` and ``index`` (bigint, 0 to n - 1 in id order) of the distinct values of ``key``; null has none.

    The numbered ids are written to the shared folder first, since the bounds of a range
    partitioning may differ when a lost part is computed again.
    """
    spark = df.sparkSession
    ids = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct()
    by = [partitions] if partitions else []
    ordered = ids.repartitionByRange(*by, "id").sortWithinPartitions("id")
    place = F.monotonically_increasing_id()
    path = shared_path(spark, "dense-ids", uuid.uuid4().hex)
    ordered.select(
        "id",
        F.shiftright(place, ROW_BITS).cast("int").alias("part"),
        place.bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("place"),
    ).write.parquet(path)
    numbered = spark.read.parquet(path)
    counts = {r["part"]: r["n"] for r in numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, upto = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(upto)
        upto += counts.get(part, 0)
    offset = F.get(F.lit(before), F.col("part")) if before else F.lit(0)
    return numbered.select("id", (F.col("place") + offset.cast("bigint")).alias("index"))
