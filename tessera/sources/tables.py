"""Ratings derived from the given parquet tables.

There is no ratings table among the inputs, so ratings are derived from
line items and their orders: the customer rates the part, the rating is
the quantity in half-star steps, and the order date is the event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import ITEM_COL, RATING_COL, TIME_COL, USER_COL


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ratings_from_tables(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """``userId, movieId, rating, timestamp`` (and ``extra`` lineitem columns) from lineitem x orders.

    Plain equi-join on the order key: both sides grow with the data, so no
    broadcast is forced; Catalyst prunes each scan to the columns used.
    Ids keep the tables' BIGINT type: customer keys pass the int range at
    large scale factors, where a cast would fail (ANSI) or wrap.
    """
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", *extra)
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("o_custkey").alias(USER_COL),
        F.col("l_partkey").alias(ITEM_COL),
        (F.ceil(F.col("l_quantity") / 5) * F.lit(0.5)).cast("float").alias(RATING_COL),
        F.unix_timestamp(F.col("o_orderdate")).cast("bigint").alias(TIME_COL),
        *extra,
    )


def planted_ratings(ratings: DataFrame) -> DataFrame:
    """Replace the rating by a smooth low-rank signal in half-star levels.

    Used to check that the recommender learns something; the derived
    order ratings are close to noise.
    """
    # The planted signal, 2.75 + 2.25*sin(0.37 u)*cos(0.91 i), rounded to 0.5.
    signal = F.lit(2.75) + F.lit(2.25) * F.sin(F.col(USER_COL) * F.lit(0.37)) * F.cos(
        F.col(ITEM_COL) * F.lit(0.91)
    )
    return ratings.withColumn(RATING_COL, (F.round(signal * 2) / 2).cast("float"))


# Oracle SQL (DuckDB) for the same ratings; used by the driver's check.
RATINGS_SQL = """
SELECT o_custkey AS "userId",
       l_partkey AS "movieId",
       CAST(ceil(l_quantity / 5) * 0.5 AS FLOAT) AS "rating",
       CAST(epoch(o_orderdate) AS BIGINT) AS "timestamp"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""".strip()

# The same rows in the ratings CSV layout (int ids), for the CSV routes.
RATINGS_CSV_SQL = """
SELECT CAST("userId" AS INTEGER) AS "userId", CAST("movieId" AS INTEGER) AS "movieId",
       rating, "timestamp"
FROM (""" + RATINGS_SQL + ")"
