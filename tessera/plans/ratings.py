"""Shared building blocks for the named queries: ratings, staged copies,
splits and the fitted model, each computed once per session and source."""

from __future__ import annotations

import os
import threading

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import recommender
from tessera.operators.split import label_split
from tessera.schema import ITEM_COL, RATING_COLUMNS, USER_COL
from tessera.session import sql_settings
from tessera.sources.csv import write_ratings_csv
from tessera.sources.staging import stage, table_fingerprint
from tessera.sources.tables import ratings_from_tables

_lock = threading.Lock()
_models: dict[tuple, ALSModel] = {}

RATING_TABLES = ["lineitem", "orders"]
# Bumped whenever what a stage holds changes, so old copies are not reused.
STAGE_VERSION = 5


def sf_path(sf_dir: str) -> str:
    return sf_dir if "://" in sf_dir else os.path.abspath(sf_dir)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings_from_tables(spark, sf_path(sf_dir))


# How the staged copy is written: a task keeps a file open for each side, so that rows are not
# sorted by side, and joins about half a million line items, whatever the size of the tables.
WRITE_SETTINGS = {
    "spark.sql.maxConcurrentOutputFileWriters": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}


def _write_by_split(df: DataFrame, path: str) -> None:
    with sql_settings(df.sparkSession, WRITE_SETTINGS):
        df.write.mode("overwrite").partitionBy("split").parquet(path)


def ratings_tag(spark: SparkSession, sf_dir: str) -> str:
    """Names the present state of the tables that ratings come from."""
    return table_fingerprint(spark, sf_path(sf_dir), RATING_TABLES, STAGE_VERSION)


def staged_ratings_parquet(spark: SparkSession, sf_dir: str) -> str:
    """Ratings written once as Parquet in the shared folder, partitioned by
    the default hash-split label: reading one side is a partition-pruned
    scan, and the per-row hash runs once, at staging."""
    sf = sf_path(sf_dir)
    tag = ratings_tag(spark, sf)
    return stage(
        spark,
        "ratings_parquet",
        tag,
        lambda: label_split(ratings_from_tables(spark, sf)),
        write=_write_by_split,
    )


def staged_ratings_csv(spark: SparkSession, sf_dir: str) -> str:
    """Ratings as header CSV text (the reference's input format)."""
    sf = sf_path(sf_dir)
    tag = ratings_tag(spark, sf)
    return stage(
        spark, "ratings_csv", tag, lambda: ratings_from_tables(spark, sf), write=write_ratings_csv
    )


def staged_half_csv(spark: SparkSession, sf_dir: str, odd: bool) -> str:
    """Ratings CSV of the users with odd, or with even, ids: two folders of one source."""
    sf = sf_path(sf_dir)
    build = lambda: ratings_from_tables(spark, sf).where(F.pmod("userId", F.lit(2)) == int(odd))
    return stage(spark, f"ratings_csv_{'odd' if odd else 'even'}", ratings_tag(spark, sf), build, write=write_ratings_csv)


def staged_wide_csv(spark: SparkSession, sf_dir: str) -> str:
    """Ratings CSV with columns in another order plus extra columns, for
    the by-name projection route."""
    sf = sf_path(sf_dir)
    tag = ratings_tag(spark, sf)

    def build() -> DataFrame:
        r = ratings_from_tables(spark, sf)
        return r.select(
            F.lit("r").alias("kind"),
            "movieId",
            "timestamp",
            "userId",
            F.col("rating").cast("double").alias("rating"),
            (F.col("userId").cast("bigint") + F.col("movieId")).alias("extra"),
        )

    return stage(spark, "ratings_wide_csv", tag, build, write=write_ratings_csv)


def staged_malformed_csv(spark: SparkSession, sf_dir: str, wide: bool = False) -> str:
    """Ratings CSV in which the line number of an order decides on a bad value:
    2 a text as user, 3 no user, 4 a fraction as item, 5 no rating, 6 a fraction as user (beside texts),
    and, if ``wide``, 7 a user beyond int."""
    sf = sf_path(sf_dir)

    def build() -> DataFrame:
        n = F.col("l_linenumber")
        rows = ratings_from_tables(spark, sf, "l_linenumber")
        user, item = F.col("userId").cast("string"), F.col("movieId").cast("string")
        bad = F.when(n == 2, "x").when(n == 3, None).when(n == 6, F.concat(user, F.lit(".7")))
        if wide:
            bad = bad.when(n == 7, (F.col("userId").cast("bigint") + F.lit(2**33)).cast("string"))
        return rows.select(
            bad.otherwise(user).alias("userId"),
            F.when(n == 4, F.concat(item, F.lit(".7"))).otherwise(item).alias("movieId"),
            F.when(n != 5, F.col("rating")).alias("rating"),
            "timestamp",
        )

    name = "ratings_wide_malformed_csv" if wide else "ratings_malformed_csv"
    return stage(spark, name, ratings_tag(spark, sf), build, write=write_ratings_csv)


def staged_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged Parquet ratings with their ``split`` label (a partition
    column): later queries read this columnar copy instead of repeating
    the lineitem x orders join."""
    return spark.read.parquet(staged_ratings_parquet(spark, sf_dir))


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_labelled(spark, sf_dir).select(*RATING_COLUMNS)


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) of the default hash split, read by partition pruning."""
    df = staged_labelled(spark, sf_dir)
    side = F.col("split")
    return (
        df.where(side == F.lit("train")).select(*RATING_COLUMNS),
        df.where(side == F.lit("test")).select(*RATING_COLUMNS),
    )


def shifted(ratings: DataFrame, shift: int) -> DataFrame:
    """The ratings with ``shift`` added to user and item ids."""
    if not shift:
        return ratings
    return ratings.withColumns({c: F.col(c).cast("bigint") + F.lit(shift) for c in (USER_COL, ITEM_COL)})


def fitted_model(
    spark: SparkSession,
    sf_dir: str,
    params: recommender.AlsParams = recommender.AlsParams(),
    held_out: bool = False,
    shift: int = 0,
) -> ALSModel | recommender.IndexedModel:
    """ALS fitted on the hash-split training rows, once per (application, state of
    the input tables, parameters).  ``held_out`` leaves out of training all rows of
    every tenth user and every seventeenth item.

    Training input is the staged Parquet copy, so refits and retries read
    files instead of replaying the join.
    """
    key = (spark.sparkContext.applicationId, ratings_tag(spark, sf_dir), params, held_out, shift)
    with _lock:
        model = _models.get(key)
    if model is None:
        train, _ = split(spark, sf_dir)
        if held_out:
            train = train.where((F.col("userId") % 10 != 0) & (F.col("movieId") % 17 != 0))
        model, _ = recommender.fit(shifted(train, shift), params)
        with _lock:
            _models[key] = model
    return model
