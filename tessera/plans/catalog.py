"""Every named query: a Spark function ``(spark, sf_dir) -> DataFrame`` and,
where the answer can be written in SQL, the DuckDB text that must give the
same rows on the same tables.

Doubles that come out of sums over many rows are rounded to ``DIGITS``
places on both sides, since the engines add in different orders.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import layout, metrics, recommender, sizing
from tessera.operators.dense_ids import dense_index
from tessera.operators.skew import HEAVY_SHARE
from tessera.operators.split import DEFAULT_SEED, DEFAULT_SPLIT_KEYS, label_split, random_split, split_threshold
from tessera.plans import experiment
from tessera.plans import ratings as R
from tessera.schema import ITEM_COL, RATING_COL, RATING_COLUMNS, USER_COL
from tessera.session import shared_path
from tessera.sources.csv import read_ratings_csv, read_sampled
from tessera.sources.incremental import StagedFiles, stage_files
from tessera.sources.rejects import ROUTES, read_with_rejects, reject_counts
from tessera.sources.tables import RATINGS_CSV_SQL, RATINGS_SQL, read_table

DIGITS = 9
# Factors are floats: what rounding them leaves of a user's normal equations.
RESIDUAL_TOLERANCE = 1e-3
# Scores are floats in MLlib and doubles in the join.
SCORE_TOLERANCE = 1e-4
# Added to the ids for the queries on ids beyond int.
WIDE_SHIFT = 2**33
# Executor memory settings the reference reasons about
# (its default, the fixed per-worker value, the compose default), then the other
# forms of the setting, small ones that the data exceed, and text that is none.
MEMORY_SETTINGS = ("4g", "6g", "1g", "512m", "1024", "2m", "6G", "xg", "")

Query = Callable[[SparkSession, str], DataFrame]


def _r(c: str) -> F.Column:
    return F.round(F.col(c), DIGITS).alias(c)


# --- SQL fragments ----------------------------------------------------------

_TRAIN_SQL = (
    "substring(md5(concat_ws('|', \"userId\", \"movieId\", \"timestamp\", "
    f"'{DEFAULT_SEED}')), 1, 8) < '{split_threshold(0.8)}'"
)


def _sql(select: str, *ctes: str) -> str:
    """``WITH ratings AS (...), <ctes> <select>``."""
    parts = [f"ratings AS ({RATINGS_SQL})", *ctes]
    return "WITH " + ",\n".join(parts) + "\n" + select


_SPLIT_CTE = f"""split AS (
  SELECT *, CASE WHEN {_TRAIN_SQL} THEN 'train' ELSE 'test' END AS split FROM ratings
)"""


# --- queries ----------------------------------------------------------------


def q_ratings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ratings(spark, sf_dir)


def q_record_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.staged(spark, sf_dir).agg(F.count(F.lit(1)).alias("records"))


def q_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_split(R.ratings(spark, sf_dir))


def q_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per side of the default split (a partition column of the staged
    copy, so no data column is read)."""
    return R.staged_labelled(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("records"))


def q_random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of Spark's native ``randomSplit``: together all rows, each once
    (which side a row is on depends on the input partitioning)."""
    train, test = random_split(R.staged(spark, sf_dir))
    return train.unionByName(test)


def q_rmse_mean_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = R.staged_labelled(spark, sf_dir)
    return metrics.mean_baseline_rmse(labelled).select(_r("rmse"), "test_records")


def q_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizing.size_estimate(R.staged(spark, sf_dir))


def q_memory_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sizing.size_estimate(R.staged(spark, sf_dir))
    return sizing.memory_pressure(sizes, MEMORY_SETTINGS)


def q_skew_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.staged(spark, sf_dir)
    users = layout.skew_summary(r, USER_COL).select(F.lit(USER_COL).alias("key_col"), "*")
    items = layout.skew_summary(r, ITEM_COL).select(F.lit(ITEM_COL).alias("key_col"), "*")
    return users.unionByName(items)


def stated_layout(spark: SparkSession, sf_dir: str, partitions: int = 8) -> DataFrame:
    """The ratings, each in the partition that its keys name."""
    return layout.repartition_by_keys(R.staged(spark, sf_dir), partitions, DEFAULT_SPLIT_KEYS)


def q_partition_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each partition of the stated layout, counted where they are."""
    return layout.partition_records(stated_layout(spark, sf_dir), 8)


def q_partition_records_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings laid out by their few values over more partitions than those fill: empty ones are reported."""
    dealt = layout.repartition_by_keys(R.staged(spark, sf_dir), 64, [RATING_COL])
    return layout.partition_records(dealt, 64)


def q_partition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, total, least, most and floor average over the stated layout."""
    return layout.partition_totals(stated_layout(spark, sf_dir), 8)


def q_partition_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions, rows and floor average; least and most depend on the deal."""
    totals = layout.partition_totals(layout.repartition(R.staged(spark, sf_dir), 8), 8)
    return totals.select("partitions", "total_records", "avg_records")


def q_csv_scan_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ratings_csv(spark, R.staged_ratings_csv(spark, sf_dir), mode="explicit")


def q_csv_scan_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ratings_csv(spark, R.staged_ratings_csv(spark, sf_dir), mode="inferred")


def q_project_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ratings_csv(spark, R.staged_wide_csv(spark, sf_dir), mode="inferred")


def q_cast_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text ids, empty fields and fractions in the CSV, by both routes."""
    path = R.staged_malformed_csv(spark, sf_dir)
    routes = [
        read_ratings_csv(spark, path, mode=mode).select(F.lit(mode).alias("route"), "*")
        for mode in ("explicit", "inferred")
    ]
    return routes[0].unionByName(routes[1])


def q_csv_scan_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types from the first lines, checked in the scan itself."""
    return read_ratings_csv(spark, R.staged_ratings_csv(spark, sf_dir), mode="sampled")


def q_csv_scan_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The malformed CSV with types from its first line, made wider by the fields that break them."""
    rows, _ = read_sampled(spark, R.staged_malformed_csv(spark, sf_dir), lines=1, on_break="widen")
    return rows


def q_cast_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected fields by route, column and reason, ids beyond int among them."""
    path = R.staged_malformed_csv(spark, sf_dir, wide=True)
    routes = [
        reject_counts(read_with_rejects(spark, path, route)).select(F.lit(route).alias("route"), "column", "reason", "fields")
        for route in ROUTES
    ]
    return routes[0].unionByName(routes[1])


def q_quarantined_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of that read, with NULL where a field was rejected."""
    path = R.staged_malformed_csv(spark, sf_dir, wide=True)
    routes = [read_with_rejects(spark, path, route).ratings.select(F.lit(route).alias("route"), "*") for route in ROUTES]
    return routes[0].unionByName(routes[1])


def q_stage_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings staged once (written only when no committed copy exists)."""
    return R.staged(spark, sf_dir)


def q_stage_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV source staged file by file: one folder first, then, with a second one added, only that."""
    even, odd = (R.staged_half_csv(spark, sf_dir, side) for side in (False, True))
    name = f"ratings-{R.ratings_tag(spark, sf_dir)}"
    read = lambda paths: read_ratings_csv(spark, paths)
    StagedFiles(spark, name).refresh([even], read)
    return stage_files(spark, name, [even, odd], read)


def q_score_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings scored against vectors from the ``embeddings`` table, used as
    user and item factor tables (id = vec_id)."""
    emb = read_table(spark, R.sf_path(sf_dir), "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features")
    )
    scored = recommender.score_vectors(R.staged(spark, sf_dir), emb, emb)
    return scored.select(*RATING_COLUMNS, _r("prediction"))


def hot_user_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged ratings with every third item's rows given to user 1."""
    hot = F.when(F.col(ITEM_COL) % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col(USER_COL))
    return R.staged(spark, sf_dir).withColumn(USER_COL, hot)


def q_score_hot_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score_vectors`` where one user holds a third of the ratings: vectors of ids
    above a share of the ratings come by broadcast, the others by shuffle."""
    emb = read_table(spark, R.sf_path(sf_dir), "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features")
    )
    scored = recommender.score_vectors(hot_user_ratings(spark, sf_dir), emb, emb, heavy_share=HEAVY_SHARE)
    return scored.select(*RATING_COLUMNS, _r("prediction"))


def q_cold_start_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows that survive ALS scoring when some users and items are held
    out of training and cold-start rows are dropped."""
    model = R.fitted_model(spark, sf_dir, held_out=True)
    _, test = R.split(spark, sf_dir)
    return recommender.predict(model, test).select(*RATING_COLUMNS)


def q_als_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = R.fitted_model(spark, sf_dir)
    _, test = R.split(spark, sf_dir)
    return recommender.predict(model, test)


def q_als_predict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored rows, and whether each score is a finite number."""
    score = F.col("prediction").cast("double")
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < F.lit(float("inf")))
    return q_als_predict(spark, sf_dir).select(USER_COL, ITEM_COL, "timestamp", finite.alias("finite"))


def q_als_predict_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows, and whether MLlib's scores are those of the join with its factors."""
    model = R.fitted_model(spark, sf_dir)
    _, test = R.split(spark, sf_dir)
    keys = [USER_COL, ITEM_COL, "timestamp", RATING_COL]
    one = F.lit(1).cast("long")
    mllib = recommender.predict(model, test).select(*keys, one.alias("n"), F.col("prediction").alias("p"))
    joined = recommender.score_vectors(test, model.userFactors, model.itemFactors).select(*keys, one.alias("m"), F.col("prediction").alias("q"))
    # rows of equal keys meet in one shuffle, uncounted, since hardly two of a side have the same keys;
    # those with a null in their keys meet only their own side's
    own = F.when(functools.reduce(or_, [F.col(k).isNull() for k in keys]), F.col("n").isNull())
    rows = mllib.unionByName(joined, allowMissingColumns=True).repartition(USER_COL, ITEM_COL, "timestamp")
    both = rows.groupBy(*keys, own.alias("own")).agg(
        F.sum("n").alias("n"), F.sum("m").alias("m"), F.max("p").alias("p"), F.max("q").alias("q"))
    differs = F.abs(F.col("p").cast("double") - F.col("q"))
    return both.agg(
        F.sum("n").alias("records"),
        F.coalesce((F.max(differs) < F.lit(SCORE_TOLERANCE)) & F.every(F.col("n").eqNullSafe(F.col("m"))), F.lit(True)).alias("matches"),
    )


def q_als_wide_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit and its scored test rows where all ids are beyond int (shifted for it, and back)."""
    model = R.fitted_model(spark, sf_dir, shift=WIDE_SHIFT)
    _, test = R.split(spark, sf_dir)
    score = F.col("prediction").cast("double")
    scored = recommender.predict(model, R.shifted(test, WIDE_SHIFT))
    back = [(F.col(c) - F.lit(WIDE_SHIFT)).alias(c) for c in (USER_COL, ITEM_COL)]
    return scored.select(*back, "timestamp", (score.isNotNull() & ~F.isnan(score)).alias("finite"))


def q_dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense number of each user and item whose ids are beyond int."""
    wide = R.shifted(R.staged(spark, sf_dir), WIDE_SHIFT)
    sides = [dense_index(wide, c).select(F.lit(c).alias("side"), "id", "index") for c in (USER_COL, ITEM_COL)]
    return sides[0].unionByName(sides[1])


def q_als_residual_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the fit, and whether all solve their normal equations."""
    train, _ = R.split(spark, sf_dir)
    residual = recommender.user_residual(R.fitted_model(spark, sf_dir), train)
    return residual.agg(
        F.count(F.lit(1)).alias("users"),
        (F.max("residual") < F.lit(RESIDUAL_TOLERANCE)).alias("within_tolerance"),
    )


def q_als_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = R.fitted_model(spark, sf_dir)
    _, test = R.split(spark, sf_dir)
    return metrics.rmse(recommender.predict(model, test))


def q_als_user_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fitted_model(spark, sf_dir).userFactors


def q_als_item_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fitted_model(spark, sf_dir).itemFactors


_EXPERIMENT_CONFIG = experiment.ExperimentConfig(2, 8)
_runs: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def _experiments(spark: SparkSession, sf_dir: str, configs) -> tuple[DataFrame, DataFrame]:
    """Sweep over the staged ratings, run once per (application, state of the
    input tables, configurations); the results are a few rows."""
    key = (spark.sparkContext.applicationId, R.ratings_tag(spark, sf_dir), tuple(configs))
    if key not in _runs:
        _runs[key] = experiment.sweep(spark, lambda: R.staged(spark, sf_dir), configs)
    return _runs[key]


def q_experiment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, _ = _experiments(spark, sf_dir, [_EXPERIMENT_CONFIG])
    return results.select("num_nodes", "partitions", "num_records", "train_records", "test_records")


def q_experiment_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _experiments(spark, sf_dir, [_EXPERIMENT_CONFIG])[0]


def q_experiment_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _experiments(spark, sf_dir, experiment.choose_configs())[0]


def q_experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.summary(_experiments(spark, sf_dir, experiment.choose_configs())[0])


def q_experiment_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _experiments(spark, sf_dir, experiment.choose_configs())[1]


def q_sweep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, _ = _experiments(spark, sf_dir, experiment.choose_configs())
    return results.select("num_nodes", "partitions", "num_records", "train_records", "test_records")


def q_results_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep's results written twice and read back: each configuration is there once."""
    results, _ = _experiments(spark, sf_dir, experiment.choose_configs())
    path = shared_path(spark, "results", R.ratings_tag(spark, sf_dir))
    for _ in range(2):
        experiment.save_results(results, path, "sweep")
    rows = experiment.read_results(spark, path, "sweep")
    return rows.select("run", "num_nodes", "partitions", "num_records", "train_records", "test_records")


def q_experiment_checkpointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-node experiment with both sides kept in the checkpoint folder instead of the cache."""
    key = (spark.sparkContext.applicationId, R.ratings_tag(spark, sf_dir), "checkpoint")
    if key not in _runs:
        _runs[key] = experiment.sweep(spark, lambda: R.staged(spark, sf_dir), [_EXPERIMENT_CONFIG], keep="checkpoint")
    return _runs[key][0].select("num_nodes", "partitions", "num_records", "train_records", "test_records")


QUERIES: dict[str, Query] = {
    "ratings_view": q_ratings_view,
    "record_count": q_record_count,
    "hash_split": q_hash_split,
    "split_counts": q_split_counts,
    "rmse_mean_baseline": q_rmse_mean_baseline,
    "size_estimate": q_size_estimate,
    "memory_pressure": q_memory_pressure,
    "skew_summary": q_skew_summary,
    "partition_records": q_partition_records,
    "partition_records_sparse": q_partition_records_sparse,
    "partition_summary": q_partition_summary,
    "partition_totals": q_partition_totals,
    "csv_scan_explicit": q_csv_scan_explicit,
    "csv_scan_inferred": q_csv_scan_inferred,
    "project_cast": q_project_cast,
    "cast_malformed": q_cast_malformed,
    "csv_scan_sampled": q_csv_scan_sampled,
    "csv_scan_widened": q_csv_scan_widened,
    "cast_rejects": q_cast_rejects,
    "quarantined_ratings": q_quarantined_ratings,
    "stage_if_absent": q_stage_if_absent,
    "stage_incremental": q_stage_incremental,
    "score_vectors": q_score_vectors,
    "score_hot_user": q_score_hot_user,
    "cold_start_kept": q_cold_start_kept,
    "als_predict": q_als_predict,
    "als_rmse": q_als_rmse,
    "als_predict_rows": q_als_predict_rows,
    "als_residual_ok": q_als_residual_ok,
    "als_predict_matches": q_als_predict_matches,
    "als_wide_ids": q_als_wide_ids,
    "dense_index": q_dense_index,
    "als_user_factors": q_als_user_factors,
    "als_item_factors": q_als_item_factors,
    "experiment_counts": q_experiment_counts,
    "experiment_result": q_experiment_result,
    "experiment_sweep": q_experiment_sweep,
    "sweep_counts": q_sweep_counts,
    "results_readback": q_results_readback,
    "experiment_checkpointed": q_experiment_checkpointed,
    "experiment_phases": q_experiment_phases,
    "experiment_summary": q_experiment_summary,
    "random_split": q_random_split,
}


# --- DuckDB twins -------------------------------------------------------------

_MEM_SQL = ", ".join(f"({i}, '{t}')" for i, t in enumerate(MEMORY_SETTINGS))

_LAYOUT_SQL = """SELECT CAST(p AS INTEGER) AS partition_id, count(k) AS records
FROM range({n}) parts(p) LEFT JOIN (
  SELECT ('0x' || substring(md5(concat_ws('|', {keys})), 1, 8))::BIGINT % {n} AS k FROM ratings
) ON k = p GROUP BY p"""
_KEYS_SQL = '"userId", "movieId", "timestamp"'

_SKEW_SQL = """SELECT '{k}' AS key_col, count(*) AS keys,
       CAST(coalesce(sum(records), 0) AS BIGINT) AS total_records,
       min(records) AS min_records, max(records) AS max_records,
       CAST(floor(sum(records) / count(*)) AS BIGINT) AS avg_records
FROM (SELECT "{k}", count(*) AS records FROM ratings GROUP BY "{k}")"""

_MALFORMED_SQL = """WITH t AS (
  SELECT CAST(o_custkey AS INTEGER) AS u, CAST(l_partkey AS INTEGER) AS i, l_linenumber AS n,
         CAST(ceil(l_quantity / 5) * 0.5 AS FLOAT) AS r, CAST(epoch(o_orderdate) AS BIGINT) AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

ORACLE_SQL: dict[str, str] = {
    "ratings_view": RATINGS_SQL,
    "record_count": _sql("SELECT count(*) AS records FROM ratings"),
    "hash_split": _sql("SELECT * FROM split", _SPLIT_CTE),
    "split_counts": _sql(
        "SELECT split, count(*) AS records FROM split GROUP BY split", _SPLIT_CTE
    ),
    "rmse_mean_baseline": _sql(
        f"""SELECT round(sqrt(avg(power(CAST(rating AS DOUBLE)
         - (SELECT avg(CAST(rating AS DOUBLE)) FROM split WHERE split = 'train'), 2))), {DIGITS}) AS rmse,
       count(*) AS test_records
FROM split WHERE split = 'test'""",
        _SPLIT_CTE,
    ),
    "size_estimate": _sql(
        """SELECT n AS num_records, CAST(n AS DOUBLE) * 32 / 1048576 AS raw_size_mb,
       CAST(n AS DOUBLE) * 32 / 1048576 * 3 AS als_memory_mb, 3 AS als_factor_multiplier FROM x""",
        "x AS (SELECT count(*) AS n FROM ratings)",
    ),
    "memory_pressure": _sql(
        """SELECT setting, executor_memory, executor_memory_mb, num_records, als_memory_mb,
       als_memory_mb > executor_memory_mb AS pressure,
       round(als_memory_mb / executor_memory_mb, 1) AS pressure_ratio
FROM sizes, mem""",
        """sizes AS (SELECT count(*) AS num_records,
                  CAST(count(*) AS DOUBLE) * 32 / 1048576 * 3 AS als_memory_mb FROM ratings)""",
        f"""mem AS (SELECT setting, executor_memory,
          CASE WHEN executor_memory LIKE '%g' THEN TRY_CAST(left(executor_memory, length(executor_memory) - 1) AS DOUBLE) * 1024
               WHEN executor_memory LIKE '%m' THEN TRY_CAST(left(executor_memory, length(executor_memory) - 1) AS DOUBLE)
               ELSE TRY_CAST(executor_memory AS DOUBLE) END AS executor_memory_mb
        FROM (VALUES {_MEM_SQL}) AS t(setting, executor_memory))""",
    ),
    "skew_summary": _sql(
        _SKEW_SQL.format(k=USER_COL) + "\nUNION ALL\n" + _SKEW_SQL.format(k=ITEM_COL)
    ),
    "csv_scan_explicit": RATINGS_CSV_SQL,
    "csv_scan_inferred": RATINGS_CSV_SQL,
    "csv_scan_sampled": RATINGS_CSV_SQL,
    "project_cast": RATINGS_CSV_SQL,
    "stage_if_absent": RATINGS_SQL,
    "stage_incremental": RATINGS_CSV_SQL,
    "score_vectors": _sql(
        f"""SELECT r."userId", r."movieId", r.rating, r."timestamp",
       round(list_dot_product(u.v, i.v), {DIGITS}) AS prediction
FROM ratings r JOIN emb u ON u.vec_id = r."userId" JOIN emb i ON i.vec_id = r."movieId\"""",
        "emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
    ),
    "score_hot_user": _sql(
        f"""SELECT h."userId", h."movieId", h.rating, h."timestamp",
       round(list_dot_product(u.v, i.v), {DIGITS}) AS prediction
FROM hot h JOIN emb u ON u.vec_id = h."userId" JOIN emb i ON i.vec_id = h."movieId\"""",
        """hot AS (SELECT CASE WHEN "movieId" % 3 = 0 THEN 1 ELSE "userId" END AS "userId", "movieId", rating, "timestamp" FROM ratings)""",
        "emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
    ),
    "cold_start_kept": _sql(
        """SELECT "userId", "movieId", rating, "timestamp" FROM split t
WHERE split = 'test'
  AND "userId" IN (SELECT "userId" FROM split WHERE split = 'train' AND "userId" % 10 <> 0 AND "movieId" % 17 <> 0)
  AND "movieId" IN (SELECT "movieId" FROM split WHERE split = 'train' AND "userId" % 10 <> 0 AND "movieId" % 17 <> 0)""",
        _SPLIT_CTE,
    ),
    "als_predict_rows": _sql(
        """SELECT "userId", "movieId", "timestamp", true AS finite FROM split t
WHERE split = 'test'
  AND "userId" IN (SELECT "userId" FROM split WHERE split = 'train')
  AND "movieId" IN (SELECT "movieId" FROM split WHERE split = 'train')""",
        _SPLIT_CTE,
    ),
    "als_predict_matches": _sql(
        """SELECT CAST(sum(1) AS BIGINT) AS records, true AS matches FROM split t
WHERE split = 'test'
  AND "userId" IN (SELECT "userId" FROM split WHERE split = 'train')
  AND "movieId" IN (SELECT "movieId" FROM split WHERE split = 'train')""",
        _SPLIT_CTE,
    ),
    "als_wide_ids": _sql(
        """SELECT "userId", "movieId", "timestamp", true AS finite FROM split t
WHERE split = 'test'
  AND "userId" IN (SELECT "userId" FROM split WHERE split = 'train')
  AND "movieId" IN (SELECT "movieId" FROM split WHERE split = 'train')""",
        _SPLIT_CTE,
    ),
    "dense_index": _sql(
        f"""SELECT side, id, row_number() OVER (PARTITION BY side ORDER BY id) - 1 AS index FROM (
  SELECT DISTINCT 'userId' AS side, "userId" + {WIDE_SHIFT} AS id FROM ratings
  UNION ALL SELECT DISTINCT 'movieId', "movieId" + {WIDE_SHIFT} FROM ratings)"""
    ),
    "als_residual_ok": _sql(
        "SELECT count(DISTINCT \"userId\") AS users, true AS within_tolerance FROM split WHERE split = 'train'",
        _SPLIT_CTE,
    ),
    "random_split": RATINGS_SQL,
    "partition_records": _sql(_LAYOUT_SQL.format(n=8, keys=_KEYS_SQL)),
    "partition_records_sparse": _sql(_LAYOUT_SQL.format(n=64, keys="rating")),
    "partition_summary": _sql(
        """SELECT count(*) AS partitions, CAST(sum(records) AS BIGINT) AS total_records, min(records) AS min_records,
       max(records) AS max_records, CAST(floor(sum(records) / count(*)) AS BIGINT) AS avg_records
FROM (""" + _LAYOUT_SQL.format(n=8, keys=_KEYS_SQL) + ")"
    ),
    "partition_totals": _sql(
        "SELECT CAST(8 AS BIGINT) AS partitions, count(*) AS total_records, CAST(floor(count(*) / 8) AS BIGINT) AS avg_records FROM ratings"
    ),
    "cast_malformed": _MALFORMED_SQL + """
SELECT route, CASE WHEN n IN (2, 3) OR (n = 6 AND route = 'explicit') THEN NULL ELSE u END AS "userId",
       CASE WHEN n = 4 AND route = 'explicit' THEN NULL ELSE i END AS "movieId",
       CASE WHEN n = 5 THEN NULL ELSE r END AS rating, ts AS "timestamp"
FROM t, (VALUES ('explicit'), ('inferred')) AS routes(route)""",
    "csv_scan_widened": _MALFORMED_SQL + """
SELECT CASE WHEN n IN (2, 3) THEN NULL ELSE u END AS "userId", i AS "movieId",
       CASE WHEN n = 5 THEN NULL ELSE r END AS rating, ts AS "timestamp" FROM t""",
    "quarantined_ratings": _MALFORMED_SQL + """
SELECT route, CASE WHEN n IN (2, 3, 7) OR (n = 6 AND route = 'explicit') THEN NULL ELSE u END AS "userId",
       CASE WHEN n = 4 AND route = 'explicit' THEN NULL ELSE i END AS "movieId",
       CASE WHEN n = 5 THEN NULL ELSE r END AS rating, ts AS "timestamp"
FROM t, (VALUES ('explicit'), ('inferred')) AS routes(route)""",
    "cast_rejects": _MALFORMED_SQL + """
SELECT route, "column", reason, count(*) AS fields
FROM t JOIN (VALUES (2, 'userId', 'text', 'both'), (3, 'userId', 'missing', 'both'), (4, 'movieId', 'fraction', 'explicit'),
                    (5, 'rating', 'missing', 'both'), (6, 'userId', 'fraction', 'explicit'), (7, 'userId', 'beyond int', 'both')) AS bad(line, "column", reason, routes)
  ON line = n JOIN (VALUES ('explicit'), ('inferred')) AS r2(route) ON routes IN ('both', route)
GROUP BY ALL""",
    "sweep_counts": _sql(
        """SELECT num_nodes, partitions, count(*) AS num_records,
       count(*) FILTER (WHERE split = 'train') AS train_records,
       count(*) FILTER (WHERE split = 'test') AS test_records
FROM split, (VALUES (1, 8), (2, 8), (5, 20)) AS configs(num_nodes, partitions)
GROUP BY num_nodes, partitions""",
        _SPLIT_CTE,
    ),
    "results_readback": _sql(
        """SELECT 'sweep' AS run, num_nodes, partitions, count(*) AS num_records,
       count(*) FILTER (WHERE split = 'train') AS train_records,
       count(*) FILTER (WHERE split = 'test') AS test_records
FROM split, (VALUES (1, 8), (2, 8), (5, 20)) AS configs(num_nodes, partitions)
GROUP BY num_nodes, partitions""",
        _SPLIT_CTE,
    ),
    "experiment_counts": _sql(
        """SELECT 2 AS num_nodes, 8 AS partitions, count(*) AS num_records,
       count(*) FILTER (WHERE split = 'train') AS train_records,
       count(*) FILTER (WHERE split = 'test') AS test_records
FROM split""",
        _SPLIT_CTE,
    ),
    "experiment_checkpointed": _sql(
        """SELECT 2 AS num_nodes, 8 AS partitions, count(*) AS num_records,
       count(*) FILTER (WHERE split = 'train') AS train_records,
       count(*) FILTER (WHERE split = 'test') AS test_records
FROM split""",
        _SPLIT_CTE,
    ),
}
