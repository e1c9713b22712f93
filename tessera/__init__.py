"""tessera: rating analytics on Spark.

Ratings in, ALS recommender out, with the reports around it (sizes,
partition spread, splits, error, run logs) written as DataFrame jobs.
"""

from tessera.operators.dense_ids import dense_index
from tessera.operators.layout import partition_records, partition_totals, repartition, repartition_by_keys, skew_summary
from tessera.operators.metrics import mean_baseline_rmse, rmse
from tessera.operators.recommender import AlsParams, fit, predict, score_vectors
from tessera.operators.runlog import eventlog_jobs, eventlog_spill, eventlog_storage, first_jobs
from tessera.operators.skew import heavy_keys, join_unique
from tessera.operators.sizing import memory_pressure, size_estimate
from tessera.operators.split import hash_split, label_split, random_split
from tessera.plans.experiment import (
    ExperimentConfig, choose_configs, read_results, run_experiment, save_results, summary, sweep,
)
from tessera.schema import RATING_COLUMNS, RATINGS_SCHEMA
from tessera.sources.csv import read_ratings_csv, read_sampled
from tessera.sources.eventlog import read_event_log
from tessera.sources.incremental import stage_files
from tessera.sources.rejects import read_with_rejects, reject_counts

__all__ = [
    "AlsParams", "ExperimentConfig", "RATINGS_SCHEMA", "RATING_COLUMNS", "choose_configs",
    "dense_index", "eventlog_jobs", "eventlog_spill", "eventlog_storage", "first_jobs", "fit",
    "hash_split", "heavy_keys", "join_unique", "label_split", "mean_baseline_rmse",
    "memory_pressure", "partition_records", "partition_totals", "predict", "random_split",
    "read_event_log", "read_ratings_csv", "read_results", "read_sampled", "read_with_rejects",
    "reject_counts", "repartition", "repartition_by_keys", "rmse", "run_experiment", "save_results",
    "score_vectors", "size_estimate", "skew_summary", "stage_files", "summary", "sweep",
]
__version__ = "0.1.0"
