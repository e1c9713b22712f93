"""Empty input: reports stay well-formed, a fit fails clearly, a sweep keeps a row."""

import os

import pytest

from tessera.operators import layout, metrics, recommender, sizing
from tessera.operators.split import hash_split, label_split
from tessera.plans import experiment
from tessera.schema import RATINGS_SCHEMA
from tessera.sources.csv import read_ratings_csv


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], RATINGS_SCHEMA)


def test_reports_on_empty(spark, empty):
    assert sizing.size_estimate(empty).first()["num_records"] == 0
    assert layout.partition_totals(empty.repartition(3)).first()["total_records"] == 0
    train, test = hash_split(empty)
    assert train.count() == test.count() == 0
    row = metrics.mean_baseline_rmse(label_split(empty)).first()
    assert row["rmse"] is None and row["test_records"] == 0
    assert metrics.rmse(empty.withColumn("prediction", empty.rating)).first()["rmse"] is None


def test_fit_on_empty_fails_clearly(spark, empty):
    with pytest.raises(ValueError, match="no training rows"):
        recommender.fit(empty)


def test_sweep_on_empty_csv_keeps_a_row(spark, scratch):
    d = os.path.join(scratch, "empty_csv")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, "part.csv"), "w") as f:
        f.write("userId,movieId,rating,timestamp\n")
    results, _ = experiment.sweep(
        spark, lambda: read_ratings_csv(spark, d), [experiment.ExperimentConfig(1, 2)]
    )
    row = results.first()
    assert row["num_nodes"] == 1 and "no training rows" in row["error"]
