import pytest

from tessera.plans import experiment
from tessera.plans import ratings as R
from tessera.sources.csv import read_ratings_csv
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def loader(spark):
    path = R.staged_ratings_csv(spark, SF_SMALL)
    return lambda: read_ratings_csv(spark, path, mode="explicit")


def test_choose_configs():
    assert [(c.num_nodes, c.partitions) for c in experiment.choose_configs()] == [(1, 8), (2, 8), (5, 20)]
    assert [(c.num_nodes, c.partitions) for c in experiment.choose_configs(two_nodes_only=True)] == [(2, 8)]
    assert [(c.num_nodes, c.partitions) for c in experiment.choose_configs(early=True)] == [(1, 4), (2, 8), (5, 20)]


def test_sweep_keeps_going_after_a_failure(spark, loader):
    configs = [
        experiment.ExperimentConfig(1, 4),
        experiment.ExperimentConfig(9, -3),  # negative partition count: must fail
        experiment.ExperimentConfig(2, None),
    ]
    results, phases = experiment.sweep(spark, loader, configs)
    rows = results.collect()
    assert [r["num_nodes"] for r in rows] == [1, 9, 2]
    ok = [r for r in rows if r["error"] is None]
    assert len(ok) == 2 and rows[1]["error"]
    for r in ok:
        assert (r["num_records"], r["train_records"], r["test_records"]) == (6000, 4841, 1159)
        assert r["scored_records"] <= r["test_records"] and r["rmse"] > 0
        assert r["total_time"] >= r["load_time"] + r["train_time"]
    assert ok[0]["partitions"] == 4 and 1490 <= ok[0]["min_partition_records"] <= 1500  # dealt per side
    assert ok[1]["partitions"] >= 1  # taken from the data when not given
    names = [p["phase"] for p in phases.where("num_nodes = 1").collect()]
    assert names == ["load", "describe", "train", "evaluate"]


def test_rmse_does_not_depend_on_partitions(spark, loader):
    results, _ = experiment.sweep(
        spark, loader, [experiment.ExperimentConfig(1, 3), experiment.ExperimentConfig(5, 13)]
    )
    a, b = [r["rmse"] for r in results.collect()]
    assert abs(a - b) < 1e-6


def test_random_split_route(spark, loader):
    result, _ = experiment.run_experiment(spark, loader, experiment.ExperimentConfig(1, 4), split="random")
    assert result["train_records"] + result["test_records"] == 6000


def test_memory_pressure_flag(spark, loader):
    result, _ = experiment.run_experiment(
        spark, loader, experiment.ExperimentConfig(1, 2, executor_memory="0.1m")
    )
    assert result["memory_pressure"] is True
    assert result["executor_memory_mb"] == 0.1


def test_phases_are_job_groups(spark, loader):
    from tessera.operators import runlog
    from tessera.sources.eventlog import read_event_log, session_event_log_path

    experiment.run_experiment(spark, loader, experiment.ExperimentConfig(7, 4))
    jobs = runlog.eventlog_jobs(read_event_log(spark, session_event_log_path(spark)))
    groups = {r["job_group"] for r in jobs.where("job_group LIKE 'tessera:7n4p:%'").collect()}
    assert {"tessera:7n4p:load", "tessera:7n4p:train"} <= groups


def test_unusable_rows_are_counted(spark, scratch):
    import os

    d = os.path.join(scratch, "with_nulls_csv")
    os.makedirs(d, exist_ok=True)
    lines = ["userId,movieId,rating,timestamp"]
    lines += [f"{u},{m},{(u * m) % 5 + 1}.0,{u * 1000 + m}" for u in range(1, 30) for m in range(1, 20)]
    lines += [",5,3.0,1", "7,,2.0,2", "8,9,,3"] * 20
    with open(os.path.join(d, "part.csv"), "w") as f:
        f.write("\n".join(lines) + "\n")
    load = lambda: read_ratings_csv(spark, d)
    result, _ = experiment.run_experiment(
        spark, load, experiment.ExperimentConfig(1, 2), recommender_params()
    )
    df = load()
    from pyspark.sql import functions as F

    from tessera.operators.split import hash_split

    train, _ = hash_split(df)
    expected = train.where(F.col("userId").isNull() | F.col("movieId").isNull() | F.col("rating").isNull()).count()
    assert expected > 0 and result["unusable_records"] == expected
    assert result["error"] is None and result["rmse"] is not None


def recommender_params():
    from tessera.operators.recommender import AlsParams

    return AlsParams(rank=3, max_iter=3)


def test_early_variant_has_its_own_settings():
    from tessera.session import EARLY_SETTINGS

    early = experiment.choose_configs(early=True, executor_memory="2g")
    assert [(c.num_nodes, c.partitions, c.executor_memory) for c in early] == [(1, 4, "6g"), (2, 8, "6g"), (5, 20, "6g")]
    assert {c.executor_memory for c in experiment.choose_configs(executor_memory="2g")} == {"2g"}
    assert EARLY_SETTINGS["spark.sql.shuffle.partitions"] == "10"


@pytest.mark.parametrize("split", ["hash", "random"])
def test_checkpointed_sides_outlast_the_cache_and_the_source(spark, tmp_path, split, monkeypatch):
    """The source is gone after the load: nothing is read from it again, and the copies go at the end."""
    import os
    import shutil

    source = str(tmp_path / "ratings")
    R.staged(spark, SF_SMALL).write.parquet(source)
    fit = experiment.recommender.fit
    seen = {}

    def fit_without_source(train, params):
        spark.catalog.clearCache()
        shutil.move(source, str(tmp_path / "gone"))
        seen["inputs"] = train.inputFiles()
        return fit(train, params)

    monkeypatch.setattr(experiment.recommender, "fit", fit_without_source)
    result, _ = experiment.run_experiment(
        spark, lambda: spark.read.parquet(source), experiment.ExperimentConfig(3, 6), recommender_params(), split, keep="checkpoint"
    )
    assert result["num_records"] == 6000 and result["train_records"] + result["test_records"] == 6000
    assert result["rmse"] is not None and result["partitions"] == 6
    assert 0 < result["min_partition_records"] <= 1000 <= result["max_partition_records"]
    assert seen["inputs"] and not any(os.path.exists(f.removeprefix("file://")) for f in seen["inputs"])
    if split == "hash":
        assert result["train_records"] == 4841


def test_keeping_is_checked_and_equal(spark, loader):
    with pytest.raises(ValueError, match="keep"):
        experiment.run_experiment(spark, loader, experiment.ExperimentConfig(1, 2), keep="memory")
    runs = [experiment.run_experiment(spark, loader, experiment.ExperimentConfig(1, 4), recommender_params(), keep=k)[0] for k in ("cache", "checkpoint")]
    same = ("num_records", "train_records", "test_records", "unusable_records", "scored_records")
    assert [runs[0][k] for k in same] == [runs[1][k] for k in same]
    assert abs(runs[0]["rmse"] - runs[1]["rmse"]) < 1e-6


def test_saved_results_are_replaced_by_run_and_configuration(spark, tmp_path):
    path = str(tmp_path / "results")

    def results(*rows):
        blank = {f.name: None for f in experiment.RESULT_SCHEMA.fields}
        return spark.createDataFrame([tuple({**blank, **r}.values()) for r in rows], experiment.RESULT_SCHEMA)

    first = [{"num_nodes": 1, "partitions": 8, "num_records": 5}, {"num_nodes": 2, "partitions": 8, "num_records": 5}, {"num_nodes": 2, "num_records": 6, "error": "e"}]
    for _ in range(2):
        experiment.save_results(results(*first), path, "a")
    assert experiment.read_results(spark, path).count() == 3
    experiment.save_results(results({"num_nodes": 2, "partitions": 8, "num_records": 9}), path, "a")
    experiment.save_results(results({"num_nodes": 2, "partitions": 8, "num_records": 7}), path, "b")
    got = {(r.run, r.num_nodes, r.partitions): r.num_records for r in experiment.read_results(spark, path).collect()}
    assert got == {("a", 1, 8): 5, ("a", 2, 8): 9, ("a", 2, None): 6, ("b", 2, 8): 7}
    back = experiment.read_results(spark, path, "b")
    assert back.columns == ["run", *(f.name for f in experiment.RESULT_SCHEMA.fields)] and back.count() == 1


def test_cached_sides_leave_memory_to_the_fit(spark, loader, monkeypatch):
    fit = experiment.recommender.fit
    seen = []

    def fit_seen(train, params):
        blocks = [(i.memSize(), i.diskSize()) for i in spark.sparkContext._jsc.sc().getRDDStorageInfo() if i.storageLevel().useDisk()]
        seen.append((train.storageLevel, blocks))
        return fit(train, params)

    before = sum(i.memSize() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo())
    monkeypatch.setattr(experiment.recommender, "fit", fit_seen)
    result, _ = experiment.run_experiment(spark, loader, experiment.ExperimentConfig(1, 4), recommender_params())
    (level, blocks), = seen
    assert result["train_records"] == 4841 and level.useDisk and not level.useMemory
    assert sum(m for m, _ in blocks) <= before and sum(d for _, d in blocks) > 0


def test_sweep_lets_go_of_each_fit(spark, loader, monkeypatch):
    """When a configuration fits, the factors of the ones before are out of the executors."""
    import time

    run, fit, left = experiment.run_experiment, experiment.recommender.fit, []

    def factors():
        return sum(r.name() in ("userFactors", "itemFactors") for r in spark.sparkContext._jsc.getPersistentRDDs().values())

    def run_later(*args):
        time.sleep(2)  # dropped handles reach the driver within a second
        return run(*args)

    def fit_seen(train, params):
        until = time.time() + 20
        while factors() > kept and time.time() < until:
            time.sleep(0.2)  # the cleaner works beside the session
        left.append(factors())
        return fit(train, params)

    kept = factors()  # models that the session still knows, or more
    monkeypatch.setattr(experiment, "run_experiment", run_later)
    monkeypatch.setattr(experiment.recommender, "fit", fit_seen)
    results, _ = experiment.sweep(spark, loader, [experiment.ExperimentConfig(n, 4) for n in (1, 2, 3)], recommender_params())
    assert results.where("error IS NULL").count() == 3
    assert len(left) == 3 and max(left) <= kept
