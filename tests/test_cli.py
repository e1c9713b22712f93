import os

from tessera.__main__ import main
from tessera.plans import ratings as R
from tests.conftest import SF_SMALL


def test_cli_two_node_run_writes_results(spark, scratch):
    out = os.path.join(scratch, "cli-results")
    csv = R.staged_ratings_csv(spark, SF_SMALL)
    assert main([csv, "--two-nodes-only", "--out", out]) == 0
    rows = spark.read.parquet(out).collect()
    assert [(r["num_nodes"], r["partitions"]) for r in rows] == [(2, 8)]
    assert rows[0]["error"] is None and rows[0]["train_records"] == 4841
    # the session was not ours to stop
    assert spark.range(3).count() == 3


def test_cli_rerun_replaces_its_rows(spark, scratch):
    out = os.path.join(scratch, "cli-reruns")
    csv = R.staged_ratings_csv(spark, SF_SMALL)
    for run in ("a", "a", "b"):
        assert main([csv, "--two-nodes-only", "--checkpoint", "--out", out, "--run", run]) == 0
    assert sorted(r["run"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_cli_reports_total_failure(spark, scratch):
    missing = os.path.join(scratch, "no-such-ratings")
    assert main([missing, "--two-nodes-only"]) == 1
