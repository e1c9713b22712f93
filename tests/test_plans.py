"""Plan shape: built-in expressions only, no pair-producing joins, pruned
scans, and no shuffle where none is needed."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

# Queries whose plans are not a single DataFrame over the tables (results
# assembled on the driver from small experiment rows, or model factors).
SKIP = {"experiment_result", "experiment_sweep", "experiment_phases", "experiment_summary"}
# The training-data queries are tested in tests/llm.
from tessera.plans.catalog import QUERIES  # noqa: E402


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for key, fn in QUERIES.items():
        if key in SKIP:
            continue
        out[key] = plan_of(fn(spark, SF_SMALL))
    return out


def test_no_pair_producing_joins(plans):
    for key, plan in plans.items():
        assert "CartesianProduct" not in plan, key
        assert "BroadcastNestedLoopJoin" not in plan, key


def test_no_python_in_the_plans(plans):
    for key, plan in plans.items():
        for node in ("EvalPython", "PythonUDF", "MapInArrow", "MapInPandas", "InPandas", "InArrow", "PythonMapIn"):
            assert node not in plan, (key, node)


def test_scans_read_only_used_columns(plans):
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plans["ratings_view"])
    assert "struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in schemas
    assert "struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in schemas
    # the split counts read no data column: the label is a partition column
    split_schema = re.findall(r"ReadSchema: (struct<[^>]*>)", plans["split_counts"])
    assert split_schema == ["struct<>"]
    size_schema = re.findall(r"ReadSchema: (struct<[^>]*>)", plans["size_estimate"])
    assert size_schema == ["struct<>"]


def test_split_adds_no_shuffle(spark):
    from tessera.operators.split import hash_split
    from tessera.plans import ratings as R

    train, _ = hash_split(R.staged(spark, SF_SMALL))
    assert "Exchange" not in plan_of(train)


def test_staged_sides_are_partition_pruned(spark):
    from tessera.plans import ratings as R

    train, test = R.split(spark, SF_SMALL)
    assert "PartitionFilters: [isnotnull(split" in plan_of(train)
    assert "(split#" in plan_of(train) and "= train)" in plan_of(train)
    assert train.count() == 4841 and test.count() == 1159


def test_aggregates_combine_before_the_shuffle(plans):
    for key in ("split_counts", "skew_summary", "rmse_mean_baseline", "size_estimate"):
        plan = plans[key]
        assert "partial_" in plan, key
