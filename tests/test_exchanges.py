"""What large tables make the rating queries sort and move: counted in plans without broadcasts."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tessera.operators import recommender
from tessera.plans import catalog
from tessera.plans import ratings as R
from tessera.session import sql_settings

PLAIN = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}


def dealt(df) -> int:
    """Exchanges by a key."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Lines of 20 customers and 15 parts, a third of them twice."""
    path = str(tmp_path_factory.mktemp("tables"))
    orders = spark.range(200).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 20 + 1).alias("o_custkey"), F.date_add(F.lit("1995-01-01"), F.col("id").cast("int") % 50).alias("o_orderdate"))
    lines = spark.range(900).select(
        (F.col("id") % 200).alias("l_orderkey"), (F.col("id") * 7 % 15 + 1).alias("l_partkey"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity"))
    orders.write.parquet(f"{path}/orders.parquet")
    lines.union(lines.where("l_orderkey % 3 = 0")).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_staged_ratings_are_not_sorted_by_side(spark, tables, monkeypatch):
    seen, write = {}, DataFrameWriter.parquet

    def parquet(self, *args, **named):
        seen.update({name: spark.conf.get(name, None) for name in R.WRITE_SETTINGS})
        return write(self, *args, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    before = {name: spark.conf.get(name, None) for name in R.WRITE_SETTINGS}
    staged = R.staged(spark, tables)
    assert seen == R.WRITE_SETTINGS
    assert {name: spark.conf.get(name, None) for name in R.WRITE_SETTINGS} == before
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, R.ratings(spark, tables).collect()))


def test_settings_come_back_after_an_error(spark):
    names = ("spark.sql.shuffle.partitions", "tessera.test.unknown")
    before = [spark.conf.get(n, None) for n in names]
    with pytest.raises(ZeroDivisionError), sql_settings(spark, dict.fromkeys(names, "3")):
        assert [spark.conf.get(n) for n in names] == ["3", "3"]
        1 / 0
    assert [spark.conf.get(n, None) for n in names] == before


def test_residuals_are_summed_where_ratings_met_their_users(spark, tables):
    train, _ = R.split(spark, tables)
    model = R.fitted_model(spark, tables)
    with sql_settings(spark, PLAIN):
        residual = recommender.user_residual(model, train)
        assert dealt(residual) == 4  # both sides of two joins
        got = {r["id"]: r["residual"] for r in residual.collect()}
    users, items = ({r["id"]: r["features"] for r in f.collect()} for f in (model.userFactors, model.itemFactors))
    rows = {}
    for r in train.collect():
        rows.setdefault(r["userId"], []).append((items[r["movieId"]], r["rating"]))
    for u, seen in rows.items():
        errors = [(sum(a * b for a, b in zip(users[u], v)) - rating, v) for v, rating in seen]
        want = max(abs(sum(e * v[k] for e, v in errors) + 0.1 * len(seen) * users[u][k]) for k in range(10))
        assert got.pop(u) == pytest.approx(want, abs=1e-6)
    assert not got


def test_scores_are_compared_in_one_shuffle(spark, tables):
    _, test = R.split(spark, tables)
    R.fitted_model(spark, tables)
    with sql_settings(spark, PLAIN):
        compared = catalog.q_als_predict_matches(spark, tables)
        assert dealt(compared) == 9  # two joins for each kind of score, then one by key
        assert [tuple(r) for r in compared.collect()] == [(test.count(), True)]
