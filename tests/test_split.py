from tessera.operators.split import hash_split, label_split, split_threshold
from tessera.plans import ratings as R
from tests.conftest import SF_SMALL


def test_threshold_text():
    assert split_threshold(0.8) == "cccccccc"
    assert split_threshold(0.0) == "00000000"
    assert split_threshold(1.0) > "ffffffff"


def test_counts_match_fixture(spark):
    train, test = hash_split(R.ratings(spark, SF_SMALL))
    assert (train.count(), test.count()) == (4841, 1159)


def test_independent_of_partitioning(spark):
    r = R.ratings(spark, SF_SMALL).cache()
    seen = set()
    for n in (1, 4, 20):
        tr, _ = hash_split(r.repartition(n))
        seen.add(tuple(sorted(tuple(x) for x in tr.collect())))
    r.unpersist()
    assert len(seen) == 1


def test_disjoint_and_complete(spark):
    r = R.ratings(spark, SF_SMALL)
    train, test = hash_split(r)
    assert train.count() + test.count() == r.count()
    # identical rows hash identically, so no row can be on both sides
    assert train.intersect(test).count() == 0


def test_label_split_agrees(spark):
    r = R.ratings(spark, SF_SMALL)
    labelled = label_split(r).groupBy("split").count()
    got = {row["split"]: row["count"] for row in labelled.collect()}
    assert got == {"train": 4841, "test": 1159}


def test_null_keys_are_split_not_lost(spark):
    df = spark.createDataFrame(
        [(None, 1, 1.0, 5), (1, None, 2.0, None)], "userId int, movieId int, rating float, timestamp long"
    )
    train, test = hash_split(df)
    assert train.count() + test.count() == 2
