import os

import pytest

from tessera.plans import ratings as R
from tessera.sources.csv import read_ratings_csv

MALFORMED = """userId,movieId,rating,timestamp
1,17,4.0,944249077
x,25,1.0,944250228
3,4.7,2.5,9999999999
,5,,1
"""
SWAPPED = "movieId,userId,rating,timestamp\n17,1,4.0,944249077\n"


def _write(scratch, name, text):
    d = os.path.join(scratch, name)
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, "part.csv"), "w") as f:
        f.write(text)
    return d


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple(str(x) for x in t))


def test_inferred_route_try_casts(spark, scratch):
    path = _write(scratch, "malformed_inferred", MALFORMED)
    df = read_ratings_csv(spark, path, mode="inferred")
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "int", "float", "bigint"]
    assert _rows(df) == _rows(
        spark.createDataFrame(
            [(1, 17, 4.0, 944249077), (None, 25, 1.0, 944250228), (3, 4, 2.5, 9999999999), (None, 5, None, 1)],
            "userId int, movieId int, rating float, timestamp long",
        )
    )


def test_explicit_route_nulls_bad_values(spark, scratch):
    path = _write(scratch, "malformed_explicit", MALFORMED)
    df = read_ratings_csv(spark, path, mode="explicit")
    got = _rows(df)
    assert (3, None, 2.5, 9999999999) in got
    assert (None, 25, 1.0, 944250228) in got
    assert len(got) == 4


def test_explicit_route_rejects_swapped_header(spark, scratch):
    path = _write(scratch, "swapped_explicit", SWAPPED)
    with pytest.raises(Exception):
        read_ratings_csv(spark, path, mode="explicit").collect()


def test_inferred_route_maps_by_name(spark, scratch):
    path = _write(scratch, "swapped_inferred", SWAPPED)
    row = read_ratings_csv(spark, path, mode="inferred").first()
    assert (row["userId"], row["movieId"]) == (1, 17)


def test_round_trip_equals_view(spark):
    from tests.conftest import SF_SMALL

    view = R.ratings(spark, SF_SMALL)
    for mode in ("explicit", "inferred"):
        back = read_ratings_csv(spark, R.staged_ratings_csv(spark, SF_SMALL), mode=mode)
        assert back.exceptAll(view).count() == 0 and view.exceptAll(back).count() == 0


def test_partitions_argument(spark):
    from tests.conftest import SF_SMALL

    df = read_ratings_csv(spark, R.staged_ratings_csv(spark, SF_SMALL), partitions=5)
    assert df.rdd.getNumPartitions() == 5


def test_staging_is_written_once(spark):
    from tests.conftest import SF_SMALL
    from tessera.session import path_complete

    p1 = R.staged_ratings_parquet(spark, SF_SMALL)
    assert path_complete(spark, p1)
    mtime = os.path.getmtime(os.path.join(p1, "_SUCCESS"))
    assert R.staged_ratings_parquet(spark, SF_SMALL) == p1
    assert os.path.getmtime(os.path.join(p1, "_SUCCESS")) == mtime


def test_stage_publishes_by_rename(spark):
    import uuid

    from tessera.session import shared_path
    from tessera.sources.staging import stage

    tag = uuid.uuid4().hex
    calls = []

    def build():
        calls.append(1)
        return spark.range(10)

    p = stage(spark, "unit_stage", tag, build)
    assert p == shared_path(spark, "unit_stage", tag)
    assert spark.read.parquet(p).count() == 10
    assert stage(spark, "unit_stage", tag, build) == p and len(calls) == 1
    parent = os.path.dirname(p.replace("file:", ""))
    assert not [n for n in os.listdir(parent) if ".attempt-" in n]


WIDE = "userId,movieId,rating,timestamp\n1,17,4.0,944249077\n2147483648,25,1.0,944250228\n"


@pytest.mark.parametrize("mode", ["explicit", "inferred"])
def test_ids_beyond_int_are_an_error(spark, scratch, mode):
    path = _write(scratch, f"wide_{mode}", WIDE)
    with pytest.raises(Exception, match="int range"):
        read_ratings_csv(spark, path, mode=mode).collect()


def test_second_writer_does_not_nest_its_copy(spark):
    """Another writer publishes between the check and the rename."""
    import uuid

    from tessera.session import shared_path
    from tessera.sources.staging import publish

    path = shared_path(spark, "race", uuid.uuid4().hex)
    for n in (3, 5):
        spark.range(n).write.parquet(f"{path}.attempt-{n}")
    publish(spark, f"{path}.attempt-3", path)
    publish(spark, f"{path}.attempt-5", path)
    assert spark.read.parquet(path).count() == 3
    assert not os.path.exists(f"{path}.attempt-5") and not [f for f in os.listdir(path) if "attempt" in f]


def test_shared_folder_is_one_per_application(spark):
    from tessera.session import checkpoint_root

    assert checkpoint_root(spark) == checkpoint_root(spark)
