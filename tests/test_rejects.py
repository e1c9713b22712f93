import os
import uuid

import pytest

from tessera.sources.csv import read_ratings_csv, read_sampled, sampled_types
from tessera.sources.rejects import read_with_rejects, reject_counts

HEADER = "userId,movieId,rating,timestamp"


@pytest.fixture()
def csv(tmp_path):
    def write(*files, header=HEADER):
        d = tmp_path / uuid.uuid4().hex
        d.mkdir()
        for n, lines in enumerate(files):
            (d / f"part-{n}.csv").write_text("\n".join([header, *lines]) + "\n")
        return str(d)

    return write


LINES = ["1,17,4.0,944249077", "x,25,1.0,944250228", "3,4.7,2.5,9999999999", ",5,,1", "2147483648, 7 ,high,12", "-5,.5,1e0,1.5", "99999999999999999999,1,1,1"]


def fields(read):
    return sorted((r["column"], r["reason"], r["raw"]) for r in read.rejects.collect())


def test_reasons_by_route(spark, csv):
    path = csv(LINES)
    explicit, inferred = (read_with_rejects(spark, path, r) for r in ("explicit", "inferred"))
    both = [
        ("rating", "missing", None), ("rating", "text", "high"), ("timestamp", "beyond int", "1.5"),
        ("userId", "beyond int", "2147483648"), ("userId", "beyond int", "99999999999999999999"),
        ("userId", "missing", None), ("userId", "text", "x"),
    ]
    assert fields(inferred) == sorted(both, key=str) or set(fields(inferred)) == set(both)
    assert set(fields(explicit)) == {*both, ("movieId", "fraction", "4.7"), ("movieId", "fraction", ".5")}
    got = {(r.userId, r.movieId, r.rating) for r in inferred.ratings.collect()}
    assert got == {(1, 17, 4.0), (None, 25, 1.0), (3, 4, 2.5), (None, 5, None), (None, 7, None), (-5, 0, 1.0), (None, 1, 1.0)}
    assert explicit.ratings.count() == len(LINES)
    assert {(r["column"], r["reason"], r["fields"]) for r in reject_counts(inferred).collect()} >= {("userId", "beyond int", 2)}


def test_rejects_are_read_without_the_text(spark, csv):
    path = csv(LINES)
    read = read_with_rejects(spark, path)
    before = reject_counts(read).count()
    os.remove(f"{path}/part-0.csv")
    assert reject_counts(read).count() == before and read.ratings.count() == len(LINES)
    kept = [d for d in os.listdir(read.path.removeprefix("file://")) if d.startswith("rejected=")]
    assert sorted(kept) == ["rejected=false", "rejected=true"]


def test_columns_go_by_name_and_must_be_there(spark, csv):
    path = csv(["5,1,0,3.0"], header="movieId,userId,timestamp,rating")
    row = read_with_rejects(spark, path).ratings.first()
    assert (row.userId, row.movieId, row.rating, row.timestamp) == (1, 5, 3.0, 0)
    with pytest.raises(ValueError, match="rating"):
        read_with_rejects(spark, csv(["1,2,3"], header="userId,movieId,timestamp"))
    with pytest.raises(ValueError):
        read_with_rejects(spark, path, "other")


def test_no_rejects_and_no_rows(spark, csv):
    assert reject_counts(read_with_rejects(spark, csv(["1,2,3.0,4"]))).collect() == []
    empty = read_with_rejects(spark, csv([]))
    assert reject_counts(empty).collect() == [] and empty.ratings.collect() == []


GOOD = [f"{u},{u + 1},{u % 5}.5,{u}" for u in range(1, 400)]


def test_sample_decides_where_it_is_right(spark, csv):
    path = csv(GOOD)
    rows, kinds = read_sampled(spark, path, lines=50)
    assert kinds == {"userId": "int", "movieId": "int", "rating": "double", "timestamp": "int"}
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, read_ratings_csv(spark, path).collect()))


@pytest.mark.parametrize("late", ["late text,1,1.0,1", "1,4.7,1.0,1", "1,1,1.0,9999999999"])
def test_a_late_field_is_an_error_or_widens(spark, csv, late):
    path = csv([*GOOD, late])
    rows, _ = read_sampled(spark, path, lines=50)
    with pytest.raises(Exception, match="as the first 50 lines say"):
        rows.collect()
    wide, kinds = read_sampled(spark, path, lines=50, on_break="widen")
    assert sorted(map(str, wide.collect())) == sorted(map(str, read_ratings_csv(spark, path, mode="inferred").collect()))
    assert kinds != {"userId": "int", "movieId": "int", "rating": "double", "timestamp": "int"}


def test_the_text_is_read_again_only_if_a_field_breaks_its_type(spark, csv):
    from tests.test_layout import _jobs

    same = csv(GOOD, GOOD)
    broken = csv(GOOD, [*GOOD, "x,1,1.0,1"])
    _, once = _jobs(spark, "sampled-once", lambda: read_sampled(spark, same, lines=5, on_break="widen"))
    _, twice = _jobs(spark, "sampled-twice", lambda: read_sampled(spark, broken, lines=5, on_break="widen"))
    assert twice == once + 1


def test_the_sample_is_bounded(spark, csv):
    path = csv(["1,2,3,4"] * 20 + ["a,b,c,d"] * 5)
    assert [f.dataType.simpleString() for f in sampled_types(spark, path, 10)] == ["int"] * 4
    # headers of further files in the sample are no fields
    assert [f.dataType.simpleString() for f in sampled_types(spark, csv(["1,2,3,4"], ["5,6,7,8"]), 10)] == ["int"] * 4
    with pytest.raises(ValueError):
        read_sampled(spark, path, on_break="ignore")


def test_fractions_beside_text_are_cut_off(spark, csv):
    path = csv(["x,1,1.0,1", "4.7,1,1.0,2", "-4.7,1,1.0,3", "+5.,1,1.0,4", "1e3,1,1.0,5", "5 6,1,1.0,6"])
    got = {r.timestamp: r.userId for r in read_ratings_csv(spark, path, mode="inferred").collect()}
    assert got == {1: None, 2: 4, 3: -4, 4: 5, 5: None, 6: None}
