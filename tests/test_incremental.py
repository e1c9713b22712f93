import json
import os
import uuid

import pytest

from tessera.sources.csv import read_ratings_csv
from tessera.sources.incremental import StagedFiles, stage_files


@pytest.fixture()
def source(spark, tmp_path):
    """A folder maker, a reader that notes which files it was given, and a name."""
    given = []

    def folder(name, **files):
        d = tmp_path / name
        d.mkdir(exist_ok=True)
        for f, ids in files.items():
            (d / f"{f}.csv").write_text("userId,movieId,rating,timestamp\n" + "".join(f"{i},1,2.0,{i}\n" for i in ids))
        return str(d)

    def read(paths):
        given.append(sorted(os.path.basename(p) for p in paths))
        return read_ratings_csv(spark, paths)

    return folder, read, given, uuid.uuid4().hex


def ids(df):
    return sorted(r.userId for r in df.collect())


def records_read(spark, event_dir, group):
    log = os.path.join(event_dir, next(f for f in os.listdir(event_dir) if spark.sparkContext.applicationId in f))
    files = [os.path.join(log, f) for f in os.listdir(log)] if os.path.isdir(log) else [log]
    stages, n = set(), 0
    for line in (x for f in files if "crc" not in f and "appstatus" not in f for x in open(f)):
        event = json.loads(line)
        if event["Event"] == "SparkListenerJobStart" and event.get("Properties", {}).get("spark.jobGroup.id") == group:
            stages |= set(event["Stage IDs"])
        if event["Event"] == "SparkListenerTaskEnd" and event["Stage ID"] in stages:
            n += event["Task Metrics"]["Input Metrics"]["Records Read"]
    return n


def test_a_second_folder_stages_only_its_rows(spark, event_dir, source):
    folder, read, _, name = source
    one = folder("one", a=range(50), b=range(100, 130))
    staged = StagedFiles(spark, name)
    staged.refresh([one], read)
    two = folder("two", c=range(200, 207))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", f"second-{name}")
    try:
        files = staged.refresh([one, two], read)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert records_read(spark, event_dir, f"second-{name}") == 7
    assert ids(staged.read(files, read([one]))) == [*range(50), *range(100, 130), *range(200, 207)]


def test_new_changed_and_removed_files(spark, source):
    folder, read, given, name = source
    one = folder("one", a=[1, 2], b=[3])
    assert ids(stage_files(spark, name, [one], read)) == [1, 2, 3]
    given.clear()
    assert ids(stage_files(spark, name, [one], read)) == [1, 2, 3] and given == [["a.csv", "b.csv"]]  # only for its schema
    folder("one", b=[30, 31], c=[4])
    given.clear()
    assert ids(stage_files(spark, name, [one], read)) == [1, 2, 4, 30, 31] and given[0] == ["b.csv", "c.csv"]
    os.remove(os.path.join(one, "a.csv"))
    given.clear()
    assert ids(stage_files(spark, name, [one], read)) == [4, 30, 31] and len(given) == 1
    assert StagedFiles(spark, name).versions() == [1, 2, 3]
    assert [os.path.basename(f.path) for f in StagedFiles(spark, name).manifest(1)] == ["a.csv", "b.csv"]


def test_odd_names_empty_files_and_single_files(spark, source):
    folder, read, _, name = source
    one = folder("with space+é", **{"a b": [1], "c%20d": [2], "empty": []})
    assert ids(stage_files(spark, name, [one], read)) == [1, 2]
    assert ids(stage_files(spark, name + "x", [os.path.join(one, "a b.csv")], read)) == [1]
    assert ids(stage_files(spark, name + "y", [folder("none")], lambda p: read_ratings_csv(spark, one))) == []


def test_two_writers_of_one_version(spark, source):
    """Another writer publishes while this one stages: its version stays, this one's comes next."""
    folder, read, _, name = source
    one, two = folder("one", a=[1]), folder("two", b=[2])
    other = StagedFiles(spark, name)
    calls = []

    def slow(paths):
        if not calls:
            calls.append(1)
            other.refresh([two], read)
        return read(paths)

    files = StagedFiles(spark, name).refresh([one, two], slow)
    assert StagedFiles(spark, name).versions() == [1, 2]
    assert ids(other.read(files, read([one]))) == [1, 2]
    assert not [f for f in os.listdir(f"{other.root.removeprefix('file://')}/manifest") if f.startswith(".") and not f.endswith(".crc")]
