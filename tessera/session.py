"""Session helpers.

The library never builds or stops a session it is handed; it only reads
settings and sets runtime SQL options.  Anything written between phases
goes under the cluster's shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import tempfile
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession


_roots: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    Read from the session (``spark.checkpoint.dir``, else the context's
    checkpoint dir).  Only when neither is set and the master is local (a
    test session) is a scratch folder created and registered; on a cluster
    that is an error, since a driver-local folder is not shared.
    """
    sc = spark.sparkContext
    if sc.applicationId in _roots:  # one folder per application
        return _roots[sc.applicationId]
    root = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if not root:
        root = current
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder every executor can reach "
                "(checkpoints and staged tables are written there)"
            )
        root = tempfile.mkdtemp(prefix="tessera-ckpt-")
    if current is None:
        sc.setCheckpointDir(root)
    _roots[sc.applicationId] = root.rstrip("/")
    return _roots[sc.applicationId]


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder."""
    return "/".join([checkpoint_root(spark), "tessera", *parts])


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library has written, if it is there."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def release_unused(spark: SparkSession, wait: float = 0.0) -> None:
    """Lets go of shuffle files and cached blocks that nothing refers to any more.

    Spark deletes them once the driver has collected what stood for them, which may be long after; a
    collection here gives their disk and memory back before the next large step.  Python's handles reach the
    driver within a second of being dropped: ``wait`` seconds let it know of the last ones too."""
    gc.collect()
    time.sleep(wait)
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def sql_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Runtime SQL options for the actions within; what the session had comes back after them."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def source_tag(*values: object) -> str:
    """Short stable tag for a source (e.g. an sf dir) used in staged paths."""
    text = "|".join(str(v) for v in values)
    return hashlib.sha1(text.encode()).hexdigest()[:16]


def path_complete(spark: SparkSession, path: str) -> bool:
    """True when a Spark write to ``path`` committed (``_SUCCESS`` exists)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


# The reference's session settings for an experiment run.
REFERENCE_SETTINGS = {
    "spark.executor.cores": "1",
    "spark.driver.memory": "2g",
    "spark.sql.shuffle.partitions": "20",
    "spark.memory.fraction": "0.8",
    "spark.memory.storageFraction": "0.3",
    "spark.rpc.message.maxSize": "256",
    "spark.kryoserializer.buffer.max": "512m",
}

# What the early variant sets otherwise.
EARLY_SETTINGS = {"spark.sql.shuffle.partitions": "10"}

# Runtime SQL options this library relies on; safe to set on a given session.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Shuffle width for a session we build: start wide and let AQE coalesce to
# ~128 MB partitions, instead of a fixed small count that only suits a few
# small workers (a fixed 20 would put 5 TB in each task at 100 TB).
SHUFFLE_SETTINGS = {
    "spark.sql.shuffle.partitions": "2000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
}


def build_session(
    app_name: str,
    master: str | None = None,
    executor_memory: str = "4g",
    extra: dict[str, str] | None = None,
    reference_shuffle: bool = False,
    early: bool = False,
) -> SparkSession:
    """A session we own (command line, benchmarks): the reference's memory
    and transport settings plus our runtime options.  The shuffle width is
    left to AQE unless ``reference_shuffle`` asks for the reference's fixed
    count (``early``: that of its early variant).  Static settings only take effect when this call starts the JVM;
    a session handed to the library is never rebuilt or stopped by it."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**REFERENCE_SETTINGS, **RUNTIME_SETTINGS, "spark.executor.memory": executor_memory}
    if early:
        settings.update(EARLY_SETTINGS)
    if not reference_shuffle:
        settings.update(SHUFFLE_SETTINGS)
    settings.update(extra or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
