"""Write a DataFrame once to the shared folder and read it back.

Later phases then read columnar Parquet (batched, pushdown, pruning) or
the staged text, instead of recomputing joins or re-parsing text, and a
lost executor re-reads files rather than replaying a long lineage.  A
stage counts as present only when its write committed (``_SUCCESS``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tessera.session import path_complete, shared_path, source_tag


def table_fingerprint(
    spark: SparkSession, sf_dir: str, names: list[str], version: object = 0
) -> str:
    """Tag that changes when any input table file changes (path, size,
    mtime) or the staged format ``version`` does."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts: list[object] = [sf_dir.rstrip("/"), version]
    for name in names:
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = p.getFileSystem(conf)
        st = fs.getFileStatus(p)
        if st.isDirectory():  # a table of many files: total bytes and file count
            cs = fs.getContentSummary(p)
            parts += [name, cs.getLength(), cs.getFileCount(), st.getModificationTime()]
        else:
            parts += [name, st.getLen(), st.getModificationTime()]
    return source_tag(*parts)


def stage(
    spark: SparkSession,
    name: str,
    tag: str,
    build: Callable[[], DataFrame],
    fmt: str = "parquet",
    write: Callable[[DataFrame, str], object] | None = None,
) -> str:
    """Path of ``name/tag`` in the shared folder, written by ``build`` if absent.

    The copy is written to a private attempt folder and then published, so
    readers never see a half-written stage and two writers of the same stage
    do not mix files.
    """
    path = shared_path(spark, name, tag)
    if path_complete(spark, path):
        return path
    attempt = f"{path}.attempt-{uuid.uuid4().hex}"
    df = build()
    if write is not None:
        write(df, attempt)
    else:
        df.write.mode("overwrite").format(fmt).save(attempt)
    publish(spark, attempt, path)
    return path


def publish(spark: SparkSession, attempt: str, path: str) -> None:
    """Moves a complete copy into place, unless another writer's is there.

    The rename fails on an existing folder (``FileSystem.rename`` would move the
    copy into it), so of several writers one wins and the others' copies go.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(attempt), jvm.org.apache.hadoop.fs.Path(path)
    fs = dst.getFileSystem(conf)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    if fs.exists(dst) and not path_complete(spark, path):
        fs.delete(dst, True)  # left by a failed write
    try:
        files.rename(fs.makeQualified(src), fs.makeQualified(dst), no_options)
    except Py4JJavaError:
        if not path_complete(spark, path):
            raise
        fs.delete(src, True)
