"""Source files staged one by one: only new or changed files are read again.

A manifest lists, for every source file, its size and time and the staged folder that holds its rows.  It is one
JSON-lines file per version, published by a rename that fails where another writer was first; that writer's
version is then read and the missing files are staged on top of it.  Readers take the newest version, so they see
whole versions only.  Files that left the source leave the manifest.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_path

#: Tries against other writers before giving up.
TRIES = 8


@dataclass(frozen=True)
class SourceFile:
    path: str
    size: int
    modified: int
    staged: str = ""  # the staged folder with its rows


class StagedFiles:
    """The staged copy ``name`` of a set of source files, in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, shared_path(spark, "staged-files", name)
        jvm = spark.sparkContext._jvm
        self._path, self._jvm = jvm.org.apache.hadoop.fs.Path, jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def sources(self, folders: Sequence[str]) -> list[SourceFile]:
        """The data files of some folders (or files), hidden ones left out."""
        found = []
        for folder in folders:
            fs, at = self._fs(folder), self._path(folder)
            if fs.getFileStatus(at).isFile():
                status = fs.getFileStatus(at)
                found.append(SourceFile(status.getPath().toString(), status.getLen(), status.getModificationTime()))
                continue
            files = fs.listFiles(at, True)
            while files.hasNext():
                status = files.next()
                if not status.getPath().getName().startswith(("_", ".")):
                    found.append(SourceFile(status.getPath().toString(), status.getLen(), status.getModificationTime()))
        return sorted(found, key=lambda f: f.path)

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/manifest")
        fs = at.getFileSystem(self._conf)
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".jsonl") and n.split(".")[0].isdigit())

    def manifest(self, version: int | None = None) -> list[SourceFile]:
        """The files of a version, by default the newest; none before the first."""
        versions = self.versions()
        if not versions:
            return []
        path = f"{self.root}/manifest/{version or versions[-1]:08d}.jsonl"
        stream = self._fs(path).open(self._path(path))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [SourceFile(**json.loads(line)) for line in text.splitlines()]

    def _publish(self, version: int, files: list[SourceFile]) -> bool:
        """Whether this writer's manifest is now that version."""
        final = f"{self.root}/manifest/{version:08d}.jsonl"
        attempt = f"{self.root}/manifest/.{uuid.uuid4().hex}"
        fs = self._fs(final)
        out = fs.create(self._path(attempt), False)
        out.write(bytearray("".join(json.dumps(asdict(f)) + "\n" for f in files).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(self._path(attempt)), fs.makeQualified(self._path(final)), options)
        except Py4JJavaError:
            if not fs.exists(self._path(final)):
                raise
            fs.delete(self._path(attempt), False)
            return False
        return True

    def refresh(self, folders: Sequence[str], read: Callable[[list[str]], DataFrame]) -> list[SourceFile]:
        """Stages what is new or changed in ``folders`` with ``read(paths)``; the files now listed.

        Rows of all new files are written by one job, each file's into a folder of its own."""
        for _ in range(TRIES):
            versions, listed = self.versions(), self.manifest()
            known = {(f.path, f.size, f.modified): f for f in listed}
            now = self.sources(folders)
            fresh = [f for f in now if (f.path, f.size, f.modified) not in known]
            if not fresh and len(now) == len(listed):
                return listed
            staged = self._stage(fresh, read) if fresh else {}
            files = [known.get((f.path, f.size, f.modified)) or SourceFile(f.path, f.size, f.modified, staged[f.path]) for f in now]
            if self._publish((versions[-1] if versions else 0) + 1, files):
                return files
        raise RuntimeError(f"{self.root}: another writer was first {TRIES} times")

    def _stage(self, fresh: list[SourceFile], read: Callable[[list[str]], DataFrame]) -> dict[str, str]:
        out = f"{self.root}/parts/{uuid.uuid4().hex}"
        file = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
        tagged = read([f.path for f in fresh]).withColumn("source_file", F.md5(file.cast("binary")))
        tagged.write.partitionBy("source_file").parquet(out)
        return {f.path: f"{out}/source_file={hashlib.md5(_plain(f.path).encode()).hexdigest()}" for f in fresh}

    def read(self, files: list[SourceFile], empty: DataFrame) -> DataFrame:
        """The staged rows of ``files`` with the columns of ``empty``."""
        held = [f.staged for f in files if self._fs(f.staged).exists(self._path(f.staged))]  # a file without rows has no folder
        return self.spark.read.schema(empty.schema).parquet(*held) if held else empty.limit(0)


def _plain(path: str) -> str:
    """A path without the scheme of local files, whose slashes vary."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def stage_files(
    spark: SparkSession, name: str, folders: Sequence[str], read: Callable[[list[str]], DataFrame]
) -> DataFrame:
    """The rows of all files in ``folders`` as ``read`` gives them, from copies staged per file."""
    staged = StagedFiles(spark, name)
    files = staged.refresh(folders, read)
    return staged.read(files, read([f.path for f in files]).limit(0))
