"""Helpers of this package: intermediate tables and bytes of Arrow text.

Intermediate tables are Parquet in the folder ``spark.checkpoint.dir``
names, so a lost executor re-reads files instead of replaying a lineage.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.session import shared_path

#: Bytes of text a task works on at once; a longer single text is one piece.
PIECE_BYTES = 1 << 20


class Table:
    """A DataFrame written once to the shared folder; ``drop()`` deletes it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = shared_path(self.spark, "llm", f"{name}-{uuid.uuid4().hex}")
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_rows(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A few rows of the driver as a table that goes to the JVM as Arrow, so that no Python worker reads it."""
    kinds = to_arrow_schema(schema)
    columns = zip(*rows) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds), schema)


def text_key(text: Column) -> Column:
    """16 bytes that name a text (null counts as empty)."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def apart(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores in front as keep them apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    lead = "__"
    while any(lead + n in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``df``, whatever marks their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in without]


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts behind each other, and n + 1 offsets (null: empty)."""
    array = array.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    if array.buffers()[2] is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(array: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of whole texts of about ``size`` bytes: (first row, texts).

    A longer text is a slice of its own.  What works on a slice holds some arrays of eight bytes a byte, so a
    text of 100 MB takes its task a few GB; executors that meet such texts need that memory."""
    _, offsets = text_bytes(array)
    first = 0
    while first < len(array):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, array.slice(first, last - first)
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_BASE = 0x5851F42D4C957F2D
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, PIECE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash, for :func:`span_hash`."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans, equal for equal bytes wherever they stand."""
    inverse = powers(len(sums), pow(_BASE, -1, 1 << 64))
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII bytes that are neither letters nor digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_hashes(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word (maximal run of bytes that are no breaks, within a
    text), and n + 1 offsets of the texts' words."""
    inside = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word never spans two texts
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hash(prefix_hash(data), starts, ends), np.searchsorted(starts, offsets)


def each_group(df: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """``work(table)`` for the rows of each distinct ``keys``, as Arrow.

    Groups are streamed from sorted partitions, so a task holds one group at a
    time and many small groups cost little; ``work`` returns a table or None.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            changed = np.zeros(batch.num_rows, bool)
            for k in keys:
                column = batch[k].to_numpy(zero_copy_only=False)
                changed[1:] |= column[1:] != column[:-1]
                if held:
                    changed[0] |= held[-1][k][held[-1].num_rows - 1].as_py() != column[0]
            cuts = np.flatnonzero(changed).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if held and changed[a]:
                    yield from finish(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from finish(held)

    def finish(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = work(pa.Table.from_batches(held).combine_chunks())
        if out is not None:
            yield from out.to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(scan, schema)


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``root`` (smallest id of its connected component) of all ends of
    ``edges`` (a, b), by alternating large and small stars; each round is a table."""
    now = Table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    while True:
        counts = now.df.agg(F.count("*").alias("n"), F.countDistinct("b").alias("ends")).first()
        if counts.n == counts.ends and now.df.join(now.df.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break  # stars: every end points at one root, and no root is an end
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = Table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "low")
        large = Table(both.where("b > a").join(low.df, "a").select(F.col("low").alias("a"), "b").distinct(), "large")
        least = Table(large.df.groupBy("b").agg(F.min("a").alias("low")), "least")
        small = large.df.join(least.df, "b")
        next_ = Table(small.select(F.col("low").alias("a"), "b").union(small.select("low", "a").where("low < a")).distinct(), "edges")
        for old in (now, low, large, least):
            old.drop()
        now = next_
    ends = now.df.select(F.col("b").alias("id"), F.col("a").alias("root"))
    return ends.union(now.df.select("a", F.col("a").alias("root")).distinct())


def linked(near: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the smallest row reachable from each row."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(near)).min(1, initial=len(near)))
        low = low[low]
        if (low == label).all():
            return label
        label = low
