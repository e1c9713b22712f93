"""Substring dedup: every byte covered by a ``length``-byte string that starts anywhere else too.

Prefix doubling names strings of growing length and goes on with those whose name
is not unique, until the length is reached.  Here:

1. ``length / 4``.  Of the positions in a string of ``length`` bytes one is chosen by the string
   alone: the one whose ``length / 4`` bytes hash lowest.  Only these positions get a name, one for a
   run of neighbouring strings.  Runs whose name occurs once are dropped: none of
   their strings is repeated.
2. Nearly ``length``.  A run is cut at fixed distances from its position into cells of
   up to ``cell`` neighbouring strings; the bytes that they all share name
   the cell's class, and all of its bytes the cell.  A cell that occurs twice is
   repeated as a whole; a class of one distinct cell that occurs once is dropped.
3. ``length``.  Where a class has different cells, one of each kind
   names its strings one by one, and repeated names are repeated strings.

Names are digests instead of sorted ranks, as only their equality counts.  Sorting rank pairs of
every surviving position was built and measured (see the README): on 0.1 GB its first round
shuffled 5.5 times the input.  Here one position in about a hundred is shuffled.  Every step is a count by name,
combined before the shuffle, so a passage in a third of all documents is one row
per task.  Equal texts are one text with a count.

Defined cases: null text is empty; texts under ``length`` bytes lose nothing; a text that
occurs twice is removed whole if it has ``length`` bytes; results of repeated rows and of null
or repeated doc_ids are per row; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.chunk_dedup import cut_out
from tessera.llm.shared import Table, pieces, prefix_hash, span_hash, text_bytes

BITS = 16  # of a distance within a run


def text_id(text: Column) -> dict[str, Column]:
    """120 bits that name a text, as two longs."""
    sha = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    return {f"k{i}": F.conv(F.substring(sha, 15 * i + 1, 15), 16, 10).cast("long") for i in (0, 1)}


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from running minima of blocks."""
    blocks = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, 1).ravel()[: len(x)]
    after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()[: len(x)]
    return np.minimum(after[: len(x) - width + 1], before[width - 1 :])


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of strings that chose one position: its name, its text, its place in the text,
    and the least and greatest distance of the strings' starts before it."""
    gram = length // 4
    width = length - gram + 1
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at = np.arange(len(data) - gram + 1)
    names = span_hash(prefix_hash(data), at, at + gram)
    # by hash, then the rightmost; places count from the end
    low32 = np.uint64(0xFFFFFFFF)
    chosen = sliding_minimum((names & ~low32) | (low32 - at.astype(np.uint64)), width)
    chosen = (low32 - (chosen & low32)).astype(np.int64)
    text = np.searchsorted(offsets, at[: len(chosen)], "right") - 1
    start = np.flatnonzero(at[: len(chosen)] + length <= offsets[text + 1])  # within one text
    if not len(start):  # texts that are long enough only together
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    place, of = chosen[start], text[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return names[place[first]].view(np.int64), of[first], place[first] - offsets[of[first]], place[first] - start[last], place[first] - start[first]


def name_runs(texts: DataFrame, length: int) -> DataFrame:
    """k0, k1, name and run (place and distances in one long)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in pieces(batch["text"], 1 << 19):
                name, of, place, low, high = runs(*text_bytes(some), length)
                if len(name):
                    row = pa.array(first + of)
                    yield pa.RecordBatch.from_arrays(
                        [batch["k0"].take(row), batch["k1"].take(row), pa.array(name), pa.array(place << 2 * BITS | low << BITS | high)],
                        ["k0", "k1", "name", "run"])

    return texts.select("k0", "k1", "text").mapInArrow(scan, "k0 long, k1 long, name long, run long")


def _digest(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for part in parts:
        h.update(part)
    return h.digest()


def _longs(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]


def _per_text(texts: DataFrame, lists: DataFrame, names: list[str], make, schema: str, flush: int = 50_000) -> DataFrame:
    """Rows of ``make(text bytes, list)`` for texts that have a list; texts are bucketed, so they stay in place."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        keys: list[tuple[int, int]] = []

        def table() -> pa.RecordBatch:
            k0, k1 = zip(*keys)
            columns = [pa.array(k0, pa.int64()), pa.array(k1, pa.int64())]
            for c in zip(*rows):
                columns += _longs(list(c)) if isinstance(c[0], bytes) else [pa.array(c, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for k0, k1, text, items in zip(*(batch[c] for c in ("k0", "k1", "text", "items"))):
                found = make(text.as_py().encode(), items.as_py())
                rows += found
                keys += [(k0.as_py(), k1.as_py())] * len(found)
                if len(rows) > flush:
                    yield table()
                    rows, keys = [], []
        if rows:
            yield table()

    return texts.select("k0", "k1", "text").join(lists, ["k0", "k1"]).select("k0", "k1", "text", "items").mapInArrow(scan, schema)


def cells(texts: DataFrame, repeated: DataFrame, length: int, cell: int) -> DataFrame:
    """start and end in the text, class (c0, c1) and name (f0, f1) of the cells of all runs in ``repeated``."""
    mask = (1 << BITS) - 1

    def make(raw: bytes, items: list[int]) -> list[tuple]:
        out = []
        for run in items:
            place, low, high = run >> 2 * BITS, run >> BITS & mask, run & mask
            for j in range(low // cell, high // cell + 1):
                near, far = max(low, j * cell), min(high, (j + 1) * cell - 1)
                core = raw[place - j * cell : place - (j + 1) * cell + 1 + length]
                kind = _digest(b"%d|" % j, core)
                a, b = place - far, place - near + length
                out.append((a, b, kind, _digest(b"%d|%d|" % (near, far), raw[a:b])))
        return out

    lists = repeated.groupBy("k0", "k1").agg(F.collect_list("run").alias("items"))
    return _per_text(texts, lists, ["k0", "k1", "a", "b", "c0", "c1", "f0", "f1"], make,
                     "k0 long, k1 long, a long, b long, c0 long, c1 long, f0 long, f1 long")


def strings(texts: DataFrame, some: DataFrame, length: int) -> DataFrame:
    """start and name (w0, w1) of every string of the cells in ``some``."""
    def make(raw: bytes, items: list) -> list[tuple]:
        return [(p, _digest(raw[p : p + length])) for p in sorted({p for c in items for p in range(c["a"], c["b"] - length + 1)})]

    lists = some.groupBy("k0", "k1").agg(F.collect_list(F.struct("a", "b")).alias("items"))
    return _per_text(texts, lists, ["k0", "k1", "p", "w0", "w1"], make, "k0 long, k1 long, p long, w0 long, w1 long")


def repeated_runs(texts: DataFrame, length: int) -> Table:
    named = Table(name_runs(texts, length), "runs")
    twice = Table(named.df.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "names")
    out = Table(named.df.join(twice.df, "name").select("k0", "k1", "run"), "repeated")
    named.drop()
    twice.drop()
    return out


def repeated_strings(texts: DataFrame, length: int, cell: int) -> list[Table]:
    """Tables of k0, k1, a, b: parts of texts that are covered by repeated strings."""
    repeated = repeated_runs(texts, length)
    found = Table(cells(texts, repeated.df, length, cell), "cells")
    repeated.drop()
    kinds = Table(found.df.groupBy("c0", "c1", "f0", "f1").agg(F.count("*").alias("n"), F.min(F.struct("k0", "k1", "a", "b")).alias("one")), "kinds")
    twice = Table(kinds.df.where("n > 1").select("c0", "c1", "f0", "f1"), "twice")
    whole = Table(found.df.join(twice.df, ["c0", "c1", "f0", "f1"]).select("k0", "k1", "a", "b"), "whole")
    found.drop()
    twice.drop()
    mixed = Table(kinds.df.groupBy("c0", "c1").agg(F.count("*").alias("m")).where("m > 1").select("c0", "c1"), "mixed")
    each = Table(kinds.df.join(mixed.df, ["c0", "c1"]).select("one.*"), "each")
    kinds.drop()
    mixed.drop()
    single = Table(strings(texts, each.df, length), "strings")
    each.drop()
    again = Table(single.df.groupBy("w0", "w1").agg(F.count("*").alias("n")).where("n > 1").select("w0", "w1"), "again")
    parts = Table(single.df.join(again.df, ["w0", "w1"]).select("k0", "k1", F.col("p").alias("a"), (F.col("p") + length).alias("b")), "parts")
    single.drop()
    again.drop()
    return [whole, parts]


def suffix_dedup(docs: DataFrame, length: int = 400, cell: int = 32) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the bytes left) per row."""
    spark = docs.sparkSession
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(text_id(F.col("text")))
    name = f"tessera_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        (named.groupBy("k0", "k1").agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
         .write.bucketBy(buckets, "k0", "k1").option("compression", "zstd").format("parquet").saveAsTable(name))
        texts = spark.table(name)
        parts = repeated_strings(texts, length, cell)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = []
                for text, copies, items in zip(*(batch[c].to_pylist() for c in ("text", "copies", "items"))):
                    size = len(text.encode())
                    items = [{"a": 0, "b": size}] if copies > 1 and size >= length else items or ()
                    spans.append([{"start": s["a"], "length": s["b"] - s["a"]} for s in items])
                out = cut_out(batch["text"], pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))))
                yield pa.RecordBatch.from_arrays(
                    [batch["k0"], batch["k1"], *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3])],
                    ["k0", "k1", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        lists = parts[0].df.unionByName(parts[1].df).groupBy("k0", "k1").agg(F.collect_set(F.struct("a", "b")).alias("items"))
        done = Table(texts.join(lists, ["k0", "k1"], "left").select("k0", "k1", "text", "copies", "items").mapInArrow(
            cut, "k0 long, k1 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "cut")
        for part in parts:
            part.drop()
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return named.select("doc_id", "k0", "k1").join(done.df, ["k0", "k1"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
