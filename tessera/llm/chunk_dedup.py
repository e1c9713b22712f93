"""Substring dedup by content-defined chunks (gear rolling hash).

A chunk ends where the gear hash of the last 32 bytes of its text has its low bits clear, at least ``least`` and
at most ``most`` bytes after the chunk's start and never inside a character.
Cuts depend on the bytes around them, so after an insertion the following chunks fall into step
again.  ``least`` is kept near the mean gap between marks: the larger it is, the more a cut depends on where
the chunk before ended, and the longer two documents take to fall into step in a passage they share.  Each chunk's digest is counted over all documents; its places except the
first (smallest doc_id, then place) are copies.  Copied chunks that follow each other make a run, and runs of
``run`` bytes or more are removed: a chunk of a few words that two documents happen to share stays, a passage goes.

Identity of a row is its doc_id and its text; of rows that agree in both, one counts as the first and all
others are copies of it.

Defined cases: null texts count as empty, with 0 bytes; null doc_ids come last in order; texts shorter than ``least``
are one chunk of less than ``least`` bytes; such short ends are never removed, and a short run only where
it is the whole text; empty tables give no rows.  A text of any length is one row: a task holds it and some 16 bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import BYTE_CODES, Table, pieces, text_bytes

GEAR = (BYTE_CODES >> np.uint64(32)).astype(np.uint32)
WINDOW = 32


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j over the last 32 bytes, by doubling."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def gear_of_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """:func:`gear` of every text apart: nothing of the text before is in a text's first windows."""
    h = gear(data)
    now = np.zeros(len(offsets) - 1, np.uint32)
    for k in range(WINDOW - 1):
        at = offsets[:-1] + k
        here = at < offsets[1:]
        now[here] = (now[here] << np.uint32(1)) + GEAR[data[at[here]]]
        h[at[here]] = now[here]
    return h


def cuts(data: np.ndarray, offsets: np.ndarray, least: int, most: int, bits: int) -> tuple[list[int], list[int], list[int]]:
    """Row, start and end of the chunks of all texts."""
    # the high bits see all of the window
    marks = np.flatnonzero((gear_of_texts(data, offsets) >> np.uint32(32 - bits)) == 0) + 1
    follows = (data & 0xC0) == 0x80  # bytes within a character
    marks = marks[marks < len(data)]
    marks = marks[~follows[marks]].tolist()
    marks.append(len(data) + most)
    rows, starts, ends = [], [], []
    at = 0
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while a < b:
            while marks[at] < a + least:
                at += 1
            end = min(marks[at], a + most, b)
            while end < b and follows[end]:
                end -= 1
            rows.append(row)
            starts.append(a)
            ends.append(end)
            a = end
    return rows, starts, ends


def chunks(docs: DataFrame, least: int, most: int, bits: int) -> DataFrame:
    """doc_id, text_hash, start, length and digest (two longs) of every chunk of ``least`` bytes or more, or of a whole text."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch.column(2)):
                data, offsets = text_bytes(texts)
                rows, starts, ends = (np.array(c, np.int64) for c in cuts(data, offsets, least, most, bits))
                begin = offsets[rows] if len(rows) else starts
                whole = (starts == begin) & (ends == offsets[rows + 1]) if len(rows) else starts > 0
                some = (ends - starts >= least) | whole
                rows, starts, ends, begin = rows[some], starts[some], ends[some], begin[some]
                raw = data.tobytes()
                digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist()))
                both = np.frombuffer(digests, np.int64).reshape(-1, 2)
                at = pa.array(first + rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array((starts - begin).astype(np.int32)), pa.array((ends - starts).astype(np.int32)),
                     pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["doc_id", "text_hash", "start", "length", "d1", "d2"])

    return docs.mapInArrow(scan, "doc_id long, text_hash long, start int, length int, d1 long, d2 long")


def cut_out(texts: pa.Array, spans: pa.Array) -> tuple[list[int], list[int], list[int], list[str]]:
    """Bytes, bytes removed, runs removed and SHA-256 of what is left, per text; ``spans`` are lists of (start, length)."""
    sizes, removed, runs, digests = [], [], [], []
    for text, cut in zip(texts, spans):
        raw = (text.as_py() or "").encode()
        sha, at, count, gone = hashlib.sha256(), 0, 0, 0
        end = -1
        for start, length in sorted((s["start"], s["length"]) for s in cut.as_py() or ()):
            count += start > end  # else it goes on from the run before
            sha.update(raw[at:max(at, start)])
            gone += max(0, start + length - max(end, start))
            end = at = max(end, start + length)
        sha.update(raw[at:])
        sizes.append(len(raw))
        removed.append(gone)
        runs.append(count)
        digests.append(sha.hexdigest())
    return sizes, removed, runs, digests


def long_runs(spans: list[dict] | None, run: int, size: int) -> list[dict]:
    """The spans in runs (each begins where the one before ends) of ``run`` bytes or more, or of the whole text."""
    out: list[dict] = []
    held: list[dict] = []
    for s in [*sorted(spans or (), key=lambda s: s["start"]), None]:
        if held and (s is None or s["start"] > held[-1]["start"] + held[-1]["length"]):
            first, end = held[0]["start"], held[-1]["start"] + held[-1]["length"]
            if end - first >= run or (first == 0 and end == size):
                out += held
            held = []
        if s is not None:
            held.append(s)
    return out


def repeated_spans(docs: DataFrame, least: int = 24, most: int = 128, bits: int = 4) -> Table:
    """A table of doc_id, text_hash and spans: the chunks of each document that another place before it has."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    all_ = Table(chunks(named, least, most, bits), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "start")
    first = all_.df.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("d1", "d2", "first")
    first = Table(first, "firsts")
    # one row per digest on this side, so a frequent chunk's side can be split
    later = all_.df.join(first.df, ["d1", "d2"]).where(place > F.col("first"))
    spans = Table(later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "length")).alias("spans")), "spans")
    all_.drop()
    first.drop()
    return spans


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,length:int>>, kept_sha256 string"


def chunk_dedup(docs: DataFrame, run: int = 64, **settings) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), spans (start, length in bytes) and
    kept_sha256 (of the bytes left) per document."""
    spans = repeated_spans(docs, **settings).df.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch["text"]).to_pylist()
            gone = pa.array([long_runs(s, run, n or 0) or None for s, n in zip(batch["spans"].to_pylist(), sizes)], span_type)
            sizes, removed, runs, digests = cut_out(batch["text"], gone)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, pa.int64()) for c in (sizes, removed, runs)), gone, pa.array(digests)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])

    def cut(rows: DataFrame) -> DataFrame:
        met = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
        return met.select("doc_id", "text", "spans").mapInArrow(scan, RESULT)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    again = Table(named.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1"), "again").df
    if again.isEmpty():
        return cut(named)
    # equal rows differ in nothing, so one of each stands for the first and the others are made from their count
    theirs = again.select(F.col("doc_id").alias("__rid"), F.col("text_hash").alias("__rhash"), "n")
    same = F.col("doc_id").eqNullSafe(F.col("__rid")) & (F.col("text_hash") == F.col("__rhash"))
    one = named.join(theirs, same).groupBy("doc_id", "text_hash").agg(F.any_value("text").alias("text"), F.max("n").alias("n"))
    firsts = cut(named.join(theirs, same, "left_anti").unionByName(one.select("doc_id", "text", "text_hash")))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    copies = one.select("doc_id", size.alias("size"), F.explode(F.sequence(F.lit(2).cast("long"), F.col("n"))))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("length")))
    return firsts.unionByName(copies.select(
        "doc_id", F.col("size").cast("long").alias("n_bytes"), F.col("size").cast("long").alias("n_removed"),
        (F.col("size") > 0).cast("long").alias("n_spans"), F.when(F.col("size") > 0, whole).alias("spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256")))
