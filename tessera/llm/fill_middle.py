"""Fill-in-middle transformation with content-defined chunk memoization.

A text is cut into two places and written as ``<P>prefix<S>suffix<M>middle`` (psm),
``<S>suffix<P>prefix<M>middle`` (spm) or as it is (plain).  Cuts are counted in
code points, which UTF-8 does not index, so:

1. A gear rolling hash over the bytes cuts a text into chunks that depend on their
   content alone, so passages that texts share give the same chunks.
2. A chunk's summary (code points, whether it holds a marker, the bytes at its two
   boundaries) is looked up by digest in a cache of bounded size that a worker keeps over its
   texts, and a hit is verified on the chunk's bytes.
3. Prefix sums of the chunks' counts give the text's length and the chunk each cut falls
   in; only that chunk is looked at by character.  A marker that spans chunks is found in
   the joined boundaries.

Forms and cuts are drawn from hashes of the document's id, so reruns agree and
nothing is shuffled.  :func:`restore` gives the text back from output and form alone.

Defined cases: null text is empty and stays plain with an empty output; a null id counts as an empty one;
rows of equal ids draw alike, each over its own text; texts of any length are worked through
whole, a block of bytes at a time; columns named like those added are replaced; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.chunk_dedup import WINDOW, gear
from tessera.llm.shared import columns, pieces, text_bytes

#: What marks prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
LEAST, MOST, BITS = 256, 8192, 10
BLOCK = 1 << 20


class Summary(NamedTuple):
    chars: int
    marked: bool
    head: bytes
    tail: bytes


class ChunkCache:
    """Summaries of chunks by digest, verified by content; the oldest go beyond ``bound`` bytes."""

    def __init__(self, markers: tuple[str, ...], bound: int = 32 << 20):
        self.markers = [m.encode() for m in markers]
        self.edge = max(len(m) for m in self.markers) - 1
        self.bound, self.held = bound, 0
        self.known: OrderedDict[tuple[int, int], tuple[bytes, Summary]] = OrderedDict()
        self.hits = self.misses = 0

    def summary(self, chunk: bytes) -> Summary:
        name = zlib.crc32(chunk), len(chunk)
        found = self.known.get(name)
        if found is not None and found[0] == chunk:
            self.hits += 1
            self.known.move_to_end(name)
            return found[1]
        self.misses += 1
        # a character starts at each byte that does not go on with one, wherever chunks are cut
        chars = len(chunk) if chunk.isascii() else int(np.count_nonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80))
        new = Summary(chars, self.marks(chunk), chunk[: self.edge], chunk[len(chunk) - min(self.edge, len(chunk)) :])
        if found is not None:
            self.held -= len(found[0])
        self.known[name] = chunk, new
        self.known.move_to_end(name)
        self.held += len(chunk)
        while self.held > self.bound and len(self.known) > 1:
            _, (old, _) = self.known.popitem(last=False)
            self.held -= len(old)
        return new

    def marks(self, raw: bytes) -> bool:
        return any(m in raw for m in self.markers)


def chunk_marks(data: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places after bytes whose gear hash ends a chunk, found block by block."""
    found = []
    for first in range(0, len(data), BLOCK):
        low = max(0, first - WINDOW + 1)
        h = gear(data[low : first + BLOCK])[first - low :]
        found.append(np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + first + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(marks: np.ndarray, start: int, end: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of the text at [start, end), given all marks in order."""
    low, high = np.searchsorted(marks, [start, end])
    own = marks[low:high].tolist()
    ends, at = [], 0
    while start < end:
        while at < len(own) and own[at] < start + least:
            at += 1
        start = min(own[at] if at < len(own) else end, start + most, end)
        ends.append(start)
    return ends


class Chunked:
    """A text as chunks: its length in code points, whether it holds a marker, and where a code point starts."""

    def __init__(self, raw: bytes, ends: list[int], cache: ChunkCache):
        self.raw, self.ends = raw, ends
        self.upto, self.marked, tail, first, total = [], False, b"", 0, 0
        for end in ends:
            s = cache.summary(raw[first:end])
            total += s.chars
            self.upto.append(total)
            self.marked |= s.marked or cache.marks(tail + s.head)
            # a chunk shorter than a boundary passes on what the one before left
            tail = s.tail if len(s.tail) == cache.edge else (tail + s.tail)[-cache.edge :] if cache.edge else b""
            first = end
        self.chars = total

    def byte_of(self, char: int) -> int:
        """The byte at which code point ``char`` starts (the text's end for its length)."""
        if char >= self.chars:
            return len(self.raw)
        k = int(np.searchsorted(self.upto, char, "right"))
        first, before = (self.ends[k - 1], self.upto[k - 1]) if k else (0, 0)
        if self.upto[k] - before == self.ends[k] - first:
            return first + char - before
        chunk = np.frombuffer(self.raw, np.uint8, self.ends[k] - first, first)
        return first + int(np.flatnonzero((chunk & 0xC0) != 0x80)[char - before])


def draws(doc_id: Column, seed: str) -> list[Column]:
    """The first four 32-bit groups of a document's hash, as longs."""
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(sha, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


#: What :func:`fill_in_middle` adds.
ADDED = [
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
]


def fill_in_middle(
    docs: DataFrame, rate: int = 90, spm: int = 20, seed: str = "1", markers: tuple[str, str, str] = MARKERS,
    doc_id: str = "doc_id", text: str = "text", cache_bytes: int = 32 << 20,
) -> DataFrame:
    """``docs`` plus n (code points), form, prefix_chars, middle_chars (null if plain) and output.

    ``rate`` of 100 texts are transformed, ``spm`` of 100 of those to spm.
    Markers must differ and begin with a character that they hold nowhere else, so that none can
    arise where text and marker meet."""
    if len(set(markers)) < 3 or any(len(m) < 2 or m[0] in n[1:] for m in markers for n in markers):
        raise ValueError(f"markers must differ and not hold their first characters twice: {markers}")
    given = docs.select(*columns(docs, without=tuple(f.name for f in ADDED)))
    rest = given.columns
    at = rest.index(text)
    schema = T.StructType([*given.schema.fields, *ADDED])
    names = schema.names
    prefix, suffix, middle = (m.encode() for m in markers)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache(markers, cache_bytes)
        for batch in batches:
            for first, texts in pieces(batch.column(at)):
                data, offsets = text_bytes(texts)
                raws, marks, offsets = memoryview(data), chunk_marks(data), offsets.tolist()
                h1, h2, h3, h4 = (batch.column(len(rest) + k).slice(first, len(texts)).to_pylist() for k in range(4))
                n, form, before, between, out = [], [], [], [], []
                for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
                    raw = bytes(raws[a:b])
                    chunked = Chunked(raw, [e - a for e in chunk_ends(marks, a, b)], cache)
                    size = chunked.chars
                    n.append(size)
                    if not size or chunked.marked or h3[i] % 100 >= rate:
                        form.append("plain")
                        before.append(None)
                        between.append(None)
                        out.append(raw)
                        continue
                    one, two = sorted((h1[i] % (size + 1), h2[i] % (size + 1)))
                    p, m = chunked.byte_of(one), chunked.byte_of(two)
                    before.append(one)
                    between.append(two - one)
                    if h4[i] % 100 < spm:
                        form.append("spm")
                        out.append(b"".join((suffix, raw[m:], prefix, raw[:p], middle, raw[p:m])))
                    else:
                        form.append("psm")
                        out.append(b"".join((prefix, raw[:p], suffix, raw[m:], middle, raw[p:m])))
                added = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()),
                         pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in batch.columns[: len(rest)]), *added], names)

    drawn = given.select(*columns(given), *draws(F.col("`" + doc_id + "`"), seed))
    # by place, as this call looks names up and reads a dot in them as a field's
    return drawn.toDF(*(f"c{i}" for i in range(len(drawn.columns)))).mapInArrow(scan, schema)


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that gave ``output`` in ``form``: the parts between the first markers, in order.

    Parts end at the first place of the next marker, as texts with markers stay plain."""
    prefix, suffix, middle = markers

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        a = F.substring_index(output.substr(F.lit(len(first) + 1), F.length(output)), second, 1)
        rest = output.substr(F.length(a) + len(first) + len(second) + 1, F.length(output))
        b = F.substring_index(rest, middle, 1)
        return a, b, rest.substr(F.length(b) + len(middle) + 1, F.length(rest))

    p, s, m = parts(prefix, suffix)
    s2, p2, m2 = parts(suffix, prefix)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


def transform_digests(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of the output and of the text restored from it."""
    done = fill_in_middle(docs.select("doc_id", "text"), **settings)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restore(F.col("output"), F.col("form"), settings.get("markers", MARKERS))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))
