"""Best-two-fit packing of tokenized documents into sequences.

Each document's ids are those of the tokenizer, then an end id; documents longer than a
sequence are cut into pieces of its length.  Pieces are dealt evenly into
groups of about ``group_rows`` (by row, not by source or text, so no group is
hot) and each group is packed by best-two-fit: a bin is filled greedily with the longest
piece that fits; then its smallest piece gives way to the two unpacked pieces
that together fit the widened gap most tightly, if they fill more than it did.
Bins that a group leaves under ``full`` are opened again and their pieces packed once more
in groups of their own, so that the loss is a few bins, not one per group.

Defined cases: null text counts as empty and is one piece holding the end id;
repeated rows are packed each for itself; an empty table gives no rows; ``doc_id``
may be null or repeated.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import LOWER, WHITE, Table, pieces, text_bytes

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


_BYTES = np.arange(256)
#: Letters: ASCII ones and all parts of characters beyond ASCII.
LETTER = (_BYTES >= 128) | np.array([b < 128 and chr(b).isalpha() for b in range(256)])
#: Bytes that a plain word has not: digits, control characters, apostrophes (they join what follows),
#: bars (the names of special ids have them) and characters outside U+00C0 to U+027F.
ODD = np.array([b < 32 or b in b"0123456789'|\x7f" for b in range(256)]) | ((_BYTES >= 0xC0) & ((_BYTES < 0xC3) | (_BYTES > 0xC9)))


#: Of word parts, those that the vocabulary reads as one word: letters only, or ASCII punctuation only.
PLAIN = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u027F]+|[!-&(-/:-@\[-`{}~]+")


def word_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and n + 1 offsets.

    Plain words (letters and ASCII punctuation) are cut where one ends and the other begins, and A-Z is folded."""
    keep = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = keep.copy()
    first[1:] &= ~keep[:-1] | edge[1:-1]
    first, kept = first[keep], data[keep]
    before = np.concatenate([[0], np.cumsum(keep)])[offsets]
    if not len(kept):
        return pa.array([], pa.large_string()), np.zeros(len(offsets), np.int64)
    odd = ODD[kept]
    signs = (kept[:-1] == 0xC3) & ((kept[1:] == 0x97) | (kept[1:] == 0xB7))  # the signs among the letters
    signs |= (kept[:-1] == 0xC4) & (kept[1:] == 0xB0)  # U+0130: its small form ends in a mark that joins punctuation
    odd[:-1] |= signs
    words = np.flatnonzero(first)
    odd = np.repeat(np.logical_or.reduceat(odd, words), np.diff(np.append(words, len(kept))))
    letter = LETTER[kept]
    first[1:] |= (letter[1:] != letter[:-1]) & ~odd[1:]
    kept = np.where(odd, kept, LOWER[kept])
    starts = np.flatnonzero(first)
    ends = np.append(starts, len(kept)).astype(np.int64)
    parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(kept))
    return parts, np.searchsorted(starts, before)


class WordEncoder:
    """Ids of whole texts from a vocabulary that treats words apart.

    The tokenizer must never join across ASCII white space, and read plain words
    in parts (see :func:`word_parts`) without regard to case; then a text's ids are those
    of its parts, and a part is encoded once for as long as it stays in the
    bounded table of known ones.
    """

    def __init__(self, path: str, max_words: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.max_words = Tokenizer.from_file(path), max_words
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if PLAIN.fullmatch(w)]
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            # one text of many words is cheaper than many texts; a plain word has one last id
            joined = [" ".join(some[i : i + 500]) for i in range(0, len(some), 500)]
            ids = np.concatenate([np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                self.keep(some, ids, np.diff(ends, prepend=0))
            else:
                self.learn_alone(some)
        self.learn_alone([w for w in words if not PLAIN.fullmatch(w)])

    def learn_alone(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self.keep(some, np.array([i for ids in found for i in ids], np.int64), np.array([len(ids) for ids in found], np.int64))

    def keep(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.slot)
        self.start, self.count = self._room(self.start, n + len(words)), self._room(self.count, n + len(words))
        self.ids = self._room(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.count[n : n + len(words)] = counts
        self.start[n : n + len(words)] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.slot.update(zip(words, range(n, n + len(words))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and n + 1 offsets."""
        parts, of_text = word_parts(*text_bytes(texts))
        coded = parts.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.slot) > self.max_words:
            self.forget()
        self.learn([w for w in words if w not in self.slot])
        slots = np.fromiter((self.slot[w] for w in words), np.int64, len(words))[coded.indices.to_numpy()]
        counts = self.count[slots]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.repeat(self.start[slots] - upto[:-1], counts) + np.arange(upto[-1])]
        return ids, upto[of_text]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per Python worker, so that tasks share the known words."""
    return WordEncoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """A row per piece: doc_id, piece, start, length and the CRC-32 of its ids."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for batch in batches:
            for first, texts in pieces(batch.column(1)):
                ids, ends = known.encode(texts)
                rows: list[tuple] = []
                for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    own = np.append(ids[a:b], end_id).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        rows.append((first + row, k, at, len(part), zlib.crc32(part.tobytes())))
                row, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, PIECE)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; bins are numbered from 0."""
    order = np.argsort(lengths, kind="stable")
    values, firsts, counts = np.unique(lengths[order], return_index=True, return_counts=True)
    left = np.zeros(capacity + 1, np.int64)  # how many pieces of a length are unpacked
    left[values] = counts
    sizes = values.tolist()  # lengths that are left, ascending

    def take(size: int) -> int:
        left[size] -= 1
        if not left[size]:
            sizes.pop(bisect_right(sizes, size) - 1)
        return size

    bins: list[list[int]] = []
    while sizes:
        gap, bin_ = capacity, []
        swapped = False
        while True:
            while sizes and sizes[0] <= gap:
                bin_.append(take(sizes[bisect_right(sizes, gap) - 1]))
                gap -= bin_[-1]
            if not gap or swapped or len(bin_) < 2 or not sizes:
                break
            smallest = min(bin_)
            pair = tightest_pair(left, gap + smallest)
            swapped = True
            if pair is None or sum(pair) <= smallest:
                break
            bin_.remove(smallest)
            bin_ += [take(pair[0]), take(pair[1])]
            gap += smallest - sum(pair)
            if not left[smallest]:
                insort(sizes, smallest)
            left[smallest] += 1
        bins.append(bin_)
    next_of = dict(zip(values.tolist(), firsts.tolist()))
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, bin_ in enumerate(bins):
        at = 0
        for size in bin_:
            row = order[next_of[size]]
            next_of[size] += 1
            bin_of[row], offset[row] = number, at
            at += size
    return bin_of, offset


def tightest_pair(left: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum up to ``gap``."""
    there = np.flatnonzero(left[: gap + 1])
    small = there[there * 2 <= gap]
    if not len(small):
        return None
    at = np.searchsorted(there, gap - small, "right") - 1
    alone = (there[at] == small) & (left[small] < 2)  # the only one of its length
    at = at - alone
    ok = at >= 0
    sums = np.where(ok, small + there[at], -1)
    best = int(np.argmax(sums))
    return (int(small[best]), int(there[at[best]])) if sums[best] > 0 else None


def _deal(rows: DataFrame, count: int, group_rows: int) -> DataFrame:
    groups = -(-count // group_rows)
    return rows.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, groups))))


def _pack(rows: DataFrame, count: int, capacity: int, group_rows: int, high: int) -> DataFrame:
    """``rows`` with sequence_id, offset and fill, packed by group; ``high`` marks the round in the ids."""
    names = rows.columns

    def one(key: tuple, table: pa.Table) -> pa.Table:
        bin_of, offset = best_two_fit(table["length"].to_numpy(), capacity)
        fill = np.bincount(bin_of, table["length"].to_numpy()).astype(np.int64)[bin_of]
        sequence = bin_of + (int(key[0].as_py()) << 24) + (high << 60)
        out = table.select(names)
        for name, column in (("sequence_id", sequence), ("offset", offset), ("fill", fill)):
            out = out.append_column(name, pa.array(column))
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long, fill long"
    return _deal(rows, count, group_rows).groupBy("__group").applyInArrow(one, schema)


def pack_pieces(rows: DataFrame, capacity: int = 4096, group_rows: int = 8192, full: float = 0.97) -> DataFrame:
    """``rows`` (with a ``length`` of 1 to ``capacity``) plus sequence_id, offset and fill.

    ``rows`` must be read from a table, so that rows are dealt alike on a retry."""
    count = rows.count()
    first = Table(_pack(rows, count, capacity, group_rows, 0), "packed").df
    loose = first.where(F.col("fill") < F.lit(int(full * capacity)))
    n = loose.count()
    if count <= group_rows or not n:
        return first
    again = _pack(loose.select(*rows.columns), n, capacity, group_rows, 1)
    return first.where(F.col("fill") >= F.lit(int(full * capacity))).unionByName(again)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    table = Table(token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    return pack_pieces(table.df, capacity).drop("fill")
