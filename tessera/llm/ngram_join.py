"""Similarity join of documents by Jaccard similarity of word 5-grams (MinHash banding).

Words are maximal runs of characters other than ASCII white space; a text of fewer than five
words has all its words as its one n-gram.  Texts that are equal are one text with a count.
Each text has ``bands`` hashes of ``rows`` minima, chosen so that a pair at the threshold meets
in some band with the target recall.  Texts are shuffled on band hashes: a bucket is the texts with one hash of one band.
Of buckets that hold the same texts (a pair of near copies meets in most bands) the first band's stays.
A pair is verified on its full sets of n-grams in the first band it shares, so never twice, and texts that share no band are never
compared, however many others connect them: pages of one template that are not alike
cost as many verifications as meet by chance.  Buckets with many or long texts are cut into blocks, and a cell is
one block or two against each other.  What comes back of a cell is a link count and a spanning forest, never the pairs.

Defined cases: null and empty texts have no n-grams and link with nothing, not even each other (a class each);
equal texts link; classes are named by the smallest doc_id (null only if all are);
repeated rows are rows of their own; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Table, apart, columns, components, each_group, linked, mix64, pieces, text_bytes, text_key, word_hashes

N = 5


def choose_bands(threshold: float, recall: float, most: int = 256, noise: float = 0.3) -> tuple[int, int]:
    """(bands, rows) within ``most`` minima that reach the recall at the threshold
    and let the fewest pairs of similarity ``noise`` meet."""
    best = None
    for rows in range(1, 33):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                meet = 1 - (1 - noise**rows) ** bands
                best = min(best or (2.0, 0, 0), (meet, bands, rows))
                break
    if best is None:
        raise ValueError(f"no banding of {most} minima reaches recall {recall} at {threshold}")
    return best[1], best[2]


def ngrams(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams (with repeats) behind each other, and offsets."""
    data, offsets = text_bytes(texts)
    words, ends = word_hashes(data, offsets)
    counts = np.diff(ends)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    upto = np.concatenate([[0], np.cumsum(grams)])
    first = np.repeat(ends[:-1] - upto[:-1], grams) + np.arange(upto[-1])
    last = np.repeat(ends[1:], grams)
    out = np.zeros(len(first), np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        at = first + k
        out = out * np.uint64(0x2545F4914F6CDD1D) + np.where(at < last, padded[at], np.uint64(k + 1))
    return mix64(out), upto


def band_hashes(texts: pa.Array, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes per text that has n-grams, and the numbers of those texts."""
    grams, upto = ngrams(texts)
    full = np.flatnonzero(np.diff(upto))
    out = np.zeros((len(full), bands), np.uint64)
    if not len(full):
        return out, full
    low = (grams >> np.uint64(32)).astype(np.uint32)
    seeds = mix64(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)).astype(np.uint32).reshape(-1, 2)
    for band in range(bands):
        value = np.full(len(full), band + 1, np.uint64)
        for flip, factor in seeds[band * rows : (band + 1) * rows]:
            least = np.minimum.reduceat((low ^ flip) * (factor | np.uint32(1)), upto[:-1][full])
            value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, band] = value
    return out, full


def signatures(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """key and bands of every text with n-grams (``texts``: key, text)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in pieces(batch.column(1), 1 << 18):
                hashes, full = band_hashes(some, bands, rows)
                if len(full):
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(hashes.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + full)), lists], ["key", "bands"])

    return texts.mapInArrow(scan, "key binary, bands array<long>")


def first_meetings(earlier: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """For texts of one bucket, which pairs share no earlier band (``earlier``: their hashes of those); ``own``: their
    blocks, where only pairs of two blocks count."""
    first = ~np.eye(len(earlier), dtype=bool) if own is None else own[:, None] != own[None, :]
    for band in earlier.T:
        if len(band) > 64 and not first.any():
            break
        first &= band[:, None] != band[None, :]
    return first


def common_counts(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted sets, for the pairs asked for (others are 0 or theirs)."""
    sizes = np.array([len(s) for s in sets])
    wanted = int(pairs.sum()) // 2 * max(1, int(sizes.mean()))
    if wanted * 30 < len(sets) ** 2 * int(sizes.max()):  # few pairs: by lookup, one text against its partners
        both = np.zeros(pairs.shape, np.float32)
        for i in np.flatnonzero(np.triu(pairs).any(1)):
            with_ = np.flatnonzero(pairs[i, i + 1 :]) + i + 1
            others = np.concatenate([sets[j] for j in with_])
            at = np.searchsorted(sets[i], others)
            hit = sets[i][np.minimum(at, len(sets[i]) - 1)] == others
            both[i, with_] = both[with_, i] = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes[with_])[:-1]]))
        return both
    names, of = np.unique(np.concatenate(sets), return_inverse=True)
    text = np.repeat(np.arange(len(sets)), sizes)
    common = np.flatnonzero(np.bincount(of)[of] > 1)  # n-grams of one text meet nothing
    place = np.cumsum(np.bincount(of) > 1) - 1
    of, text = place[of[common]], text[common]
    both = np.zeros(pairs.shape, np.float32)
    by_name = np.argsort(of, kind="stable")
    of, text = of[by_name], text[by_name]
    width = max(256, (1 << 22) // len(sets))  # columns held at once
    for first in range(0, int(of[-1]) + 1 if len(of) else 0, width):
        a, b = np.searchsorted(of, [first, first + width])
        has = np.zeros((len(sets), min(width, int(of[-1]) + 1 - first)), np.float32)
        has[text[a:b], of[a:b] - first] = 1
        both += has @ has.T
    return both


def verify(table: pa.Table, threshold: float) -> pa.Table | None:
    """The pairs of a cell that meet first in its band, verified on their full sets: per text its links and the
    smallest text of its part of the cell."""
    if table.num_rows < 2:
        return None
    own = table["own"].to_numpy() if table["lo"][0].as_py() != table["hi"][0].as_py() else None
    earlier = table["earlier"].combine_chunks()
    pairs = first_meetings(earlier.flatten().to_numpy().reshape(table.num_rows, -1), own)
    meets = np.flatnonzero(pairs.any(1))
    if not len(meets):
        return None
    ids, copies = (table[c].to_numpy()[meets] for c in ("id", "n"))
    pairs = pairs[np.ix_(meets, meets)]
    sets = []
    for _, some in pieces(table["text"].combine_chunks().take(pa.array(meets))):
        grams, upto = ngrams(some)
        sets += [np.unique(grams[a:b]) for a, b in zip(upto[:-1], upto[1:])]
    sizes = np.array([len(s) for s in sets])
    # sets of too different sizes cannot reach the threshold
    pairs &= np.minimum(sizes[:, None], sizes[None, :]) >= threshold * np.maximum(sizes[:, None], sizes[None, :]) - 1e-9
    if not pairs.any():
        return None
    both = common_counts(sets, pairs)
    union = sizes[:, None] + sizes[None, :] - both
    ok = pairs & (both.astype(float) >= threshold * union - 1e-9)
    some = np.flatnonzero(ok.any(1))
    if not len(some):
        return None
    some = some[np.argsort(ids[some])]
    ok = ok[np.ix_(some, some)]
    return pa.table({"id": pa.array(ids[some]), "links": pa.array(ok @ copies[some]), "low": pa.array(ids[some][linked(ok)])})


def cells(texts: DataFrame, block_texts: int, block_bytes: int) -> tuple[DataFrame, Table]:
    """id and its cells (bucket, lo, hi, own block, number of earlier bands) for texts (id, bands, bytes)
    that meet another one, and the table of buckets that this reads."""
    members = texts.select("id", "bytes", F.posexplode("bands").alias("band", "bucket"))
    # 128 bits name a bucket's texts; equal buckets of later bands hold no pair that has not met
    alike = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    blocks = F.greatest(F.ceil(F.count("*") / block_texts), F.ceil(F.sum("bytes") / block_bytes)).cast("int")
    sized = members.groupBy("band", "bucket").agg(F.count("*").alias("size"), blocks.alias("blocks"), *alike).where("size > 1")
    kept = Table(sized.groupBy("size", "x0", "x1").agg(F.min(F.struct("band", "bucket", "blocks")).alias("k")).select("k.*"), "buckets")
    placed = members.select("id", "band", "bucket").join(kept.df, ["band", "bucket"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.struct("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "band")
    # at most bands x blocks cells a text
    return each.groupBy("id").agg(F.collect_list(cell).alias("cells")), kept


def text_classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, block_texts: int = 768, block_bytes: int = 4 << 20) -> DataFrame:
    """Per distinct text with n-grams: key, n (its rows), first (smallest doc_id), first_rows (rows
    with that id), links (rows of other texts linked), root (of its class) and class_id."""
    bands, rows = choose_bands(threshold, recall)
    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    by_id = keyed.groupBy("key", "doc_id").agg(F.count("*").alias("rows"), F.max(F.octet_length("text")).alias("bytes"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rows"))
    counted = by_id.groupBy("key").agg(F.sum("rows").alias("n"), F.max("bytes").alias("bytes"), first.alias("f")).select(
        "key", "n", "bytes", F.col("f.doc_id").alias("first"), F.col("f.rows").alias("first_rows"))
    # one row of each text; equal texts have equal signatures, so any row's will do
    signed = signatures(keyed.select("key", "text"), bands, rows).groupBy("key").agg(F.any_value("bands").alias("bands"))
    texts = Table(counted.join(signed, "key").withColumn("id", F.monotonically_increasing_id()), "texts")
    by_text, buckets = cells(texts.df, block_texts, block_bytes)
    dealt = Table(by_text.join(texts.df, "id"), "cells")
    buckets.drop()
    # one row per text, the one with the smallest doc_id, so copies stay behind; equal rows once
    mine = dealt.df.select(F.col("key").alias("__key"), "id", "n", "bands", "cells", "first")
    fetched = (keyed.join(mine, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("first")))
               .dropDuplicates(["id"])
               .select("id", "n", "bands", "text", F.explode("cells").alias("c"))
               .select("id", "n", "c.own", "c.bucket", "c.lo", "c.hi", F.slice("bands", F.lit(1), F.col("c.band")).alias("earlier"), "text"))
    found = Table(each_group(fetched, ["bucket", "lo", "hi"], lambda t: verify(t, threshold), "id long, links long, low long"), "links")
    roots = components(found.df.select(F.col("id").alias("a"), F.col("low").alias("b")))
    links = found.df.groupBy("id").agg(F.sum("links").alias("links"))
    named = Table(texts.df.drop("bands").join(links, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "named").df
    for done in (texts, dealt, found):
        done.drop()
    classes = named.groupBy("root").agg(F.min("first").alias("class_id"))
    return named.join(classes, "root").select("key", "n", "first", "first_rows", F.coalesce("links", F.lit(0)).alias("links"), "root", "class_id")


def ngram_join(docs: DataFrame, threshold: float = 0.8, **settings) -> DataFrame:
    """doc_id, class_id and n_links (other rows linked directly) for every row."""
    named = Table(text_classes(docs, threshold, **settings), "classes").df
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    return (keyed.join(named, "key", "left")
            .select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links")))


def drop_near_copies(docs: DataFrame, threshold: float = 0.8, **settings) -> DataFrame:
    """The documents of ``docs`` with one left per class: a row with the smallest doc_id.

    Documents without n-grams all stay."""
    named = text_classes(docs, threshold, **settings)
    stays = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key", "first_rows"))
    key, first, rows = apart(docs, "key", "first", "rows")
    keep = Table(named.groupBy("root").agg(stays.alias("s")).select(
        F.col("s.key").alias(key), F.col("s.first").alias(first), F.col("s.first_rows").alias(rows)), "keep").df
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # joined on text and id, so that copies of a text are not one key
    kept = docs.join(keep, (text_key(F.col("text")) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(first)))
    single = kept.where(F.col(rows) == 1).select(*columns(docs))
    repeated = kept.where(F.col(rows) > 1).dropDuplicates([key]).select(*columns(docs))
    return docs.where(wordless).union(single).union(repeated)
