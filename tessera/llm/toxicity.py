"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features are the distinct words, word pairs and skip pairs (one word left
out) of a whole text, hashed to ``2**bits`` places.  FTRL-proximal keeps a
rate per place and its L1 term leaves most weights at zero, so the model is a short list of
(place, weight) that every task holds; a score is the logistic of the sum of the
weights present.  Letters A-Z are folded and ASCII punctuation separates words.

The model is fitted on a bounded sample: up to ``max_rows`` labelled rows, those
of the smallest hash of doc_id; scoring covers all documents.

Defined cases: null and empty texts score from the bias alone; a null doc_id
counts as the empty text for the remainder and has no label; labels repeated
for a doc_id count as toxic if any is; of texts under one doc_id one is learned; documents repeated are scored each; without labelled
rows every score is 0.5 or less (the bias is 0 and 0.5 is lowered to just below); empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.shared import LOWER, PUNCTUATION, apart, columns, mix64, pieces, text_bytes, word_hashes


@dataclass(frozen=True)
class FtrlParams:
    bits: int = 21
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.01
    epochs: int = 8
    batch: int = 16
    #: Bound of the training sample, in labelled rows.
    max_rows: int = 8192


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of all words, pairs and skip pairs, and the text each is of (with repeats)."""
    data, offsets = text_bytes(texts)
    words, ends = word_hashes(LOWER[data], offsets, PUNCTUATION)
    text = np.repeat(np.arange(len(texts)), np.diff(ends))
    places, of = [words], [text]
    for step in (1, 2):
        pair = mix64(words[:-step] * np.uint64(2 * step + 1) + mix64(words[step:]) + np.uint64(step))
        same = text[:-step] == text[step:]
        places.append(pair[same])
        of.append(text[:-step][same])
    return (np.concatenate(places) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(of)


def distinct(places: np.ndarray, of: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((of << bits) | places)
    return both & ((1 << bits) - 1), both >> bits


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, p: FtrlParams) -> tuple[float, np.ndarray]:
    """Bias and weights; ``rows`` are arrays of distinct places."""
    size = 1 << p.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last place is the bias, free of L1

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == size, 0.0, p.l1)
        w = -(z[at] - np.sign(z[at]) * l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    rng = np.random.default_rng(7)
    for _ in range(p.epochs):
        order = rng.permutation(len(rows))
        for first in range(0, len(rows), p.batch):
            some = order[first : first + p.batch]
            places = np.concatenate([np.append(rows[i], size) for i in some])
            of = np.repeat(np.arange(len(some)), [len(rows[i]) + 1 for i in some])
            at, where = np.unique(places, return_inverse=True)
            w = weights(at)
            sums = np.bincount(of, w[where], len(some))
            error = 1 / (1 + np.exp(-np.clip(sums, -35, 35))) - labels[some]
            g = np.bincount(where, error[of], len(at))
            squares = np.bincount(where, (error**2)[of], len(at))
            rate = (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / p.alpha
            z[at] += g - rate * w
            n[at] += squares
    w = weights(np.arange(size + 1))
    return float(w[size]), w[:size]


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, label: str = "toxic") -> DataFrame:
    """doc_id, text and label of up to ``max_rows`` labelled documents outside the held-out fold.

    One text for each id, that of the smallest hash: ids that many rows repeat cost one row a task, and the fit
    gets at most ``max_rows`` rows whatever the documents."""
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0))
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows ids of 12 bytes: a proven bound
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", text.alias("text")).join(F.broadcast(sample), "doc_id")
    return named.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, places and weights that are not zero."""
    bits = params.bits

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch.column(1)):
                at, of = distinct(*features(texts, bits), bits)
                ends = np.searchsorted(of, np.arange(len(texts) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), lists, batch.column(2).slice(first, len(texts))], ["doc_id", "places", "label"])

    def fit(_: tuple, table: pa.Table) -> pa.Table:
        # a fixed order, so that reruns agree
        order = np.lexsort((mix64(table["doc_id"].to_numpy().astype(np.uint64)),))
        lists = table["places"].combine_chunks()
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        rows = [values[ends[i] : ends[i + 1]] for i in order]
        bias, w = fit_ftrl(rows, table["label"].to_numpy()[order].astype(float), params)
        at = np.flatnonzero(w)
        return pa.table({"place": pa.array(np.append(at, -1).astype(np.int32)), "weight": pa.array(np.append(w[at], bias))})

    rows = training_rows(docs, labels, params.max_rows).mapInArrow(places, "doc_id long, places array<int>, label int")
    # one task fits the bounded sample; at most 2**bits weights come back
    model = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(fit, "place int, weight double").toArrow()
    at, w = model["place"].to_numpy(), model["weight"].to_numpy()
    bias = float(w[at < 0].sum())
    return bias, at[at >= 0], w[at >= 0]


def score_documents(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], bits: int, name: str = "score") -> DataFrame:
    """``docs`` (with a column ``text``) plus the score; a column of that name is replaced."""
    rest = [c for c in docs.columns if c != name]
    at_text = rest.index("text")
    bias, at, w = model
    shipped = docs.sparkSession.sparkContext.broadcast((at, w))  # at most 2**bits pairs
    given = docs.select(*columns(docs, without=(name,)))
    schema = StructType([*given.schema.fields, StructField(name, DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(1 << bits)
        weight[shipped.value[0]] = shipped.value[1]
        for batch in batches:
            sums = np.full(batch.num_rows, bias)
            for first, texts in pieces(batch.column(at_text)):
                places, of = features(texts, bits)
                counts = weight[places] != 0
                places, of = distinct(places[counts], of[counts], bits)
                sums[first : first + len(texts)] += np.bincount(of, weight[places], len(texts))
            score = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            score[sums == 0] = np.nextafter(0.5, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], rest + [name])

    # by place, as this call looks names up and reads a dot in them as a field's
    return given.toDF(*(f"c{i}" for i in range(len(rest)))).mapInArrow(scan, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = train(docs, labels, params)
    return score_documents(docs.select("doc_id", "text"), model, params.bits).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> DataFrame:
    """The documents that score below 0.5, with their own columns."""
    model = train(docs, labels, params)
    (score,) = apart(docs, "score")
    return score_documents(docs, model, params.bits, score).where(F.col(score) < 0.5).select(*columns(docs))
