"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash.  Sizes are summed by source and leading
hash bits; in each source the bucket in which the budget runs out is found
from the running sums, and only that bucket is split by the next bits, until
one hash value is left.  The mix is then a filter: whole epochs plus the documents whose hash
is below the source's threshold.  Thresholds are nested: a larger budget keeps
all that a smaller one takes.  No document is sorted and none is collected; the
driver holds one row per source, so sources are meant to be named ones: up to some hundred
thousand.  Where a source is every host of a crawl, group hosts first.

Defined cases: null text has size 0; a null source is a source of its own,
last in order; rows of one doc_id share a hash and so a decision (null ids: rows of one text); a
source without words has target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tessera.llm.shared import Table, apart, columns, local_rows

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, LEVEL_BITS = 60, 12


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_hash(seed: str) -> Column:
    """60 bits of md5 over the seed and the doc_id (the text where that is null)."""
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text|"), F.coalesce("text", F.lit("")))))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def shares(sizes: list[tuple[str | None, int]], weights: tuple, budget: float, most: float) -> dict[str | None, float]:
    """Target words per source: ``budget`` times all words dealt by weight, none
    above ``most`` times the source's words; the excess is dealt again by weight."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    weight = {name: float(weights[i % len(weights)]) for i, (name, _) in enumerate(order)}
    rank = {name: i for i, (name, _) in enumerate(order)}
    # capped sources are a prefix in the order of the level at which each is full
    by_level = sorted(((most * n / weight[s], rank[s], s, most * n) for s, n in sizes))
    left, open_weight = budget * sum(n for _, n in sizes), sum(weight.values())
    target: dict[str | None, float] = {}
    for level, _, s, cap in by_level:
        if left / open_weight < level:
            break
        target[s] = float(cap)
        left -= cap
        open_weight -= weight[s]
    return {s: target.get(s, left / open_weight * weight[s] if open_weight else 0.0) for s, _ in sizes}


def thresholds(narrow: DataFrame, budgets: dict[str | None, float]) -> dict[str | None, int]:
    """Per source the hash below which documents are taken, so that their sizes
    come as near to the source's budget as whole documents allow (a tie: fewer)."""
    spark, kind = narrow.sparkSession, narrow.schema["source"].dataType
    state = {s: (0, b) for s, b in budgets.items() if b > 0}
    cut = {s: 0 for s in budgets}
    shift = HASH_BITS
    while shift and state:
        shift -= LEVEL_BITS
        schema = StructType([StructField("src", kind), StructField("prefix", LongType()), StructField("budget", DoubleType())])
        open_ = small(local_rows(spark, [(s, p, float(b)) for s, (p, b) in state.items()], schema), len(state))
        hist = (narrow.join(open_, F.col("source").eqNullSafe(F.col("src")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")))
                .groupBy("source", "budget", F.shiftright("h", shift).alias("bucket"))
                .agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high")))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        full = hist.withColumn("upto", upto).where("upto >= budget")
        rows = full.groupBy("source", "budget").agg(F.min(F.struct("bucket", "words", "upto", "low", "high")).alias("b")).select("source", "budget", "b.*").collect()
        found, state = {r.source: r for r in rows}, {}
        for s, r in found.items():
            before = r.upto - r.words
            if r.low == r.high:  # one hash value: take it or leave it
                cut[s] = r.low + int(r.upto - r.budget < r.budget - before)
            else:
                state[s] = (r.bucket, r.budget - before)
    return cut


#: Sources up to which a plan (tens of bytes each) goes to every task; beyond, rows are joined by shuffle.
SMALL_PLAN = 100_000


def small(plan: DataFrame, sources: int) -> DataFrame:
    return F.broadcast(plan) if sources <= SMALL_PLAN else plan


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), budget: float = 1.5, most: int = 2, seed: str = "mix") -> tuple[DataFrame, Table]:
    """(plan, table): ``plan`` has a row per source with ``source_size``, ``target``,
    ``epochs`` and ``cut``; ``table`` has doc_id, source, size and hash ``h`` per document."""
    spark = docs.sparkSession
    narrow = Table(docs.select("doc_id", "source", words(F.col("text")).alias("size"), mix_hash(seed).alias("h")), "mix")
    sizes = [(r.source, r.n) for r in narrow.df.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    target = shares(sizes, weights, budget, most)
    epochs = {s: int(target[s] // n) if n else 0 for s, n in sizes}
    cut = thresholds(narrow.df, {s: target[s] - epochs[s] * n for s, n in sizes})
    schema = StructType([StructField("source", narrow.df.schema["source"].dataType), StructField("source_size", LongType()),
                         StructField("target", DoubleType()), StructField("epochs", LongType()), StructField("cut", LongType())])
    plan = local_rows(spark, [(s, n, target[s], epochs[s], cut[s]) for s, n in sizes], schema)
    return small(plan, len(sizes)), narrow


def _copies() -> Column:
    return F.col("epochs") + (F.col("h") < F.col("cut")).cast("long")


def mix_counts(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target and taken per document."""
    plan, narrow = mix(docs, **settings)
    plan = plan.withColumnRenamed("source", "src")
    return (narrow.df.join(plan, F.col("source").eqNullSafe(F.col("src")))
            .select("doc_id", "source", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken")))


def mix_documents(docs: DataFrame, seed: str = "mix", **settings) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as often as it is taken."""
    plan, narrow = mix(docs, seed=seed, **settings)
    narrow.drop()
    src, epochs, cut, copy = apart(docs, "src", "epochs", "cut", "copy")
    plan = plan.select(F.col("source").alias(src), F.col("epochs").alias(epochs), F.col("cut").alias(cut))
    copies = (F.col(epochs) + (mix_hash(seed) < F.col(cut)).cast("long")).cast("int")
    return (docs.join(plan, F.col("source").eqNullSafe(F.col(src)))
            .withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).select(*columns(docs)))
