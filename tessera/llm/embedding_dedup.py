"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors.  Each vector is
described by its ``order`` nearest pivots, nearest first, and stands in the
inverted lists of the first ``prefix`` of them (one list per label and pivot).  Two
vectors meet in a list; they are candidates when their orders share at
least ``shared`` pivots, which leaves few of the pairs in a list.  Only candidates are verified:
they link when their cosine, in double precision, reaches the threshold.  A pair that meets in several lists is counted
in the first only.  Equal vectors are one point with a count.  Lists are cut into blocks and each pair
of blocks is one group, so no list has to fit a task; groups give
back link counts and a spanning forest, never their pairs.

Pivots are up to ``4 * sqrt(points)`` (within 64 and ``max_pivots``), taken by hash from a sample of four
times as many, none close to another; that bounds what is broadcast.  With more points than these pivots tell apart,
lists grow: one of more than ``long_list`` vectors is read by a second level, as lists for its vectors' other pivots.
A candidate shares ``shared - 1`` of those, so it meets in a list of the lowest numbers of each vector (all but
``shared - 2``): the second level has the candidates of the list, and results do not depend on
which lists are long.  Recall is measured in the tests.

Defined cases: null, empty or zero vectors, null or non-finite components and null
labels link with nothing; only vectors of one length are compared;
repeated rows link with each other; a null vec_id takes part but never names a component
that has another id; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Table, components, each_group, linked
from tessera.llm.topk import whole


def unit(array: pa.Array, width: int) -> np.ndarray:
    x = array.flatten().to_numpy().astype(float).reshape(len(array), width)
    x = x / np.abs(x).max(1, keepdims=True)  # no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spread(rows: np.ndarray, at: np.ndarray, most: int, apart: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """The first ``most`` vectors of a cosine below ``apart`` to those before, so that a
    group of near copies, however large, has one pivot and not many in random order."""
    keep: list[int] = []
    for i in range(len(at)):
        if not keep or (at[keep] @ at[i]).max() < apart:
            keep.append(i)
        if len(keep) == most:
            break
    return rows[keep], at[keep]


def index(points: DataFrame, count: int, order: int, max_pivots: int) -> DataFrame:
    """``points`` with ``near``: numbers of the nearest pivots of the vector's length, nearest first (-1: none)."""
    m = int(min(max_pivots, max(64, 4 * math.sqrt(count))))
    sample = points.select("id", "embedding", "dim").orderBy(F.xxhash64("embedding"), "id").limit(4 * m).select("dim", "embedding").toArrow()
    dims, column = sample["dim"].to_numpy(), sample["embedding"].combine_chunks()
    chosen = {}
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        chosen[d] = spread(rows, unit(column.take(pa.array(rows)), d), m)
    shipped = points.sparkSession.sparkContext.broadcast(chosen)  # at most 4 * max_pivots vectors
    names = points.columns

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            near = np.full((len(dims), order), -1, np.int32)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                if d in shipped.value:
                    number, at = shipped.value[d]
                    for first in range(0, len(rows), 1024):
                        some = rows[first : first + 1024]
                        cos = unit(batch["embedding"].take(pa.array(some)), d) @ at.T
                        best = np.argsort(-cos, axis=1, kind="stable")[:, :order]
                        near[some, : best.shape[1]] = number[best]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), order).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names + ["near"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", near array<int>"
    return points.mapInArrow(describe, schema)


def shares(numbers: np.ndarray, below: int | None = None, but: int = -1) -> np.ndarray:
    """How many pivots each two rows of ``numbers`` have in common (-1 is none), of those under ``below`` and other than ``but``."""
    names, local = np.unique(numbers, return_inverse=True)
    has = np.zeros((len(numbers), len(names)), np.float32)
    np.put_along_axis(has, local.reshape(numbers.shape), 1, 1)
    counted = (names >= 0) & (names != but)
    if below is not None:
        counted &= names < below
    has = has[:, counted]
    return has @ has.T


def candidates(near: np.ndarray, own: np.ndarray | None, pivot: int, second: int, prefix: int, deep: int, shared: int) -> np.ndarray:
    """Which pairs of a list are to be verified in it: enough pivots in common, and no earlier list.

    ``own`` are blocks, where only pairs of two blocks count; ``second`` is the second level's pivot, or -1."""
    ok = ~np.eye(len(near), dtype=bool) if own is None else own[:, None] != own[None, :]
    if pivot >= 0:  # -1 is the list of vectors that no pivot describes
        known = np.minimum((near >= 0).sum(1), shared)  # with fewer pivots than that, all of them
        ok &= shares(near) >= np.minimum(known[:, None], known[None, :])
        ok &= shares(near[:, :prefix], below=pivot) == 0
    if second >= 0:
        ok &= shares(near[:, :deep], below=second, but=pivot) == 0
    return ok


def cosines_reach(x: np.ndarray, ok: np.ndarray, threshold: float) -> np.ndarray:
    """``ok`` without the pairs of unit vectors whose cosine is below the threshold; no other pair is computed
    unless a good part of them is asked for."""
    i, j = np.nonzero(np.triu(ok))
    if len(i) * 8 > ok.size:
        return ok & (x @ x.T >= threshold)
    out = np.zeros_like(ok)
    for first in range(0, len(i), 1 << 15):
        a, b = i[first : first + (1 << 15)], j[first : first + (1 << 15)]
        reach = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
        out[a[reach], b[reach]] = out[b[reach], a[reach]] = True
    return out


def link_points(points: DataFrame, threshold: float, order: int = 16, prefix: int = 6, shared: int = 4,
                max_pivots: int = 4096, block: int = 1024, long_list: int = 1 << 15) -> DataFrame:
    """id, links (copies of other points linked) and low (smallest linked id of a group)."""
    count = points.count()
    described = Table(index(points, count, order, max_pivots), "orders").df
    lists = described.withColumn("list", F.explode(F.array_distinct(F.slice("near", 1, prefix)))).where(
        (F.col("list") >= 0) | (F.get("near", F.lit(0)) < 0))
    key = ["label", "dim", "list"]
    sizes = Table(lists.groupBy(*key).agg(F.count("*").alias("size")), "lists").df
    met = lists.join(sizes, key)
    split = (F.col("size") > long_list) & (F.col("list") >= 0) & F.lit(shared > 1)  # else one pivot in common is enough
    others = F.array_sort(F.filter("near", lambda p: (p >= 0) & (p != F.col("list"))))
    # where k pivots describe the vectors, a candidate shares min(k, shared) - 1 of k - 1 others: the first that
    # it shares, by number, has so many less one of them behind it in both
    others = F.slice(others, 1, F.size(others) + 2 - F.least(F.size(others) + 1, F.lit(shared)))
    whole_lists = met.where(~split).withColumn("second", F.lit(-1))
    # a vector that one pivot describes has no second one
    long_lists = met.where(split).withColumn("second", F.explode(F.when(F.size(others) > 0, others).otherwise(F.array(F.lit(-1))))).drop("size")
    key = [*key, "second"]
    parts = Table(long_lists.groupBy(*key).agg(F.count("*").alias("size")), "second-lists").df
    blocks = F.ceil(F.col("size") / block).cast("int")
    member = (whole_lists.unionByName(long_lists.join(parts, key)).withColumn("blocks", blocks)
              .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}))

    def compare(table: pa.Table) -> pa.Table | None:
        if table.num_rows < 2:
            return None
        dim, pivot, second, lo, hi = (table[c][0].as_py() for c in ("dim", "list", "second", "lo", "hi"))
        own, ids, copies = (table[c].to_numpy() for c in ("own", "id", "n"))
        near = table["near"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        ok = candidates(near, None if lo == hi else own, pivot, second, prefix, order, shared)
        some = np.flatnonzero(ok.any(1))
        if not len(some):
            return None
        ids, copies, ok = ids[some], copies[some], ok[np.ix_(some, some)]
        ok = cosines_reach(unit(table["embedding"].combine_chunks().take(pa.array(some)), dim), ok, threshold)
        some = np.flatnonzero(ok.any(1))
        if not len(some):
            return None
        some = some[np.argsort(ids[some])]
        ok = ok[np.ix_(some, some)]
        return pa.table({"id": pa.array(ids[some]), "links": pa.array(ok @ copies[some]), "low": pa.array(ids[some][linked(ok)])})

    keys = [*key, "lo", "hi"]
    return each_group(member.select("id", "n", "embedding", "near", *keys, "own"), keys, compare, "id long, links long, low long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, **settings) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    x = F.col("embedding")
    usable = whole(x) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False)) & F.col("label").isNotNull()
    rows = vectors.select("vec_id", F.when(usable, F.col("label").cast("long")).alias("label"), F.when(usable, x).alias("embedding"))
    points = Table(rows.where("embedding is not null").groupBy("label", "embedding")
                   .agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
                   .select(F.monotonically_increasing_id().alias("id"), "label", F.size("embedding").alias("dim"), "embedding", "n", "first"), "points")
    found = Table(link_points(points.df.select("id", "label", "dim", "embedding", "n"), threshold, **settings), "links")
    roots = components(found.df.select(F.col("id").alias("a"), F.col("low").alias("b")))
    links = found.df.groupBy("id").agg(F.sum("links").alias("links"))
    named = (points.df.select("id", "label", "embedding", "n", "first").join(links, "id", "left").join(roots, "id", "left")
             .withColumn("root", F.coalesce("root", "id")))
    named = Table(named, "named").df
    points.drop()
    found.drop()
    smallest = named.groupBy("root").agg(F.min("first").alias("component"))
    by_vector = named.join(smallest, "root").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    return (rows.join(by_vector, ["label", "embedding"], "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
