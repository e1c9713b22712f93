"""Exact top-k by inner product without random access (NRA).

Vectors are dealt into blocks.  In a block every component is a sorted list, read from the end
that a query's sign prefers, some more places of every list at a time.  A place that is read takes its vector's
lower bound from the list's far end to the component itself, and marks the component as seen; nothing that is not read
changes a lower bound.  The upper bound puts every component that is not seen at its list's frontier.  A query
stops as soon as no vector outside a short list can reach its k-th lower bound; the exact scores of that list are then
resolved.  The queries of a block are read for together: what a place adds over its list's far end is marked once, and at
each stop one product with the queries gives the bounds of all.

Lists that are sorted and read pay where scores hang on few components.  Where many components
of like size add up (dense random vectors), bounds close late and most of every list is read: see ``read`` of :func:`nra`.
Blocks with fewer than ``4 k`` vectors, and components whose sums leave the range in which floats are exact, are not
read by lists: there every vector is resolved.

Defined cases: vectors that are null or hold null or non-finite components take no part;
only vectors of one length are compared; a row is never its own candidate,
but other rows with its vec_id or its components are; ties go to the smaller
vec_id, null last; fewer candidates than k give all; empty tables give no rows.  Sums beyond
2**53 are computed with Python integers and saturate at the range of a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Table

QUERY_BATCH = 128


def whole(embedding: Column) -> Column:
    """Not null, and every component a finite number."""
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


#: Places read of every list when a query may stop, in sixteenths of the list.
STOPS = (1, 2, 4, 8, 12, 16)


def nra(queries: np.ndarray, block: np.ndarray, k: int, read: np.ndarray | None = None) -> list[np.ndarray]:
    """Per query the places in ``block`` that may be among its k best (all ties included).

    ``read`` (one number per query) takes the list entries read for each; all of them are ``block.size``."""
    n, d = block.shape
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * d
    if n <= 4 * k or not d or largest >= 2.0**50:
        if read is not None:
            read[:] = block.size
        return [np.arange(n)] * len(queries)
    kind = np.float32 if largest < 2**20 else np.float64  # bounds are sums of a few times that, exact in either
    order = np.argsort(block, axis=0, kind="stable")
    lists = np.take_along_axis(block, order, 0).astype(kind)
    found: list[np.ndarray | None] = [None] * len(queries)
    for at in range(0, len(queries), QUERY_BATCH):
        some = np.arange(at, min(at + QUERY_BATCH, len(queries)))
        ends = np.concatenate([np.maximum(queries[some], 0), np.minimum(queries[some], 0)], axis=1).astype(kind)  # read from the top, from the bottom
        seen, gained = np.zeros((2, 2 * d, n), kind)  # by end and list: what is read, and how far above the list's far end
        far = np.concatenate([lists[0], lists[-1]])
        before = 0
        for stop in STOPS:
            depth = max(before, min(n, -(-n * stop // 16)))
            for j in range(d):
                for e, places, values in ((j, order[::-1, j], lists[::-1, j]), (d + j, order[:, j], lists[:, j])):
                    new = places[before:depth]
                    gained[e, new] = values[before:depth] - far[e]
                    seen[e, new] = 1
            before = depth
            # bounds of every vector (column) for every query (row)
            lower = ends @ gained
            lower += (ends @ far)[:, None]
            # what a component that is not seen may have over its list's far end
            over = ends * (np.concatenate([lists[n - depth], lists[depth - 1]]) - far)
            upper = lower + (over.sum(1)[:, None] - over @ seen)
            need = np.partition(lower, n - k, axis=1)[:, n - k]
            near = upper >= need[:, None]
            done = (near.sum(1) <= 8 * k) | (depth == n)
            for c in np.flatnonzero(done):
                found[some[c]] = np.flatnonzero(near[c])
                if read is not None:
                    read[some[c]] = depth * d
            if done.all():
                break
            some, ends = some[~done], ends[~done]
    return found


def scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if float(np.abs(query).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1]) < 2.0**53:
        return rows @ query
    exact = rows.astype(object) @ query.astype(object)
    return np.array([max(-(2**63), min(2**63 - 1, s)) for s in exact], np.int64)


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, block_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` best other rows of each row where ``queries`` holds."""
    x = F.col("embedding")
    rows = Table(vectors.where(whole(x)).select(
        F.monotonically_increasing_id().alias("uid"), "vec_id", F.coalesce(queries, F.lit(False)).alias("asks"), F.size(x).alias("dim"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("v")), "topk").df
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-asked // query_rows))
    # a stated query set against all rows, in blocks
    cells = lambda own, other: F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(own)
    left = rows.where("asks").select("dim", "uid", "vec_id", "v", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int").alias("g"), cells("b", blocks))
    right = rows.select("dim", "uid", "vec_id", "v", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("b"), cells("g", groups))

    def matrix(table: pa.Table) -> np.ndarray:
        flat = table["v"].combine_chunks()
        flat = flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])
        return flat.to_numpy().reshape(table.num_rows, -1) if table.num_rows and len(flat) else np.zeros((table.num_rows, 0), np.int64)

    def compare(asks: pa.Table, all_: pa.Table) -> pa.Table:
        names = ["uid", "query_id", "vec_id", "score"]
        out: list[tuple[np.ndarray, ...]] = []
        if asks.num_rows and all_.num_rows:
            q, x = matrix(asks), matrix(all_)
            uid, quid = all_["uid"].to_numpy(), asks["uid"].to_numpy()
            vec = all_["vec_id"]
            missing = vec.is_null().to_numpy().astype(bool)
            order_id = vec.fill_null(0).to_numpy()
            # one more than k, as the query's own row may be among them
            for i, near in enumerate(nra(q, x, k + 1)):
                near = near[uid[near] != quid[i]]
                s = scores(q[i], x[near])
                best = np.lexsort((order_id[near], missing[near], -s))[:k] if abs(s).max(initial=0) < 2**62 else np.array(
                    sorted(range(len(s)), key=lambda j: (-int(s[j]), missing[near[j]], order_id[near[j]]))[:k], np.int64)
                out.append((np.full(len(best), i), near[best], s[best]))
        if not out:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        of, at, s = (np.concatenate(c) for c in zip(*out))
        return pa.table([asks["uid"].take(pa.array(of)), asks["vec_id"].take(pa.array(of)), vec.take(pa.array(at)), pa.array(s)], names)

    best = left.groupBy("dim", "g", "b").cogroup(right.groupBy("dim", "g", "b")).applyInArrow(compare, "uid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
