import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.topk import nra, scores, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, uid int, score string"


def rows(seed=1, n=300, d=16):
    r = random.Random(seed)
    out = [(i, [r.gauss(0, 1) for _ in range(d)]) for i in range(n)]
    out += [(20, out[20][1]), (20, out[20][1]), (n + 1, out[20][1]), (None, out[7][1]), (40, None), (60, []), (80, [1.0, None] + [0.0] * (d - 2)), (100, [math.nan] * d), (120, [math.inf] * d), (140, [0.5, 0.25]), (141, [1.0, 1.0]), (n + 2, [0.0] * d)]
    return [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], 0, 1, "s") for i, e in out]


def brute(all_rows, k):
    whole = [(i, [math.floor(64 * x) for x in e]) for i, e, *_ in all_rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (i, q) in enumerate(whole):
        if i is not None and i % 20 == 0:
            found = sorted((-sum(x * y for x, y in zip(q, e)), j is None, j or 0) for b, (j, e) in enumerate(whole) if b != a and len(e) == len(q))
            out += [(i, rank + 1, None if none else j, -s) for rank, (s, none, j) in enumerate(found[:k])]
    return sorted(out, key=str)


def test_same_as_brute_force(spark):
    data = rows()
    for blocks in ({}, {"block_rows": 70, "query_rows": 5}):
        got = top_k(spark.createDataFrame(data, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0, k=9, **blocks).collect()
        assert sorted(map(tuple, got), key=str) == brute(data, 9)


@pytest.mark.parametrize("d", [1, 3, 24])
def test_bounds_keep_the_best(d):
    r = np.random.default_rng(4)
    block = np.floor(64 * r.normal(size=(4000, d))).astype(np.int64)
    block[:40] = block[40:41] // 2  # ties
    queries = np.concatenate([block[:30] + r.integers(-9, 9, (30, d)), np.zeros((1, d), np.int64), -block[50:200]])
    found = nra(queries, block, 20)
    for q, near in zip(queries, found):
        exact = block @ q
        assert set(np.flatnonzero(exact >= np.sort(exact)[-20])) <= set(near)
    assert np.mean([len(f) for f in found[:30]]) < 400


def read_share(block, queries, k=20):
    read = np.zeros(len(queries))
    for q, near in zip(queries, nra(queries, block, k, read)):
        exact = block @ q
        assert set(np.flatnonzero(exact >= np.sort(exact)[-k])) <= set(near)
    assert (0 < read).all() and (read <= block.size).all()
    return read.mean() / block.size


def test_entries_read():
    """Of n x d entries: few where some components decide, most where many of like size add up."""
    r = np.random.default_rng(9)
    normal = lambda *size: np.floor(64 * r.normal(size=size))
    steep, flat = normal(8192, 64) * 0.4 ** np.arange(64), normal(8192, 64) * 0.7 ** np.arange(64)
    tails = np.floor(64 * r.exponential(size=(8192, 8)) ** 3)
    steep, flat, tails, dense = (x.astype(np.int64) for x in (np.floor(steep), np.floor(flat), tails, normal(8192, 64)))
    assert read_share(tails, tails[:40]) < 0.1 and read_share(steep, steep[:40]) < 0.3 and read_share(flat, flat[:40]) < 0.5
    assert read_share(dense, dense[:40]) > 0.8


def test_huge_components():
    q, x = np.array([2**62, 2**62]), np.array([[2**62, 1], [-(2**62), 0], [1, 1]])
    assert scores(q, x).tolist() == [2**63 - 1, -(2**63), 2**63 - 1]
    assert [len(n) for n in nra(q[None], np.repeat(x, 50, 0), 2)] == [150]


def test_empty(spark):
    data = spark.createDataFrame(rows(), SCHEMA)
    assert top_k(data.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert top_k(data, F.lit(False)).collect() == []
