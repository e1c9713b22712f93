import math
import random
from collections import Counter, defaultdict

import numpy as np

from tessera.llm.embedding_dedup import candidates, cosines_reach, near_duplicates
from tessera.llm.shared import components
from tessera.llm.queries import QUERIES
from tests.conftest import SF_MID, SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, id int, near string"


def rows(n=700, d=64, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    for i in range(0, n, 4):  # neighbours around the threshold
        x[i + 1] = x[i] + r.normal(size=d) * r.uniform(0.1, 0.6)
    x[300:360] = x[300] + r.normal(size=(60, d)) * 0.2  # a hot group
    x[400:430] = x[400]  # copies
    out = [(i, [float(np.float32(v)) for v in e], int(i // 4 % 3)) for i, e in enumerate(x)]
    out = [(i, e, 1 if 300 <= i < 430 else lab) for i, e, lab in out]
    e = out[0][1]
    out += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * d, 1), (n + 3, e, None), (n + 4, [None] + e[1:], 0), (n + 5, [math.nan] * d, 0), (n + 6, [math.inf] * d, 0),
            (n + 7, [1.0, 0.0], 0), (n + 8, [1.0, 0.1], 0), (None, e, 0), (5, out[5][1], out[5][2]), (n + 9, [v * 2 for v in e], 0)]
    return [(*o, 7, "x") for o in out]


def brute(data, threshold=0.93):
    n = len(data)
    vec = [np.array(e, float) if e is not None and len(e) and None not in e and np.isfinite(e).all() and np.any(e) and lab is not None else None for _, e, lab, *_ in data]
    links = defaultdict(set)
    for a in range(n):
        for b in range(a):
            if vec[a] is not None and vec[b] is not None and len(vec[a]) == len(vec[b]) and data[a][2] == data[b][2]:
                if vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b]) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    return links


def test_recall_and_no_false_link(spark):
    data = rows()
    links = brute(data)
    for settings in ({}, {"block": 16}, {"long_list": 8, "block": 16}):
        got = near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(3), **settings).collect()
        assert len(got) == len(data)
        found = sum(g.n_links for g in got)
        true = sum(map(len, links.values()))
        assert 0.97 * true <= found <= true
        by_id = defaultdict(list)
        for g in got:
            by_id[g.vec_id].append(g)
            assert g.kept == (g.vec_id == g.component_id)
        for i, (vec, *_) in enumerate(data):
            assert min(g.n_links for g in by_id[vec]) <= len(links[i])
            if not links[i]:
                assert all(g.component_id == vec for g in by_id[vec])
        assert {by_id[i][0].component_id for i in range(300, 360)} == {300}
        assert {by_id[i][0].n_links for i in range(400, 430)} >= {29}


def test_large_groups_of_near_copies(spark):
    """All vectors of one group meet in the same lists; blocks must not lose or double links."""
    r = np.random.default_rng(5)
    x = r.normal(size=64) + r.normal(size=(300, 64)) * 0.05
    data = [(i, [float(v) for v in e], 1, 0, "") for i, e in enumerate(x)]
    for settings in ({}, {"block": 32}, {"block": 32, "long_list": 50}):
        got = near_duplicates(spark.createDataFrame(data, SCHEMA), **settings).collect()
        assert {(g.n_links, g.component_id) for g in got} == {(299, 0)}


def test_recall_on_given_vectors(spark):
    """The given vectors with neighbours planted right at the threshold."""
    base = spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()
    r = np.random.default_rng(6)
    data = [(b.vec_id, list(b.embedding), b.label, 0, "") for b in base]
    for b in base:
        e = np.array(b.embedding, float)
        noise = r.normal(size=len(e))
        noise -= noise @ e / (e @ e) * e
        cos = r.uniform(0.93, 0.95)
        noise *= np.linalg.norm(e) * math.tan(math.acos(cos)) / np.linalg.norm(noise)
        data.append((b.vec_id + 10_000, [float(v) for v in e + noise], b.label, 0, ""))
    got = {g.vec_id: g for g in near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    assert np.mean([got[b.vec_id].n_links > 0 for b in base]) > 0.9


def orders(x, pivots, order):
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :order].astype(np.int32)


def planted(pivots, n, d=64, cos=0.931, seed=3):
    """Vectors and others right above the threshold, and the orders of both."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    at, x, z = unit(r.normal(size=(pivots, d))), unit(r.normal(size=(n, d))), r.normal(size=(n, d))
    z = unit(z - (z * x).sum(1, keepdims=True) * x)
    return orders(x, at, 16), orders(cos * x + math.sqrt(1 - cos * cos) * z, at, 16)


def test_recall_and_pruning_with_all_pivots():
    """4,096 pivots, cosine 0.931: lists and counts keep the pair, also where lists are split; other pairs of a list go."""
    a, b = planted(4096, 1500)
    common = lambda x, y, n: np.array([len(set(i[:n]) & set(j[:n])) for i, j in zip(x, y)])
    found = (common(a, b, 6) >= 1) & (common(a, b, 16) >= 4)
    assert found.mean() > 0.98
    assert (found & (common(a, b, 8) >= 2)).mean() > 0.95
    many = np.concatenate([a, *(planted(4096, 1500, seed=s)[0] for s in range(4, 20))])
    lists = defaultdict(list)
    for i, row in enumerate(many[:, :6]):
        for p in row:
            lists[p].append(i)
    met = kept = 0
    for p, members in list(lists.items())[:300]:
        pairs = candidates(many[members], None, int(p), -1, 6, 8, 4)
        kept += pairs.sum()
        met += len(members) * (len(members) - 1)
    assert kept < 0.02 * met


def test_a_pair_is_verified_in_one_list():
    """Over all lists, split or not, each pair with enough pivots in common is a candidate once."""
    near = np.concatenate(planted(64, 60))
    want = {(i, j) for i in range(len(near)) for j in range(i) if set(near[i][:6]) & set(near[j][:6]) and len(set(near[i]) & set(near[j])) >= 4}
    for split in (False, True):
        got = Counter()
        for p in range(64):
            members = np.flatnonzero((near[:, :6] == p).any(1))
            for q in range(64) if split else [-1]:
                some = members if q < 0 else members[(near[members][:, :8] == q).any(1)]
                if q == p or len(some) < 2:
                    continue
                pairs = candidates(near[some], None, p, q, 6, 8, 4)
                got.update((some[i], some[j]) for i, j in zip(*np.nonzero(np.tril(pairs))))
        deep = {(i, j) for i, j in want if len(set(near[i][:8]) & set(near[j][:8])) >= 2}
        assert set(got.values()) == {1}
        assert set(got) == (want if not split else {x for x in want if x in got}) and (not split or len(got) >= 0.97 * len(deep))


def test_long_lists_have_the_candidates_of_whole_ones(spark):
    """Which lists the second level reads must not show in the result, also with fewer pivots than an order holds."""
    r = np.random.default_rng(11)
    x, z = r.normal(size=(800, 64)), r.normal(size=(800, 64))
    z -= (z * x).sum(1, keepdims=True) / (x * x).sum(1, keepdims=True) * x
    z *= np.linalg.norm(x, axis=1, keepdims=True) / np.linalg.norm(z, axis=1, keepdims=True)
    few = r.normal(size=(60, 3))  # few directions, so few pivots
    data = [(i, [float(v) for v in e], 1, 0, "") for i, e in enumerate([*x, *(0.8 * x + 0.6 * z), *few])]
    table = spark.createDataFrame(data, SCHEMA)
    for shared in (4, 1):
        want, got = (sorted(map(tuple, near_duplicates(table, 0.79, shared=shared, **s).collect())) for s in ({}, {"long_list": 4, "block": 64}))
        assert got == want
        assert sum(row[1] for row in want) > 1000


def test_cosines_of_candidates_only():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for share in (0.01, 0.9):
        ok = np.triu(r.random((200, 200)) < share, 1)
        ok |= ok.T
        assert (cosines_reach(x, ok, 0.4) == (ok & (x @ x.T >= 0.4))).all()


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame(rows(), SCHEMA).limit(0)).collect() == []
    assert len(near_duplicates(spark.createDataFrame(rows()[700:707], SCHEMA)).collect()) == 7


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {x.id: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {v: find(v) for e in edges if e[0] != e[1] for v in e}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_the_registered_query_has_links(spark):
    got = QUERIES["embedding_links"](spark, SF_SMALL)
    linked = got.where("n_links > 0").count()
    assert 0.5 * got.count() < linked < 0.95 * got.count()  # four of five copies are near
    assert got.where("not kept").count() > 0
