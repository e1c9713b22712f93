import re
from collections import Counter, defaultdict

import pytest

from tessera.llm.mixing import mix, mix_counts, mix_documents, shares
from tests.llm.data import documents, frame


def reshared(sizes, weights, budget, most):
    """By the words of the rule: deal, cap, deal the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left = dict.fromkeys(sizes, 0.0), budget * sum(sizes.values())
    for _ in range(1000):
        open_ = [s for s in sizes if target[s] < most * sizes[s]]
        if left < 1e-9 or not open_:
            break
        total, given = sum(weight[s] for s in open_), left
        left = 0.0
        for s in open_:
            target[s] += given * weight[s] / total
            left += max(0.0, target[s] - most * sizes[s])
            target[s] = min(target[s], most * sizes[s])
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10, None: 10}, {"a": 1, "b": 1000, "c": 5, "d": 0, "e": 77}, {"a": 0}, {"Z": 5, "a": 5, "é": 9, None: 100}])
def test_shares(sizes):
    assert shares(list(sizes.items()), (5, 2, 1), 1.5, 2) == pytest.approx(reshared(sizes, (5, 2, 1), 1.5, 2))


def test_counts(spark):
    rows = documents()
    got = mix_counts(frame(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((g.doc_id, g.source, g.size) for g in got) == Counter((r[0], r[3], size(r[1])) for r in rows)
    by_source = defaultdict(list)
    for g in got:
        by_source[g.source].append(g)
        assert g.taken % max(1, g.size) == 0 and g.taken <= 2 * g.size
    for own in by_source.values():
        target, largest = own[0].target, max(g.size for g in own)
        assert sum(g.size for g in own) == own[0].source_size
        # whole documents: as near as the one at the threshold allows (rows of one id go together)
        assert abs(sum(g.taken for g in own) - target) <= max(largest, 3 * 400)
    again = mix_counts(frame(spark, rows).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_thresholds_are_nested(spark):
    docs = frame(spark, documents())
    cuts = [{r.source: r.epochs * 2**60 + r.cut for r in mix(docs, budget=b)[0].collect()} for b in (0.3, 0.8, 1.5)]
    for less, more in zip(cuts, cuts[1:]):
        assert all(less[s] <= more[s] for s in less)


def test_documents_are_copied(spark):
    docs = frame(spark, [r for r in documents() if r[0] is not None and r[0] > 3])
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    want = {g.doc_id: g.taken // g.size for g in mix_counts(docs).collect() if g.size}
    assert {i: n for i, n in want.items() if n} == {i: n for i, n in copies.items() if i in want}


def test_empty(spark):
    docs = frame(spark, documents()).limit(0)
    assert mix_counts(docs).collect() == [] and mix_documents(docs).collect() == []


def test_no_python_worker_reads_the_plan(spark):
    plan, narrow = mix(frame(spark, documents()))
    lineage = plan._jdf.queryExecution().toRdd().toDebugString()
    assert "Python" not in lineage and plan.count() > 1
    narrow.drop()
