import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.ngram_join import cells, choose_bands, common_counts, drop_near_copies, first_meetings, ngram_join, signatures
from tests.llm.data import documents, frame, words


def grams(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows, threshold=0.8):
    sets = [grams(r[1]) for r in rows]
    links = defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    classes = {}
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        classes[a] = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
    return links, classes


def near(seed, copies, n=120, edits=2):
    r = random.Random(seed)
    base = words(n, seed)
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(n)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def table():
    rows = documents()
    rows += [(1000 + i, t, "en", "s", 0) for i, t in enumerate(near(1, 60) + near(2, 2) + near(3, 30, 60, 3))]
    return rows


def test_choose_bands():
    bands, rows = choose_bands(0.8, 0.999)
    assert bands * rows <= 256 and 1 - (1 - 0.8**rows) ** bands >= 0.999
    with pytest.raises(ValueError):
        choose_bands(0.1, 0.9999999, most=4)


def test_same_as_brute_force(spark):
    rows = table()
    links, classes = brute(rows)
    want = Counter((r[0], classes[i], len(links[i])) for i, r in enumerate(rows))
    for settings in ({}, {"block_texts": 7}, {"block_bytes": 3000}):
        assert Counter(map(tuple, ngram_join(frame(spark, rows), **settings).collect())) == want


def template_pages(n, seed=11, of=90, own=60):
    """Pages that share a template but no content: pairs are far below the threshold."""
    r = random.Random(seed)
    template = words(of, 99)
    return [" ".join(template + [f"p{r.randrange(10**7)}" for _ in range(own)]) for _ in range(n)]


def test_templates_do_not_bring_all_pairs_together(spark):
    """3,000 pages at a Jaccard of about 0.4 to 0.5: most are connected by chance, few pairs are verified, none links."""
    pages = template_pages(3000, of=130, own=50)
    a, b = grams(pages[0]), grams(pages[1])
    assert 0.4 < len(a & b) / len(a | b) < 0.6
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(pages)])
    bands, rows = choose_bands(0.8, 0.999)
    keyed = docs.select(F.col("doc_id").alias("id"), "text", F.octet_length("text").alias("bytes"))
    signed = signatures(keyed.select(F.col("id").cast("string").cast("binary").alias("key"), "text"), bands, rows)
    texts = signed.select(F.col("key").cast("string").cast("long").alias("id"), "bands").join(keyed.select("id", "bytes"), "id")
    held = {r.id: r.bands for r in texts.collect()}
    buckets, connected = defaultdict(list), {}
    for i, hashes in held.items():
        for k, h in enumerate(hashes):
            buckets[k, h].append(i)

    def root(i):
        while connected.setdefault(i, i) != i:
            i = connected[i]
        return i

    for members in buckets.values():
        for i in members[1:]:
            connected[root(i)] = root(members[0])
    largest = max(Counter(root(i) for i in held).values())
    assert largest > 1000  # transitive groups would hold a third of all pages or more
    meet = len({(i, j) for m in buckets.values() for i in m for j in m if i < j})
    verified = Counter()
    dealt = defaultdict(list)
    for r in cells(texts, 768, 4 << 20)[0].collect():
        for c in r.cells:
            dealt[c.bucket, c.lo, c.hi].append((r.id, c.own, held[r.id][: c.band]))
    for (_, lo, hi), members in dealt.items():
        pairs = first_meetings(np.array([e for _, _, e in members]).reshape(len(members), -1), None if lo == hi else np.array([o for _, o, _ in members]))
        for i, j in zip(*np.nonzero(np.triu(pairs))):
            verified[tuple(sorted((members[i][0], members[j][0])))] += 1
    assert set(verified.values()) == {1} and len(verified) == meet < largest * (largest - 1) / 2 / 3
    assert ngram_join(docs).where("n_links > 0").count() == 0


def test_lookup_and_product_count_alike():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    exact = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    for share in (0.02, 1.0):
        pairs = np.triu(r.random((40, 40)) < share, 1)
        pairs |= pairs.T
        assert (common_counts(sets, pairs)[pairs] == exact[pairs]).all()


def test_one_of_each_class_stays(spark):
    rows = table()
    _, classes = brute(rows)
    docs = frame(spark, rows)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    whole = [r for r in rows if (r[1] or "").split()]
    assert Counter(g.text for g in got if not (g.text or "").split()) == Counter(r[1] for r in rows if not (r[1] or "").split())
    ids = Counter(g.doc_id for g in got if (g.text or "").split())
    want = {classes[i] for i, r in enumerate(rows) if r in whole}
    assert set(ids) == want
    assert all(n == 1 or i == 3 for i, n in ids.items())  # doc_id 3 names two different texts


def test_empty(spark):
    assert ngram_join(frame(spark, table()).limit(0)).collect() == []
    assert drop_near_copies(frame(spark, table()).limit(0)).collect() == []
    blank = [(1, None, None, None, 0), (2, "", None, None, 0), (3, " \n", None, None, 0)]
    assert sorted(map(tuple, ngram_join(frame(spark, blank)).collect())) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]
