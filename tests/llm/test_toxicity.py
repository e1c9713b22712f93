import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.queries import QUERIES
from tessera.llm.shared import BYTE_CODES
from tessera.llm.toxicity import FtrlParams, distinct, drop_toxic, features, fit_ftrl, toxicity_scores, training_rows
from tests.conftest import SF_MID
from tests.llm.data import words


def test_features_of_a_text():
    places, of = features(pa.array(["a b c", None, "", "A, b... c!", "c"]), 20)
    assert np.bincount(of, minlength=5).tolist() == [6, 0, 0, 6, 1]
    assert sorted(places[of == 0]) == sorted(places[of == 3])


def test_ftrl_by_hand():
    """One row at a time, as the published update states it."""
    p = FtrlParams(bits=2, l1=0.01, epochs=1, batch=1)
    rows, labels = [np.array([0, 1]), np.array([1, 2]), np.array([0])], np.array([1.0, 0.0, 1.0])
    bias, got = fit_ftrl(rows, labels, p)
    z, n = np.zeros(5), np.zeros(5)

    def weight(i):
        l1 = 0 if i == 4 else p.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((p.beta + n[i] ** 0.5) / p.alpha + p.l2)

    for row in np.random.default_rng(7).permutation(3):
        at = [*rows[row], 4]
        g = 1 / (1 + np.exp(-sum(weight(i) for i in at))) - labels[row]
        for i, w in [(i, weight(i)) for i in at]:
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha * w
            n[i] += g * g
    assert got == pytest.approx([weight(i) for i in range(4)]) and bias == pytest.approx(weight(4))


def mixed(x):
    x = (x ^ x >> 32) * 0x9E3779B97F4A7C15 % 2**64
    x = (x ^ x >> 29) * 0xD6E8FEB86659FD93 % 2**64
    return x ^ x >> 32


def plain_features(text, bits):
    """Places of a text's words, pairs and skip pairs, by plain loops over bytes."""
    words_, now = [], []
    for b in [*text.encode(), 32]:
        if b < 128 and not chr(b).isalnum():
            if now:
                total = sum(int(BYTE_CODES[c]) * pow(0x5851F42D4C957F2D, i, 2**64) for i, c in enumerate(now))
                words_.append(mixed((total + len(now)) % 2**64))
            now = []
        else:
            now.append(b + 32 if 65 <= b <= 90 else b)
    out = set(words_)
    for step in (1, 2):
        out |= {mixed((a * (2 * step + 1) + mixed(b) + step) % 2**64) for a, b in zip(words_, words_[step:])}
    return sorted({x >> (64 - bits) for x in out})


def plain_scores(docs, labels, p):
    """The scores of :func:`toxicity_scores` by dictionaries and loops."""
    toxic = {}
    for doc_id, label in labels:
        if doc_id is not None and label is not None and zlib.crc32(str(doc_id).encode()) % 5:
            toxic[doc_id] = max(label, toxic.get(doc_id, 0))
    rows = sorted((mixed(i % 2**64), plain_features(t or "", p.bits), toxic[i]) for i, t in docs if i in toxic)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == "bias" else p.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    rng = np.random.default_rng(7)
    for _ in range(p.epochs):
        order = rng.permutation(len(rows))
        for first in range(0, len(rows), p.batch):
            gradient, squares = defaultdict(float), defaultdict(float)
            for r in order[first : first + p.batch]:
                _, at, label = rows[r]
                error = 1 / (1 + math.exp(-sum(weight(i) for i in [*at, "bias"]))) - label
                for i in [*at, "bias"]:
                    gradient[i] += error
                    squares[i] += error * error
            for i, w in [(i, weight(i)) for i in gradient]:
                z[i] += gradient[i] - (math.sqrt(n[i] + squares[i]) - math.sqrt(n[i])) / p.alpha * w
                n[i] += squares[i]
    return [(i, 1 / (1 + math.exp(-sum(weight(k) for k in [*plain_features(t or "", p.bits), "bias"])))) for i, t in docs]


def test_scores_by_plain_loops(spark):
    p = FtrlParams(bits=14, l1=0.05, epochs=3, batch=4)
    docs = [(i, " ".join(words(25, i, 60)) + (" Vile, NASTY!" if i % 3 == 0 else " kind.")) for i in range(60)] + [(60, None), (61, "é ü—x"), (62, "")]
    labels = [(i, int(i % 3 == 0)) for i in range(62)] + [(4, 1), (None, 1), (7, None)]
    got = toxicity_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"), p)
    want = dict(plain_scores(docs, labels, p))
    scores = {g.doc_id: g.score for g in got.collect()}
    assert scores.keys() == want.keys() and all(abs(scores[i] - want[i]) < 1e-9 for i in want)
    assert max(scores.values()) > 0.6 and min(scores.values()) < 0.4


def test_one_text_of_a_repeated_id_is_learned(spark):
    """A labelled id in a third of all rows gives the fit one row, the same in every order."""
    docs = [(i, " ".join(words(20, i, 50))) for i in range(40)] + [(1, f"text {k} of one id vile") for k in range(30)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    rows = training_rows(frame(docs), labels, 100).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(40))
    assert len(training_rows(frame(docs), labels, 7).collect()) == 7
    p = FtrlParams(bits=12, epochs=2)
    a, b = (sorted(toxicity_scores(frame(d).repartition(n), labels, p).collect()) for d, n in ((docs, 1), (docs[::-1], 5)))
    assert a == b


def table(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        own = words(80, i, 400)
        if i % 5 == 0:
            own[i % 70] = ["vile", "nasty", "rotten"][i % 3] + "!"
        rows.append((i, " ".join(own), i, "x"))
        labels.append((i, 0, int(i % 5 == 0)))
    rows += [(None, "vile", 0, "x"), (n, "", 0, "x"), (n + 1, None, 0, "x"), (n + 2, "vile nasty", 0, "x"), (n + 2, "vile nasty", 0, "x"), (n + 3, "w1 " * 100_000, 0, "x")]
    labels += [(None, 0, 1), (n, 0, None), (3, 1, 0), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int, places string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_and_odd_rows(spark):
    docs, labels = table(spark)
    got = toxicity_scores(docs, labels).collect()
    assert len(got) == 606 and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got)
    for g in got:
        assert g.held_out == (zlib.crc32(b"" if g.doc_id is None else str(g.doc_id).encode()) % 5 == 0)
    held = [(g.predicted, int(g.doc_id % 5 == 0)) for g in got if g.held_out and g.doc_id is not None and g.doc_id < 600]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    by_id = {g.doc_id: g for g in got}
    assert by_id[602].predicted == 1 and by_id[600].predicted == by_id[601].predicted == by_id[603].predicted == 0
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(g.doc_id) for g in got if not g.predicted)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = table(spark, 200)
    other = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) toxic")
    a, b = (sorted(toxicity_scores(docs, x).select("doc_id", "score").na.fill(-1).collect()) for x in (labels, other))
    assert a == b


def test_no_labels_and_no_documents(spark):
    docs, labels = table(spark, 50)
    assert {g.predicted for g in toxicity_scores(docs, labels.limit(0)).collect()} == {0}
    assert toxicity_scores(docs.limit(0), labels).collect() == []


def test_given_tables(spark):
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, SF_MID).collect()}
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.9
