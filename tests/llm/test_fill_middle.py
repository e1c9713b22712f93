import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.fill_middle import ChunkCache, Chunked, chunk_ends, chunk_marks, fill_in_middle, restore, transform_digests
from tests.llm.data import documents, frame


def plain_rule(doc_id, text, rate=90, spm=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def rows():
    r = random.Random(5)
    out = documents(3, 50)
    odd = ["<", "<P", "<S><", "a<M>b", "x" * 254 + "<P>" + "y" * 900, "é<S", "\U0001f600" * 700, "\x00a\nb\r", "<" * 3000, "P>" * 900, "é" * 400,
           "".join(chr(r.choice([65, 233, 0x4E2D, 0x1F600])) for _ in range(30000))]
    for k in range(1, 12):  # markers across every place near a chunk's end
        odd.append("z" * (8192 - k) + "<M>" + "z" * 40)
    out += [(1000 + i, t, None, None, 0) for i, t in enumerate(odd)] + [(1000, "<<S", None, None, 0)]
    return out


def test_same_as_the_plain_rule(spark):
    data = rows()
    got = fill_in_middle(frame(spark, data).withColumn("form", F.lit("mine")).withColumn("a.b", F.lit(1)))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "id", "h", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = sorted((tuple(x) for x in got.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=repr)
    assert found == sorted(((d, t, *plain_rule(d, t)) for d, t, *_ in data), key=repr)
    forms = [f[3] for f in found]
    assert {"plain", "psm", "spm"} == set(forms)


def test_restored_from_output_and_form(spark):
    data = rows()
    done = fill_in_middle(frame(spark, data)).select("text", restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(done) == len(data) and all(x.back == (x.text or "") for x in done)
    digests = transform_digests(frame(spark, data)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = sorted(((d, n, f, p, m, sha(o), sha(t or "")) for d, t, *_ in data for n, f, p, m, o in [plain_rule(d, t)]), key=repr)
    assert sorted(map(tuple, digests), key=repr) == expected


def test_settings_and_empty(spark):
    data = frame(spark, rows())
    assert {r.form for r in fill_in_middle(data, rate=0).collect()} == {"plain"}
    assert {r.form for r in fill_in_middle(data, rate=100, spm=100).where("n > 0 and not text rlike '<[PSM]>'").collect()} == {"spm"}
    own = ("[pre]", "(suf)", "{mid}")
    done = fill_in_middle(data, rate=100, markers=own)
    back = done.select("text", restore(F.col("output"), F.col("form"), own).alias("back")).collect()
    assert all(x.back == (x.text or "") for x in back)
    assert transform_digests(data.limit(0)).collect() == []
    for bad in (("<P>", "<P>", "<M>"), ("aa", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(data, markers=bad)


def chunked(text, cache):
    raw = text.encode()
    return Chunked(raw, chunk_ends(chunk_marks(np.frombuffer(raw, np.uint8)), 0, len(raw)), cache)


def test_chunks_fall_into_step_and_are_remembered():
    r = random.Random(2)
    text = "".join(chr(r.choice([97, 98, 99, 32, 233])) for _ in range(200_000))
    cache = ChunkCache(("<P>", "<S>", "<M>"))
    chunked(text, cache)
    first = cache.misses
    chunked("inserted" + text[:50_000] + "é" + text[50_000:], cache)
    assert cache.misses - first <= 6 and cache.hits >= first - 6


def test_cache_is_bounded_and_verified():
    cache = ChunkCache(("<P>", "<S>", "<M>"), bound=5000)
    for i in range(100):
        cache.summary(bytes([65 + i % 20]) * (300 + i))
        assert cache.held <= 5000 and cache.held == sum(len(c) for c, _ in cache.known.values())
    # an entry of another content under the same name is no hit
    chunk = b"abc" * 100
    name = next(iter({(__import__("zlib").crc32(chunk), len(chunk))}))
    cache.known[name] = (b"x" * len(chunk), cache.summary(b"x" * len(chunk)))
    assert cache.summary(chunk).head == b"ab"


def test_places_of_code_points_over_block_borders():
    r = random.Random(8)
    text = "".join(chr(r.choice([97, 233, 0x4E2D, 0x1F600])) for _ in range(900_000))  # over two blocks of bytes
    c = chunked(text, ChunkCache(("<P>", "<S>", "<M>")))
    assert c.chars == len(text)
    for k in [0, 1, len(text) - 1, len(text), *(r.randrange(len(text)) for _ in range(200))]:
        assert c.byte_of(k) == len(text[:k].encode())
