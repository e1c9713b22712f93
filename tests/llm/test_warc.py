import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.warc import MANIFEST, manifest, parse, read_warc, resolve, sample_keys, shard_bounds, shard_of, key, write_warc

SCHEMA = "page_id long, url string, html string, digest string, h int, payload string"


def pages(seed=1, n=150):
    r = random.Random(seed)
    text = lambda size: "".join(r.choice("abcé <>\n") for _ in range(size))
    large, small = text(1500), "s" * 999
    out = [(i, f"https://h{i % 9}.example/{i}?q=é x", text(r.choice([0, 10, 400, 2000, 30_000]))) for i in range(n)]
    out += [(1000 + i, f"https://c.example/{i}", large) for i in range(40)] + [(2000 + i, "https://d.example/", small) for i in range(5)]
    out += [(3000 + i, None, "t" * 1000) for i in range(4)] + [(None, "x", "t" * 1000), (None, "", None), (None, None, "t" * 1000)]
    out += [(77, "https://r.example/", "u" * 1200)] * 3 + [(77, "https://s.example/", "u" * 1200), (5, "http://two/", "v" * 1100), (5, "http://one/\r\nWARC-Type: x", "v" * 1100)]
    out += [(None, "n", "w" * 1300)] * 2
    return [(*x, "d", 1, "p") for x in out]


def expected(rows):
    groups = {}
    for at, (page, url, html, *_) in enumerate(rows):
        groups.setdefault((html or "").encode(), []).append(at)
    out = []
    for raw, members in groups.items():
        order = sorted(members, key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
        for i in members:
            revisit = len(raw) >= 1000 and i != order[-1]
            out.append((rows[i][0], len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", rows[order[-1]][0] if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture()
def folder(tmp_path):
    return f"file://{tmp_path}/archive"


def local(folder):
    return folder.removeprefix("file://")


def test_round_trip(spark, folder):
    data = pages()
    write_warc(spark.createDataFrame(data, SCHEMA).repartition(4), folder)
    records = read_warc(spark, folder)
    assert sorted(map(tuple, resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == expected(data)
    held = records.where("record_type = 'response'").select("page_id", "payload").collect()
    whole = {(p, (t or "").encode()) for p, _, t, *_ in data}
    assert all((r.page_id, bytes(r.payload)) in whole for r in held)
    assert records.select("record_id").distinct().count() == len(data)
    assert not any("\r" in r.target_uri or " " in r.target_uri for r in records.select("target_uri").collect())


def test_bytes_depend_on_the_pages_alone(spark, tmp_path):
    data = pages(3)
    found = []
    for n, parts in enumerate((1, 7)):
        folder = f"file://{tmp_path}/{n}"
        r = random.Random(n)
        write_warc(spark.createDataFrame(r.sample(data, len(data)), SCHEMA).repartition(parts), folder, roll_bytes=3000)
        at = local(folder)
        found.append({f: hashlib.sha256(open(f"{at}/{f}", "rb").read()).hexdigest() for f in os.listdir(at) if f.endswith(".warc.gz")})
    assert found[0] == found[1] and len(found[0]) > 10


def test_files_roll_and_segments_cover_them(spark, folder):
    data = pages(4)
    parts = write_warc(spark.createDataFrame(data, SCHEMA), folder, roll_bytes=20_000, segment_bytes=4000, shard_bytes=10**9).collect()
    by_file = {}
    for s in parts:
        by_file.setdefault(s.file, []).append(s)
    assert any(len(v) > 1 for v in by_file.values()) and any(s.part > 0 for s in parts)
    order = []
    for name in sorted(by_file):
        raw = open(f"{local(folder)}/{name}", "rb").read()
        at = 0
        for s in sorted(by_file[name], key=lambda s: s.start):
            assert s.start == at and hashlib.sha256(raw[at : at + s.length]).hexdigest() == s.sha256
            at += s.length
        assert at == len(raw) and len(raw) < 20_000 + 40_000
        lines = gzip.decompress(raw).split(b"\r\n")
        assert lines[0] == b"WARC/1.1" and b"WARC-Type: warcinfo" in lines[:3]
        order += [int(x.split(b": ")[1]) for x in lines if x.startswith(b"Page-ID")]
    assert order == sorted(order)  # records are in order over shards and files
    assert sum(s.records for s in parts) == len(data) + len(by_file)
    assert sorted(f for f in os.listdir(local(folder)) if not f.startswith((".", "_"))) == sorted(by_file)
    assert not os.path.exists(f"{local(folder)}/_temporary")
    with pytest.raises(FileExistsError):
        write_warc(spark.createDataFrame(data, SCHEMA), folder)


def test_damage_is_found(spark, folder):
    write_warc(spark.createDataFrame(pages(5), SCHEMA), folder)
    first = manifest(spark, folder).orderBy("file").first()
    path = f"{local(folder)}/{first.file}"
    raw = bytearray(open(path, "rb").read())
    raw[len(raw) // 2] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="(?s)(BadArchive|zlib.error|not the segment)"):
        read_warc(spark, folder).collect()
    good = b"WARC/1.1\r\nWARC-Block-Digest: sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert parse(good)[1] == b""
    for bad in (good.replace(b"3I42", b"3I43"), good.replace(b"Length: 0", b"Length: 1"), good[:-1]):
        with pytest.raises(ValueError):
            parse(bad)


def test_files_without_a_manifest_row_are_not_read(spark, folder):
    data = pages(6)
    write_warc(spark.createDataFrame(data, SCHEMA), folder)
    with open(f"{local(folder)}/pages-999999-0000.warc.gz", "wb") as f:
        f.write(b"left by a lost attempt")
    assert read_warc(spark, folder).count() == len(data)


def test_empty(spark, folder):
    empty = spark.createDataFrame(pages(), SCHEMA).limit(0)
    made = write_warc(empty, folder)
    assert made.collect() == [] and made.columns == [c.split()[0] for c in MANIFEST.split(", ")]
    assert resolve(read_warc(spark, folder)).collect() == []


def test_shards_by_binary_search(spark):
    r = random.Random(1)
    rows = [(None if r.random() < 0.3 else r.randrange(50), r.randrange(-(2**62), 2**62), r.randrange(100, 5000), 1) for _ in range(3000)]
    keys = spark.createDataFrame(rows, "page_id long, h long, bytes int, n long")
    bounds = shard_bounds(keys, 13)
    assert bounds == sorted(set(bounds)) and len(bounds) == 12
    got = keys.select("page_id", "h", "bytes", shard_of(bounds, key(F.col("page_id"), F.col("h"))).alias("s")).collect()
    assert all(x.s == sum(b <= (x.page_id is None, x.page_id or 0, x.h) for b in bounds) for x in got)
    sizes = [0] * 13
    for x in got:
        sizes[x.s] += x.bytes
    assert max(sizes) < 1.6 * sum(sizes) / 13  # a third without an id is cut apart too
    assert keys.select(shard_of([], key(F.col("page_id"), F.col("h"))).alias("s")).distinct().collect()[0].s == 0


def test_the_sample_is_bounded():
    assert [sample_keys(n) for n in (1, 24, 4096)] == [64, 24 * 64, 4096 * 64]
    assert sample_keys(10_000) == 10_000 * 26 and sample_keys(100_000) == 800_000


def test_a_payload_that_most_pages_share(spark, folder):
    """Two thirds of all pages are copies: one response, the rest refer to it, over all shards."""
    data = [(i, f"http://x/{i}", "hot " * 400 if i % 3 else f"own {i} " * 200, "d", 1, "p") for i in range(900)]
    write_warc(spark.createDataFrame(data, SCHEMA).repartition(5), folder)
    got = resolve(read_warc(spark, folder)).collect()
    assert sorted(map(tuple, (r[:] for r in got)), key=repr) == expected(data)
    assert sum(r.record_type == "revisit" for r in got) == 599
    stored = sum(len(r.payload) for r in read_warc(spark, folder).where("payload is not null").select("payload").collect())
    assert stored == 1600 + sum(len(x[2]) for x in data if x[0] % 3 == 0)
