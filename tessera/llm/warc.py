"""WARC archives: a deterministic sharded writer and a verifying reader.

Writing:

1. Every page has a key: its id, a hash of url and payload digest.  Keys, payload sizes and copies are counted
   without payloads.  Of payloads that occur more than once and have ``least`` bytes, the page with the largest
   id is the response; the others become revisits.
2. Range sort: the order of keys is cut into shards of about equal bytes.  The cuts come from the keys of smallest
   hash (up to ``KEYS_A_SHARD`` per shard, three numbers each), so they depend on the pages alone, not on how
   these are partitioned, and pages without an id or with one id are cut apart by the hash.  Pages move to
   their shard once and are sorted there; a copy's role stands just before its page.
3. A task writes its shard as a run of gzip members, one per record, with headers and digests made anew, and starts
   another file when the compressed size reaches ``roll_bytes``.  Files have names of the task attempt;
   what it returns are rows of segments with their digests.
4. Commit: the segments of the attempts that Spark kept are the manifest.  Their files are renamed, then the manifest
   is published by a rename.  Readers go by the manifest, so files of lost or repeated attempts are never seen.

Same pages, same bytes: dates, record ids and file names are functions of the input.

Reading takes the manifest's segments apart over the cluster, checks each segment's digest and number of records and
each record's length, block digest and payload digest, and fails on any difference.

The folder is one that executors open with ``pyarrow.fs`` (a shared path, hdfs, s3).

Defined cases: null html is empty; a null id comes last, so it is the response only among null ids, and is
read back as null; a null or empty url is written as ``about:blank``, and bytes of a url that may not stand in a header as %XX; among equal ids the
greater url is the response; rows equal in everything are records of their own, one of which is the response; an empty table
gives a manifest without segments.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import Table
from tessera.operators.skew import join_unique
from tessera.session import path_complete
from tessera.sources.staging import publish

#: The WARC version, the profile of revisits, and the date of records (pages have none).
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: Keys of the sample that shards are cut by, per shard.
KEYS_A_SHARD = 64
MOST_KEYS = 1 << 18
LEAST_SHARDS = 24
_PRINTABLE = "".join(map(chr, range(33, 127)))
MANIFEST = ("file string, shard int, part int, start long, length long, records long, sha256 string")


def base32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record_id(*parts: object) -> str:
    """A uuid named by its parts."""
    return "<" + uuid.uuid5(uuid.NAMESPACE_URL, "tessera|" + "|".join(map(repr, parts))).urn + ">"


def record(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One record as a gzip member of its own."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: {base32(hashlib.sha1(block).digest())}",
             f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, digest: str, html: bytes, copy: int, refers: tuple | None, level: int) -> bytes:
    """The response of a page, or, where ``refers`` names another (id, url, digest, copy), its revisit."""
    target = quote(url or "about:blank", safe=_PRINTABLE)
    headers = [
        ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id, url, digest, copy)),
        ("WARC-Date", DATE), ("WARC-Target-URI", target), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", base32(bytes.fromhex(digest))),
    ]
    if page_id is not None:
        headers.append(("Page-ID", str(page_id)))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    if refers:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(*refers)),
                    ("WARC-Refers-To-Target-URI", quote(refers[1] or "about:blank", safe=_PRINTABLE)), ("WARC-Refers-To-Date", DATE)]
    else:
        block += html
    return record(headers, block, level)


class ShardWriter:
    """Files of one shard: opened at need, closed at ``roll_bytes``, cut into segments that are read apart."""

    def __init__(self, folder: str, prefix: str, shard: int, roll_bytes: int, segment_bytes: int, level: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.prefix, self.shard, self.roll, self.segment, self.level = prefix, shard, roll_bytes, segment_bytes, level
        self.attempt, self.part, self.out = uuid.uuid4().hex, 0, None
        self.segments: list[tuple] = []

    @staticmethod
    def temporary(folder: str, name: str, attempt: str) -> str:
        return f"{folder}/_temporary/{name}.{attempt}"

    def _open(self) -> None:
        self.name = f"{self.prefix}-{self.shard:06d}-{self.part:04d}.warc.gz"
        self.fs.create_dir(f"{self.folder}/_temporary", recursive=True)
        self.out = self.fs.open_output_stream(self.temporary(self.folder, self.name, self.attempt), compression=None)
        self.at = 0
        self._start()
        about = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
        self._put(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("file", self.name)), ("WARC-Date", DATE),
                          ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], about, self.level))

    def _start(self) -> None:
        self.start, self.records, self.sha = self.at, 0, hashlib.sha256()

    def _end(self) -> None:
        if self.records:
            self.segments.append((f"{self.name}.{self.attempt}", self.shard, self.part, self.start, self.at - self.start, self.records, self.sha.hexdigest()))

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.at += len(member)
        self.records += 1

    def write(self, member: bytes) -> None:
        if self.out is None:
            self._open()
        self._put(member)
        if self.at >= self.roll:
            self.close()
        elif self.at - self.start >= self.segment:
            self._end()
            self._start()

    def close(self) -> None:
        if self.out is not None:
            self._end()
            self.out.close()
            self.out = None
            self.part += 1


def page_rows(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """page_id, url, payload, its digest (hex) and a hash of url and digest."""
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = pages.select(q(page_id).cast("long").alias("page_id"), q(url).cast("string").alias("url"),
                        F.coalesce(q(html).cast("binary"), F.lit(b"")).alias("payload"))
    return rows.withColumn("digest", F.sha1("payload")).withColumn("h", F.xxhash64("url", "digest"))


def key(page_id: Column, h: Column) -> Column:
    """What shards are ordered by: the id (null last), then the hash."""
    return F.struct(page_id.isNull().alias("none"), F.coalesce(page_id, F.lit(0)).alias("page_id"), h.alias("h"))


def sample_keys(shards: int) -> int:
    """Keys that shards are cut by: ``KEYS_A_SHARD`` for each while these are ``MOST_KEYS`` at most, 8 at least."""
    return shards * max(8, min(KEYS_A_SHARD, MOST_KEYS // shards))


def shard_bounds(keys: DataFrame, shards: int) -> list[tuple[bool, int, int]]:
    """The first keys of all shards but the first: quantiles by bytes of the keys of smallest hash."""
    sample = (keys.select(key(F.col("page_id"), F.col("h")).alias("k"), ((F.col("bytes") + 500) * F.col("n")).alias("w"))
              .orderBy(F.xxhash64("k.none", "k.page_id", "k.h"), "k").limit(sample_keys(shards)).select("k.*", "w").toArrow())
    none, ids, hashes, weights = (sample[c].to_numpy() for c in ("none", "page_id", "h", "w"))
    order = np.lexsort((hashes, ids, none))
    upto, total, bounds = 0, int(weights.sum()), []
    for i in order.tolist():
        k = bool(none[i]), int(ids[i]), int(hashes[i])
        # a key that begins beyond the next multiple of a shard's share begins a shard
        if upto * shards >= total * (len(bounds) + 1) and (not bounds or k > bounds[-1]):
            bounds.append(k)
        upto += int(weights[i])
    return bounds


def shard_of(bounds: list[tuple[bool, int, int]], k: Column) -> Column:
    """How many of the sorted ``bounds`` are not above the key, by binary search."""
    if not bounds:
        return F.lit(0)
    kind = "struct<none:boolean,page_id:bigint,h:bigint>"
    none, ids, hashes = (F.lit(list(c)) for c in zip(*bounds))
    all_ = F.arrays_zip(none.alias("none"), ids.alias("page_id"), hashes.alias("h")).cast(f"array<{kind}>")
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["low"] + s["high"]) / 2).cast("int")
        right = (s["low"] < s["high"]) & (F.get(all_, mid) <= k)
        left = (s["low"] < s["high"]) & (F.get(all_, mid) > k)
        return F.struct(F.when(right, mid + 1).otherwise(s["low"]).alias("low"), F.when(left, mid).otherwise(s["high"]).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), halve, lambda s: s["low"])


def copies(keys: DataFrame, least: int) -> DataFrame:
    """page_id, url, digest of pages whose payload others have too, with its response's id and url."""
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", F.col("url").isNotNull().alias("named"), "url"))
    groups = (keys.where(F.col("bytes") >= least).groupBy("digest").agg(best.alias("best"), F.sum("n").alias("pages")).where("pages > 1")
              .select("digest", F.col("best.page_id").alias("best_id"), F.col("best.url").alias("best_url")))
    return join_unique(keys, groups, "digest")


def write_warc(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, prefix: str = "pages",
    shard_bytes: int = 1 << 30, roll_bytes: int = 256 << 20, segment_bytes: int = 32 << 20, level: int = 6,
) -> DataFrame:
    """Writes ``pages`` as WARC files under ``folder`` (which holds no manifest yet); the manifest, one row per segment.

    Pages with equal payloads of at least ``least`` bytes are stored once."""
    spark = pages.sparkSession
    folder = folder.rstrip("/")
    if path_complete(spark, f"{folder}/_manifest"):
        raise FileExistsError(f"{folder} holds an archive already")
    rows = page_rows(pages, page_id, url, html)
    counted = rows.groupBy("page_id", "url", "digest", "h", F.octet_length("payload").alias("bytes")).agg(F.count("*").alias("n"))
    keys = Table(counted, "warc-keys")
    size = keys.df.agg(F.coalesce(F.sum(F.col("bytes") * F.col("n")), F.lit(0))).first()[0]
    bounds = shard_bounds(keys.df, max(LEAST_SHARDS, -(-size // shard_bytes)))
    shard = shard_of(bounds, key(F.col("page_id"), F.col("h"))).alias("shard")
    of_copies = copies(keys.df, least)
    # a role (without payload) stands before its page
    roles = of_copies.select("page_id", "url", "digest", "h", shard, F.lit(None).cast("binary").alias("payload"), F.lit(True).alias("copied"), "best_id", "best_url")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("copied", "boolean"), ("best_id", "long"), ("best_url", "string"))]
    placed = roles.unionByName(rows.select("page_id", "url", "digest", "h", shard, "payload", *none))
    sorted_ = placed.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(
        F.asc_nulls_last("page_id"), "h", F.asc_nulls_first("url"), "digest", F.desc_nulls_last("copied"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, copy, best = None, None, 0, None
        for batch in batches:
            ids, urls, digests, numbers, payloads, copied, best_ids, best_urls = (batch.column(c) for c in
                ("page_id", "url", "digest", "shard", "payload", "copied", "best_id", "best_url"))
            for i in range(batch.num_rows):
                one = ids[i].as_py(), urls[i].as_py(), digests[i].as_py()
                if copied[i].as_py():
                    role = one, (best_ids[i].as_py(), best_urls[i].as_py(), one[2], 0)
                    best = role
                    continue
                copy = copy + 1 if one == last else 0
                last = one
                if out is None:
                    out = ShardWriter(folder, prefix, numbers[i].as_py(), roll_bytes, segment_bytes, level)
                refers = best[1] if best is not None and best[0] == one and (*one, copy) != best[1] else None
                out.write(page_record(*one, payloads[i].as_py(), copy, refers, level))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out.segments), (
                pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.string()))], [c.split()[0] for c in MANIFEST.split(", ")])

    segments = Table(sorted_.select("page_id", "url", "digest", "shard", "payload", "copied", "best_id", "best_url").mapInArrow(write, MANIFEST), "warc-segments")
    keys.drop()
    commit(spark, folder, segments.df)
    segments.drop()
    return manifest(spark, folder)


def commit(spark: SparkSession, folder: str, segments: DataFrame) -> None:
    """Renames the segments' files and publishes the manifest; files of other attempts go.

    A rename that an earlier try of the task has done is left as it is."""
    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                name, attempt = file.rsplit(".", 1)
                temporary, final = ShardWriter.temporary(base, name, attempt), f"{base}/{name}"
                if fs.get_file_info(temporary).type != pafs.FileType.NotFound:
                    fs.move(temporary, final)
                elif fs.get_file_info(final).type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"neither {temporary} nor {final} is there")
            yield batch

    final = segments.withColumn("file", F.regexp_replace("file", r"\.[0-9a-f]+$", ""))
    files = segments.select("file").distinct()
    if files.count() != final.select("file").distinct().count():
        raise RuntimeError(f"{folder}: two attempts wrote one file")
    files.mapInArrow(rename, "file string").agg(F.count("*")).first()
    attempt = f"{folder}/_manifest.attempt-{uuid.uuid4().hex}"
    final.orderBy("file", "start").write.parquet(attempt)
    publish(spark, attempt, f"{folder}/_manifest")
    temporary = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary")
    temporary.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(temporary, True)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/_manifest")


RECORDS = ("file string, record_id string, record_type string, page_id long, target_uri string, refers_id string, "
           "payload_digest string, payload binary")


class BadArchive(ValueError):
    pass


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record, with its length and block digest checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    length = int(headers["content-length"])
    block = rest[:length]
    if version != VERSION or len(block) != length or rest[length:] != b"\r\n\r\n":
        raise BadArchive(f"record {headers.get('warc-record-id')}: wrong length or version")
    if headers["warc-block-digest"] != base32(hashlib.sha1(block).digest()):
        raise BadArchive(f"record {headers.get('warc-record-id')}: wrong block digest")
    return headers, block


def members(stream, length: int, sha) -> Iterator[bytes]:
    """The gzip members of the next ``length`` bytes of a stream, one at a time."""
    inflate, held, left = zlib.decompressobj(31), [], length
    while left:
        raw = stream.read(min(left, 1 << 20))
        if not raw:
            raise BadArchive("a segment ends early")
        left -= len(raw)
        sha.update(raw)
        while raw:
            held.append(inflate.decompress(raw))
            raw = inflate.unused_data
            if inflate.eof:
                yield b"".join(held)
                inflate, held = zlib.decompressobj(31), []
    if held:
        raise BadArchive("a segment ends within a record")


def read_warc(spark: SparkSession, folder: str, parts: int | None = None) -> DataFrame:
    """The records of an archive, but for file descriptions: ``payload`` is null for revisits, ``payload_digest`` hex.

    One task reads some segments of the manifest; ``parts`` tasks (one per segment, at most the shuffle partitions)."""
    folder = folder.rstrip("/")
    segments = manifest(spark, folder)
    names, held_bytes = [c.split()[0] for c in RECORDS.split(", ")], 8 << 20

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out, held = [], 0

        def flush() -> pa.RecordBatch:
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            columns = zip(*out) if out else [()] * len(names)
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            out.clear()
            return done

        for batch in batches:
            for s in batch.to_pylist():
                sha, count = hashlib.sha256(), 0
                with fs.open_input_file(f"{base}/{s['file']}") as f:
                    f.seek(s["start"])
                    for raw in members(f, s["length"], sha):
                        count += 1
                        headers, block = parse(raw)
                        kind = headers["warc-type"]
                        if kind == "warcinfo":
                            continue
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:"))
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None and hashlib.sha1(payload).digest() != digest:
                            raise BadArchive(f"record {headers['warc-record-id']}: wrong payload digest")
                        page = headers.get("page-id")
                        out.append((s["file"], headers["warc-record-id"], kind, None if page is None else int(page), headers["warc-target-uri"],
                                    headers.get("warc-refers-to"), digest.hex(), payload))
                        held += len(raw)
                        if held >= held_bytes:
                            yield flush()
                            held = 0
                if count != s["records"] or sha.hexdigest() != s["sha256"]:
                    raise BadArchive(f"{s['file']} at {s['start']}: not the segment of the manifest")
        yield flush()

    if parts is None:
        parts = max(1, min(segments.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return segments.repartition(parts, "file", "start").mapInArrow(scan, RECORDS)


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (the response's page) of :func:`read_warc`'s records.

    A revisit takes size and digest from the record that it refers to, which must be there and have its digest."""
    index = Table(records.select("record_id", "record_type", "page_id", "refers_id", "payload_digest", F.octet_length("payload").cast("long").alias("bytes")), "warc-index").df
    responses = index.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_id"), F.col("page_id").alias("to"), F.col("bytes").alias("to_bytes"), F.col("payload_digest").alias("to_digest"))
    met = join_unique(index, responses, "refers_id", "left")
    revisit = F.col("record_type") == "revisit"
    wrong = F.raise_error(F.concat(F.lit("no response of its digest for revisit "), F.col("record_id")))
    size = F.when(~revisit, F.col("bytes")).when(F.col("to_digest") == F.col("payload_digest"), F.col("to_bytes")).otherwise(wrong.cast("long"))
    return met.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", F.when(revisit, F.col("to")).alias("refers_to"))
