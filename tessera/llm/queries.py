"""The queries of this package over the given tables, and their SQL twins."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    chunk_dedup, conversations, embedding_dedup, fill_middle, mixing, ngram_join, packing, pii, suffix_dedup, topk, toxicity, url_filter, warc,
)
from tessera.llm.shared import read
from tessera.session import shared_path

#: The rules of the url query as (action, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives executors this package, once per application, where it isn't installed."""
    if spark.sparkContext.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tessera-package-')}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(spark.sparkContext.applicationId)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    return run


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(read(spark, sf_dir, "documents")).drop("source")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def perturbed(vectors: DataFrame, offset: int = 10**9) -> DataFrame:
    """The vectors and a copy of each with ids ``offset`` on and noise that depends on id and place: four of
    five copies near their vector, the fifth farther away."""
    size = F.when(F.col("vec_id") % 5 == 0, 45.0).otherwise(150.0)
    noise = lambda x, i: x.cast("double") + (F.pmod(F.col("vec_id") * 7 + i * 13, F.lit(11)) - 5) / size
    doubles = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), "label")
    copies = vectors.select((F.col("vec_id") + offset).alias("vec_id"), F.transform("embedding", noise).alias("embedding"), "label")
    return doubles.unionByName(copies)


def embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate operator on vectors and perturbed copies of them, so that there are links to find."""
    return embedding_dedup.near_duplicates(perturbed(read(spark, sf_dir, "embeddings")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


#: Key of the query's pseudonyms.  A corpus of real people needs one that is kept secret.
PSEUDONYM_KEY = "key of the query over synthetic documents"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents"))


def url_rules(spark: SparkSession) -> DataFrame:
    """The rules as literals of the plan: no Python worker reads them."""
    rule = lambda action, host, path: F.struct(F.lit(action).alias("action"), F.lit(host).alias("host"), F.lit(path).alias("path"))
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*[rule(*r) for r in URL_RULES])))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), url_rules(spark)).drop("url")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"))


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.chunk_dedup(read(spark, sf_dir, "documents")).drop("spans")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "llm", f"warc-{uuid.uuid4().hex}")
    warc.write_warc(read(spark, sf_dir, "pages"), folder)
    return warc.resolve(warc.read_warc(spark, folder))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.transform_digests(read(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_report(read(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: query(f)
    for f in (op1_mixing, op2_embedding_dedup, op3_packing, op4_pii, op5_toxicity, op6_suffix_dedup,
              op7_url_filter, op8_topk, op9_ngram_join, op10_chunk_dedup, op11_warc, op12_fill_middle,
              op13_conversation_repair, embedding_links, pipeline)
}

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, {_WORDS}::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'text|' || coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT source, n, i, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s
), r AS (
  SELECT *, 2.0::DOUBLE * n / weight AS level, row_number() OVER (ORDER BY 2.0::DOUBLE * n / weight, i) AS pos,
         1.5::DOUBLE * sum(n) OVER () - coalesce(sum(2.0::DOUBLE * n) OVER before, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open
  FROM w WINDOW before AS (ORDER BY 2.0::DOUBLE * n / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT arg_min(rest / open, pos) FILTER (WHERE rest / open < level) AS share, min(pos) FILTER (WHERE rest / open < level) AS from_pos FROM r
), t AS (
  SELECT source, n, CASE WHEN from_pos IS NULL OR pos < from_pos THEN 2.0::DOUBLE * n ELSE share * weight END AS target FROM r, f
), e AS (
  SELECT *, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS epochs FROM t
), c AS (
  SELECT d.source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY h) AS upto
  FROM d GROUP BY d.source, h
), b AS (
  SELECT c.source, h, upto, words, target - epochs * n AS budget FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source
), cut AS (
  SELECT source, min(h) AS h, arg_min(upto, h) AS upto, arg_min(words, h) AS words, any_value(budget) AS budget
  FROM b WHERE budget > 0 AND upto >= budget GROUP BY source
), x AS (
  SELECT e.*, coalesce(cut.h + CASE WHEN upto - budget < budget - (upto - words) THEN 1 ELSE 0 END, 0) AS below
  FROM e LEFT JOIN cut ON e.source IS NOT DISTINCT FROM cut.source
)
SELECT doc_id, size, n AS source_size, target, size * (epochs + CASE WHEN h < below THEN 1 ELSE 0 END) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source""",
    "op7_url_filter": r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r(action, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), k AS (
  SELECT host, path, max(length(rule_host || rule_path)) AS len, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(action, length(rule_host || rule_path)) AS action
  FROM (SELECT DISTINCT host, path FROM p) JOIN r
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, p.host, p.path, rule, coalesce(action, 'allow') AS verdict
FROM p LEFT JOIN k ON p.host = k.host AND p.path = k.path""",
    "op8_topk": r"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS uid, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.uid AS quid, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.uid <> c.uid AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
), k AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY quid ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20""",
    "op2_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, row_number() OVER () AS uid, label,
         CASE WHEN label IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
               AND len([x for x in embedding if x <> 0]) > 0 THEN embedding::DOUBLE[] END AS e
  FROM embeddings
), l AS (
  SELECT a.uid AS a, b.uid AS b
  FROM v a JOIN v b ON a.label = b.label AND a.uid <> b.uid AND len(a.e) = len(b.e)
   AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93
), reach AS (
  SELECT uid, vec_id AS v FROM v
  UNION
  SELECT l.a, reach.v FROM reach JOIN l ON l.b = reach.uid
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT uid, min(v) AS c FROM reach GROUP BY uid)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id IS NOT DISTINCT FROM c AS kept
FROM v JOIN c USING (uid) LEFT JOIN n ON n.a = v.uid""",
    "embedding_links": r"""
WITH RECURSIVE given AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings
  UNION ALL
  SELECT vec_id + 1000000000, label,
         [x::DOUBLE + ((vec_id * 7 + (i - 1) * 13) % 11 - 5) / CASE WHEN vec_id % 5 = 0 THEN 45.0::DOUBLE ELSE 150.0::DOUBLE END for x, i in embedding]
  FROM embeddings
), v AS (
  SELECT vec_id, row_number() OVER () AS uid, label,
         CASE WHEN label IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
               AND len([x for x in embedding if x <> 0]) > 0 THEN embedding::DOUBLE[] END AS e
  FROM given
), l AS (
  SELECT a.uid AS a, b.uid AS b
  FROM v a JOIN v b ON a.label = b.label AND a.uid <> b.uid AND len(a.e) = len(b.e)
   AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93
), reach AS (
  SELECT uid, vec_id AS v FROM v
  UNION
  SELECT l.a, reach.v FROM reach JOIN l ON l.b = reach.uid
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT uid, min(v) AS c FROM reach GROUP BY uid)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id IS NOT DISTINCT FROM c AS kept
FROM v JOIN c USING (uid) LEFT JOIN n ON n.a = v.uid""",
    "op9_ngram_join": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, row_number() OVER () AS uid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT uid, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
                                   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM t
), s AS (SELECT uid, count(*) AS n FROM g GROUP BY uid), p AS (
  SELECT a.uid AS a, b.uid AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.uid <> b.uid GROUP BY a.uid, b.uid
), l AS (
  SELECT a, b FROM p JOIN s x ON x.uid = a JOIN s y ON y.uid = b WHERE shared >= 0.8::DOUBLE * (x.n + y.n - shared)
), reach AS (
  SELECT uid, doc_id AS v FROM t
  UNION
  SELECT l.a, reach.v FROM reach JOIN l ON l.b = reach.uid
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT uid, min(v) AS c FROM reach GROUP BY uid)
SELECT doc_id, c AS class_id, coalesce(n, 0) AS n_links FROM t JOIN c USING (uid) LEFT JOIN n ON n.a = t.uid""",
    "op11_warc": r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), r AS (
  SELECT *, n >= 1000 AND row_number() OVER (PARTITION BY d ORDER BY page_id DESC NULLS LAST) > 1 AS again, max(page_id) OVER (PARTITION BY d) AS top FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN top END AS refers_to
FROM r""",
    "op12_fill_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), h AS (
  SELECT doc_id, t, n, ('0x' || x[1:8])::BIGINT % (n + 1) AS a, ('0x' || x[9:16])::BIGINT % (n + 1) AS b,
         ('0x' || x[17:24])::BIGINT % 100 AS r, ('0x' || x[25:32])::BIGINT % 100 AS m FROM d
), f AS (
  SELECT *, least(a, b) AS p, greatest(a, b) AS e,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r >= 90 THEN 'plain' WHEN m < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), o AS (
  SELECT *, substring(t, 1, p) AS pre, substring(t, p + 1, e - p) AS mid, substring(t, e + 1) AS suf FROM f
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN e - p END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM o""",
    "op13_conversation_repair": r"""
WITH RECURSIVE tab AS (  -- CRC-32 by the usual polynomial
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), c AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT),
                         lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) % 20 AS kind FROM o, tab
), d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, LATERAL (SELECT unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))
), p AS (
  SELECT *, coalesce(conv_id::VARCHAR, '') AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS pos,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, substr(role, 1, 1) AS i FROM d
), f AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         count(*) OVER (PARTITION BY conv_id) AS n, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS j FROM p
), g AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE j || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv
), e AS (  -- cost, audit and repaired lines from a row on, by state: 0 start, 1 after s, 2 after u, 3 after a
  SELECT conv, n + 1 AS pos, {'c': 0, 'a': '', 'l': ''} AS v0, {'c': 6, 'a': 'II', 'l': chr(10) || 'user:' || chr(10) || 'assistant:'} AS v1,
         {'c': 3, 'a': 'I', 'l': chr(10) || 'assistant:'} AS v2, {'c': 0, 'a': '', 'l': ''} AS v3
  FROM f WHERE pos = n
  UNION ALL
  SELECT conv, pos, least(v0, {'c': v2.c + 3, 'a': 'I' || v2.a, 'l': chr(10) || 'user:' || v2.l}) AS v0,
         least(v1, {'c': v2.c + 3, 'a': 'I' || v2.a, 'l': chr(10) || 'user:' || v2.l}) AS v1, v2, v3
  FROM (
    SELECT conv, pos, v0, v1, least(v2, {'c': v3.c + 3, 'a': 'I' || v3.a, 'l': chr(10) || 'assistant:' || v3.l}) AS v2,
           least(v3, {'c': v2.c + 3, 'a': 'I' || v2.a, 'l': chr(10) || 'user:' || v2.l}) AS v3
    FROM (
      SELECT conv, pos,
             least({'c': v0.c + 4, 'a': 'D' || v0.a, 'l': v0.l},
                   CASE WHEN stays AND i = 's' THEN {'c': v1.c + x, 'a': 'K' || v1.a, 'l': line || v1.l} WHEN stays AND i = 'u' THEN {'c': v2.c + x, 'a': 'K' || v2.a, 'l': line || v2.l} END,
                   CASE WHEN stays THEN {'c': v2.c + x + 3, 'a': 'R' || v2.a, 'l': chr(10) || 'user:' || text || v2.l} END) AS v0,
             least({'c': v1.c + 4, 'a': 'D' || v1.a, 'l': v1.l},
                   CASE WHEN stays AND i = 'u' THEN {'c': v2.c + x, 'a': 'K' || v2.a, 'l': line || v2.l} END,
                   CASE WHEN stays THEN {'c': v2.c + x + 3, 'a': 'R' || v2.a, 'l': chr(10) || 'user:' || text || v2.l} END) AS v1,
             least({'c': v2.c + 4, 'a': 'D' || v2.a, 'l': v2.l},
                   CASE WHEN stays AND i = 'a' THEN {'c': v3.c + x, 'a': 'K' || v3.a, 'l': line || v3.l} END,
                   CASE WHEN stays THEN {'c': v3.c + x + 3, 'a': 'R' || v3.a, 'l': chr(10) || 'assistant:' || text || v3.l} END) AS v2,
             least({'c': v3.c + 4, 'a': 'D' || v3.a, 'l': v3.l},
                   CASE WHEN stays AND i = 'u' THEN {'c': v2.c + x, 'a': 'K' || v2.a, 'l': line || v2.l} END,
                   CASE WHEN stays THEN {'c': v2.c + x + 3, 'a': 'R' || v2.a, 'l': chr(10) || 'user:' || text || v2.l} END) AS v3
      FROM (SELECT f.conv, f.pos, i, text, fault IN ('', 'truncated') AS stays, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS x,
                   chr(10) || role || ':' || text AS line, v0, v1, v2, v3 FROM e JOIN f ON f.conv = e.conv AND f.pos = e.pos - 1)))
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(substr(v0.l, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS conv FROM conversations) LEFT JOIN g USING (conv) LEFT JOIN (SELECT * FROM e WHERE pos = 1) USING (conv)""",
}
