import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from tessera.llm import mixing, packing, pii
from tessera.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.data import DOCS, documents
from tests.llm.test_ngram_join import brute
from tests.util import duck_bag, spark_bag


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    assert spark_bag(QUERIES[name](spark, SF_SMALL)) == duck_bag(duck(SF_SMALL), ORACLE_SQL[name])


def test_every_query_is_there():
    numbers = [int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in QUERIES) if m]
    assert numbers == list(range(1, 14))
    assert set(QUERIES) - {n for n in QUERIES if n.startswith("op")} == {"embedding_links", "pipeline"}
    assert duckdb.__version__


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stage(spark, before, SF_MID)
        if name != "packing":
            assert now.columns == docs.columns
        now = corpus_pipeline.Table(now, "test").df
        kept[name] = before, now
    rows = lambda df: sorted(map(tuple, df.collect()))
    before, after = kept["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    marked = [labels[i] for i in gone if i in labels]
    assert marked and sum(marked) / len(marked) > 0.9
    assert sum(labels.values()) - sum(marked) < 0.15 * sum(labels.values())
    before, after = kept["ngram_join"]
    data = rows(before)
    _, classes = brute(data)
    assert sorted(r[0] for r in rows(after)) == sorted(set(classes.values()))
    before, after = kept["pii"]
    feistel = pii.Feistel(corpus_pipeline.PSEUDONYM_KEY.encode())
    assert rows(after) == sorted((r[0], pii.pseudonymize(r[1], feistel, {})[0], *r[2:]) for r in rows(before))
    before, after = kept["mixing"]
    want = {g.doc_id: g.taken // g.size for g in mixing.mix_counts(before).collect() if g.size}
    assert Counter(r[0] for r in rows(after)) == Counter({i: n for i, n in want.items() if n})
    before, after = kept["packing"]
    alone = packing.token_pieces(before, tokenizer_path())
    assert rows(after.select(alone.columns)) == rows(alone)
    assert rows(corpus_pipeline.run(spark, SF_MID).select("doc_id", "piece", "length")) == rows(after.select("doc_id", "piece", "length"))


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Extra columns named like those that a stage makes for itself, or with marks in their names, pass through."""
    extra = ["__key", "__first", "__rows", "__score", "___score", "__src", "__epochs", "__cut", "__copy", "n_email", "n_card", "score", "size", "a.b"]
    rows = [(*r, *(f"{c}-{i}" for c in extra)) for i, r in enumerate(documents(seed=2, n=20))]
    schema = DOCS + "".join(f", `{c}` string" for c in extra)
    now = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF_SMALL)
        assert after.columns == now.columns
        given = {tuple(r)[5:] for r in now.collect()}
        assert after.count() and {tuple(r)[5:] for r in after.collect()} <= given, name
        now = corpus_pipeline.Table(after, "test").df
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF_SMALL).count()


def folder(spark, tmp_path, docs):
    """A folder of tables with these documents and the given labels."""
    at = str(tmp_path / "tables")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{SF_SMALL}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


def test_an_empty_table(spark, tmp_path):
    at = folder(spark, tmp_path, spark.createDataFrame([], DOCS))
    out = corpus_pipeline.run(spark, at)
    assert out.collect() == [] and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_odd_rows(spark, tmp_path):
    """Null and empty texts, null and repeated ids, repeated rows: each stage's rule holds, nothing fails."""
    rows = documents(seed=6, n=25)
    at = folder(spark, tmp_path, spark.createDataFrame(rows, DOCS))
    out = corpus_pipeline.run(spark, at).collect()
    blank = [r for r in rows if not (r[1] or "").split()]
    ids = {r[0] for r in blank} - {r[0] for r in rows if r not in blank}
    assert {r.length for r in out if r.doc_id in ids} <= {1}  # their end id
    whole = {(r[1] or "") for r in rows}
    assert 0 < len({r.doc_id for r in out}) <= len(whole)
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096


def test_batches_are_bounded(spark):
    """No stage works on Arrow batches of more than 1,000 rows, whatever the session had; smaller ones stay."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = [(i, f"text {i} of a@b{i}.org", "en", "s", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    before = spark.conf.get(setting)
    try:
        for given, most in (("10000", 1000), ("0", 1000), ("70", 70)):
            spark.conf.set(setting, given)
            now = corpus_pipeline.personal_data(spark, docs, SF_SMALL)
            found = [r.n for r in now.mapInArrow(sizes, "n long").collect()]
            assert sum(found) == 3000 and max(found) == most
    finally:
        spark.conf.set(setting, before)
