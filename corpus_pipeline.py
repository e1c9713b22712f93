"""A corpus pipeline: toxic documents go, near copies go, personal data gets
pseudonyms, sources are mixed to weights, and what is left is packed.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as
Parquet in the folder of ``spark.checkpoint.dir`` and read again as the next one's
documents.  All but the last keep the columns of documents.

Defined cases, in every stage: null texts count as empty (toxicity scores them from the bias,
they join no group of copies, hold no personal data, weigh 0 and pack as their end id); null
and repeated doc_ids and repeated rows are rows of their own, except that of equal texts one row
stays; extra columns pass through whatever their names, until packing gives its own; a text is worked through
whole, in one task; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, ngram_join, packing, pii, toxicity
from tessera.llm.queries import ship_package, tokenizer_path
from tessera.llm.shared import Table, read


#: Rows of an Arrow batch.  Spark's 10,000 are tens of MB of text, which a task holds several times, in the JVM's direct memory and in Python.
BATCH_ROWS = 1000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage with Arrow batches of at most ``BATCH_ROWS`` rows.

    The session keeps the setting, as results are lazy; a smaller one that it has stays."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
            spark.conf.set(setting, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@bounded
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


@bounded
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.drop_near_copies(docs)


#: Key of the pseudonyms.  A corpus of real people needs one that is kept secret.
PSEUDONYM_KEY = "key of the pipeline over synthetic documents"


@bounded
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms for personal data."""
    return pii.pseudonymize_documents(docs, key=PSEUDONYM_KEY, count=False)


@bounded
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


@bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxic),
    ("ngram_join", near_copies),
    ("pii", personal_data),
    ("mixing", mixture),
    ("packing", pack),
]

#: No SQL can state a trained classifier or MinHash; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir), f"stage-{name}").df
    return STAGES[-1][1](spark, docs, sf_dir)
