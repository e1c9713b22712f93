"""Ratings from CSV text.

Two routes, as in the reference's two program versions:

* ``explicit`` (default): a fixed schema, no inference pass.  Columns are
  taken by position, so the header is checked against the schema names in
  every file while the scan runs (``enforceSchema=false``), which rejects
  swapped or renamed columns instead of silently mislabelling them.
* ``inferred``: Spark infers types (an extra pass over the data; sample it
  with ``sampling_ratio`` on large inputs), then the four columns are
  picked by name and converted with ``try_cast``, so a bad value becomes
  NULL rather than failing the job (under ANSI mode a plain cast raises).
* ``sampled``: types come from a bounded number of first lines, and the scan that
  casts the fields also checks them against those types; a field that breaks its type
  is an error (``on_break="error"``) or makes the types wider for a second read
  (``"widen"``).  So the text is read once where the sample was right.

:mod:`tessera.sources.rejects` reads the same text and keeps what does not fit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.layout import repartition
from tessera.schema import RATING_COLUMNS, RATING_TYPES, RATINGS_SCHEMA
from tessera.session import shared_path
from tessera.sources.rejects import INT_TEXT, whole_part


def checked_id(name: str) -> F.Column:
    """The bigint column ``name`` as int; NULL stays NULL, an id beyond int is an error."""
    wide = F.col(name)
    fits = wide.isNull() | wide.between(-(2**31), 2**31 - 1)
    error = F.raise_error(F.concat(F.lit(f"{name} beyond the int range: "), wide.cast("string")))
    return F.when(fits, wide.cast("int")).otherwise(error.cast("int")).alias(name)


def int_ids(df: DataFrame) -> DataFrame:
    return df.select(*[checked_id(f.name) if RATING_TYPES[f.name] == "int" else F.col(f.name) for f in df.schema])


def project_cast(df: DataFrame) -> DataFrame:
    """The four rating columns by name, each ``try_cast`` to its type; ids
    that are numbers beyond int are an error, not NULL."""
    def cast(c: str) -> F.Column:
        if RATING_TYPES[c] != "int":
            return F.col(c).try_cast(RATING_TYPES[c])
        # a column that holds text is text throughout: its fractions are cut off like those of a double column
        text = isinstance(df.schema[c].dataType, T.StringType)
        return whole_part(F.col(c)) if text else F.col(c).try_cast("bigint")

    return int_ids(df.select(*[cast(c).alias(c) for c in RATING_COLUMNS]))


#: Lines that the types of the ``sampled`` route come from.
SAMPLE_LINES = 1000


def sampled_types(spark: SparkSession, path: str, lines: int = SAMPLE_LINES) -> T.StructType:
    """Column types inferred from the first ``lines`` lines; only the files they are in are read."""
    head = [r.value for r in spark.read.text(path).limit(lines + 1).collect()]
    if not head:
        raise ValueError(f"{path} holds no text")
    head = head[:1] + [line for line in head[1:] if line != head[0]]  # each file begins with the header
    return spark.read.option("header", True).option("inferSchema", True).csv(spark.sparkContext.parallelize(head, 1)).schema


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of a column whose sample says ``a`` and whose other fields say ``b``."""
    order = [T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()]
    return order[max(order.index(x) if x in order else 3 for x in (a, b))]


def _field_types(text: F.Column) -> F.Column:
    """The least type of a field, as a place in int, bigint, double, string; null for a missing one."""
    return (F.when(text.isNull(), None).when(text.try_cast("int").isNotNull() & text.rlike(INT_TEXT), 0)
            .when(text.try_cast("bigint").isNotNull() & text.rlike(INT_TEXT), 1).when(text.try_cast("double").isNotNull(), 2).otherwise(3))


def read_sampled(spark: SparkSession, path: str, lines: int = SAMPLE_LINES, on_break: str = "error") -> tuple[DataFrame, dict[str, str]]:
    """Ratings under types from a sample, and those types.

    ``error``: the scan fails at the first field that its column's type cannot hold.  ``widen``: rows are staged by one scan
    that also finds the widest field per column; only if one breaks its type is the text read again, under the wider types."""
    if on_break not in ("error", "widen"):
        raise ValueError(f"on_break must be 'error' or 'widen', got {on_break!r}")
    sampled = {f.name: f.dataType for f in sampled_types(spark, path, lines)}
    missing = [c for c in RATING_COLUMNS if c not in sampled]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    text = spark.read.option("header", True).csv(path).select(*RATING_COLUMNS)
    order = [T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()]
    kinds = {c: sampled[c] if sampled[c] in order else T.StringType() for c in RATING_COLUMNS}

    def typed(kinds: dict[str, T.DataType], check: bool) -> DataFrame:
        def column(c: str) -> F.Column:
            value = F.col(c).try_cast(kinds[c])
            if check:
                breaks = F.col(c).isNotNull() & (_field_types(F.col(c)) > order.index(kinds[c]))
                error = F.raise_error(F.concat(F.lit(f"{c} is no {kinds[c].simpleString()}, as the first {lines} lines say: "), F.col(c)))
                value = F.when(breaks, error.cast(kinds[c])).otherwise(value)
            return value.alias(c)

        return project_cast(text.select(*[column(c) for c in RATING_COLUMNS]))

    if on_break == "error":
        return typed(kinds, True), {c: t.simpleString() for c, t in kinds.items()}
    seen = Observation()
    widest = [F.max(_field_types(F.col(c))).alias(c) for c in RATING_COLUMNS]

    def staged(df: DataFrame) -> DataFrame:
        out = shared_path(spark, "sampled", uuid.uuid4().hex)
        df.write.parquet(out)
        return spark.read.schema(df.schema).parquet(out)

    observed = text.observe(seen, *widest)
    first = project_cast(observed.select(*[F.col(c).try_cast(kinds[c]).alias(c) for c in RATING_COLUMNS]))
    rows = staged(first)
    found = seen.get
    wider = {c: _wider(kinds[c], order[found[c]]) if found[c] is not None else kinds[c] for c in RATING_COLUMNS}
    if wider != kinds:
        rows = staged(typed(wider, False))
    return rows, {c: t.simpleString() for c, t in wider.items()}


def read_ratings_csv(
    spark: SparkSession,
    path: str,
    mode: str = "explicit",
    partitions: int | None = None,
    sampling_ratio: float = 1.0,
) -> DataFrame:
    reader = spark.read.option("header", True)
    if mode == "explicit":
        wide = T.StructType([T.StructField(f.name, T.LongType() if f.dataType == T.IntegerType() else f.dataType) for f in RATINGS_SCHEMA])
        df = int_ids(reader.option("enforceSchema", False).schema(wide).csv(path))
    elif mode == "inferred":
        df = project_cast(
            reader.option("inferSchema", True).option("samplingRatio", sampling_ratio).csv(path)
        )
    elif mode == "sampled":
        df, _ = read_sampled(spark, path)
    else:
        raise ValueError(f"mode must be 'explicit', 'inferred' or 'sampled', got {mode!r}")
    return repartition(df, partitions)


def write_ratings_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path
