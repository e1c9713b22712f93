"""Fields of a ratings CSV that do not fit their column, kept instead of lost.

The text is read once, as text.  Every field is cast and, where the cast gives no value, given a
reason; rows go to one table in the shared folder, written in that one pass and partitioned by whether a field was
rejected.  So a wide id ends no job, and what was wrong can be asked afterwards without reading the CSV again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.schema import RATING_COLUMNS, RATING_TYPES
from tessera.session import shared_path

MISSING, TEXT, FRACTION, BEYOND = "missing", "text", "fraction", "beyond int"
INT_TEXT = r"^\s*[+-]?\d+\s*$"
FRACTION_TEXT = r"^\s*[+-]?(\d+\.\d*|\.\d+)\s*$"
ROUTES = ("explicit", "inferred")


def whole_part(text: Column) -> Column:
    """An integer from text as a plain cast to int reads it: digits, and a fraction that is cut off.

    Null for other text, and for numbers beyond bigint."""
    digits = F.regexp_extract(text, r"^\s*([+-]?\d*)\.?\d*\s*$", 1)
    digits = F.when(digits.isin("", "+", "-"), F.lit("0")).otherwise(digits)
    return F.when(text.rlike(INT_TEXT) | text.rlike(FRACTION_TEXT), digits.try_cast("bigint"))


def field_value(text: Column, kind: str, route: str) -> Column:
    """The field in its type, null where it is rejected."""
    if kind == "int":
        wide = whole_part(text) if route == "inferred" else F.when(text.rlike(INT_TEXT), F.trim(text).try_cast("bigint"))
        return F.when(wide.between(-(2**31), 2**31 - 1), wide).try_cast("int")
    return text.try_cast(kind)


def field_reason(text: Column, kind: str, route: str) -> Column:
    """Why a field has no value: null where it has one."""
    number = text.rlike(INT_TEXT) | text.rlike(FRACTION_TEXT)
    reason = F.when(text.isNull() | (F.trim(text) == ""), MISSING)
    if kind == "int" and route == "explicit":
        reason = reason.when(text.rlike(FRACTION_TEXT), FRACTION)
    beyond = number if kind in ("int", "bigint") else F.lit(False)
    return F.when(field_value(text, kind, route).isNull(), reason.when(beyond, BEYOND).otherwise(TEXT))


@dataclass(frozen=True)
class Quarantined:
    """A ratings CSV read with its rejects; both are parts of one table at ``path``."""

    path: str
    ratings: DataFrame  # every row, rejected fields null
    rejects: DataFrame  # row, column, reason, raw: one row per rejected field


def read_with_rejects(spark: SparkSession, path: str, route: str = "explicit") -> Quarantined:
    """The ratings of a CSV with a header, and what was rejected, in one pass over the text.

    ``route`` decides on fractions in id columns: ``explicit`` rejects them, ``inferred`` cuts them off.
    Columns go by name."""
    if route not in ROUTES:
        raise ValueError(f"route must be one of {ROUTES}, got {route!r}")
    named = spark.read.option("header", True).csv(path)  # every column is text
    missing = [c for c in RATING_COLUMNS if c not in named.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    text = named.select(*RATING_COLUMNS)
    bad = F.filter(
        F.array(*[F.struct(F.lit(c).alias("column"), field_reason(F.col(c), RATING_TYPES[c], route).alias("reason"), F.col(c).alias("raw")) for c in RATING_COLUMNS]),
        lambda f: f["reason"].isNotNull(),
    )
    rows = text.select(
        *[field_value(F.col(c), RATING_TYPES[c], route).alias(c) for c in RATING_COLUMNS],
        bad.alias("bad"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("rejected", F.size("bad") > 0)
    out = shared_path(spark, "quarantine", uuid.uuid4().hex)
    rows.write.partitionBy("rejected").parquet(out)
    schema = T.StructType([f for f in rows.schema])
    both = spark.read.schema(schema).parquet(out)
    each = both.where(F.col("rejected")).select("row", F.explode("bad").alias("f"))
    return Quarantined(out, both.select(*RATING_COLUMNS), each.select("row", "f.column", "f.reason", "f.raw"))


def reject_counts(read: Quarantined) -> DataFrame:
    """column, reason and number of rejected fields; reads the rejected rows only."""
    return read.rejects.groupBy("column", "reason").agg(F.count(F.lit(1)).alias("fields"))
