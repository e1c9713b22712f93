"""Train/test splits.

``hash_split`` is the default: each row goes to train or test by a hash of
its key columns and a seed, so the split does not depend on how the input
is partitioned or ordered, needs no shuffle or sort, and rows with equal
keys always fall on the same side.  ``random_split`` keeps Spark's native
``randomSplit`` for runs that want the reference's exact call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schema import ITEM_COL, TIME_COL, USER_COL

DEFAULT_SPLIT_KEYS = (USER_COL, ITEM_COL, TIME_COL)
# The reference splits 80/20 with seed 42.
DEFAULT_FRACTION = 0.8
DEFAULT_SEED = 42


def split_threshold(fraction: float) -> str:
    """Hex text of ``fraction * 2**32``; compared with the first 8 hex digits
    of the md5 (plain string comparison orders equal-width hex correctly)."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError(f"fraction must be in [0, 1], got {fraction}")
    if fraction >= 1.0:
        return "g"  # sorts after every hex digit: all rows train
    return format(int(fraction * 2**32), "08x")


def split_hash(keys: Sequence[str] = DEFAULT_SPLIT_KEYS, seed: int = DEFAULT_SEED) -> Column:
    """First 8 hex digits of md5('k1|k2|...|seed'); NULL keys are skipped."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.substring(F.md5(text.cast("binary")), 1, 8)


def in_train(
    fraction: float = DEFAULT_FRACTION,
    seed: int = DEFAULT_SEED,
    keys: Sequence[str] = DEFAULT_SPLIT_KEYS,
) -> Column:
    return split_hash(keys, seed) < F.lit(split_threshold(fraction))


def hash_split(
    df: DataFrame,
    fraction: float = DEFAULT_FRACTION,
    seed: int = DEFAULT_SEED,
    keys: Sequence[str] = DEFAULT_SPLIT_KEYS,
) -> tuple[DataFrame, DataFrame]:
    """(train, test): disjoint, complete, and independent of partitioning."""
    cond = in_train(fraction, seed, keys)
    return df.where(cond), df.where(~cond)


def label_split(
    df: DataFrame,
    fraction: float = DEFAULT_FRACTION,
    seed: int = DEFAULT_SEED,
    keys: Sequence[str] = DEFAULT_SPLIT_KEYS,
    col: str = "split",
) -> DataFrame:
    """Same split as a column ('train' / 'test') instead of two DataFrames."""
    return df.withColumn(
        col, F.when(in_train(fraction, seed, keys), F.lit("train")).otherwise(F.lit("test"))
    )


def random_split(
    df: DataFrame, fraction: float = DEFAULT_FRACTION, seed: int = DEFAULT_SEED
) -> tuple[DataFrame, DataFrame]:
    """Spark's ``randomSplit([f, 1-f], seed)``: depends on the partitioning."""
    train, test = df.randomSplit([fraction, 1.0 - fraction], seed=seed)
    return train, test
