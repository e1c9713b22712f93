"""Equi-join of a large side with hot keys to a side with one row per key.

Keys that hold more than ``share`` of the large side's rows are heavy.  There are fewer
than ``1 / share`` of them, however large the input, so their rows of the
other side are a bounded broadcast and the hot rows stay where they are; all
other keys meet by shuffle, where no key has more than that share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of the rows on.
HEAVY_SHARE = 1 / 256


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> list:
    """The values of ``key`` with more than ``share`` of all rows: fewer than ``1 / share``.

    One aggregate (partial counts before the shuffle) after a row count; null is no key.
    """
    if not 0 < share <= 1:
        raise ValueError(f"share must be above 0 and at most 1, got {share}")
    least = df.count() * share
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.where(F.col("n") > F.lit(least)).select(key).collect()]


def join_unique(
    large: DataFrame,
    unique: DataFrame,
    key: str,
    how: str = "inner",
    share: float = HEAVY_SHARE,
    heavy: list | None = None,
) -> DataFrame:
    """``large`` joined on ``key`` to ``unique``, which has at most one row per key.

    ``how`` is ``inner`` or ``left``.  ``large`` is read for the counts and for each of
    the parts, so give a table rather than a long computation; ``heavy`` are the heavy
    keys where they are known already.  Rows without a key meet
    nothing: they are dropped, or kept with nulls in a left join, and never shuffled.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be 'inner' or 'left', got {how!r}")
    heavy = heavy_keys(large, key, share) if heavy is None else heavy
    is_heavy = F.col(key).isin(heavy) if heavy else F.lit(False)
    light = large.where(F.col(key).isNotNull() & ~is_heavy).join(unique, key, how)
    parts = [light]
    if heavy:
        few = unique.where(F.col(key).isin(heavy))  # at most one row per heavy key
        parts.append(large.where(is_heavy).join(F.broadcast(few), key, how))
    if how == "left":
        rest = [c for c in unique.columns if c != key]
        none = [F.lit(None).cast(unique.schema[c].dataType).alias(c) for c in rest]
        parts.append(large.where(F.col(key).isNull()).select(*light.columns[: len(large.columns)], *none))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
