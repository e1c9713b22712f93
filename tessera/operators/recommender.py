"""Matrix-factorisation recommender (MLlib ALS) and its scoring.

The solver is MLlib's; this module fixes its parameters (always seeded, with an
explicit block count, since the fit depends on it), and offers the scoring
step as a plain DataFrame join so it can be checked outside MLlib.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.dense_ids import dense_index
from tessera.operators.skew import heavy_keys, join_unique
from tessera.schema import ITEM_COL, RATING_COL, USER_COL
from tessera.session import checkpoint_root, release_unused, shared_path


@dataclass(frozen=True)
class AlsParams:
    # The reference trains rank 10, 10 iterations, reg 0.1,
    # explicit feedback, cold-start rows dropped.
    rank: int = 10
    max_iter: int = 10
    reg_param: float = 0.1
    cold_start_strategy: str = "drop"
    implicit_prefs: bool = False
    alpha: float = 1.0
    nonnegative: bool = False
    # Not set by the reference (MLlib would seed from the class name, which
    # changes per Python process); always seeded here.
    seed: int = 42
    # User and item blocks: tasks of a half-step.  The factors depend on it
    # (they start block by block), so it never follows the cluster; raise it for
    # large inputs.  MLlib's default.
    num_blocks: int = 10
    checkpoint_interval: int = 10
    user_col: str = USER_COL
    item_col: str = ITEM_COL
    rating_col: str = RATING_COL
    extra: dict = field(default_factory=dict, compare=False, hash=False)


def build_als(spark, params: AlsParams = AlsParams()) -> ALS:
    # ALS checkpoints its factor RDDs every ``checkpoint_interval`` iterations
    # when the context has a checkpoint dir; make sure it has the shared one.
    checkpoint_root(spark)
    return ALS(
        rank=params.rank,
        maxIter=params.max_iter,
        regParam=params.reg_param,
        numUserBlocks=params.num_blocks,
        numItemBlocks=params.num_blocks,
        implicitPrefs=params.implicit_prefs,
        alpha=params.alpha,
        nonnegative=params.nonnegative,
        seed=params.seed,
        checkpointInterval=params.checkpoint_interval,
        coldStartStrategy=params.cold_start_strategy,
        userCol=params.user_col,
        itemCol=params.item_col,
        ratingCol=params.rating_col,
        **params.extra,
    )


def drop_unusable(df: DataFrame, params: AlsParams = AlsParams()) -> DataFrame:
    """ALS refuses NULL ids or ratings; drop those rows before fitting."""
    return df.where(
        F.col(params.user_col).isNotNull()
        & F.col(params.item_col).isNotNull()
        & F.col(params.rating_col).isNotNull()
    )


INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def heaviest_share(train: DataFrame, params: AlsParams = AlsParams()) -> DataFrame:
    """Skew report, one row: total rows and the largest row count of a single
    user and of a single item.  MLlib solves each id inside one block, so an id
    with more rows than total / num_blocks makes one task the longest of a
    half-step.  Counts per user and per item come from one grouping-sets
    aggregate (partial counts before the shuffle)."""
    u, i = params.user_col, params.item_col
    per_key = train.groupingSets([[u], [i]], u, i).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")
    )
    by_user = F.col("g") == F.lit(1)  # item aggregated away
    by_item = F.col("g") == F.lit(2)  # user aggregated away
    return per_key.agg(
        F.coalesce(F.sum(F.when(by_user, F.col("n"))), F.lit(0)).alias("total"),
        F.max(F.when(by_user, F.col("n"))).alias("top_user"),
        F.max(F.when(by_item, F.col("n"))).alias("top_item"),
    )


def ids_fit_int(train: DataFrame, params: AlsParams = AlsParams()) -> bool:
    """Whether MLlib takes the ids as they are; no rows at all are an error."""
    u, i = params.user_col, params.item_col
    row = train.agg(
        F.min(F.least(F.col(u), F.col(i))).cast("bigint").alias("low"),
        F.max(F.greatest(F.col(u), F.col(i))).cast("bigint").alias("high"),
    ).first()
    if row["low"] is None:
        raise ValueError("no training rows (after dropping NULL ids and ratings)")
    return INT_MIN <= row["low"] and row["high"] <= INT_MAX


@dataclass(frozen=True)
class IndexedModel:
    """A model fitted on dense numbers, with the ids they stand for; factors carry the ids."""

    model: ALSModel
    users: DataFrame  # id, index
    items: DataFrame
    user_col: str
    item_col: str

    @property
    def rank(self) -> int:
        return self.model.rank

    @property
    def userFactors(self) -> DataFrame:
        return _named(self.model.userFactors, self.users)

    @property
    def itemFactors(self) -> DataFrame:
        return _named(self.model.itemFactors, self.items)


def _named(factors: DataFrame, index: DataFrame) -> DataFrame:
    by_index = factors.select(F.col("id").cast("bigint").alias("index"), "features")
    return index.join(by_index, "index").select("id", "features")


def fit_indexed(data: DataFrame, params: AlsParams = AlsParams()) -> IndexedModel:
    """Fit on usable rows with ids of any size: both id columns are replaced by dense numbers.

    The numbers are ranks, so the fit does not depend on partitions.  A user or item with a
    large share of the rows gets its number by a bounded broadcast.  The numbered rows are written to the
    shared folder, so that the exchanges of these joins are off the disks before those of the fit are on them."""
    u, i = params.user_col, params.item_col
    spark = data.sparkSession
    users, items = dense_index(data, u), dense_index(data, i)
    for side, index in ((u, users), (i, items)):
        most = index.agg(F.max("index")).first()[0]
        if most > INT_MAX:
            raise ValueError(f"{most + 1} distinct values of {side}: MLlib ALS numbers at most {INT_MAX + 1}")
    heavy = {c: heavy_keys(data, c) for c in (u, i)}
    for c, index in ((u, users), (i, items)):
        number = index.select(F.col("id").alias(c), F.col("index").cast("int").alias(f"_{c}_index"))
        data = join_unique(data, number, c, heavy=heavy[c])
    dense = data.select(F.col(f"_{u}_index").alias(u), F.col(f"_{i}_index").alias(i), params.rating_col)
    path, schema = shared_path(spark, "dense-ratings", uuid.uuid4().hex), dense.schema
    dense.write.parquet(path)
    del data, dense
    release_unused(spark, wait=1.5)
    model = build_als(spark, params).fit(spark.read.schema(schema).parquet(path))
    return IndexedModel(model, users, items, u, i)


def fit(train: DataFrame, params: AlsParams = AlsParams()) -> tuple[ALSModel | IndexedModel, float]:
    """Fit on ``train`` (only the three columns used are passed on).

    Ids beyond int are numbered densely first, which gives an :class:`IndexedModel`."""
    cols = [params.user_col, params.item_col, params.rating_col]
    data = drop_unusable(train.select(*cols), params)
    start = time.perf_counter()
    if ids_fit_int(data, params):
        model = build_als(train.sparkSession, params).fit(data)
    else:
        model = fit_indexed(data, params)
    return model, time.perf_counter() - start


def user_residual(
    model: ALSModel | IndexedModel, train: DataFrame, params: AlsParams = AlsParams()
) -> DataFrame:
    """``id`` and ``residual`` per user: the largest entry, in absolute value, of
    ``(V'V + reg * n * I) u - V'r`` over the user's n ratings.

    ``V'(Vu - r)`` needs no matrix: per rating the error times the item's vector,
    summed per user.  Close to 0 for the side that the fit solved last.  Ratings meet their users
    last, so that they are summed where they met, in the order of that join."""
    u = model.userFactors.select(F.col("id").alias(params.user_col), F.col("features").alias("_u"))
    v = model.itemFactors.select(F.col("id").alias(params.item_col), F.col("features").alias("_v"))
    data = drop_unusable(train.select(params.user_col, params.item_col, params.rating_col), params)
    met = data.join(v, params.item_col).join(u, params.user_col)
    met = met.withColumn("_e", dot(F.col("_u"), F.col("_v")) - F.col(params.rating_col).cast("double"))
    parts = [F.sum(F.col("_e") * F.get("_v", F.lit(k)).cast("double")).alias(f"g{k}") for k in range(model.rank)]
    shrink = F.lit(params.reg_param) * F.col("_n")
    per_user = met.groupBy(params.user_col).agg(F.count(F.lit(1)).alias("_n"), F.first("_u").alias("_u"), *parts)
    entries = [F.abs(F.col(f"g{k}") + shrink * F.get("_u", F.lit(k)).cast("double")) for k in range(model.rank)]
    return per_user.select(F.col(params.user_col).alias("id"), F.array_max(F.array(*entries)).alias("residual"))


def predict(model: ALSModel | IndexedModel, df: DataFrame) -> DataFrame:
    """Input rows plus ``prediction``; cold-start rows dropped per the model.

    Rows with a NULL user or item cannot be scored (MLlib refuses them):
    they are dropped like cold-start rows, or kept with a NaN prediction
    under the ``nan`` strategy.  Column types are those of ``df`` (MLlib
    hands ids back as int)."""
    if isinstance(model, IndexedModel):
        return predict_by_id(model, df)
    strategy = model.getColdStartStrategy()
    user_col, item_col = model.getUserCol(), model.getItemCol()
    known = F.col(user_col).isNotNull() & F.col(item_col).isNotNull()
    out = model.transform(df.where(known))
    out = out.select(
        *[F.col(c).cast(df.schema[c].dataType).alias(c) for c in df.columns],
        F.col("prediction").cast("float").alias("prediction"),
    )
    if strategy != "drop":
        nan = F.lit(float("nan")).cast("float").alias("prediction")
        out = out.unionByName(df.where(~known).select(*df.columns, nan))
    return out


def predict_by_id(model: IndexedModel, df: DataFrame) -> DataFrame:
    """:func:`predict` for ids of any size: rows meet the factors by id, so the dense numbers
    are looked up per factor and not per row."""
    u, i = model.user_col, model.item_col
    if model.model.getColdStartStrategy() == "drop":
        out = score_vectors(df, model.userFactors, model.itemFactors, u, i)
    else:
        users = model.userFactors.select(F.col("id").alias(u), F.col("features").alias("_u"))
        items = model.itemFactors.select(F.col("id").alias(i), F.col("features").alias("_i"))
        met = df.join(users, u, "left").join(items, i, "left")
        out = met.withColumn("prediction", F.coalesce(dot(F.col("_u"), F.col("_i")), F.lit(float("nan"))))
    return out.select(*df.columns, F.col("prediction").cast("float").alias("prediction"))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two float arrays in double, summed left to right."""
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + v)


def score_vectors(
    pairs: DataFrame,
    user_factors: DataFrame,
    item_factors: DataFrame,
    user_col: str = USER_COL,
    item_col: str = ITEM_COL,
    id_col: str = "id",
    vec_col: str = "features",
    out_col: str = "prediction",
    heavy_share: float | None = None,
) -> DataFrame:
    """Each pair meets its user and item vector; score = their dot product.

    Inner joins, so pairs without a vector on either side drop out, like
    the cold-start rule.  Factor tables hold one row per id and grow with
    the number of users and items, so neither side is forced to broadcast;
    a user or item with a large share of the pairs is split by AQE's skew
    join handling, or, with ``heavy_share``, never shuffled: ids above that
    share of the pairs get their vectors by a bounded broadcast (one row
    per id in each factor table; counts run when the plan is made).
    """
    u = user_factors.select(F.col(id_col).alias(user_col), F.col(vec_col).alias("_u"))
    i = item_factors.select(F.col(id_col).alias(item_col), F.col(vec_col).alias("_i"))
    if heavy_share is None:
        met = pairs.join(u, user_col).join(i, item_col)
    else:
        # both counts are over the pairs, and the filter on heavy items passes below the user join
        users, items = (heavy_keys(pairs, c, heavy_share) for c in (user_col, item_col))
        met = join_unique(join_unique(pairs, u, user_col, heavy=users), i, item_col, heavy=items)
    return (
        met
        .withColumn(out_col, dot(F.col("_u"), F.col("_i")))
        .drop("_u", "_i")
    )


def cold_start_kept(
    train: DataFrame, test: DataFrame, user_col: str = USER_COL, item_col: str = ITEM_COL
) -> DataFrame:
    """Test rows whose user and item both occur in training (what
    ``coldStartStrategy='drop'`` keeps), as two left-semi joins."""
    return test.join(train.select(user_col), user_col, "left_semi").join(
        train.select(item_col), item_col, "left_semi"
    ).select(*test.columns)
