"""The ratings data model."""

from pyspark.sql import types as T

# The ratings input layout (column names, order and types).
USER_COL = "userId"
ITEM_COL = "movieId"
RATING_COL = "rating"
TIME_COL = "timestamp"
RATING_COLUMNS = (USER_COL, ITEM_COL, RATING_COL, TIME_COL)

RATINGS_SCHEMA = T.StructType(
    [
        T.StructField(USER_COL, T.IntegerType(), True),
        T.StructField(ITEM_COL, T.IntegerType(), True),
        T.StructField(RATING_COL, T.FloatType(), True),
        T.StructField(TIME_COL, T.LongType(), True),
    ]
)

# Spark SQL type names used when a column is cast by name.
RATING_TYPES = {USER_COL: "int", ITEM_COL: "int", RATING_COL: "float", TIME_COL: "bigint"}
