"""Spark event logs as a DataFrame of JSON lines.

Reads plain (uncompressed) logs, single-file or rolling
(``eventlog_v2_<app>/events_<n>_<app>``).  Each line keeps its position
in the log -- application, file index, split start, row within split --
because some events (block updates) carry no timestamp and only their
order says which came last.  Compressed logs use Spark's own codec
framing, which the text reader cannot open; decompress them first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File-name patterns of Spark event logs.
ROLLING_FILE = r"^events_(\d+)_(.+?)(\.inprogress)?$"
SINGLE_FILE = r"^(.+?)(\.inprogress)?$"
STATUS_FILE_PREFIX = "appstatus_"


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """``app_id, file_index, block_start, row_in_split, line`` per log line.

    ``path`` may be a log file, a rolling-log directory, a directory of
    logs, or a glob.  Order within the log is
    ``(app_id, file_index, block_start, row_in_split)``.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    name = F.col("_metadata.file_name")
    rolling = name.rlike(ROLLING_FILE)
    return (
        raw.where(~name.startswith(STATUS_FILE_PREFIX) & ~name.endswith(".crc"))
        .select(
            F.when(rolling, F.regexp_extract(name, ROLLING_FILE, 2))
            .otherwise(F.regexp_extract(name, SINGLE_FILE, 1))
            .alias("app_id"),
            F.when(rolling, F.regexp_extract(name, ROLLING_FILE, 1).cast("int"))
            .otherwise(F.lit(0))
            .alias("file_index"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("row_in_split"),
            F.col("value").alias("line"),
        )
    )


def events_of(log: DataFrame, event: str) -> DataFrame:
    """Lines of one event type (a cheap text test first, then the parsed name)."""
    return log.where(F.col("line").contains(f'"{event}"')).where(
        F.get_json_object("line", "$.Event") == F.lit(event)
    )


def position(prefix: str = "") -> Column:
    """Sortable position of a line in its application's log."""
    return F.struct(
        F.col(f"{prefix}file_index").alias("file_index"),
        F.col(f"{prefix}block_start").alias("block_start"),
        F.col(f"{prefix}row_in_split").alias("row_in_split"),
    )


def session_event_log_path(spark: SparkSession) -> str | None:
    """Where this session writes its own event log, if logging is on."""
    conf = spark.sparkContext.getConf()
    if conf.get("spark.eventLog.enabled", "false").lower() != "true":
        return None
    base = conf.get("spark.eventLog.dir", "file:/tmp/spark-events").rstrip("/")
    return f"{base}/*{spark.sparkContext.applicationId}*"
