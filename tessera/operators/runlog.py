"""Run reports from Spark event logs: jobs, cached storage, spill.

Each report parses only the event type it needs, with a narrow JSON
schema, and reduces by key with aggregates that combine partially before
any shuffle (``max_by`` for "latest state"), so a long log is split over
many tasks and no key's lines need to sit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.eventlog import events_of, position

BYTES_PER_MB = 1024 * 1024


def bytes_to_mb(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double") / F.lit(float(BYTES_PER_MB))


_JOB_START = T.StructType(
    [
        T.StructField("Job ID", T.IntegerType()),
        T.StructField("Submission Time", T.LongType()),
        T.StructField("Stage IDs", T.ArrayType(T.IntegerType())),
        T.StructField("Properties", T.MapType(T.StringType(), T.StringType())),
    ]
)
_JOB_END = T.StructType(
    [
        T.StructField("Job ID", T.IntegerType()),
        T.StructField("Completion Time", T.LongType()),
        T.StructField(
            "Job Result",
            T.StructType(
                [
                    T.StructField("Result", T.StringType()),
                    T.StructField(
                        "Exception", T.StructType([T.StructField("Message", T.StringType())])
                    ),
                ]
            ),
        ),
    ]
)
_TASK_END = T.StructType(
    [
        T.StructField("Stage ID", T.IntegerType()),
        T.StructField("Stage Attempt ID", T.IntegerType()),
        T.StructField(
            "Task Metrics",
            T.StructType(
                [
                    T.StructField("Memory Bytes Spilled", T.LongType()),
                    T.StructField("Disk Bytes Spilled", T.LongType()),
                ]
            ),
        ),
    ]
)
_BLOCK_UPDATED = T.StructType(
    [
        T.StructField(
            "Block Updated Info",
            T.StructType(
                [
                    T.StructField(
                        "Block Manager ID",
                        T.StructType([T.StructField("Executor ID", T.StringType())]),
                    ),
                    T.StructField("Block ID", T.StringType()),
                    T.StructField("Memory Size", T.LongType()),
                    T.StructField("Disk Size", T.LongType()),
                ]
            ),
        )
    ]
)
_UNPERSIST = T.StructType([T.StructField("RDD ID", T.IntegerType())])
_BM_REMOVED = T.StructType(
    [
        T.StructField(
            "Block Manager ID", T.StructType([T.StructField("Executor ID", T.StringType())])
        )
    ]
)
_STAGE_SUBMITTED = T.StructType(
    [
        T.StructField(
            "Stage Info",
            T.StructType(
                [
                    T.StructField(
                        "RDD Info",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("RDD ID", T.IntegerType()),
                                    T.StructField("Name", T.StringType()),
                                ]
                            )
                        ),
                    )
                ]
            ),
        )
    ]
)

# Job result names in the log and the status they map to.
JOB_SUCCEEDED = "JobSucceeded"
RDD_BLOCK = r"^rdd_(\d+)_(\d+)$"


def _parsed(log: DataFrame, event: str, schema: T.StructType) -> DataFrame:
    return events_of(log, event).select(
        "app_id", "file_index", "block_start", "row_in_split",
        F.from_json("line", schema).alias("e"),
    )


def eventlog_jobs(log: DataFrame) -> DataFrame:
    """One row per job: status (SUCCEEDED, FAILED, or RUNNING when the log
    has no end for it), stage ids, job group, times and failure message."""
    starts = _parsed(log, "SparkListenerJobStart", _JOB_START).select(
        "app_id",
        F.col("e.`Job ID`").alias("job_id"),
        F.col("e.`Stage IDs`").alias("stage_ids"),
        F.col("e.Properties").getItem("spark.jobGroup.id").alias("job_group"),
        F.col("e.`Submission Time`").alias("submission_time"),
    )
    ends = _parsed(log, "SparkListenerJobEnd", _JOB_END).select(
        "app_id",
        F.col("e.`Job ID`").alias("job_id"),
        F.col("e.`Completion Time`").alias("completion_time"),
        F.col("e.`Job Result`.Result").alias("result"),
        F.col("e.`Job Result`.Exception.Message").alias("error"),
    )
    j = starts.join(ends, ["app_id", "job_id"], "left")
    status = (
        F.when(F.col("result").isNull(), F.lit("RUNNING"))
        .when(F.col("result") == F.lit(JOB_SUCCEEDED), F.lit("SUCCEEDED"))
        .otherwise(F.lit("FAILED"))
    )
    return j.select(
        "app_id",
        "job_id",
        status.alias("status"),
        "stage_ids",
        "job_group",
        "submission_time",
        "completion_time",
        (F.col("completion_time") - F.col("submission_time")).alias("duration_ms"),
        "error",
    )


def first_jobs(jobs: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` jobs by id per application (the short listing).

    ``row_number() <= n`` lets Spark keep a partial top-n in every map task
    before the shuffle (a partial window group limit), so an application
    with millions of jobs sends n rows per task, not all of them."""
    from pyspark.sql import Window

    w = Window.partitionBy("app_id").orderBy("job_id")
    return jobs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def jobs_by_group(jobs: DataFrame) -> DataFrame:
    """Jobs per job group (the phase label): counts by status and time."""
    return jobs.groupBy("app_id", "job_group").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count(F.when(F.col("status") == "SUCCEEDED", 1)).alias("succeeded"),
        F.count(F.when(F.col("status") == "FAILED", 1)).alias("failed"),
        F.count(F.when(F.col("status") == "RUNNING", 1)).alias("running"),
        F.sum("duration_ms").alias("duration_ms"),
    )


def eventlog_storage(log: DataFrame) -> DataFrame:
    """Cached RDDs at the end of the log: partitions, memory MB, disk MB.

    The latest update per (block, executor) wins; blocks whose RDD was
    unpersisted, or whose executor's block manager was removed (a lost
    executor takes its blocks with it, and the log has no per-block event
    for that), after that update are gone; non-RDD blocks (broadcast,
    shuffle) are ignored.

    A log that names its settings but was written without
    ``spark.eventLog.logBlockUpdates.enabled`` has no such updates: an error.
    """
    setting = F.get_json_object("line", "$['Spark Properties']['spark.eventLog.logBlockUpdates.enabled']")
    logged = events_of(log, "SparkListenerEnvironmentUpdate").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.lower(setting) == "true").alias("on")
    ).first()
    if logged["n"] and not logged["on"]:
        raise ValueError("block updates are not logged (spark.eventLog.logBlockUpdates.enabled)")
    upd = _parsed(log, "SparkListenerBlockUpdated", _BLOCK_UPDATED).select(
        "app_id",
        position().alias("pos"),
        F.col("e.`Block Updated Info`.`Block ID`").alias("block_id"),
        F.col("e.`Block Updated Info`.`Block Manager ID`.`Executor ID`").alias("executor_id"),
        F.col("e.`Block Updated Info`.`Memory Size`").alias("mem"),
        F.col("e.`Block Updated Info`.`Disk Size`").alias("disk"),
    ).where(F.col("block_id").rlike(RDD_BLOCK))
    latest = upd.groupBy("app_id", "block_id", "executor_id").agg(
        F.max("pos").alias("pos"),
        F.max_by(F.struct("mem", "disk"), "pos").alias("size"),
    )
    unpersisted = (
        _parsed(log, "SparkListenerUnpersistRDD", _UNPERSIST)
        .select("app_id", F.col("e.`RDD ID`").alias("rdd_id"), position().alias("pos"))
        .groupBy("app_id", "rdd_id")
        .agg(F.max("pos").alias("unpersist_pos"))
    )
    blocks = latest.select(
        "app_id",
        "executor_id",
        F.regexp_extract("block_id", RDD_BLOCK, 1).cast("int").alias("rdd_id"),
        F.regexp_extract("block_id", RDD_BLOCK, 2).cast("int").alias("partition"),
        "pos",
        F.col("size.mem").alias("mem"),
        F.col("size.disk").alias("disk"),
    )
    removed = (
        _parsed(log, "SparkListenerBlockManagerRemoved", _BM_REMOVED)
        .select(
            "app_id",
            F.col("e.`Block Manager ID`.`Executor ID`").alias("executor_id"),
            position().alias("pos"),
        )
        .groupBy("app_id", "executor_id")
        .agg(F.max("pos").alias("removed_pos"))
    )
    live = (
        blocks.join(unpersisted, ["app_id", "rdd_id"], "left")
        .join(removed, ["app_id", "executor_id"], "left")
        .where(F.col("unpersist_pos").isNull() | (F.col("pos") > F.col("unpersist_pos")))
        .where(F.col("removed_pos").isNull() | (F.col("pos") > F.col("removed_pos")))
        .where((F.col("mem") > 0) | (F.col("disk") > 0))
    )
    per_rdd = live.groupBy("app_id", "rdd_id").agg(
        F.count_distinct("partition").alias("num_partitions"),
        F.sum("mem").alias("memory_bytes"),
        F.sum("disk").alias("disk_bytes"),
    )
    names = (
        _parsed(log, "SparkListenerStageSubmitted", _STAGE_SUBMITTED)
        .select("app_id", F.inline("e.`Stage Info`.`RDD Info`"))
        .groupBy("app_id", F.col("RDD ID").alias("rdd_id"))
        .agg(F.max("Name").alias("name"))
    )
    return per_rdd.join(names, ["app_id", "rdd_id"], "left").select(
        "app_id",
        "rdd_id",
        "name",
        "num_partitions",
        bytes_to_mb("memory_bytes").alias("memory_used_mb"),
        bytes_to_mb("disk_bytes").alias("disk_used_mb"),
    )


def eventlog_spill(log: DataFrame) -> DataFrame:
    """Per stage attempt: tasks, bytes spilled in memory and on disk."""
    t = _parsed(log, "SparkListenerTaskEnd", _TASK_END)
    return t.groupBy(
        "app_id",
        F.col("e.`Stage ID`").alias("stage_id"),
        F.col("e.`Stage Attempt ID`").alias("stage_attempt"),
    ).agg(
        F.count(F.lit(1)).alias("tasks"),
        F.coalesce(F.sum("e.`Task Metrics`.`Memory Bytes Spilled`"), F.lit(0).cast("long")).alias(
            "memory_bytes_spilled"
        ),
        F.coalesce(F.sum("e.`Task Metrics`.`Disk Bytes Spilled`"), F.lit(0).cast("long")).alias(
            "disk_bytes_spilled"
        ),
    )
