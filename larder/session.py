"""Session defaults and the two session-level helpers the operators need."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the split costs another shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    # Recording the Python call site of every column call costs more than planning does.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "larder", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults the operators are written for.

    On a cluster leave ``master`` unset; shuffle partitions are then the cluster's business
    (AQE coalesces), so nothing here fixes a partition count.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder, for a result that is read many times."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    """The folder for rows that all executors read again.

    It is the one the cluster names in ``spark.checkpoint.dir``. Without one there is nothing
    that all executors share: on a cluster that is an error; in local mode, where all threads share a
    disk, the rows come from a folder in the session's warehouse.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return context.getCheckpointDir()
