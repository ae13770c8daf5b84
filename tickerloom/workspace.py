"""Session settings and the shared folder in which intermediate tables are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def settle(spark: SparkSession) -> SparkSession:
    """Pin the one session setting results depend on: dates and epochs are read and shown in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``; the setting is trusted, since a ``file:`` path
    may be a mount that all machines share.

    Only a single-machine (``local[..]``) session may go without the setting; it then gets one folder per
    application. On a cluster a missing setting is an error, since a machine-local folder would be lost with its
    executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = _LOCAL_FOLDERS.get(sc.applicationId)
        if folder is None:
            folder = tempfile.mkdtemp(prefix="tickerloom-")
            _LOCAL_FOLDERS[sc.applicationId] = folder
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses. An application's intermediate tables lie together
    under its id, so they can be removed as one folder when it has ended."""
    application = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/tickerloom/{application}/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the stored copy.

    This cuts lineage like a checkpoint, survives the loss of executors, computes the plan a single time and keeps
    column pruning and filter pushdown for whatever reads the stage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
