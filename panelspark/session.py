"""Session helpers: where written intermediates go."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the checkpoint
    folder that the caller set on the context."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return base.rstrip("/")


def name_shared_folder(spark: SparkSession) -> None:
    """For entry points (driver contract, bench): where nothing names a shared folder, a local
    session gets one that is removed at exit. On a cluster the folder has to be named."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="panelspark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh folder for a written intermediate, in the shared folder."""
    return f"{shared_folder(spark)}/panelspark/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a result as Parquet and read it back: cuts lineage and survives executor loss."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
