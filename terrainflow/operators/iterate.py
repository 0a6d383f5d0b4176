"""Shared parts of the iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder of spark.checkpoint.dir; where all tasks run on this machine and it is unset (tests), in one of its own."""
    set_folder(df.sparkSession)
    return df.checkpoint()


def set_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set first where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, for files that executors write and read again."""
    return f"{set_folder(spark)}/{name}-{uuid.uuid4().hex}"
