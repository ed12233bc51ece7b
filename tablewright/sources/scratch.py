"""Durable intermediate results in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def has_scratch(spark: SparkSession) -> bool:
    """Whether intermediate results have a place: a folder that is named, or a temporary one of a local session."""
    context = spark.sparkContext
    return bool(spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()) or context.master.startswith("local")


def scratch_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for a local session without it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tablewright-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, stem: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_folder(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The table written out once, so that later steps see the same rows in the same partitions."""
    scratch_folder(df.sparkSession)
    return df.checkpoint(eager=True)
