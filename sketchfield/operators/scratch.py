"""Cutting lineage at files that outlive any executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the one that ``spark.checkpoint.dir`` names; only a local session gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sketchfield-")
    return f"{found}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as files in the folder that ``spark.checkpoint.dir`` names; only a local session gets one of its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="sketchfield-"))
    return df.checkpoint()


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at a path of ``shared_folder``, with fewer bytes than a checkpoint; for rows that need no order."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
