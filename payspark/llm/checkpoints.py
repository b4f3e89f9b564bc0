"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where none is set, a temporary one in local mode and an error on a cluster."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif context.master.startswith("local[") or context.master == "local":
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept, partition by partition, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as compressed Parquet and read again."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again; it stays as long as the folder does."""
    return write_table(df, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}")


def files_of(spark: SparkSession, path: str):
    """Hadoop's path and file system of a name."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Scratch:
    """Tables that a job needs on its way, in a folder of their own; ``drop`` deletes them together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/job-{uuid.uuid4().hex}"

    def save(self, df: DataFrame) -> DataFrame:
        return write_table(df, f"{self.folder}/{uuid.uuid4().hex}")

    def drop(self) -> None:
        path, files = files_of(self.spark, self.folder)
        files.delete(path, True)
