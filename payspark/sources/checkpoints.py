"""Results that later writes must not change."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where none is set, a temporary one in local mode and an error on a cluster."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = folder or tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return folder or known.get()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder.

    A cached frame would be computed again when a table that it read is
    written.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a folder in the shared one that nothing uses yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
