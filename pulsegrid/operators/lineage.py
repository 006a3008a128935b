"""Folders that all executors share, and cutting of lineage in them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only a local session (tests) may leave it unset and gets a
    new folder of its own; on a cluster a folder of one machine would not do, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or tempfile.mkdtemp(prefix="spark-", dir="/tmp")).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with files in the shared folder, which survive lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)
