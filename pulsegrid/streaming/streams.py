"""Structured Streaming forms of the append-only manifest and of event building."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str, files_per_trigger: int) -> DataFrame:
    """The Parquet files at ``path`` as a stream."""
    path = path.rstrip("/")
    # a glob that only the path itself fits lets the file source take a single file as well as a directory of files
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def append_all(spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame], files_per_trigger: int = 8) -> DataFrame:
    """Stream the Parquet files at ``path`` that are there now through ``transform`` into an append-only Parquet table, and read that.

    The stream's progress and the table are in the shared folder, so a restarted query goes on where it stopped."""
    out = shared_folder(spark, "manifest")
    flow = transform(source(spark, path, files_per_trigger))
    flow.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-progress").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(flow.schema).parquet(out)


def session_events(frame: DataFrame, time: str, keys: list[str], gap: str, late: str | None) -> DataFrame:
    """Events of a candidate stream: sessions of each key, closed when the watermark passes ``gap`` behind their last row.

    ``late`` bounds how far out of order rows may come; it should be at least the gap. Without it (tables that
    are there as a whole) no row is late and all sessions are closed."""
    timed = frame.withColumn("_t", F.col(time).cast("timestamp"))
    timed = timed if late is None else timed.withWatermark("_t", late)
    grouped = timed.groupBy(F.session_window("_t", gap).alias("w"), *keys).agg(F.count("*").alias("event_size"), F.max("value").alias("strongest"))
    return grouped.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_size", "strongest")


def whole_sessions(spark: SparkSession, path: str, time: str, keys: list[str], gap: str) -> DataFrame:
    """All sessions of the files at ``path``: the rows are streamed into an append-only table in any order, and sessions built over it as a whole."""
    return session_events(append_all(spark, path, lambda frame: frame.select(time, *keys, "value")), time, keys, gap, None)
