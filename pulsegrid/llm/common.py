"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step inside a Python worker handles at a time (one row may be longer).
CHUNK_BYTES = 2 << 20
#: Rows that such a step handles at most, however short they are.
CHUNK_ROWS = 8192


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``. Only a local session (tests) may leave it unset
    and gets a new folder of its own; on a cluster a folder of one machine would not do, so that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with files in the shared checkpoint folder, which survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of all texts, counted (estimates of the optimiser don't exist for every kind of input)."""
    return df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most ``rows`` rows with at most ``limit`` bytes of text each (one row at least)."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text))
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
    begin = 0
    while begin < batch.num_rows:
        base = ends[begin - 1] if begin else 0
        end = min(begin + rows, max(begin + 1, int(np.searchsorted(ends, base + limit, side="right"))))
        yield batch.slice(begin, end - begin)
        begin = end


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges(a, b)`` with the smallest node of its component: ``(node, root)``.

    Alternating large-star and small-star steps, each a min-aggregate and an equi-join, until no edge changes;
    the number of rounds grows with the logarithm of the longest chain. Each round ends in a checkpoint.
    Rows with a null end and self-loops are ignored. An empty input gives an empty result.
    """

    def star(both: DataFrame, keep) -> DataFrame:
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(low, "u").where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))

    def told(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = checkpointed(edges), None
    while (now := told(edges)) != before and now[0]:
        before = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both, "v > u").where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = checkpointed(small.where("a <> b").distinct())
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
