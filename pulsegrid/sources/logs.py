"""Log files as records with typed fields: patterns with named groups, records of several lines, one summary for each log."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records of a search log and what its file name says (fixed formats).
BLOCK = r"(?s)Time\].*?load=(?P<load>[0-9.]+)s\s.*?freq_ds\+norm=(?P<prepare>[0-9.]+)s\s+dedisp=(?P<dedisp>[0-9.]+)s\s+detect\+save=(?P<detect>[0-9.]+)s\s+total=(?P<total>[0-9.]+)s\s.*?bursts=(?P<bursts>\d+)"
DONE = r"(?s)Done\] total_bursts=(?P<total_bursts>\d+)\s+total_time=(?P<total_time>[0-9.]+)s\s+avg_per_block=(?P<avg_per_block>[0-9.]+)s"
FAILED = r"(?s)Traceback|^Fail\]"
NAME = r"s(?P<section>\d+)_(?P<backend>cupy|numba)_(?P<model>.+)\.log$"
KINDS = {"bursts": "long", "total_bursts": "long", "section": "int"} | dict.fromkeys(("load", "prepare", "dedisp", "detect", "total", "total_time", "avg_per_block"), "double")


def compiled(pattern: str) -> tuple[str, dict[str, int]]:
    """A pattern without its groups' names, which the JVM doesn't take in this form, and the number of each name."""
    names = dict(re.compile(pattern).groupindex)
    plain = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{names[m[1]]}", re.sub(r"\(\?P<\w+>", "(", pattern))
    return plain, names


def fields(text: Column, pattern: str, kinds: Mapping[str, str] = KINDS) -> dict[str, Column]:
    """A column for each named group: its text at the first match, cast to its kind (text by default). Null without a match,
    and where the text is none of its kind."""
    plain, names = compiled(pattern)
    found = {n: F.when(text.rlike(plain), F.regexp_extract(text, plain, i)) for n, i in names.items()}
    return {n: c.try_cast(kinds[n]) if n in kinds else c for n, c in found.items()}


def read_records(spark: SparkSession, path: str, glob: str = "*.log", start: str = "[") -> DataFrame:
    """``(path, record, place)``: the records of log files, each from a line that begins with ``start`` up to the next such
    line (without ``start`` itself); lines before the first one are a record of their own. ``place`` grows along a file.

    The line reader splits files at line breaks followed by ``start``, so a long log is read by many tasks."""
    lines = spark.read.option("lineSep", f"\n{start}").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value"), place.alias("place"))
    return rows.select("path", F.when(F.col("value").startswith(start), F.substring("value", len(start) + 1, 1 << 30)).otherwise(F.col("value")).alias("record"), "place")


def summarise(records: DataFrame) -> DataFrame:
    """One row for each log whose name fits: ``(section, backend, model, status, blocks, total_time, avg_per_block,
    total_bursts, block_bursts, <stage>_avg ...)``.

    Averages run over the log's block records (0 without any); totals are those of its last closing record. The status is
    ``ok`` with a closing record, else ``failed`` if it tells of an error, else ``missing_done``."""
    block, done = fields(F.col("record"), BLOCK), fields(F.col("record"), DONE)
    parsed = records.select("path", "place", F.struct(*(c.alias(n) for n, c in block.items())).alias("b"), F.struct(*(c.alias(n) for n, c in done.items())).alias("d"), F.col("record").rlike(FAILED).alias("failed"))
    is_block, is_done = F.col("b.total").isNotNull() & F.col("b.bursts").isNotNull(), F.col("d.total_time").isNotNull()
    stages = ("load", "prepare", "dedisp", "detect", "total")
    per_log = parsed.groupBy("path").agg(
        F.count_if(is_block).alias("blocks"), *(F.sum(F.when(is_block, F.col(f"b.{s}"))).alias(f"{s}_sum") for s in stages), F.coalesce(F.sum(F.when(is_block, F.col("b.bursts"))), F.lit(0)).alias("block_bursts"),
        F.max_by(F.when(is_done, F.col("d")), F.when(is_done, F.col("place"))).alias("d"), F.max("failed").alias("failed"),
    )
    name = fields(F.regexp_extract("path", r"([^/]*)$", 1), NAME)
    status = F.when(F.col("d.total_time").isNotNull(), "ok").when(F.col("failed"), "failed").otherwise("missing_done")
    averages = [(F.coalesce(F.col(f"{s}_sum"), F.lit(0.0)) / F.greatest("blocks", F.lit(1))).alias(f"{'block_total' if s == 'total' else s}_avg") for s in stages]
    return per_log.select(*(c.alias(n) for n, c in name.items()), status.alias("status"), "blocks", "d.total_time", "d.avg_per_block", "d.total_bursts", "block_bursts", *averages).where("section is not null")


def matrix(logs: DataFrame) -> DataFrame:
    """``(backend, model, sections, wall_est, avg_block, avg_dedisp, avg_detect)`` over the logs that ended well: the longest
    total is the wall time of sections that ran side by side. Without any such log ``sections`` is 0 and the rest null."""
    good = F.col("status") == "ok"
    mean = lambda c: F.avg(F.when(good, F.col(c)))
    return logs.groupBy("backend", "model").agg(F.count_if(good).alias("sections"), F.max(F.when(good, F.col("total_time"))).alias("wall_est"), mean("avg_per_block").alias("avg_block"), mean("dedisp_avg").alias("avg_dedisp"), mean("detect_avg").alias("avg_detect"))
