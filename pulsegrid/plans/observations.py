"""Driver queries over the observation data source: files written from the tables, read with pushed filters, rewritten in place and packed."""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import signals as S
from ..sources import observations as O
from ..sources import psrfits
from ..streaming.streams import shared_folder
from .files import _SHAPES
from .proxies import SPEC, spec
from .registry import query

#: Sums of both polarizations; odd files hold their channels from the highest frequency down, with an axis that says so.
_POL = "((CAST(floor(v / {}::DOUBLE) AS BIGINT) % 256) + 256) % 256"
_SUMS = f"(SELECT t // 128 AS file, t % 128 AS t, chan, {_POL.format(1)} + {_POL.format(256)} AS v FROM {SPEC})"
_MHZ = "1000.0::DOUBLE + chan * 7.8125::DOUBLE"


def _files(spark, sf_dir):
    """Observations of 128 samples, 64 channels and two polarizations with frequency axes, offsets and scales."""
    root = shared_folder(spark, "observations")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, number = pdf["t"].to_numpy() - pdf["t"].min(), int(pdf["t"].iloc[0]) // 128
        x, axis = np.zeros((t.max() + 1, 2, 64), np.uint8), 1000.0 + np.arange(64) * 7.8125
        for p in range(2):
            x[t, p, pdf["chan"]] = pdf["v"].to_numpy() // 256**p % 256
        if number % 2:
            x, axis = x[:, :, ::-1], axis[::-1]
        content = psrfits.encode(x, nsblk=gcd(len(x), 32 >> number % 3), tbin_s=100e-6, axis=axis, scales=True)
        return pd.DataFrame({"path": [f"{root}/file_{number:07d}.fits"], "content": [content]})

    rows = spec(spark, sf_dir).groupBy(F.expr("t div 128")).applyInPandas(run, "path string, content binary")
    psrfits.write_files(rows).agg(F.sum("bytes")).first()
    return root


def _number(name: str = "file"):
    return F.regexp_extract(name, r"_(\d+)(?:\.fits)?$", 1).cast("long").alias("file")


@query("observation_window", f"SELECT file, t, chan, {_MHZ} AS freq_mhz, v / 2.0::DOUBLE AS v FROM {_SUMS} WHERE t BETWEEN 20 AND 70 AND chan >= 5 AND chan < 37")
def observation_window(spark, sf_dir):
    """A window of time and channels of all files; only its rows are read."""
    rows = O.read(spark, _files(spark, sf_dir), stretch_bytes=1 << 14)
    return rows.where("t between 20 and 70 and chan >= 5 and chan < 37").withColumn("file", _number())


@query("observation_pooled", f"SELECT file, t // 3 AS t, chan, {_MHZ} AS freq_mhz, round(avg(v / 2.0::DOUBLE), 6) AS v FROM {_SUMS} JOIN (SELECT file, n FROM {_SHAPES}) USING (file) WHERE t < n // 3 * 3 GROUP BY ALL")
def observation_pooled(spark, sf_dir):
    """All files pooled by the rates that their headers give: three samples, no channels."""
    return O.read(spark, _files(spark, sf_dir), stretch_bytes=1 << 14, pooled=True).withColumns({"file": _number(), "v": F.round("v", 6)})


@query("rows_in_place", f"SELECT file, t, chan, {_MHZ} AS freq_mhz, CASE WHEN t // nsblk % 2 = 0 THEN 255 - v / 2.0::DOUBLE ELSE v / 2.0::DOUBLE END AS v FROM {_SUMS} JOIN {_SHAPES} USING (file)")
def rows_in_place(spark, sf_dir):
    """Every other table row of each file is turned round (255 - level) in a copy of the file."""
    old, new = _files(spark, sf_dir), shared_folder(spark, "turned")

    def turned(batches):
        for batch in batches:
            data = [bytes(255 - np.frombuffer(x.as_py(), np.uint8)) for x in batch.column("data")]
            yield pa.record_batch([batch.column("file"), batch.column("row"), pa.array(data, pa.binary())], names=["file", "row", "data"])

    rows = psrfits.read_blocks(spark, old, range_bytes=1 << 14).where("row % 2 = 0").select(F.regexp_extract("path", r"([^/]+)\.fits$", 1).alias("file"), "row", "data")
    O.write(rows.mapInArrow(turned, "file string, row int, data binary"), new, old)
    return O.read(spark, new, stretch_bytes=1 << 14).withColumn("file", _number())


@query("packed_files", f"""WITH h AS (SELECT file, chan, v, count(*) AS n FROM {_SUMS} GROUP BY ALL), c AS (SELECT file, chan, v, sum(n) OVER (PARTITION BY file, chan ORDER BY v) AS cdf, sum(n) OVER (PARTITION BY file, chan) AS total FROM h),
q AS (SELECT file, chan, min(v) FILTER (cdf > total * 0.25) AS q1, min(v) FILTER (cdf > total * 0.5) AS q2, min(v) FILTER (cdf > total * 0.75) AS q3 FROM c GROUP BY ALL)
SELECT file, t, chan, CAST((v > q1)::INT + (v > q2)::INT + (v > q3)::INT AS DOUBLE) AS v FROM {_SUMS} JOIN q USING (file, chan)""")
def packed_files(spark, sf_dir):
    """The files' two-bit set: quartile levels of each file and channel, packed into files with headers of their own, and read."""
    old, new = _files(spark, sf_dir), shared_folder(spark, "packed")
    sums = O.read(spark, old).select("file", "t", "chan", (F.col("v") * 2).cast("int").alias("v"))
    # the levels go where the file has their channel
    levels = S.quantise_2bit(sums, "file").withColumn("chan", F.when(_number() % 2 == 1, 63 - F.col("chan")).otherwise(F.col("chan")))
    shapes = psrfits.read_headers(spark, old).select(F.regexp_extract("path", r"([^/]+)\.fits$", 1).alias("file"), "nsblk")
    O.write(S.packed_rows(levels.join(shapes, "file"), F.col("nsblk")), new, old, bits=2)
    return O.read(spark, new).select(_number(), "t", "chan", "v")
