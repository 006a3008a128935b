"""Signal-search views over the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dynamic spectrum ``(t, chan, v)``: a vector is one time sample of 64 channels, in millionths."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("chan", "x")).select("t", "chan", F.round(F.col("x").cast("double") * 1000000).cast("long").alias("v"))


SPEC = "(SELECT vec_id AS t, CAST(chan AS INT) AS chan, CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS v FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS chan, unnest(embedding) AS x FROM embeddings))"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 8 x 8 pixels ``(image, py, px, v)``."""
    return spec(spark, sf_dir).select(F.col("t").alias("image"), F.expr("chan div 8").cast("int").alias("py"), F.expr("chan % 8").cast("int").alias("px"), "v")


def pixel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images as rows of arrays ``(image, pixels)``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("long")).alias("pixels"))


def unrolled(rows: DataFrame, scaled: Column) -> DataFrame:
    """``(image, py, px, scaled)`` of an expression over the ``pixels`` of rows of 8 x 8."""
    cells = rows.select("image", F.posexplode(scaled).alias("i", "scaled"))
    return cells.select("image", F.expr("i div 8").cast("int").alias("py"), (F.col("i") % 8).alias("px"), "scaled")


IMAGES = f"(SELECT t AS image, CAST(chan // 8 AS INT) AS py, CAST(chan % 8 AS INT) AS px, v FROM {SPEC})"


def detections(e: DataFrame) -> DataFrame:
    """Events, of a table or a stream, as detections of a search, with their time."""
    day = F.date_format("ts", "yyyyMMdd")
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return e.select(
        "ts", "event_id", "event_type", F.when(F.col("user_id") % 2 == 0, "raw8").otherwise("packed2").alias("quant"), F.concat(F.lit("X-M01_"), F.lpad(F.dayofmonth("ts").cast("string"), 4, "0")).alias("stem"),
        day.alias("day"), seconds.cast("long").alias("sample"), F.col("value").alias("dm"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


_DETECTIONS = """(SELECT event_id, event_type, CASE WHEN user_id % 2 = 0 THEN 'raw8' ELSE 'packed2' END AS quant, 'X-M01_' || lpad(CAST(day(ts) AS VARCHAR), 4, '0') AS stem,
 strftime(ts, '%Y%m%d') AS day, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS sample, value AS dm, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injection truth: purchases."""
    return detections(table(spark, sf_dir, "events")).where("event_type = 'purchase'").select(F.col("event_id").alias("injection_id"), "quant", "stem", "sample", "dm", F.col("k").cast("double").alias("snr"))


TRUTH = f"(SELECT event_id AS injection_id, quant, stem, sample, dm, CAST(k AS DOUBLE) AS snr FROM {_DETECTIONS} WHERE event_type = 'purchase')"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search candidates: all other events."""
    return as_candidates(detections(table(spark, sf_dir, "events"))).drop("ts")


def as_candidates(detected: DataFrame) -> DataFrame:
    d = detected.where("event_type <> 'purchase'")
    return d.select("ts", F.col("event_id").alias("cand_id"), "quant", "stem", "sample", "dm", (F.col("k") / 10.0).alias("sigma"), (F.col("k") / 100.0).alias("cls"), ((F.col("k") * 7 % 100) / 100.0).alias("det"), (F.col("event_id") % 16).cast("int").alias("candidate_index"))


CANDIDATES = f"(SELECT event_id AS cand_id, quant, stem, sample, dm, k / 10.0::DOUBLE AS sigma, k / 100.0::DOUBLE AS cls, (k * 7 % 100) / 100.0::DOUBLE AS det, CAST(event_id % 16 AS INT) AS candidate_index FROM {_DETECTIONS} WHERE event_type <> 'purchase')"


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched injections ``(quant, snr, dm, width, detected)``."""
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "packed2").otherwise("raw8").alias("quant"), (F.col("l_quantity") * 2).alias("snr"), (F.col("l_extendedprice") / 50).alias("dm"),
        (F.col("l_linenumber") * 2.5).alias("width"), (F.col("l_discount") > 0.05).alias("detected"), (F.col("l_discount") * 100 - 5).alias("dm_error"),
    )


MATCHES = "(SELECT CASE WHEN l_returnflag = 'R' THEN 'packed2' ELSE 'raw8' END AS quant, l_quantity * 2 AS snr, l_extendedprice / 50 AS dm, l_linenumber * 2.5::DOUBLE AS width, l_discount > 0.05 AS detected, l_discount * 100 - 5 AS dm_error FROM lineitem)"


def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False positives with the parameters of their nearest injection. Sigma is rounded as SQL engines round doubles, by scaling;
    Spark's own rounding of the decimal text gives another hundredth where the scaled value falls just short of a half."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "packed2").otherwise("raw8").alias("quant"), (price % 100).alias("snr"), (price / 250).alias("dm"), (F.col("o_orderkey") % 21).cast("double").alias("width"), (F.round(price / 40000 * 100) / 100).alias("sigma"),
    )


FALSE_POSITIVES = "(SELECT CASE WHEN o_orderstatus = 'F' THEN 'packed2' ELSE 'raw8' END AS quant, o_totalprice % 100 AS snr, o_totalprice / 250 AS dm, CAST(o_orderkey % 21 AS DOUBLE) AS width, round(o_totalprice / 40000, 2) AS sigma FROM orders)"
