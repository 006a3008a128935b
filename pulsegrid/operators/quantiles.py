"""Exact quantiles by selection: histograms that narrow down on the wanted ranks, so that no task holds or sorts a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed

#: Buckets of a histogram. A round divides the range that a wanted rank can lie in by this.
BUCKETS = 4096


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], name: str = "q") -> DataFrame:
    """``(*keys, n, <name> array<double>)``: the linearly interpolated quantiles of ``value`` in each group of ``keys``.

    Equal to the ``percentile`` aggregate, whose buffer would hold a group's distinct values. Here each round counts, for
    each wanted rank, the values of the bucket that holds it in ``BUCKETS`` finer ones; counts are summed before the shuffle.
    A bucket whose least and largest value are equal ends the search. Groups should be few (they are joined to the rows with
    their bounds, broadcast if Spark finds them small); null keys are keys; nulls and NaN are no values; groups without a value
    are left out. Infinite values take part in ranks only if no wanted rank needs their interpolation.
    """
    cells = rows.select(*(F.struct(F.lit(0).alias("_"), *keys).alias("_key"),), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    # infinities would make all buckets infinitely wide; as the largest finite numbers they keep their order
    most = 1.7976931348623157e308
    cells = cells.withColumn("_v", F.least(F.greatest("_v", F.lit(-most)), F.lit(most)))
    whole = checkpointed(cells.groupBy("_key").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    at = F.array(*[F.struct(F.lit(i).alias("share"), (F.lit(float(s)) * (F.col("n") - 1)).alias("position")) for i, s in enumerate(shares)])
    wanted = whole.withColumn("w", F.explode(at)).select("_key", "n", "w.*", "lo", "hi")
    ranks = wanted.select("*", F.explode(F.array_distinct(F.array(F.floor("position"), F.ceil("position")))).alias("rank")).select("_key", "rank", "lo", "hi", F.lit(0).cast("long").alias("below")).distinct()
    found, left = ranks.where("lo = hi"), ranks.where("lo < hi")
    # half the distance is finite where the whole isn't
    place = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    while not left.isEmpty():
        inside = cells.join(left, "_key").where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
        bucket = F.least(F.lit(BUCKETS - 1), F.floor(place * BUCKETS)).cast("int")
        counts = inside.groupBy("_key", "rank", "below", bucket.alias("bucket")).agg(F.count("*").alias("m"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("m").over(Window.partitionBy("_key", "rank").orderBy("bucket"))
        placed = counts.withColumn("upto", F.col("below") + upto).withColumn("before", F.col("upto") - F.col("m"))
        hit = checkpointed(placed.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("upto"))).select("_key", "rank", "lo", "hi", F.col("before").alias("below")))
        found, left = found.unionByName(hit.where("lo = hi")), hit.where("lo < hi")
    values = found.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("at"))
    low, high = F.element_at("at", F.floor("position")), F.element_at("at", F.ceil("position"))
    between = F.when(low == high, low).otherwise(low + (high - low) * (F.col("position") - F.floor("position")))
    listed = wanted.join(values, "_key").groupBy("_key").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("share", between.alias("v")))).alias("s"))
    return listed.select(*(F.col("_key")[k].alias(k) for k in keys), "n", F.transform("s", lambda x: x["v"]).alias(name))
