"""Discovery, manifests, sections and merge bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def discover_tasks(files: DataFrame) -> DataFrame:
    """Tasks of ``files(source, date, beam, path)``: one per source, date and beam with its sorted files; rows without a tag are skipped."""
    tagged = files.dropna(subset=["source", "date", "beam"])
    grouped = tagged.groupBy("source", "date", "beam").agg(F.sort_array(F.collect_list("path")).alias("files"))
    return grouped.select(F.concat_ws("_", "source", "date", "beam").alias("identifier"), "source", "date", "beam", "files", F.size("files").alias("n_files"))


def round_robin(rows: DataFrame, order: str, n: int) -> DataFrame:
    """Add ``section``: position in order modulo n. The rows are task descriptions, few beside the data they name."""
    return rows.withColumn("section", ((F.row_number().over(Window.orderBy(order)) - 1) % n).cast("int"))


def file_sections(files: DataFrame, keys: list[str], order: str, sections: int, overlap: int) -> DataFrame:
    """Split each task's files into runs of n // sections + 1 with ``overlap`` files of the next run behind each:
    ``(keys, section, order, searched)``; files of the overlap are read but not searched."""
    position = Window.partitionBy(*keys)
    placed = files.withColumns({"_i": F.row_number().over(position.orderBy(order)) - 1, "_n": F.count("*").over(position)})
    size = F.expr(f"_n div {sections} + 1")
    own = F.floor(F.col("_i") / size)
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - size - overlap + 1) / size))
    spread = placed.withColumn("section", F.explode(F.sequence(first.cast("int"), own.cast("int"))))
    return spread.select(*keys, "section", order, (F.col("section") == own).alias("searched"))


def not_completed(tasks: DataFrame, completed: DataFrame, key: str = "identifier") -> DataFrame:
    """Tasks whose key is not in the completion log."""
    return tasks.join(completed.select(key).distinct(), key, "left_anti")


def missing_numbers(files: DataFrame, group: str, number: str) -> DataFrame:
    """Numbers between the first and last of each group that no file has."""
    span = files.groupBy(group).agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    expected = span.select(group, F.explode(F.sequence("lo", "hi")).alias(number))
    return expected.join(files.select(group, number).distinct(), [group, number], "left_anti")


def context_windows(files: DataFrame, group: str, order: str, before: int, after: int) -> DataFrame:
    """Each file with the names of its neighbours: ``(group, order, context, n_context)``."""
    frame = Window.partitionBy(group).orderBy(order).rowsBetween(-before, after)
    return files.withColumn("context", F.array_join(F.collect_list(order).over(frame), ",")).withColumn("n_context", F.size(F.split("context", ",")))


def flatten(rows: DataFrame, column: str) -> DataFrame:
    """Replace a struct column by its fields, prefixed with its name."""
    fields = rows.schema[column].dataType.fieldNames()
    return rows.select(*[c for c in rows.columns if c != column], *[F.col(f"{column}.{f}").alias(f"{column}_{f}") for f in fields])


def union_all_columns(*frames: DataFrame, preferred: list[str] | None = None) -> DataFrame:
    """Union by name with all columns of any frame; preferred columns first, the rest in order of name."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    first = [c for c in preferred or [] if c in out.columns]
    return out.select(*first, *sorted(c for c in out.columns if c not in first))


def finite_double(text: Column) -> Column:
    """A finite number, else null (empty, malformed, nan, inf)."""
    value = F.trim(text).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def truthy(text: Column) -> Column:
    """True for true, 1, yes, y in any case."""
    return F.lower(F.trim(text)).isin("true", "1", "yes", "y")


def parse_singlepulse(lines: DataFrame, low: int, high: int, text: str = "line") -> DataFrame:
    """Candidates of text lines ``dm sigma time sample downfact``: comments, lines with fewer tokens and unparsable ones go,
    as do samples outside [low, high); ``center_sample`` counts from ``low``."""
    # generators, so that filters on the parts don't take the text apart again
    split = lines.withColumn("_p", F.explode(F.array(F.split(F.trim(text), r"\s+")))).where(~F.col("_p")[0].startswith("#") & (F.size("_p") >= 5))
    cast = [finite_double(F.col("_p")[i]).alias(n) for i, n in enumerate(("dm", "sigma", "time_s"))] + [F.col("_p")[i].try_cast("long").alias(n) for i, n in ((3, "sample"), (4, "downfact"))]
    parsed = split.select(*[c for c in lines.columns if c != text], F.inline(F.array(F.struct(*cast)))).dropna(subset=["dm", "sigma", "time_s", "sample", "downfact"])
    return parsed.where((F.col("sample") >= low) & (F.col("sample") < high)).withColumn("center_sample", F.col("sample") - low)


def log_metrics(lines: DataFrame, text: str, pattern: str, group: int, value: int) -> DataFrame:
    """Count, mean and maximum of a number in log lines by the section named in them."""
    found = lines.select(F.regexp_extract(text, pattern, group).alias("section"), F.regexp_extract(text, pattern, value).try_cast("double").alias("x")).where("x is not null")
    return found.groupBy("section").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.max("x").alias("largest"))


def shard_offsets(shards: DataFrame, shard: str, n: str) -> DataFrame:
    """Running offset of each shard in the merged table. One row per shard."""
    return shards.withColumn("offset", F.sum(n).over(Window.orderBy(shard)) - F.col(n))


def count_audit(objects: DataFrame, image: str, most: int) -> DataFrame:
    """How many images have how many objects, and whether that is over the limit."""
    return objects.groupBy(image).agg(F.count("*").alias("n_objects")).groupBy("n_objects").agg(F.count("*").alias("n_images")).withColumn("violates", F.col("n_objects") > most)


#: Task manifest: an object with ``tasks``, or a bare list of tasks.
TASK = T.StructType([T.StructField("identifier", T.StringType()), T.StructField("files", T.ArrayType(T.StringType())), T.StructField("info", T.MapType(T.StringType(), T.StringType()))])


#: States of a campaign's task and the steps between them; a task may fail from any of the others and start again (fixed values).
STEPS = ("pending>running", "running>ready", "ready>active", "active>done", "running>failed", "ready>failed", "active>failed", "failed>pending")


def task_states(events: DataFrame, task: str, order: str, state: str, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """``(task, state, n_events, n_rejected)``: where each task stands after its events, which count in order if they are a
    step from where it stood (it begins as ``pending``); others are rejected. Events without a task, an order or a state are
    left out; of equal orders the first by state counts first. A task's events are one row."""
    known = events.where(F.col(task).isNotNull() & F.col(order).isNotNull() & F.col(state).isNotNull())
    listed = known.groupBy(F.col(task).alias("task")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(state).alias("to")))).alias("events"))
    allowed = F.array(*map(F.lit, steps))
    start = F.struct(F.lit("pending").alias("state"), F.lit(0).alias("bad"))

    def step(now: Column, event: Column) -> Column:
        good = F.array_contains(allowed, F.concat(now["state"], F.lit(">"), event["to"]))
        return F.struct(F.when(good, event["to"]).otherwise(now["state"]).alias("state"), (now["bad"] + F.when(good, 0).otherwise(1)).alias("bad"))

    end = F.aggregate("events", start, step)
    return listed.withColumn("end", end).select("task", F.col("end.state").alias("state"), F.size("events").alias("n_events"), F.col("end.bad").alias("n_rejected"))


def startable(states: DataFrame, ahead: int) -> DataFrame:
    """The pending tasks that may start, first ones first, so that no more than ``ahead`` are running or ready at a time."""
    busy = states.agg(F.count_if(F.col("state").isin("running", "ready")).alias("busy"))
    first = states.where("state = 'pending'").orderBy("task").limit(ahead).withColumn("place", F.row_number().over(Window.orderBy("task")))  # ``ahead`` rows
    return first.crossJoin(F.broadcast(busy)).where(F.col("place") <= ahead - F.col("busy")).select("task")
