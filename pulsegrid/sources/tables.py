"""Manifests, logs and campaign tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import TASK, union_all_columns


def _or_empty(spark: SparkSession, schema: str | T.StructType, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines with a fixed schema; a missing path is empty; bad lines fail (strict) or are dropped."""
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("recursiveFileLookup", "true").json(path))


def bad_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines of JSON files that don't parse, with their file."""
    named = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value").where(F.trim("value") != "")
    parsed = lines.withColumn("_r", F.from_json("value", named, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.where("_r._corrupt_record is not null").select("path", F.col("value").alias("line"))


def read_candidates(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """All candidate manifests below a folder: files named ``*candidates*.jsonl`` or ``candidate_manifest*.jsonl``, each once."""
    read = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "{*candidates*,candidate_manifest*}.jsonl")
    return _or_empty(spark, schema, lambda: read.json(path))


def read_csv(spark: SparkSession, path: str, glob: str = "*.csv*") -> DataFrame:
    """CSV files, gzipped or not, all columns as text; empty cells are null."""
    return spark.read.option("header", "true").option("nullValue", "").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").csv(path)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of a manifest document: an object with ``tasks`` or a bare list. A task without identifier or files fails."""
    document = spark.read.text(path, wholetext=True)
    tasks = T.ArrayType(TASK)
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", tasks)).otherwise(F.from_json("value", T.StructType([T.StructField("tasks", tasks)]))["tasks"])
    rows = document.select(F.explode(listed).alias("t")).select("t.*")
    sound = F.col("identifier").isNotNull() & (F.size("files") > 0)
    return rows.withColumn("identifier", F.when(sound, F.col("identifier")).otherwise(F.raise_error(F.lit("a task needs an identifier and files"))))


def read_truth_archive(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Truth manifests below a folder, with batch and quantization from their path ``..._b<NN>_<quant>...``."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*truth*.jsonl").json(path).withColumn("truth_manifest", F.input_file_name())
    return rows.withColumns({"batch": F.regexp_extract("truth_manifest", r"_b(\d+)", 1).try_cast("int"), "quantization": F.coalesce(F.col("quantization") if "quantization" in rows.columns else F.lit(None), F.nullif(F.regexp_extract("truth_manifest", "(raw8|packed2)", 1), F.lit("")))})


def with_quantization(rows: DataFrame, path: str = "source_path", field: str = "quantization") -> DataFrame:
    """Quantization from the field or else the path; both given and different, or neither, is an error."""
    by_path = F.nullif(F.regexp_extract(path, "(raw8|packed2)", 1), F.lit(""))
    by_field = F.nullif(F.trim(field), F.lit("")) if field in rows.columns else F.lit(None).cast("string")
    wrong = F.when(by_path.isNotNull() & by_field.isNotNull() & (by_path != by_field), F.raise_error(F.concat(F.lit("quantization differs from path "), F.col(path)))).when(by_path.isNull() & by_field.isNull(), F.raise_error(F.concat(F.lit("no quantization for "), F.col(path))))
    return rows.withColumn(field, F.coalesce(wrong.cast("string"), by_field, by_path))


def read_campaign(spark: SparkSession, path: str, name: str) -> DataFrame:
    """All CSV tables ``name`` below a folder, with their path and quantization."""
    return with_quantization(read_csv(spark, path, f"{name}*").withColumn("source_path", F.input_file_name()))


def read_background_files(spark: SparkSession, path: str, beam: str = "M01") -> DataFrame:
    """Observation files of one beam with their number; names tagged _N_, _W_ or _F_ are left out: ``(path, number, bytes)``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fits").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    number = F.regexp_extract("path", rf"-{beam}_(\d{{4}})\.fits$", 1)
    return files.where(~F.col("path").rlike("_[NWF]_") & (number != "")).select("path", number.cast("int").alias("number"), "bytes")


def read_artefact_keys(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """Keys ``(rate, file, block)`` of artefacts named ``<file>-<block>`` in folders named by rate."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path")
    parts = [F.regexp_extract("path", r"([^/]+)/([^/]+)-(\d+)\.[a-z]+$", i) for i in (1, 2, 3)]
    return files.select(parts[0].alias("rate"), parts[1].alias("file"), parts[2].try_cast("int").alias("block")).where("block is not null")


def _existing(spark: SparkSession, root: str, names: Sequence[str]) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for name in names:
        at = path(root, f"{name}.parquet")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            found.append(name)
    return found


def read_sample_sets(spark: SparkSession, root: str, positive: Sequence[str], negative: Sequence[str], renewed: str = "True_LPT") -> DataFrame:
    """The classifier's catalogue: ``(set, idx, name, label, source, repeat, sample_key)`` of the sample sets ``<root>/<set>.parquet``
    (``names, labels, idx`` and, not in all sets, ``sources``). Sets that are missing are skipped; without any it is an error.

    A sample is named by its set and index; of equal names the first by name, label and source stays. ``repeat`` is 6 for samples of the set
    ``renewed`` whose name begins with a date and a beam of 02, 05 or 10 and whose source is not its old one, 2 for negative sets, else 1."""
    found = _existing(spark, root, [*positive, *negative])
    if not found:
        raise FileNotFoundError(f"no sample set in {root}")
    sets = []
    for name in found:
        rows = spark.read.parquet(f"{root}/{name}.parquet")
        source = F.col("sources") if "sources" in rows.columns else F.lit("")
        sets.append(rows.select(F.lit(name).alias("set"), F.col("idx").cast("long").alias("idx"), F.col("names").cast("string").alias("name"), F.col("labels").cast("long").alias("label"), F.coalesce(source.cast("string"), F.lit("")).alias("source")))
    whole = sets[0]
    for rows in sets[1:]:
        whole = whole.unionByName(rows)
    new = F.col("name").rlike(r"^\d{8}-(02|05|10)") & (F.col("source") != f"{renewed}_Old")
    repeat = F.when((F.col("set") == renewed) & F.coalesce(new, F.lit(False)), 6).when(F.col("set").isin(*negative) if negative else F.lit(False), 2).otherwise(1)
    one = whole.groupBy("set", "idx").agg(F.min(F.struct("name", "label", "source")).alias("s")).select("set", "idx", "s.*")
    return one.select("set", "idx", "name", "label", "source", repeat.alias("repeat"), F.concat_ws(":", "set", "idx").alias("sample_key"))


def read_frame_sets(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    """The detector's catalogue: ``(set, frame, n_boxes, has_annotation, min_box_size)`` of ``<root>/<set>.parquet`` with
    ``frame`` and ``boxes array<struct<left, top, width, height>>``. Boxes with a null or a side under a pixel don't count;
    ``min_box_size`` is the least square root of a box's area, infinite without boxes. Missing sets are skipped."""
    found = _existing(spark, root, names)
    if not found:
        raise FileNotFoundError(f"no frame set in {root}")
    whole = None
    for name in found:
        rows = spark.read.parquet(f"{root}/{name}.parquet").select(F.lit(name).alias("set"), "frame", "boxes")
        whole = rows if whole is None else whole.unionByName(rows)
    good = F.filter(F.coalesce("boxes", F.expr("cast(array() as array<struct<left:double,top:double,width:double,height:double>>)")), lambda b: b["left"].isNotNull() & b["top"].isNotNull() & (b["width"] >= 1) & (b["height"] >= 1))
    size = F.coalesce(F.array_min(F.transform(good, lambda b: F.sqrt(b["width"] * b["height"]))), F.lit(float("inf")))
    return whole.select("set", "frame", F.size(good).alias("n_boxes"), (F.size(good) > 0).alias("has_annotation"), size.alias("min_box_size"))


def write_jsonl(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Append rows as JSON lines, keys in order of name."""
    rows.select(*sorted(rows.columns)).write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str, fields: list[str], mode: str = "errorifexists") -> None:
    """CSV with the given fields: missing ones are empty, others are left out. An existing path is not overwritten unless asked."""
    known = [F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields]
    rows.select(*known).write.mode(mode).option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)


def publish(rows: DataFrame, folder: str, stem: str, suffix: str = ".jsonl") -> None:
    """Files ``<stem>-<number><suffix>`` of a folder: JSON lines, or by the suffix CSV (``.csv``, ``.csv.gz``) or text (``.json``,
    ``.txt``, a row with its one column being a line). They are written under a hidden name and moved when whole; an
    existing file is an error."""
    spark = rows.sparkSession
    hidden = f"{folder}/_{stem}-{uuid.uuid4().hex}"
    if suffix.startswith(".csv"):
        rows.write.option("header", "true").option("compression", "gzip" if suffix.endswith(".gz") else "none").csv(hidden)
    elif suffix in (".json", ".txt"):
        rows.write.text(hidden)
    else:
        rows.select(*sorted(rows.columns)).write.json(hidden)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(hidden).getFileSystem(spark._jsc.hadoopConfiguration())
    for i, name in enumerate(sorted(x.getPath().getName() for x in files.listStatus(path(hidden)) if x.getPath().getName().startswith("part-"))):
        target = path(folder, f"{stem}-{i:05d}{suffix}")
        if files.exists(target) or not files.rename(path(hidden, name), target):
            raise FileExistsError(target.toString())
    files.delete(path(hidden), True)


def write_task_manifests(tasks: DataFrame, path: str, *by: str) -> None:
    """One manifest document ``{"tasks": [...]}`` for each value of some columns; ``tasks`` has ``identifier``, ``files`` and ``info`` (a struct)."""
    document = F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("identifier", "files", "info"))).alias("tasks")))
    tasks.groupBy(*by).agg(document.alias("value")).write.partitionBy(*by).text(path)


def write_partitioned(rows: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> None:
    """Parquet by the values of some columns (source, date and beam, or a threshold), rows of a folder brought together first;
    adaptive execution gives a large folder to several tasks, a file each."""
    rows.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def write_for_quantizations(truth: DataFrame, path: str, quantizations: list[str], mode: str = "errorifexists") -> None:
    """The same truth once for each quantization."""
    kinds = truth.sparkSession.createDataFrame([(q,) for q in quantizations], "quantization string")
    write_partitioned(truth.drop("quantization").crossJoin(F.broadcast(kinds)), path, "quantization", mode=mode)


def merge_feeds(*feeds: DataFrame) -> DataFrame:
    """Union of feeds with different columns."""
    return union_all_columns(*feeds)


def write_run(truth: DataFrame, settings: Mapping[str, object], path: str, quantizations: Sequence[str], derived: str | None = None) -> None:
    """A run's manifests for each quantization: its truth, and a document ``run_config`` of the settings that also names the
    quantization and, for the others, the one its data are ``derived`` from."""
    write_for_quantizations(truth, f"{path}/truth", list(quantizations), mode="errorifexists")
    documents = [(json.dumps(dict(settings) | {"quantization": q} | ({"derived_from": derived} if derived not in (None, q) else {}), sort_keys=True),) for q in quantizations]
    publish(truth.sparkSession.createDataFrame(documents, "value string").coalesce(1), f"{path}/config", "run_config", ".json")


def read_run(spark: SparkSession, path: str, settings: str) -> tuple[DataFrame, DataFrame]:
    """(truth, run configurations) as ``write_run`` left them; ``settings`` is the schema of the settings."""
    config = read_jsonl(spark, f"{path}/config/run_config-*.json", f"{settings}, quantization string, derived_from string", strict=True)
    return spark.read.parquet(f"{path}/truth"), config


def write_frame_set(images: DataFrame, boxes: DataFrame, path: str) -> None:
    """A training set ``<path>`` of ``frame``, ``pixels`` and ``boxes``, and beside it ``<path>.json``, the boxes of each frame as a
    document (``[[-1, -1, -1, -1]]`` where there is none).

    ``images(frame, pixels)`` and ``boxes(frame, box, left, top, width, height)``; boxes in order of ``box``. Pixels are not
    shuffled with the boxes if these are small: Spark decides by their size."""
    cells = ("left", "top", "width", "height")
    listed = boxes.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("box", *(F.col(c).cast("double").alias(c) for c in cells)))).alias("b"))
    listed = listed.select("frame", F.transform("b", lambda b: F.struct(*(b[c].alias(c) for c in cells))).alias("boxes"))
    images.join(listed, "frame", "left").write.mode("errorifexists").parquet(path)
    held = images.select("frame").join(listed, "frame", "left")
    numbers = F.coalesce(F.transform("boxes", lambda b: F.array(*(b[c] for c in cells))), F.array(F.array(*[F.lit(-1.0)] * 4)))
    held.select(F.to_json(F.struct("frame", numbers.alias("annotations"))).alias("value")).write.mode("errorifexists").text(f"{path}.json")
