"""Driver queries: discovery, manifests, sections, logs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import matching
from ..streaming import sessions, streams
from .proxies import CANDIDATES, as_candidates, candidates, detections, table
from . import sequential as Q
from .registry import query


def _files(spark, sf_dir):
    orders, people = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(people, orders.o_custkey == people.c_custkey, "left")
    beam = F.concat(F.lit("M"), F.lpad((F.col("o_orderkey") % 4).cast("string"), 2, "0"))
    path = F.concat(F.lit("X-"), beam, F.lit("_"), F.lpad(F.expr("o_orderkey div 4").cast("string"), 7, "0"), F.lit(".fits"))
    return joined.select(F.col("c_mktsegment").alias("source"), F.date_format("o_orderdate", "yyyyMM").alias("date"), beam.alias("beam"), path.alias("path"), F.expr("o_orderkey div 4").alias("number"))


_FILES = """(SELECT c_mktsegment AS source, strftime(o_orderdate, '%Y%m') AS date, 'M' || lpad(CAST(o_orderkey % 4 AS VARCHAR), 2, '0') AS beam, 'X-M' || lpad(CAST(o_orderkey % 4 AS VARCHAR), 2, '0') || '_' || lpad(CAST(o_orderkey // 4 AS VARCHAR), 7, '0') || '.fits' AS path, o_orderkey // 4 AS number
FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""
_TASKS = f"(SELECT source || '_' || date || '_' || beam AS identifier, source, date, beam, string_agg(path, ',' ORDER BY path) AS files, CAST(count(*) AS INT) AS n_files FROM {_FILES} WHERE source IS NOT NULL GROUP BY source, date, beam)"


def _tasks(spark, sf_dir):
    return C.discover_tasks(_files(spark, sf_dir))


@query("task_discovery", f"SELECT * FROM {_TASKS}")
def task_discovery(spark, sf_dir):
    return _tasks(spark, sf_dir).withColumn("files", F.array_join("files", ","))


@query("task_sections", f"SELECT identifier, n_files, CAST((row_number() OVER (ORDER BY identifier) - 1) % 32 AS INT) AS section FROM {_TASKS}")
def task_sections(spark, sf_dir):
    return C.round_robin(_tasks(spark, sf_dir).select("identifier", "n_files"), "identifier", 32)


@query("file_sections", f"""WITH p AS (SELECT source, beam, path, row_number() OVER (PARTITION BY source, beam ORDER BY path) - 1 AS i, count(*) OVER (PARTITION BY source, beam) // 8 + 1 AS size FROM {_FILES} WHERE source IS NOT NULL)
SELECT source, beam, CAST(s AS INT) AS section, path, i // size = s AS searched FROM p JOIN range(8) r(s) ON i >= s * size AND i < s * size + size + 5""")
def file_sections(spark, sf_dir):
    return C.file_sections(_files(spark, sf_dir).where("source is not null"), ["source", "beam"], "path", 8, 5)


@query("completed_antijoin", f"SELECT identifier, n_files FROM {_TASKS} WHERE identifier NOT IN (SELECT identifier FROM {_TASKS} WHERE n_files % 3 = 0)")
def completed_antijoin(spark, sf_dir):
    tasks = _tasks(spark, sf_dir).select("identifier", "n_files")
    return C.not_completed(tasks, tasks.where("n_files % 3 = 0"))


_NUMBERS = "(SELECT beam, number FROM (SELECT o_orderkey // 4 AS number, CAST(o_orderkey % 4 AS INT) AS beam, o_orderstatus FROM orders) WHERE o_orderstatus <> 'P')"


@query("missing_files", f"SELECT beam, number FROM (SELECT beam, unnest(range(min(number), max(number) + 1)) AS number FROM {_NUMBERS} GROUP BY beam) EXCEPT SELECT beam, number FROM {_NUMBERS}")
def missing_files(spark, sf_dir):
    files = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select((F.col("o_orderkey") % 4).cast("int").alias("beam"), F.expr("o_orderkey div 4").alias("number"))
    return C.missing_numbers(files, "beam", "number")


_STEMS = f"(SELECT DISTINCT quant, stem FROM {CANDIDATES})"


@query("context_window", f"SELECT quant, stem, string_agg(o, ',' ORDER BY o) AS context, CAST(count(*) AS INT) AS n_context FROM (SELECT a.quant, a.stem, b.stem AS o FROM (SELECT *, row_number() OVER (PARTITION BY quant ORDER BY stem) AS i FROM {_STEMS}) a JOIN (SELECT *, row_number() OVER (PARTITION BY quant ORDER BY stem) AS i FROM {_STEMS}) b ON a.quant = b.quant AND b.i BETWEEN a.i - 1 AND a.i + 2) GROUP BY 1, 2")
def context_window(spark, sf_dir):
    stems = candidates(spark, sf_dir).select("quant", "stem").distinct()
    return C.context_windows(stems, "quant", "stem", 1, 2)


@query("manifest_flatten", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k FROM events")
def manifest_flatten(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "struct<k:bigint>").alias("props"))
    return C.flatten(parsed, "props")


@query("manifest_union_schema", """SELECT event_id, event_type, CAST(NULL AS DOUBLE) AS amount, user_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, event_type, value AS amount, CAST(NULL AS BIGINT) AS user_id FROM events WHERE event_type = 'purchase'""")
def manifest_union_schema(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("event_id", "event_type", "user_id")
    bought = e.where("event_type = 'purchase'").select("event_id", "event_type", F.col("value").alias("amount"))
    return C.union_all_columns(clicks, bought, preferred=["event_id", "event_type"])


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query("singlepulse_parse", f"""SELECT event_id, value AS dm, {_K} / 10.0::DOUBLE AS sigma, user_id / 4.0::DOUBLE AS time_s, event_id * 3 AS sample, {_K} % 30 AS downfact, event_id * 3 - 3000 AS center_sample FROM events WHERE event_id % 10 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id * 3 >= 3000 AND event_id * 3 < 27000""")
def singlepulse_parse(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    good = F.concat_ws(" ", F.col("value").cast("string"), (k / 10.0).cast("string"), (F.col("user_id") / 4.0).cast("string"), (F.col("event_id") * 3).cast("string"), (k % 30).cast("string"))
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("# "), good)).when(F.col("event_id") % 13 == 0, "12.5 nan 0.1 77 3").when(F.col("event_id") % 17 == 0, "12.5 6.1 0.1 77").otherwise(good)
    return C.parse_singlepulse(table(spark, sf_dir, "events").select("event_id", line.alias("line")), 3000, 27000)


@query("log_metrics", r"""SELECT s AS section, count(*) AS n, round(avg(x), 6) AS mean, max(x) AS largest FROM (SELECT regexp_extract(url, '\.example\.([a-z]+)/([a-z]+)/([0-9]+)', 2) AS s, TRY_CAST(nullif(regexp_extract(url, '\.example\.([a-z]+)/([a-z]+)/([0-9]+)', 3), '') AS DOUBLE) AS x FROM pages) WHERE x IS NOT NULL GROUP BY s""")
def log_metrics(spark, sf_dir):
    return C.log_metrics(table(spark, sf_dir, "pages"), "url", r"\.example\.([a-z]+)/([a-z]+)/([0-9]+)", 2, 3).withColumn("mean", F.round("mean", 6))


@query("shard_merge_offsets", "SELECT shard, n, CAST(sum(n) OVER (ORDER BY shard) - n AS BIGINT) AS \"offset\" FROM (SELECT l_suppkey AS shard, count(*) AS n FROM lineitem GROUP BY 1)")
def shard_merge_offsets(spark, sf_dir):
    return C.shard_offsets(table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("shard")).agg(F.count("*").alias("n")), "shard", "n")


@query("object_count_audit", "SELECT n_objects, count(*) AS n_images, n_objects > 10 AS violates FROM (SELECT l_orderkey, count(*) AS n_objects FROM lineitem GROUP BY 1) GROUP BY n_objects")
def object_count_audit(spark, sf_dir):
    return C.count_audit(table(spark, sf_dir, "lineitem"), "l_orderkey", 10)


@query("stream_manifest_append", "SELECT event_id, event_type, value, user_id FROM events WHERE value > 50")
def stream_manifest_append(spark, sf_dir):
    def strong(frame):
        return frame.where("value > 50").select("event_id", "event_type", "value", "user_id")

    return streams.append_all(spark, f"{sf_dir}/events.parquet", strong)


@query("stream_event_clusters", Q.SESSIONS)
def stream_event_clusters(spark, sf_dir):
    found = streams.whole_sessions(spark, f"{sf_dir}/events.parquet", "ts", ["event_type"], "5 minutes")
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("start", "end")})


def _in_order(spark, sf_dir, parts=5):
    """The events as files that each hold a stretch of time, written one after the other, as a telescope would."""
    root, rows = streams.shared_folder(spark, "arrivals"), table(spark, sf_dir, "events")
    low, high = rows.agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))), F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()
    part = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(low or 0)) * parts / F.lit((high or 0) - (low or 0) + 1))
    for i in range(parts):
        rows.where(part == i).coalesce(1).write.mode("append").parquet(root)  # an arrival is one file
    return root


@query("stream_timed_sessions", Q.SESSIONS)
def stream_timed_sessions(spark, sf_dir):
    """Sessions that timers close while files arrive, and those still open at the end."""
    closed, left, _ = sessions.stream_sessions(spark, _in_order(spark, sf_dir), "ts", ["event_type"], "5 minutes", "1 second", 1)
    return closed.unionByName(left).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("start", "end")})


@query("stream_bounded_events", Q.bounded_events(600, 60.0))
def stream_bounded_events(spark, sf_dir):
    """Events of bounded diameter, built when the watermark has passed their island (samples are whole seconds of the times)."""

    build = lambda pdf: matching.events_of(pdf, 600, 60.0)
    closed, left, _ = sessions.stream_islands(spark, _in_order(spark, sf_dir), lambda frame: as_candidates(detections(frame)), "ts", ["quant", "stem"], "601 seconds", "1 second", build, "cand_id long, event long, event_size long", 1)
    return closed.unionByName(left)


_STATE = "['running', 'ready', 'active', 'done', 'failed', 'pending'][CAST(json_extract_string(props, '$.k') AS BIGINT) % 6 + 1]"
_ALLOWED = ", ".join(f"'{s}'" for s in C.STEPS)


@query("task_states", f"""WITH RECURSIVE e AS (SELECT user_id AS task, {_STATE} AS state, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), s AS (SELECT DISTINCT task, 0::BIGINT AS i, 'pending' AS state, 0 AS bad FROM e
UNION ALL SELECT s.task, e.i, CASE WHEN s.state || '>' || e.state IN ({_ALLOWED}) THEN e.state ELSE s.state END, s.bad + CASE WHEN s.state || '>' || e.state IN ({_ALLOWED}) THEN 0 ELSE 1 END FROM s JOIN e ON e.task = s.task AND e.i = s.i + 1)
SELECT task, arg_max(state, i) AS state, CAST(max(i) AS INT) AS n_events, CAST(max(bad) AS INT) AS n_rejected FROM s GROUP BY task""")
def task_states(spark, sf_dir):
    """Where the tasks of a campaign stand after their status events."""
    k = F.get_json_object("props", "$.k").cast("int") % 6
    state = F.element_at(F.array(*map(F.lit, ("running", "ready", "active", "done", "failed", "pending"))), k + 1)
    return C.task_states(table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("state")), "user_id", "event_id", "state")
