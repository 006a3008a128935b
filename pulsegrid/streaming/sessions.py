"""Sessions and islands of a stream as keyed state with timers.

The state of a key holds what is still open. An event-time timer stands at the moment when no row that may still come can
belong to it any more; when the watermark passes it, the session or island is closed and its result goes out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .streams import shared_folder, source

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OPEN = "first_us long, last_us long, size long, strongest double"


def merged(spans: list[tuple], gap_us: int) -> list[tuple]:
    """Sessions ``(first, last, size, strongest)`` joined where one begins ``gap_us`` or less behind the end of another."""
    out: list[tuple] = []
    for first, last, size, strongest in sorted(spans):
        if out and first <= out[-1][1] + gap_us:
            a, b, n, s = out[-1]
            out[-1] = (a, max(b, last), n + size, max((x for x in (s, strongest) if x is not None), default=None))
        else:
            out.append((first, last, size, strongest))
    return out


def _closes_ms(last_us: int, gap_us: int) -> int:
    """The first millisecond at which a row can't come near enough any more."""
    return (last_us + gap_us) // 1000 + 2


class _Timed(StatefulProcessor):
    """Keeps one timer, for the session of the key that closes first; when it expires, all that the watermark has passed close."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _OPEN)

    def _held(self) -> list[tuple]:
        return [tuple(x) for x in self.open.get()]

    def _hold(self, spans: list[tuple]) -> None:
        if spans:
            self.open.put(spans)
        else:
            self.open.clear()
        due = min((_closes_ms(s[1], self.gap_us) for s in spans), default=None)
        known = list(self.handle.listTimers())
        for t in known:
            if t != due:
                self.handle.deleteTimer(t)
        if due is not None and due not in known:
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


class SessionTotals(_Timed):
    """Open sessions as totals: their first and last time, rows and strongest value."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spans = self._held()
        for pdf in rows:
            strongest = [None if pd.isna(v) else float(v) for v in pdf["value"]]
            spans = merged(spans + [(int(t), int(t), 1, v) for t, v in zip(pdf["time_us"], strongest)], self.gap_us)
        self._hold(spans)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, spans = timerValues.getCurrentWatermarkInMs(), self._held()
        done = [s for s in spans if _closes_ms(s[1], self.gap_us) <= now]
        self._hold([s for s in spans if _closes_ms(s[1], self.gap_us) > now])
        columns = list(zip(*done)) or [()] * 4
        yield pd.DataFrame({f"k{i}": [k] * len(done) for i, k in enumerate(key)} | dict(zip(("first_us", "last_us", "size", "strongest"), columns)))


def packed(rows: pd.DataFrame) -> bytes:
    """Rows as an Arrow stream."""
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(batches: Iterable[bytes]) -> pd.DataFrame:
    """The rows of one or more Arrow streams."""
    return pd.concat([pa.ipc.open_stream(b).read_pandas() for b in batches], ignore_index=True)


class IslandRows(_Timed):
    """Rows of open islands; when an island closes, ``build`` makes its result from its rows."""

    def __init__(self, gap_us: int, row_schema: str, build: Callable[[pd.DataFrame], pd.DataFrame]):
        super().__init__(gap_us)
        self.row_schema, self.build = row_schema, build

    def init(self, handle) -> None:
        super().init(handle)
        self.names = [x.split(" ", 1)[0] for x in self.row_schema.split(", ")]
        self.rows = handle.getListState("rows", "batch binary")  # a batch of rows is one element, as each is a call of its own

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spans = self._held()
        for pdf in rows:
            self.rows.appendList([(packed(pdf[self.names]),)])
            spans = merged(spans + [(int(t), int(t), 1, None) for t in pdf["time_us"]], self.gap_us)
        self._hold(spans)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, spans = timerValues.getCurrentWatermarkInMs(), self._held()
        done = [s for s in spans if _closes_ms(s[1], self.gap_us) <= now]
        rows = unpacked(bytes(r[0]) for r in self.rows.get())
        closed = pd.Series(False, index=rows.index)
        for first, last, *_ in done:
            inside = rows["time_us"].between(first, last)
            closed |= inside
            yield self.build(rows[inside])
        if len(left := rows[~closed]):
            self.rows.put([(packed(left),)])
        else:
            self.rows.clear()
        self._hold([s for s in spans if _closes_ms(s[1], self.gap_us) > now])


def _run(spark: SparkSession, flow: DataFrame) -> tuple[str, str, int]:
    """Run a stateful flow over all that is there: (table of what was closed, folder of its progress, late rows)."""
    out = shared_folder(spark, "sessions")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    try:
        query = flow.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-progress").option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    late = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    return out, f"{out}-progress", late


def _state(spark: SparkSession, progress: str, variable: str) -> DataFrame:
    """What a flow still holds of one of its state variables, one row for each element."""
    return spark.read.format("statestore").option("stateVarName", variable).load(progress)


def _timed(spark: SparkSession, path: str, time: str, late: str, files_per_trigger: int, select) -> DataFrame:
    frame = select(source(spark, path, files_per_trigger)).withColumn("_t", F.col(time).cast("timestamp"))
    return frame.where("_t is not null").withWatermark("_t", late).withColumn("time_us", F.unix_micros("_t"))


def stream_sessions(spark: SparkSession, path: str, time: str, keys: list[str], gap: str, late: str, files_per_trigger: int = 8) -> tuple[DataFrame, DataFrame, int]:
    """Sessions of the Parquet files at ``path`` (with a column ``value``): (closed ones, those still open, late rows).

    Both tables are ``(*keys, start, end, event_size, strongest)``; a row belongs to a session if it lies ``gap`` or less
    behind the one before it; ``end`` is the last row's time and the gap. Timers close sessions as the stream goes on. Rows
    more than ``late`` behind the latest time of the batches up to the one before the last are dropped and counted; the union of both tables is
    exact if there are none, however the rows are dealt over files and whatever their order. Rows without a
    time are left out; null keys are keys and null values no value. The state is totals, so it grows with the open sessions and
    not with their rows."""
    gap_us = int(pd.Timedelta(gap).value // 1000)
    flow = _timed(spark, path, time, late, files_per_trigger, lambda s: s.select(time, *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col("value").cast("double").alias("value")))
    kinds = {f.name: f.dataType for f in flow.schema}
    fields = [T.StructField(f"k{i}", kinds[f"k{i}"]) for i in range(len(keys))]
    schema = T.StructType(fields + T._parse_datatype_string(_OPEN).fields)
    totals = flow.groupBy(*(f"k{i}" for i in range(len(keys)))).transformWithStateInPandas(SessionTotals(gap_us), schema, "Append", "EventTime")
    out, progress, late_rows = _run(spark, totals)

    def shown(df: DataFrame) -> DataFrame:
        ends = (F.timestamp_micros("first_us").alias("start"), F.timestamp_micros(F.col("last_us") + gap_us).alias("end"))
        return df.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), *ends, F.col("size").alias("event_size"), "strongest")

    left = _state(spark, progress, "open").select("key.*", "list_element.*")
    return shown(spark.read.schema(schema).parquet(out)), shown(left), late_rows


def stream_islands(spark: SparkSession, path: str, select: Callable[[DataFrame], DataFrame], time: str, keys: list[str], gap: str, late: str, build: Callable[[pd.DataFrame], pd.DataFrame], schema: str, files_per_trigger: int = 8) -> tuple[DataFrame, DataFrame, int]:
    """``build`` over every time island (rows ``gap`` or less apart) of each key of ``select`` over the files at ``path``:
    (results of closed islands, of those still open, late rows), as in ``stream_sessions``.

    The state keeps the rows of open islands, which ``build`` needs; keys may not be null here."""
    gap_us = int(pd.Timedelta(gap).value // 1000)
    flow = _timed(spark, path, time, late, files_per_trigger, select).drop(time)
    rows = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flow.schema if f.name != "_t")
    islands = flow.groupBy(*keys).transformWithStateInPandas(IslandRows(gap_us, rows, build), schema, "Append", "EventTime")
    out, progress, late_rows = _run(spark, islands)

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = unpacked(pdf["batch"])
        spans = merged([(int(t), int(t), 1, None) for t in pdf["time_us"]], gap_us)
        return pd.concat([build(pdf[pdf["time_us"].between(first, last)]) for first, last, *_ in spans])

    left = _state(spark, progress, "rows").select("key.*", "list_element.batch").groupBy(*keys).applyInPandas(rest, schema)
    return spark.read.schema(T._parse_datatype_string(schema)).parquet(out), left, late_rows
