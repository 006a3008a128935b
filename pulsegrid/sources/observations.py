"""Search-mode observations as a Spark data source: ``spark.read.format("observations")`` and ``df.write.format("observations")``.

Reading splits files by bytes and pushes filters on file, time and channel into the reader. Writing copies template files
row by row with new samples, and moves the finished files into place only when all tasks have ended well."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import gcd, inf

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from . import psrfits

READ_SCHEMA = "file string, t long, chan int, freq_mhz double, v double"
#: The pooled time resolution in seconds is this times the time factor, and this many channels stay after pooling (fixed values).
TIME_UNIT_S, CHANNELS = 49.152e-6, 512
_KIND = re.compile(r"\s*(\d*)([A-Z])")
_CODES = {"B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}


def time_pool(tbin_s: float, time_factor: float = 8.0) -> int:
    """Samples that one pooled sample takes."""
    return max(1, int(TIME_UNIT_S * time_factor / tbin_s))


def channel_pool(nchan: int) -> int:
    return max(1, nchan // CHANNELS)


@dataclass(frozen=True)
class Column:
    name: str
    form: str
    begin: int
    width: int


@dataclass(frozen=True)
class Table:
    """Where the samples of a file are."""

    primary: dict
    cards: dict
    at: int
    columns: dict[str, Column]

    @property
    def stride(self) -> int:
        return int(self.cards["NAXIS1"])

    @property
    def rows(self) -> int:
        return int(self.cards["NAXIS2"])

    @property
    def shape(self) -> tuple[int, int, int, int]:
        return tuple(int(self.cards[k]) for k in ("NSBLK", "NPOL", "NCHAN", "NBITS"))


def described(f, size: int) -> Table:
    """The table of an open file, of which only header units are read."""

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    primary, cards, at, *_ = psrfits.layout(read, size)
    columns, begin = {}, 0
    for i in range(1, int(cards["TFIELDS"]) + 1):
        form = str(cards[f"TFORM{i}"])
        name = str(cards.get(f"TTYPE{i}", f"column{i}"))
        columns[name] = Column(name, form, begin, psrfits._width(form))
        begin += columns[name].width
    return Table(primary, cards, at, columns)


def numbers(f, table: Table, name: str, row: int = 0) -> np.ndarray | None:
    """The numbers of a column in one row; None without the column."""
    column = table.columns.get(name)
    if column is None:
        return None
    f.seek(table.at + row * table.stride + column.begin)
    return np.frombuffer(f.read(column.width), _CODES[_KIND.match(column.form)[2]]).astype(np.float64)


def frequencies(f, table: Table) -> tuple[np.ndarray, bool]:
    """Rising frequencies of the channels, and whether the file has them the other way round: from ``DAT_FREQ``, else from
    the centre frequency and the bandwidth (which is negative where the axis falls)."""
    nchan = table.shape[2]
    axis = numbers(f, table, "DAT_FREQ") if table.rows else None
    if axis is None or len(axis) != nchan:
        centre, band = float(table.primary["OBSFREQ"]), float(table.primary["OBSBW"])
        axis = centre - band / 2 + np.arange(nchan) * band / nchan
    falls = bool(nchan > 1 and axis[0] > axis[-1])
    return (axis[::-1] if falls else axis), falls


def listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """Files (and their bytes) in a folder and below whose name fits, or the one file that ``path`` names."""
    system, name = psrfits.opened(path)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    info = system.get_file_info(name)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=True))
    good = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + r"\Z")
    return sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File and good.match(x.base_name) and not x.base_name.startswith(("_", ".")))


@dataclass
class Stretch(ds.InputPartition):
    """Bytes of a file; the rows that begin in them are a task's."""

    path: str
    size: int
    begin: int
    end: int


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


class ObservationReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.pattern = options.get("glob", "*.fits")
        self.stretch = int(options.get("stretch_bytes", 64 << 20))
        self.pooled = options.get("pooled", "false").lower() == "true"
        self.factor = float(options.get("time_factor", 8.0))
        self.bad = options.get("bad_files", "fail")
        self.files: set[str] | None = None
        self.t, self.chan = [-inf, inf], [-inf, inf]  # ends included

    def pushFilters(self, filters: list[ds.Filter]):  # noqa: N802
        """Takes equality and ranges of ``file``, ``t`` and ``chan``; gives back what Spark has to do."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if name == "file" and isinstance(f, (ds.EqualTo, ds.In)):
                values = {value} if isinstance(f, ds.EqualTo) else set(value)
                self.files = values if self.files is None else self.files & values
            elif name in ("t", "chan") and isinstance(value, (int, float)) and isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)):
                span = self.t if name == "t" else self.chan
                if not isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
                    span[0] = max(span[0], value + isinstance(f, ds.GreaterThan))
                if not isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)):
                    span[1] = min(span[1], value - isinstance(f, ds.LessThan))
            elif not (isinstance(f, ds.IsNotNull) and name in ("file", "t", "chan", "v", "freq_mhz")):  # they never are null
                yield f

    def partitions(self) -> list[Stretch]:
        """Only names and sizes are looked at here; tasks read the headers."""
        files = [(p, n) for p, n in listed(self.path, self.pattern) if self.files is None or stem(p) in self.files]
        return [Stretch(p, n, at, min(at + self.stretch, n)) for p, n in files for at in range(0, max(n, 1), self.stretch)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file fits
            return
        system, name = psrfits.opened(partition.path)
        with system.open_input_file(name) as f:
            try:
                table = described(f, partition.size)
                axis, falls = frequencies(f, table)
                nsblk, npol, nchan, nbits = table.shape
                if (nsblk * npol * nchan * nbits) // 8 != table.columns["DATA"].width:
                    raise ValueError("the samples don't fill their column")
            except (ValueError, KeyError, TypeError) as e:
                if self.bad == "skip":
                    return
                raise ValueError(f"{partition.path}: {e}") from None
            time, wide = (time_pool(float(table.cards["TBIN"]), self.factor), channel_pool(nchan)) if self.pooled else (1, 1)
            axis = axis[: nchan // wide * wide].reshape(-1, wide).mean(axis=1)
            keep = np.arange(max(0, int(max(self.chan[0], 0))), int(min(self.chan[1], len(axis) - 1)) + 1)
            unit = time // gcd(time, nsblk)  # rows that begin with a pooled sample are so far apart
            for row in range(0, table.rows, unit):
                if not partition.begin <= table.at + row * table.stride < partition.end:
                    continue
                first, n = row * nsblk // time, min(unit, table.rows - row)
                last = first + n * nsblk // time - 1
                if not len(keep) or last < first or last < self.t[0] or first > self.t[1]:
                    continue
                x = np.concatenate([self._row(f, table, row + i)[:, :, ::-1] if falls else self._row(f, table, row + i) for i in range(n)])
                x = x[: len(x) // time * time, :2, : nchan // wide * wide].mean(axis=1, dtype=np.float64)
                x = x.reshape(len(x) // time, time, -1, wide).mean(axis=(1, 3))
                low, high = int(max(self.t[0], first)), int(min(self.t[1], last))
                x = x[low - first : high - first + 1, keep]
                t = np.repeat(np.arange(low, high + 1), len(keep))
                yield pa.record_batch(
                    [pa.array([stem(partition.path)] * x.size, pa.string()), pa.array(t.astype(np.int64)), pa.array(np.tile(keep.astype(np.int32), len(x))), pa.array(np.tile(axis[keep], len(x))), pa.array(x.reshape(-1))],
                    names=["file", "t", "chan", "freq_mhz", "v"],
                )

    @staticmethod
    def _row(f, table: Table, row: int) -> np.ndarray:
        column = table.columns["DATA"]
        f.seek(table.at + row * table.stride + column.begin)
        return psrfits.samples(f.read(column.width), *table.shape)


def _card(key: str, value: object) -> bytes:
    text = ("T" if value else "F") if isinstance(value, bool) else (f"'{value}'" if isinstance(value, str) else repr(value))
    return f"{key:<8}= {text:>20}".ljust(80)[:80].encode()


def _reformed(unit: bytes, changed: dict[str, object], dropped: set[str]) -> bytes:
    """A header unit with some cards changed or left out and all others, with their comments, as they are."""
    cards = [unit[i : i + 80] for i in range(0, len(unit), 80)]
    cards = cards[: next(i for i, c in enumerate(cards) if c[:8].rstrip() == b"END")]
    left, out = dict(changed), []
    for card in cards:
        key = card[:8].decode("ascii", "replace").rstrip()
        if key in dropped:
            continue
        out.append(_card(key, left.pop(key)) if key in left else card)
    out += [_card(k, v) for k, v in left.items()]
    body = b"".join(out) + b"END".ljust(80)
    return body.ljust(-(-len(body) // psrfits.BLOCK) * psrfits.BLOCK)


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[tuple[str, str]]  # hidden and final path


class ObservationWriter(ds.DataSourceWriter):
    """Rows ``(file, row, data)`` go into copies of the template files of the same names, ``data`` taking the place of the
    samples of its table row. With ``bits`` 8 other rows stay as in the template; with 2 the rows are packed levels of one
    polarization, every row must come, and scales and offsets keep their first polarization.

    A task streams one file after the other, row by row, to a hidden name beside the final one. The files move into place
    in ``commit``, after all tasks; in ``abort`` they are removed. So a failed job or task leaves the old files as they are,
    and nobody meets half a file."""

    def __init__(self, options: dict[str, str]):
        self.path, self.template = options["path"].rstrip("/"), options["template"].rstrip("/")
        self.bits = int(options.get("bits", 8))
        self.suffix = options.get("suffix", ".fits")
        if self.bits not in (2, 8):
            raise ValueError("bits must be 2 or 8")

    def write(self, iterator) -> Written:
        files: list[tuple[str, str]] = []
        held = None  # (file, state of the copy)
        try:
            for r in iterator:
                if held is None or held[0] != r["file"]:
                    if held is not None:
                        held[1].close()
                    if any(final == f"{self.path}/{r['file']}{self.suffix}" for _, final in files):
                        raise ValueError(f"the rows of {r['file']} don't come together")
                    hidden, final = f"{self.path}/_{r['file']}-{uuid.uuid4().hex}", f"{self.path}/{r['file']}{self.suffix}"
                    files.append((hidden, final))
                    held = (r["file"], _Copy(f"{self.template}/{r['file']}{self.suffix}", hidden, self.bits))
                held[1].put(int(r["row"]), bytes(r["data"]))
            if held is not None:
                held[1].close()
        except BaseException:
            _remove(hidden for hidden, _ in files)
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [x for m in messages if m is not None for x in m.files]
        if len({final for _, final in files}) < len(files):
            _remove(hidden for hidden, _ in files)
            raise ValueError("the rows of a file were dealt over several tasks")
        for hidden, final in files:
            system, name = psrfits.opened(hidden)
            system.move(name, psrfits.opened(final)[1])

    def abort(self, messages: list[Written | None]) -> None:
        _remove(hidden for m in messages if m is not None for hidden, _ in m.files)


def _remove(paths) -> None:
    for path in paths:
        system, name = psrfits.opened(path)
        if system.get_file_info(name).type == fs.FileType.File:
            system.delete_file(name)


class _Copy:
    """A template file that is being copied with new samples in some of its rows."""

    def __init__(self, template: str, target: str, bits: int):
        system, name = psrfits.opened(template)
        size = system.get_file_info(name).size
        self.source = system.open_input_file(name)
        self.table = described(self.source, size)
        self.bits, self.next, self.size = bits, 0, size
        nsblk, npol, nchan, nbits = self.table.shape
        self.width = nsblk * nchan // 4 if bits == 2 else self.table.columns["DATA"].width
        out, folder = psrfits.opened(target)[0], psrfits.opened(target)[1].rpartition("/")[0]
        out.create_dir(folder, recursive=True)
        self.out = out.open_output_stream(psrfits.opened(target)[1])
        header = self._bytes(0, self.table.at)
        if bits == 8:
            self.out.write(header)
            return
        self.narrow = [c.name for c in self.table.columns.values() if c.name in ("DAT_OFFS", "DAT_SCL") and int(_KIND.match(c.form)[1] or 1) == npol * nchan]
        changed: dict[str, object] = {"NPOL": 1, "NBITS": 2}
        stride = 0
        for i, c in enumerate(self.table.columns.values(), 1):
            if c.name == "DATA":
                changed |= {f"TFORM{i}": f"{self.width}B", f"TDIM{i}": f"(1,{nchan},1,{nsblk // 4})"}
            elif c.name in self.narrow:
                changed[f"TFORM{i}"] = f"{nchan}{_KIND.match(c.form)[2]}"
            stride += self.width if c.name == "DATA" else c.width // npol if c.name in self.narrow else c.width
        at = header.rindex(b"XTENSION")
        self.out.write(header[:at] + _reformed(header[at:], changed | {"NAXIS1": stride}, {"CHECKSUM", "DATASUM"}))
        self.stride = stride

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _old(self, row: int) -> bytes:
        return self._bytes(self.table.at + row * self.table.stride, self.table.stride)

    def put(self, row: int, data: bytes) -> None:
        if row < self.next or row >= self.table.rows or len(data) != self.width:
            raise ValueError(f"row {row} with {len(data)} bytes: rows must rise, lie in the table and hold {self.width} bytes")
        if self.bits == 2 and row > self.next:
            raise ValueError(f"row {self.next} is missing")
        while self.next < row:
            self.out.write(self._old(self.next))
            self.next += 1
        old, npol = self._old(row), self.table.shape[1]
        for c in self.table.columns.values():
            cell = old[c.begin : c.begin + c.width]
            self.out.write(data if c.name == "DATA" else cell[: c.width // npol] if self.bits == 2 and c.name in self.narrow else cell)
        self.next += 1

    def close(self) -> None:
        if self.bits == 2:
            if self.next < self.table.rows:
                raise ValueError(f"row {self.next} is missing")
            self.out.write(b"\0" * (-(self.stride * self.table.rows) % psrfits.BLOCK))
        else:
            while self.next < self.table.rows:
                self.out.write(self._old(self.next))
                self.next += 1
            end = self.table.at + self.table.rows * self.table.stride
            for at in range(end, self.size, 1 << 20):
                self.out.write(self._bytes(at, min(1 << 20, self.size - at)))
        self.out.close()
        self.source.close()


class Observations(ds.DataSource):
    """Options for reading: ``path``, ``glob``, ``stretch_bytes``, ``pooled`` (time by the time factor, channels to 512),
    ``time_factor``, ``bad_files`` (``fail`` or ``skip``); for writing: ``path``, ``template``, ``bits``, ``suffix``."""

    @classmethod
    def name(cls) -> str:
        return "observations"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> ObservationReader:
        return ObservationReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ObservationWriter:
        return ObservationWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Observations)


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """``(file, t, chan, freq_mhz, v)`` of all observations in a folder: the mean of the first two polarizations, channels by
    rising frequency. Filters on ``file``, ``t`` and ``chan`` choose files, table rows and channels before bytes are read."""
    register(spark)
    return spark.read.format("observations").options(**options).load(path)


def write(rows: DataFrame, path: str, template: str, bits: int = 8, **options: object) -> None:
    """Write ``rows(file, row, data)`` over copies of the templates' rows. A file is one task's work, streamed row by row."""
    register(rows.sparkSession)
    dealt = rows.select("file", "row", "data").repartition("file").sortWithinPartitions("file", "row")
    dealt.write.format("observations").mode("append").options(template=template, bits=bits, **options).save(path)
