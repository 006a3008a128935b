"""Search-mode FITS observations: headers and sample blocks from any path that Spark can read."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 2880
_HEADER = {"TBIN": "tbin_s", "NCHAN": "nchan", "NSBLK": "nsblk", "NPOL": "npol", "NBITS": "nbits", "NAXIS2": "naxis2"}
HEADER_SCHEMA = "path string, tbin_s double, nchan int, nsblk int, npol int, nbits int, naxis2 int, obsfreq_mhz double, obsbw_mhz double, stt_imjd int, stt_smjd int, stt_offs double, error string"
BLOCK_SCHEMA = "path string, row int, nsblk int, npol int, nchan int, nbits int, data binary, error string"


def _cards(data: bytes, at: int) -> tuple[dict[str, object], int]:
    """The header cards from a byte position, and where the unit's data begin."""
    cards: dict[str, object] = {}
    while at < len(data):
        card = data[at : at + 80].decode("ascii", "replace")
        at += 80
        key = card[:8].strip()
        if key == "END":
            return cards, -(-at // BLOCK) * BLOCK
        if card[8:10] == "= ":
            value = card[10:].strip()
            if value.startswith("'"):
                cards[key] = value[1:].split("'")[0].rstrip()
            else:
                value = value.split("/")[0].strip()
                cards[key] = {"T": True, "F": False}.get(value) if value in "TF" else (int(value) if value.lstrip("+-").isdigit() else float(value.replace("D", "E")))
    raise ValueError("header without an end")


def _width(form: str) -> int:
    """Bytes of a table column by its TFORM: a repeat count and a type letter."""
    if not (found := re.match(r"\s*(\d*)([A-Z])", form)):
        raise ValueError(f"column form {form!r}")
    count, kind = found.groups()
    n = int(count or 1)
    return (n + 7) // 8 if kind == "X" else n * {"I": 2, "J": 4, "E": 4, "K": 8, "D": 8, "C": 8, "M": 16, "P": 8, "Q": 16}.get(kind, 1)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path there."""
    scheme, colon, rest = path.partition(":")
    if not colon:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + "://" + (rest if rest.startswith("//") else "//" + rest).removeprefix("//"))


def layout(read: Callable[[int, int], bytes], size: int) -> tuple[dict[str, object], dict[str, object], int, int, int]:
    """(primary cards, table cards, where the table's rows begin, first byte of DATA in a row, its bytes) of a file, of
    which only header units are read: ``read(at, n)`` gives ``n`` bytes from ``at``."""

    def unit(at: int) -> tuple[dict[str, object], int]:
        data = b""
        while at + len(data) < size:
            data += read(at + len(data), BLOCK)
            if any(data[i : i + 8].rstrip() == b"END" for i in range(max(0, len(data) - BLOCK), len(data), 80)):
                break
        cards, length = _cards(data, 0)
        return cards, at + length

    primary, at = unit(0)
    while at < size:
        table, at = unit(at)
        held = int(table["NAXIS1"]) * int(table["NAXIS2"])
        if table.get("XTENSION") == "BINTABLE" and table.get("EXTNAME") == "SUBINT":
            if at + held > size:
                raise ValueError("file is cut short")
            begin = 0
            for i in range(1, int(table["TFIELDS"]) + 1):
                width = _width(str(table[f"TFORM{i}"]))
                if table.get(f"TTYPE{i}") == "DATA":
                    return primary, table, at, begin, width
                begin += width
            raise ValueError("no DATA column")
        at += -(-held // BLOCK) * BLOCK
    raise ValueError("no SUBINT table")


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")


def _layout_of(path: str, length: int) -> tuple:
    system, name = opened(path)
    with system.open_input_file(name) as f:

        def read(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        return layout(read, length)


def _read_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    cast = {"double": float, "int": int, "string": str}
    fields = [f.split() for f in HEADER_SCHEMA.split(", ")]
    for batch in batches:
        out = []
        for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
            row = {"path": path, "error": None}
            try:
                primary, table, *_ = _layout_of(path, length)
                found = {name: table.get(key) for key, name in _HEADER.items()}
                found |= {"obsfreq_mhz": primary.get("OBSFREQ"), "obsbw_mhz": primary.get("OBSBW"), "stt_imjd": primary.get("STT_IMJD"), "stt_smjd": primary.get("STT_SMJD"), "stt_offs": primary.get("STT_OFFS")}
                row |= {n: cast[k](found[n]) for n, k in fields if found.get(n) is not None}
            except (ValueError, KeyError, TypeError) as e:
                row["error"] = str(e)
            out.append(row)
        yield pa.record_batch([pa.array([r.get(n) for r in out], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def read_headers(spark: SparkSession, path: str, glob: str = "*.fits") -> DataFrame:
    """One row per file, of which only the header units are read; a file that can't be parsed has only its path and the error."""
    return _files(spark, path, glob).mapInArrow(_read_headers, HEADER_SCHEMA)


def frequency(channel: Column) -> Column:
    """Frequency in MHz of a channel number, from a header row's centre and bandwidth."""
    return F.col("obsfreq_mhz") - F.col("obsbw_mhz") / 2 + channel * (F.col("obsbw_mhz") / F.col("nchan"))


_RANGE = "path string, at long, width long, stride long, row int, n int, nsblk int, npol int, nchan int, nbits int, error string"


def _ranges(range_bytes: int):
    """Stretches of rows of each file, of about ``range_bytes``."""
    fields = [f.split() for f in _RANGE.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                try:
                    _, table, at, begin, width = _layout_of(path, length)
                    shape = [int(table[k]) for k in ("NSBLK", "NPOL", "NCHAN", "NBITS")]
                    stride, total = int(table["NAXIS1"]), int(table["NAXIS2"])
                    step = max(1, range_bytes // max(1, stride))
                    rows += [(path, at + i * stride + begin, width, stride, i, min(step, total - i), *shape, None) for i in range(0, total, step)]
                except (ValueError, KeyError, TypeError) as e:
                    rows.append((path, *[None] * 9, str(e)))
            columns = list(zip(*rows)) or [()] * len(fields)
            yield pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])

    return run


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "row", "nsblk", "npol", "nchan", "nbits", "data", "error"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    for batch in batches:
        for r in batch.to_pylist():
            if r["error"] is not None:
                yield pa.record_batch([pa.array([c], k) for c, k in zip((r["path"], *[None] * 6, r["error"]), kinds)], names=names)
                continue
            system, name = opened(r["path"])
            shape = [r[k] for k in ("nsblk", "npol", "nchan", "nbits")]
            with system.open_input_file(name) as f:
                for i in range(r["n"]):
                    f.seek(r["at"] + i * r["stride"])
                    cell = (r["path"], r["row"] + i, *shape, f.read(r["width"]), None)
                    yield pa.record_batch([pa.array([c], k) for c, k in zip(cell, kinds)], names=names)


def read_blocks(spark: SparkSession, path: str, glob: str = "*.fits", range_bytes: int = 64 << 20) -> DataFrame:
    """One row per table row of each file with its raw samples; a bad file gives one row with the error
    (Spark doesn't list empty files, which are missing ones here).

    A task reads the headers of its files, then stretches of rows of about ``range_bytes`` are spread over tasks, each of
    which reads its bytes row by row: a file of any size is read by many tasks and never held as a whole."""
    ranges = _files(spark, path, glob).mapInArrow(_ranges(range_bytes), _RANGE)
    return ranges.repartition(F.col("path"), F.coalesce("row", F.lit(-1))).mapInArrow(_read_blocks, BLOCK_SCHEMA)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done: list[tuple[str, int]] = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            system, name = opened(path)
            folder, _, last = name.rpartition("/")
            system.create_dir(folder, recursive=True)
            hidden = f"{folder}/_{last}-{uuid.uuid4().hex}"
            with system.open_output_stream(hidden) as f:
                f.write(content.as_buffer())
            system.move(hidden, name)
            done.append((path, len(content.as_buffer())))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*done)) or [(), ()], (pa.string(), pa.int64()))], names=["path", "bytes"])


def write_files(files: DataFrame) -> DataFrame:
    """Write ``files(path, content)``, each under a hidden name and then moved, so that readers and repeated tasks meet whole
    files only: ``(path, bytes)``, when the result is asked for."""
    return files.mapInArrow(_write, "path string, bytes long")


def samples(data: bytes, nsblk: int, npol: int, nchan: int, nbits: int) -> np.ndarray:
    """(time, pol, chan) levels of one table row: 8-bit values, or 2-bit levels packed from the upper bits down."""
    raw = np.frombuffer(data, np.uint8)
    if nbits == 2:
        raw = np.stack([raw >> s & 3 for s in (6, 4, 2, 0)], axis=1).reshape(-1)
    return raw.reshape(nsblk, npol, nchan)


def _spectrum(reverse: bool, pool: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["error"] is not None:
                    continue
                x = samples(r["data"], r["nsblk"], r["npol"], r["nchan"], r["nbits"])[:, :2].mean(axis=1)
                x = x[: len(x) // pool * pool].reshape(-1, pool, x.shape[1]).mean(axis=1)
                if reverse:
                    x = x[:, ::-1]
                t = np.repeat(np.arange(len(x)) + r["row"] * (r["nsblk"] // pool), x.shape[1])
                yield pa.record_batch([pa.array([r["path"]] * x.size), pa.array(t.astype(np.int64)), pa.array(np.tile(np.arange(x.shape[1], dtype=np.int32), len(x))), pa.array(x.reshape(-1))], names=["path", "t", "chan", "v"])

    return run


def spectrum(blocks: DataFrame, reverse: bool = False, pool: int = 1) -> DataFrame:
    """``(path, t, chan, v)``: mean of the first two polarizations, pooled over ``pool`` samples, channels reversed on demand."""
    return blocks.mapInArrow(_spectrum(reverse, pool), "path string, t long, chan int, v double")


def bad_files(blocks: DataFrame) -> DataFrame:
    return blocks.where("error is not null").select("path", "error")


def replace_bad(blocks: DataFrame, like: DataFrame, pool: int = 1) -> DataFrame:
    """Uniform noise ``(u - 0.5) sqrt(15 / pool) + 1.5`` in the place of bad files, from a hash of path, sample and channel:
    ``(path, t, chan, v)``. ``like`` is the header table that tells the shape of a good file."""
    shape = like.where("error is null").agg(F.max(F.col("naxis2") * F.col("nsblk")).alias("n"), F.max("nchan").alias("nchan"))
    cells = bad_files(blocks).crossJoin(F.broadcast(shape)).select("path", "nchan", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {pool} - 1"))).alias("t"))
    cells = cells.select("path", "t", F.explode(F.sequence(F.lit(0), F.col("nchan") - 1)).alias("chan"))
    u = F.pmod(F.xxhash64("path", "t", "chan"), F.lit(1 << 24)) / float(1 << 24)
    return cells.withColumn("v", (u - 0.5) * float(np.sqrt(15 / pool)) + 1.5)


def inconsistent(headers: DataFrame) -> DataFrame:
    """Header keys that differ between good files: ``(key, n_values)``."""
    keys = ["tbin_s", "nchan", "nsblk", "npol", "nbits", "naxis2", "obsfreq_mhz", "obsbw_mhz"]
    counts = headers.where("error is null").agg(*[F.count_distinct(F.coalesce(F.col(k).cast("string"), F.lit(""))).alias(k) for k in keys])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("n_values")) for k in keys])).alias("x")).select("x.*").where("n_values > 1")


def encode(x: np.ndarray, nbits: int = 8, tbin_s: float = 49.152e-6, nsblk: int | None = None, obsfreq: float = 1250.0, obsbw: float = 500.0, imjd: int = 60000, axis: np.ndarray | None = None, scales: bool = False) -> bytes:
    """A small search-mode file of (time, pol, chan) levels, with a frequency ``axis`` in each row and with offsets and
    scales of each polarization and channel on demand."""
    nsblk = nsblk or len(x)
    rows = x.reshape(-1, nsblk * x.shape[1] * x.shape[2]).astype(np.uint8)
    if nbits == 2:
        four = rows.reshape(len(rows), -1, 4)
        rows = four[:, :, 0] << 6 | four[:, :, 1] << 4 | four[:, :, 2] << 2 | four[:, :, 3]

    def unit(cards: dict[str, object]) -> bytes:
        def text(v: object) -> str:
            return ("T" if v else "F") if isinstance(v, bool) else (f"'{v}'" if isinstance(v, str) else repr(v))

        head = "".join(f"{k:<8}= {text(v):>20}".ljust(80) for k, v in cards.items()) + "END".ljust(80)
        return head.ljust(-(-len(head) // BLOCK) * BLOCK).encode()

    def wide(values: np.ndarray, kind: str) -> np.ndarray:
        return np.broadcast_to(np.frombuffer(np.asarray(values).astype(kind).tobytes(), np.uint8), (len(rows), len(values) * int(kind[-1])))

    columns = [("OFFS_SUB", "1D", np.zeros((len(rows), 8), np.uint8))]
    cells = x.shape[1] * x.shape[2]
    columns += [("DAT_FREQ", f"{len(axis)}D", wide(axis, ">f8"))] if axis is not None else []
    columns += [("DAT_OFFS", f"{cells}E", wide(np.arange(cells), ">f4")), ("DAT_SCL", f"{cells}E", wide(np.arange(cells) + 0.5, ">f4"))] if scales else []
    columns.append(("DATA", f"{rows.shape[1]}B", rows))
    names = {f"{k}{i}": v for i, (name, form, _) in enumerate(columns, 1) for k, v in (("TTYPE", name), ("TFORM", form))}
    first = unit({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0, "OBSFREQ": obsfreq, "OBSBW": obsbw, "STT_IMJD": imjd, "STT_SMJD": 0, "STT_OFFS": 0.0})
    table = unit({"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": sum(c.shape[1] for *_, c in columns), "NAXIS2": len(rows), "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(columns), **names,
                  "EXTNAME": "SUBINT", "TBIN": tbin_s, "NCHAN": x.shape[2], "NPOL": x.shape[1], "NBITS": nbits, "NSBLK": nsblk})
    body = np.concatenate([c for *_, c in columns], axis=1).tobytes()
    return first + table + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")
