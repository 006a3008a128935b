"""Chroma fingerprints of audio columns and their alignment.

A recording becomes a sequence of pitch-class frames (12 energies each); sixteen filters, each the balance between two
parts of a rectangle of frames read from an integral image, are quantised to two bits and packed into one 32-bit
integer per frame. Two recordings are aligned by the histogram of offsets at which their integers agree, where those of
the asked recording are also looked up with their least certain bits turned, and compared by the share of differing bits
where they then overlap. Integers that last over frames, as in silence or a steady tone, tell nothing of an offset; only
those that differ from the frame before are looked up, each together with the upper half of the one ``STEP`` frames later, as
one integer alone would meet strangers by chance in a large collection.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

RATE = 8000
FRAME, HOP = 1024, 256
LOW_HZ, HIGH_HZ = 60.0, 3500.0
#: Frames that the widest filter spans.
SPAN = 16
#: Frames between the two integers of a key.
STEP = 8
#: Least certain filters of a key's first integer, and of the upper half of its second one, whose bits are turned in the look-up, in every combination.
DOUBTS, LATER_DOUBTS = 3, 2
#: Integers that must agree at the best offset, and the largest share of differing bits of an aligned pair.
MIN_VOTES, MAX_BIT_ERROR = 3, 0.25
#: Filters by a rule: kind of balance, first pitch class, pitch classes, frames.
FILTERS = [(k % 4, 3 * k % 12, 2 + 5 * k % 7, (4, 8, 12, 16)[k // 4]) for k in range(16)]
#: Balances (log ratios) at which the two bits change.
LEVELS = (-0.35, 0.0, 0.35)
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def samples(media: bytes | None) -> np.ndarray:
    """Mono samples in -1..1 of a PCM WAV file of 8 to 32 bits; none if it is null or can't be read. Of a file that was cut
    off, the whole frames that are left."""
    try:
        with wave.open(io.BytesIO(media or b"")) as file:
            size, channels = file.getsampwidth(), file.getnchannels()
            raw = file.readframes(file.getnframes())
    except (wave.Error, EOFError):
        return np.empty(0)
    if not 1 <= size <= 4 or not channels:
        return np.empty(0)
    cells = np.frombuffer(raw[: len(raw) // (size * channels) * size * channels], np.uint8).reshape(-1, size)
    if size == 1:  # the only unsigned width
        values = cells[:, 0].astype(np.float64) / 128 - 1
    else:
        wide = np.zeros((len(cells), 4), np.uint8)
        wide[:, 4 - size :] = cells
        values = wide.view("<i4")[:, 0] / 2.0**31
    return values.reshape(-1, channels).mean(axis=1)


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The used bins of a spectrum in the order of their pitch classes, and where each class begins."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    pitch = np.round(12 * np.log2(hz[used] / 440)).astype(int) % 12
    order = np.argsort(pitch, kind="stable")
    return used[order], np.searchsorted(pitch[order], np.arange(12))


def chroma(signal: np.ndarray) -> np.ndarray:
    """Pitch-class energies of each frame, smoothed over five frames and scaled to unit length."""
    n = (len(signal) - FRAME) // HOP + 1
    if n < 5:
        return np.empty((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP] * np.hanning(FRAME)
    bins, begin = _classes()
    spectrum = np.fft.rfft(frames, axis=1)
    energy = np.add.reduceat((spectrum.real**2 + spectrum.imag**2)[:, bins], begin, axis=1)
    smooth = sum(w * energy[i : n - 4 + i] for i, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    return smooth / np.maximum(np.sqrt((smooth**2).sum(axis=1, keepdims=True)), 1e-9)


def fingerprint(frames: np.ndarray, doubts: bool = False) -> np.ndarray:
    """One uint32 for each frame that has ``SPAN`` frames from it on. With ``doubts``, a table of further columns: the
    bits that change if each of the ``DOUBTS`` least certain filters, then of the ``LATER_DOUBTS`` ones of the upper half,
    falls on the other side of its nearest level."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.empty((0, 1 + DOUBTS + LATER_DOUBTS) if doubts else 0, np.uint32)
    wide = np.concatenate([frames, frames], axis=1)  # pitch classes go round
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = wide.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[t + t1, p1] - image[t + t0, p1] - image[t + t1, p0] + image[t + t0, p0]

    out, margins, turns = np.zeros(n, np.uint32), [], []
    for place, (kind, low, high, width) in enumerate(FILTERS):
        up, half = low + high, width // 2
        middle = low + max(1, high // 2)
        whole = area(0, width, low, up)
        if kind == 0:  # later against earlier
            a = area(half, width, low, up)
        elif kind == 1:  # upper against lower
            a = area(0, width, middle, up)
        elif kind == 2:  # one diagonal of quarters against the other
            a = area(0, half, low, middle) + area(half, width, middle, up)
        else:  # the middle frames against the outer ones
            a = area(width // 4, width - width // 4, low, up)
        balance = np.round(np.log((a + 1e-3) / (whole - a + 1e-3)), 6)  # steady sounds stay on one side of a level
        level = np.digitize(balance, LEVELS)
        out = out << np.uint32(2) | _GRAY[level]
        if doubts:
            apart = np.abs(balance[:, None] - LEVELS)
            nearest = apart.argmin(axis=1)
            margins.append(apart[t, nearest])
            turns.append((_GRAY[nearest] ^ _GRAY[nearest + 1]) << np.uint32(2 * (len(FILTERS) - 1 - place)))
    if not doubts:
        return out
    margin, turn = np.stack(margins, axis=1), np.stack(turns, axis=1)
    least = np.argsort(margin, axis=1, kind="stable")[:, :DOUBTS]
    upper = np.argsort(margin[:, : len(FILTERS) // 2], axis=1, kind="stable")[:, :LATER_DOUBTS]
    return np.concatenate([out[:, None], np.take_along_axis(turn, least, 1), np.take_along_axis(turn, upper, 1)], axis=1)


def tone_wav(vector: list[float] | None) -> bytes | None:
    """A 16-bit WAV of about 4 seconds whose notes follow the components of a vector: eight octaves to a unit around 440 Hz."""
    if vector is None or not len(vector):
        return None
    x = np.nan_to_num(np.asarray([v if v is not None else 0.0 for v in vector], float))
    hz = np.clip(440 * 2 ** np.clip(8 * x, -2.5, 2.5), 70, 3000)
    n = max(1, 128 * HOP // len(x))
    phase = np.cumsum(np.repeat(hz, n)) * 2 * np.pi / RATE
    sound = io.BytesIO()
    with wave.open(sound, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(RATE)
        file.writeframes((np.sin(phase) * 0.6 * 32767).astype("<i2").tobytes())
    return sound.getvalue()


def _voiced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.record_batch([part.column(0), pa.array([tone_wav(v) for v in part.column(1).to_pylist()], pa.binary())], names=["media_id", "media"])


def media_from_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A media table ``(media_id, media)`` of WAV files that sound the rows' vectors; a null or empty vector gives null media."""
    return vectors.select(F.col(id_col).cast("long").alias("media_id"), F.col(vector_col)).mapInArrow(_voiced, "media_id long, media binary")


def tracks_from_vectors(vectors: DataFrame, segments: int = 4, notes: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, embedding)``: for each row the first ``notes`` components of the vectors of its id and the next ``segments`` - 1
    ids, one after the other, so that recordings of neighbouring ids share sound at known offsets.

    Missing, null and empty vectors leave their part out; of repeated ids one vector sounds; null ids give no track."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.slice(F.col(vector_col), 1, notes).alias("part")).where("id is not null").groupBy("id").agg(F.min("part").alias("part"))
    parts = rows.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda k: F.col("id") - k)).alias("at", "track"), "part")
    gathered = parts.where("part is not null").groupBy("track").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))  # a few for each track
    tracks = rows.select("id").join(gathered, F.col("id") == F.col("track"), "left")
    return tracks.select(F.col("id").alias("vec_id"), F.flatten(F.transform("parts", lambda p: p["part"])).alias("embedding"))


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            prints, doubts = [], []
            for m, asked in zip(part.column("media").to_pylist(), part.column("asked").to_pylist()):
                table = fingerprint(chroma(samples(m)), bool(asked)).astype("<u4")
                prints.append((table[:, 0] if asked else table).tobytes())
                doubts.append(table[:, 1:].tobytes() if asked else None)
            yield pa.record_batch([part.column("media_id"), part.column("asked"), pa.array(prints, pa.binary()), pa.array(doubts, pa.binary())], names=["media_id", "asked", "print", "doubts"])


def fingerprints(media: DataFrame, asked=None) -> DataFrame:
    """``(media_id, asked, print, doubts)``: little-endian uint32 integers of each recording of ``media(media_id, media)``,
    and for those that the condition ``asked`` selects the least certain bits of each.

    Null, unreadable and too short media have an empty print."""
    flag = F.lit(False) if asked is None else F.coalesce(asked, F.lit(False))
    return media.select("media_id", flag.alias("asked"), "media").mapInArrow(_printed, "media_id long, asked boolean, print binary, doubts binary")


def told(print_: np.ndarray) -> np.ndarray:
    """The places of a print whose integer differs from the one before and that have one ``STEP`` later."""
    at = np.flatnonzero(print_[1:] != print_[:-1]) + 1
    return at[at + STEP < len(print_)]


def keys(print_: np.ndarray, doubts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys with a row for each place): 48 bits, and with ``doubts`` every combination of the least certain ones turned."""
    at = told(print_)
    own = (print_[at].astype(np.int64) << 16 | print_[at + STEP] >> 16)[:, None]
    if doubts is not None:
        turns = [x.astype(np.int64) << 16 for x in doubts[at, :DOUBTS].T] + [x.astype(np.int64) >> 16 for x in doubts[at + STEP, DOUBTS:].T]
        for turn in turns:
            own = np.concatenate([own, own ^ turn[:, None]], axis=1)
    return at, own


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The integers of each print; with ``doubts``, also each with every combination of its least certain bits turned."""
    for batch in batches:
        ids, found, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, (value, doubts) in enumerate(zip(batch.column("print").to_pylist(), batch.column("doubts").to_pylist())):
            x = np.frombuffer(value, "<u4")
            at, own = keys(x, None if doubts is None else np.frombuffer(doubts, "<u4").reshape(-1, DOUBTS + LATER_DOUBTS))
            ids.append(np.full(own.size, i))
            found.append(own.ravel())
            places.append(np.repeat(at, own.shape[1]))
        rows, key, at = np.concatenate(ids), np.concatenate(found), np.concatenate(places)
        yield pa.record_batch([batch.column("class_id").take(pa.array(rows)), pa.array(key), pa.array(at.astype(np.int32))], names=["class_id", "key", "at"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        error = []
        for a, b, offset in zip(*(batch.column(c).to_pylist() for c in ("print", "other", "offset"))):
            x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
            x, y = x[max(0, -offset) :], y[max(0, offset) :]
            n = min(len(x), len(y))
            error.append(float(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n) if n else 1.0)
        yield pa.record_batch([*(batch.column(c) for c in ("class_id", "match_class", "offset", "votes")), pa.array(error)], names=["class_id", "match_class", "offset", "votes", "bit_error"])


def align_recordings(media: DataFrame, asked, min_votes: int = MIN_VOTES, max_bit_error: float = MAX_BIT_ERROR) -> DataFrame:
    """Align the recordings that the condition ``asked`` (on media_id) selects with all recordings.

    Recordings with the same print form a class, named by its smallest id; classes are compared, not their members.
    The result has one row for each recording (``media_id, class_id``, the rest null) and one for each aligned pair of
    an asked class (``media_id`` = ``class_id``) with another class: ``match_class, offset`` (frames by which the
    match's sound lies later), ``votes, bit_error``. Of equal offsets the smallest in size, then the negative one,
    is taken. A steady or silent stretch has no integers to look up, so recordings that share only such a stretch do not
    align. Recordings without a print are a class of their own, by themselves. Null ids and repeated rows are kept;
    extra columns are ignored; an empty table gives an empty result.
    """
    prints = checkpointed(fingerprints(media, asked).withColumn("digest", F.sha2("print", 256)))
    voiced = prints.where(F.length("print") > 0)
    classes = checkpointed(voiced.groupBy("digest").agg(F.min("media_id").alias("class_id"), F.max("asked").alias("asked"), F.first("print").alias("print"), F.max("doubts").alias("doubts")).where("class_id is not null"))
    left = classes.where("asked").select("class_id", "print", "doubts").mapInArrow(_keyed, "class_id long, key long, at int").withColumnRenamed("at", "begin")
    every = classes.select("class_id", "print", F.lit(None).cast("binary").alias("doubts")).mapInArrow(_keyed, "class_id long, key long, at int")
    right = every.select(F.col("class_id").alias("match_class"), "key", F.col("at").alias("end"))
    votes = left.join(right, "key").where("class_id <> match_class").groupBy("class_id", "match_class", (F.col("end") - F.col("begin")).alias("offset")).agg(F.count("*").alias("votes"))
    best = Window.partitionBy("class_id", "match_class").orderBy(F.desc("votes"), F.abs("offset"), "offset")
    aligned = votes.where(F.col("votes") >= min_votes).withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")
    own, other = classes.select("class_id", "print"), classes.select(F.col("class_id").alias("match_class"), F.col("print").alias("other"))
    pairs = aligned.join(own, "class_id").join(other, "match_class").select("class_id", "match_class", "offset", "votes", "print", "other")
    pairs = pairs.mapInArrow(_compared, "class_id long, match_class long, offset int, votes long, bit_error double").where(F.col("bit_error") <= max_bit_error)
    named = prints.join(classes.select("digest", F.col("class_id")), "digest", "left").select("media_id", F.coalesce("class_id", "media_id").alias("class_id"))
    return named.unionByName(pairs.withColumn("media_id", F.col("class_id")), allowMissingColumns=True)
