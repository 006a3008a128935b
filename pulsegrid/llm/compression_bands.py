"""Quality rules with compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. Text that repeats itself compresses far better than
prose of its length, and encoded or random bytes far worse; as short texts compress less than long ones, every length has
its own band of ratios. Counts of words, symbols, repeated lines and repeated eight-word windows come with the verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .wordhash import SPACE, Words

LEVEL = 3
CHUNK = 2048
#: Bytes that a band reaches to, and the least and the largest ratio (bytes to compressed bytes) of prose in it. Prose has
#: 1.1 at 200 bytes and 3 at 60 kB; coded random bytes (base64) have 1.3 at any length, a phrase said over and over 4 to 200.
BANDS = (
    (128, 0.0, 3.0),
    (256, 0.95, 3.25),
    (512, 1.15, 3.5),
    (1024, 1.3, 3.5),
    (4096, 1.36, 3.75),
    (16384, 1.4, 4.0),
    (65536, 1.4, 4.5),
    (float("inf"), 1.4, 6.0),
)
#: Share of the chunks that may lie outside the band of their length.
ODD_SHARE = 0.2
#: Words of a repeated window, least words, and the largest share (per cent) of words in repeated windows.
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
SYMBOLS = "#*$%&|<>"

_RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_odd_chunks long"


def _per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][np.r_[0, ends]])


def _seen_before(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of things with a hash in a text: which equal an earlier one of the text, and which equal any other."""
    order = np.lexsort((hashes, doc))  # stable, so equal ones stay in the order of the text
    d, h = doc[order], hashes[order]
    same = np.r_[False, (d[1:] == d[:-1]) & (h[1:] == h[:-1])][: len(d)]
    earlier, shared = np.empty(len(d), bool), np.empty(len(d), bool)
    earlier[order] = same
    shared[order] = same | np.r_[same[1:], False][: len(d)]
    return earlier, shared


def counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Words, their code points, symbols, repeated lines and words in repeated windows of each text. Words and lines are
    compared by 64-bit hashes within a text."""
    words = Words(texts)
    data = np.frombuffer(words.data, np.uint8)[: sum(map(len, texts)) + len(texts)]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True

    feed = np.zeros(256, bool)
    feed[0x0A] = True
    lines = Words(texts, feed)
    worded = np.r_[0, np.cumsum(~SPACE[np.frombuffer(lines.data, np.uint8)])]
    told = worded[lines.end] > worded[lines.begin]
    earlier, _ = _seen_before(lines.doc[told], lines.hashes[told])

    at = words.starts(WINDOW)
    _, shared = _seen_before(words.doc[at], words.grams(at, WINDOW))
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at[shared], 1)
    np.add.at(edges, at[shared] + WINDOW, -1)
    covered = np.cumsum(edges)[:-1] > 0
    n = len(texts)
    return {
        "n_words": np.diff(words.first),
        "word_chars": _per_text(~SPACE[data] & ((data & 0xC0) != 0x80), ends),
        "n_symbols": _per_text(symbol[data], ends),
        "n_dup_lines": np.bincount(lines.doc[told][earlier], minlength=n),
        "n_repeat_words": np.bincount(words.doc[covered], minlength=n),
    }


def band(length: int, bands=BANDS) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands if length <= most)


def judge(text: bytes, press: zstandard.ZstdCompressor, chunk: int = CHUNK, bands=BANDS) -> tuple[float | None, int, int, bool]:
    """Ratio of the whole text (None if empty), its chunks, those outside the band of their length, and the verdict."""
    if not text:
        return None, 0, 0, False

    def inside(piece: memoryview) -> tuple[float, bool]:
        ratio = len(piece) / len(press.compress(piece))
        low, high = band(len(piece), bands)
        return ratio, low <= ratio <= high

    view = memoryview(text)
    whole, good = inside(view)
    if len(text) <= chunk:
        return whole, 1, int(not good), good
    odd = [not inside(view[i : i + chunk])[1] for i in range(0, len(text), chunk)]
    return whole, len(odd), sum(odd), good and sum(odd) <= ODD_SHARE * len(odd)


def _judged(part: pa.RecordBatch, press: zstandard.ZstdCompressor, chunk: int, bands) -> dict[str, np.ndarray | tuple]:
    texts = [(x.as_py() or "").encode() for x in part.column("text")]
    found = counts(texts)
    failed = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > REPEAT_PERCENT * found["n_words"])
    ratio, n_chunks, n_odd, good = zip(*(judge(t, press, chunk, bands) for t in texts))
    return found | {"base_failed": failed, "kept": ~failed & np.array(good), "ratio": ratio, "n_chunks": n_chunks, "n_odd_chunks": n_odd}


def measure(docs: DataFrame, chunk: int = CHUNK, level: int = LEVEL, bands=BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id as ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``kept``, ``ratio`` (null for an empty text), ``n_chunks`` and ``n_odd_chunks``.

    Null texts count as empty: no words, so ``base_failed``. Null ids and repeated rows give result rows of their own, other
    columns are ignored, an empty table gives an empty result. A text is held whole by one task, with a few times its size
    for the hashes of its words; nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            for part in slices(batch):
                cells = _judged(part, press, chunk, bands)
                kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "ratio": pa.float64()}
                yield pa.record_batch([part.column(0), *(pa.array(x, kinds.get(k, pa.int64())) for k, x in cells.items())], names=["doc_id", *cells])

    return rows.mapInArrow(run, _RESULT)


def keep_compressible(docs: DataFrame, chunk: int = CHUNK, level: int = LEVEL, bands=BANDS) -> DataFrame:
    """The rows of ``docs`` whose ``text`` ``measure`` keeps, with all their columns unchanged, whatever their names and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(_judged(part, press, chunk, bands)["kept"]))

    return docs.mapInArrow(run, docs.schema)
