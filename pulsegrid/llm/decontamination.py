"""Benchmark decontamination by q-gram lemma filtering.

Each benchmark item is cut into pieces: long ones for passages with edits, and short ones, started so densely that every
quote of ``LEAST`` characters holds a whole one; a short piece only counts where ``LEAST`` characters of its item align.
A text region that aligns with a piece of m characters at e edits or fewer shares at least m + 1 - q (e + 1) of its
q-grams, all near one diagonal (text position minus piece position). So shared q-grams are counted for each stretch of
text and piece, then in overlapping bands of diagonals; bands that reach the bound are retained and verified by banded
alignment, many at once. Documents are only scanned: the benchmark goes to the tasks in blocks of bounded size, one at
a time, and each task builds the block's q-gram index.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices

Q = 8
#: Edits allowed in a long piece and in a partial quote, as a share of its characters.
EDIT_SHARE = 0.10
#: Characters of a piece; shorter items are one piece. Pieces of an item start half a piece apart, the last one at its end.
PIECE = 120
#: Characters of a short piece, between starts of two, and edits in one: a quote of SHORT + STEP - 1 characters or more holds a whole one.
SHORT, STEP, SHORT_EDITS = 48, 12, 3
#: Least length of a partial quote, in characters of the item (shorter items count as a whole).
LEAST = 60
#: Benchmark characters in one block of the index, which takes some 64 bytes for each in a worker; each block takes one scan of the documents.
BLOCK_CHARS = 4_000_000
#: Q-grams with more places in a block than this are not counted for a piece, whose bound falls by as many (half of it at most).
FREQUENT = 256
#: Characters of a stretch of text in which shared q-grams are counted, and of its overlap with the next one.
STRETCH, OVERLAP = 16_384, 512
#: Places of shared q-grams, and bands to be aligned, that are worked on at a time.
MOST_PLACES, MOST_BANDS = 2_000_000, 1024
_BITS = 22
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FAR = 1 << 14


def normalised(text: str | None) -> str:
    """Lower case, with runs of white space as one space, trimmed."""
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    """64-bit hash of the Q characters from each position."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(Q):
        h = h * np.uint64(0x100000001B3) + codes[k : k + n]
    return h * _FACTOR


@dataclass
class Index:
    """Distinct pieces of one block of the benchmark and where their q-grams are."""

    texts: list[str]
    codes: list[np.ndarray]
    owners: list[list[tuple[int, str, int] | tuple[int]]]  # of each piece: its items, those of a short piece with the item's text and its place in it
    edits: np.ndarray
    bounds: np.ndarray  # shared q-grams needed
    known: np.ndarray  # bitmap by the upper hash bits
    grams: np.ndarray  # sorted distinct hashes
    begin: np.ndarray  # of each hash in `piece` and `at`
    piece: np.ndarray
    at: np.ndarray
    tiny: list[tuple[int, str]]  # items shorter than a q-gram


def pieces(text: str, size: int = PIECE) -> list[str]:
    if len(text) <= size:
        return [text]
    starts = [*range(0, len(text) - size, size // 2), len(text) - size]
    return [text[s : s + size] for s in starts]


def build_index(items: list[tuple[int, str]]) -> Index:
    """Index of (item id, normalised text). Items shorter than Q characters hold no q-gram and are kept apart."""
    held: dict[tuple[str, bool], list] = {}
    for i, t in items:
        for p in dict.fromkeys(pieces(t)):
            if len(p) >= Q:
                held.setdefault((p, False), []).append((i,))
        if len(t) > LEAST:
            for s in [*range(0, len(t) - SHORT, STEP), len(t) - SHORT]:
                held.setdefault((t[s : s + SHORT], True), []).append((i, t, s))
    texts, short = [p for p, _ in held], np.array([x for _, x in held], bool)
    codes = [_codes(p) for p in texts]
    lengths = np.array([len(p) for p in texts], np.int64)
    edits = np.where(short, SHORT_EDITS, np.minimum((lengths * EDIT_SHARE).astype(np.int64), np.maximum((lengths - Q) // Q, 0)))  # at least one shared q-gram
    bounds = lengths + 1 - Q * (edits + 1)
    hashes = [_grams(c) for c in codes]
    flat = np.concatenate([*hashes, np.empty(0, np.uint64)])
    piece = np.repeat(np.arange(len(texts), dtype=np.int32), [len(h) for h in hashes])
    at = np.concatenate([*(np.arange(len(h), dtype=np.int16) for h in hashes), np.empty(0, np.int16)])
    # leave out the most frequent q-grams of each piece
    _, back, n = np.unique(flat, return_inverse=True, return_counts=True)
    often = n[back] if len(flat) else flat.astype(np.int64)
    order = np.lexsort((-often, piece))
    size = np.bincount(piece, minlength=len(texts))
    place = np.empty(len(flat), np.int64)
    place[order] = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out = (often > FREQUENT) & (place < (bounds // 2)[piece]) if len(flat) else np.zeros(0, bool)
    bounds = bounds - np.bincount(piece[out], minlength=len(texts))
    flat, piece, at = flat[~out], piece[~out], at[~out]
    order = np.argsort(flat, kind="stable")
    grams, begin = np.unique(flat[order], return_index=True)
    known = np.zeros(1 << _BITS, bool)
    known[grams >> np.uint64(64 - _BITS)] = True
    tiny = [(i, t) for i, t in items if 0 < len(t) < Q]
    return Index(texts, codes, list(held.values()), edits, bounds, known, grams, np.r_[begin, len(flat)], piece[order], at[order], tiny)


def align(pieces: list[np.ndarray], codes: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the best place of each piece on its band of diagonals, or ``_FAR`` edits if it has more than ``most``.

    ``low`` to ``high`` are the diagonals (position in ``codes`` minus position in the piece, both included) on which the
    place may begin and end; it lies within ``first:last``. Of equal places the first end is taken. The rows of all tables
    are worked out together, and tables whose least cost is above ``most`` are dropped on the way."""
    edits, start, end = (np.full(len(pieces), x, np.int64) for x in (_FAR, 0, 0))
    lengths = np.array([len(p) for p in pieces], np.int64)
    spans = high - low + 1
    order = np.lexsort((spans, lengths))
    heads = np.flatnonzero(np.r_[True, np.diff(lengths[order]) != 0]) if len(order) else []
    for b, e in zip(heads, [*heads[1:], len(order)]):
        for at in range(b, e, MOST_BANDS):
            rows = order[at : min(e, at + MOST_BANDS)]
            _align_rows(rows, np.stack([pieces[i] for i in rows]), codes, low, spans, first, last, most, edits, start, end)
    return edits, start, end


def _align_rows(rows, table, codes, low, spans, first, last, most, edits, start, end) -> None:
    m, width = table.shape[1], int(spans[rows].max())
    steps = np.arange(width, dtype=np.int32)
    at = low[rows, None] + np.arange(m + width)
    text = codes[np.clip(at, 0, len(codes) - 1)].astype(np.int64)
    text[(at < first[rows, None]) | (at >= last[rows, None])] = -1
    origin = at[:, :width].astype(np.int32)
    legal = (origin >= first[rows, None]) & (origin <= last[rows, None]) & (steps < spans[rows, None])
    cost = np.where(legal, 0, _FAR).astype(np.int32)
    off = np.where(steps < spans[rows, None], 0, _FAR).astype(np.int32)
    for i in range(m):
        match = cost + (text[:, i : i + width] != table[:, i : i + 1])
        drop = np.concatenate([cost[:, 1:], np.full((len(cost), 1), _FAR, np.int32)], axis=1) + 1
        from_ = np.where(match <= drop, origin, np.concatenate([origin[:, 1:], origin[:, -1:]], axis=1))
        best = np.minimum(match, drop) + off - steps
        reach = np.minimum.accumulate(best, axis=1)  # then edits along the row
        source = np.maximum.accumulate(np.where(best == reach, steps, 0), axis=1)
        cost, origin = reach + steps, np.take_along_axis(from_, source, 1)
        if i % 8 == 7:
            alive = cost.min(axis=1) <= most[rows]
            if not alive.all():
                rows, table, text, cost, origin, off = (x[alive] for x in (rows, table, text, cost, origin, off))
                if not len(rows):
                    return
    ends = low[rows, None] + m + steps
    cost = np.where(ends <= last[rows, None], cost, _FAR)
    k = cost.argmin(axis=1)
    line = np.arange(len(rows))
    good = cost[line, k] <= most[rows]
    own, line, k = rows[good], line[good], k[good]
    edits[own], start[own], end[own] = cost[line, k], origin[line, k], ends[line, k]


def _stretches(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of overlapping stretches of texts of these sizes."""
    n = np.maximum(1, -(-np.maximum(sizes - OVERLAP, 1) // (STRETCH - OVERLAP)))
    text = np.repeat(np.arange(len(sizes)), n)
    begin = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * (STRETCH - OVERLAP)
    return text, begin, np.minimum(begin + STRETCH, sizes[text])


def _bands(codes: np.ndarray, first: np.ndarray, index: Index) -> Iterator[np.ndarray]:
    """Distinct (text, piece, least diagonal) of the bands that reach their piece's bound, some stretches at a time; diagonals are positions in ``codes``."""
    h = _grams(codes)
    hit = np.flatnonzero(index.known[h >> np.uint64(64 - _BITS)]) if len(index.grams) else np.empty(0, np.int64)
    slot = np.minimum(np.searchsorted(index.grams, h[hit]), len(index.grams) - 1)
    true = index.grams[slot] == h[hit] if len(hit) else np.zeros(0, bool)
    hit, slot = hit[true], slot[true]
    n = index.begin[slot + 1] - index.begin[slot]
    total = np.r_[0, np.cumsum(n)]
    text, begin, end = _stretches(np.diff(first))
    low = np.searchsorted(hit, first[text] + begin)
    high = np.maximum(low, np.searchsorted(hit, first[text] + end - Q, side="right"))
    busy = np.flatnonzero(high > low)
    cost = total[high[busy]] - total[low[busy]]
    ends = np.cumsum(cost)
    at = 0
    while at < len(busy):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_PLACES, side="right")))
        some = busy[at:to]
        at, found = to, []
        size = high[some] - low[some]
        own = np.repeat(np.arange(len(some)), size)
        i = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[some], size)
        # one entry for each text position and piece position with the same q-gram
        entry = np.arange(int(n[i].sum())) - np.repeat(np.cumsum(n[i]) - n[i], n[i]) + np.repeat(index.begin[slot[i]], n[i])
        own, position, piece = np.repeat(own, n[i]), np.repeat(hit[i], n[i]), index.piece[entry].astype(np.int64)
        pair = own * len(index.texts) + piece
        if len(some) * len(index.texts) <= 4_000_000:
            shared = np.bincount(pair)[pair] if len(pair) else pair
        else:
            _, back, counts = np.unique(pair, return_inverse=True, return_counts=True)
            shared = counts[back]
        enough = shared >= index.bounds[piece]
        own, piece, entry, position = own[enough], piece[enough], entry[enough], position[enough]
        diagonal = position - index.at[entry]
        # overlapping bands: twice as wide as the edits need, each diagonal in two of them
        width = index.edits[piece] + 1
        for half in (0, 1):
            band = (diagonal + half * width) // (2 * width)
            order = np.lexsort((band, piece, own))
            o, p, b = own[order], piece[order], band[order]
            head = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (p[1:] != p[:-1]) | (b[1:] != b[:-1])]) if len(o) else np.empty(0, np.int64)
            full = head[np.diff(np.r_[head, len(o)]) >= index.bounds[p[head]]] if len(head) else head
            w = index.edits[p[full]] + 1
            found.append(np.stack([text[some[o[full]]], p[full], b[full] * 2 * w - half * w], axis=1))
        yield np.unique(np.concatenate(found), axis=0)


def _apart(rows: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of (text, piece, start, end, edits) those that stay when, in one text and piece, places are taken by fewest edits (then
    by start) and each takes away only the places that overlap it itself."""
    kept: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for o, p, start, end, edits in sorted(set(rows), key=lambda r: (r[4], *r)):
        own = kept.setdefault((o, p), [])  # apart from each other, in order
        at = bisect_left(own, (start, end, edits))
        if (at == 0 or own[at - 1][1] <= start) and (at == len(own) or own[at][0] >= end):
            own.insert(at, (start, end, edits))
    return [(*key, *place) for key in sorted(kept) for place in kept[key]]


def _piece_matches(texts: list[str], codes: np.ndarray, first: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text number, piece number, start, end, edits) of every place of a piece in normalised texts; of overlapping ones the best."""
    if not index.texts or not len(codes):
        return []
    found = []
    for bands in _bands(codes, first, index):
        text, piece, low = bands.T
        e = index.edits[piece]
        edits, start, end = align([index.codes[p] for p in piece], codes, low - e, low + 2 * (e + 1) - 1 + e, first[text], first[text + 1], e)
        good = edits < _FAR
        found += zip(text[good].tolist(), piece[good].tolist(), (start - first[text])[good].tolist(), (end - first[text])[good].tolist(), edits[good].tolist())
    return _apart(found)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return _codes("".join(texts)), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def matches(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text number, item id, start, end, edits) of the pieces found in normalised texts, short ones by themselves too."""
    found = _piece_matches(texts, *_joined(texts), index)
    return sorted({(o, owner[0], s, t, e) for o, p, s, t, e in found for owner in index.owners[p]})


def passages(texts: list[str], index: Index, tiny: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(text number, item id, start, end, edits) of the long pieces found, of quotes of ``LEAST`` characters apart from
    those, and of items shorter than a q-gram if ``tiny`` is set."""
    codes, first = _joined(texts)
    out, spans, asked = set(), {}, []
    for o, p, s, t, e in _piece_matches(texts, codes, first, index):
        for owner in index.owners[p]:
            if len(owner) == 1:
                out.add((o, owner[0], s, t, e))
                spans.setdefault((o, owner[0]), []).append((s, t))
            else:
                asked.append((o, s, *owner))
    # a short piece asks for the best LEAST characters of its item around it
    exact, near = [], []
    for o, s, item, text, at in asked:
        if any(s < y and s + SHORT > x for x, y in spans.get((o, item), ())):
            continue
        windows = range(max(0, at + SHORT - LEAST), min(at, len(text) - LEAST) + 1)
        whole = next((i for w in windows if (i := texts[o].find(text[w : w + LEAST], max(0, s - (at - w) - 12), s - (at - w) + LEAST + 12)) >= 0), -1)
        if whole >= 0:
            exact.append((o, item, whole, whole + LEAST, 0))
        else:
            near += [(o, item, s - (at - w), text[w : w + LEAST]) for w in windows]
    if near:
        own, most = np.array([x[0] for x in near]), int(LEAST * EDIT_SHARE)
        middle = first[own] + np.array([x[2] for x in near])
        edits, start, end = align([_codes(x[3]) for x in near], codes, middle - 2 * most, middle + 2 * most, first[own], first[own + 1], np.full(len(near), most))
        exact += [(o, item, int(s - first[o]), int(t - first[o]), int(e)) for (o, item, _, _), e, s, t in zip(near, edits, start, end) if e < _FAR]
    for row in _apart(exact):
        if not any(row[2] < y and row[3] > x for x, y in spans.get(row[:2], ())):
            out.add(row)
    for item, text in index.tiny if tiny else ():
        for o, whole in enumerate(texts):
            at = whole.find(text)
            while at >= 0:
                if not (whole[at - 1 : at].isalnum() or whole[at + len(text) : at + len(text) + 1].isalnum()):
                    out.add((o, item, at, at + len(text), 0))
                at = whole.find(text, at + len(text))
    return sorted(out)


@lru_cache(maxsize=1)
def _index(items: tuple[tuple[int, str], ...]) -> Index:
    """A worker keeps the index of the block it works on."""
    return build_index(list(items))


def _scanned(items: tuple[tuple[int, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items)
        for batch in batches:
            for part in slices(batch):
                found = passages([normalised(t) for t in part.column("text").to_pylist()], index)
                cells = list(zip(*found)) or [()] * 5
                ids = part.column("doc_id").take(pa.array(cells[0], pa.int64()))
                yield pa.record_batch([ids, *(pa.array(c, pa.int64()) for c in cells[1:])], names=["doc_id", "item_id", "start", "end", "edits"])
    return run


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = BLOCK_CHARS) -> Iterator[tuple[tuple[int, str], ...]]:
    """The benchmark's items in blocks of about ``most`` characters, one block at a time on the driver. Null ids and texts are left out."""
    held, size = [], 0
    items = benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).dropna().dropDuplicates()
    for item, text in items.toLocalIterator():
        held.append((item, normalised(text)))
        size += len(text)
        if size >= most:
            yield tuple(held)
            held, size = [], 0
    if held:
        yield tuple(held)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, start, end, edits)``: every place where a piece of a benchmark item occurs in a document with few edits.

    An exact quote of ``LEAST`` or more characters of an item is always found, wherever it starts; so is a passage of
    ``PIECE`` characters on the grid of long pieces, or a whole item of up to ``PIECE`` characters, within the edits
    allowed. Items under 8 characters are found where they stand as they are between characters that are no letters or
    digits. Positions are code points of the normalised text (lower case, white space runs as one space). All repeats of
    a piece are reported; of places that overlap the one with the fewest edits, or the first of equals, is taken first and
    takes away those that overlap it itself.

    Null and empty texts match nothing; null ids of documents stay null; repeated rows give repeated results; other
    columns are ignored; an empty table on either side gives an empty result. If the benchmark takes several blocks,
    each block's results are written to the checkpoint folder before the next block is read, so that the driver holds
    one block's text.
    """
    schema = "doc_id long, item_id long, start long, end long, edits long"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    whole = before = None
    for block in blocks(benchmark):
        if before is not None:
            before = checkpointed(before)
            whole = before if whole is None else whole.unionByName(before)
        before = source.mapInArrow(_scanned(block), schema)
    if before is None:
        return docs.sparkSession.createDataFrame([], schema)
    return before if whole is None else whole.unionByName(before)


def _clean(items: tuple[tuple[int, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items)
        for batch in batches:
            for part in slices(batch):
                keep = np.ones(part.num_rows, bool)
                keep[[m[0] for m in passages([normalised(t) for t in part.column("text").to_pylist()], index, tiny=False)]] = False
                yield part.filter(pa.array(keep))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, in which no piece of a benchmark item occurs (as ``find_contamination``
    finds them). Items under 8 characters are no evidence and drop nothing."""
    more = False
    for block in blocks(benchmark):
        docs = (checkpointed(docs) if more else docs).mapInArrow(_clean(block), docs.schema)
        more = True
    return docs
