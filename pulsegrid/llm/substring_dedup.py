"""Removal of repeated word sequences with prefix-partitioned suffix trees.

A window (``window`` words of one document) is the depth to which suffixes are compared. The suffixes of all documents
are split into groups by a prefix of variable length: usually the 12 words at the suffix's anchor (the least 12-word
hash of its window, so that neighbouring suffixes share a group and travel with one copy of their words), or the whole
window where the anchor alone would hold more suffixes than a task should take. Equal windows have equal anchors, so
they always meet in one group. Each group's suffixes are sorted by their words, with the words that neighbours share
(a suffix array and its common prefixes, which is the group's tree): those below an internal node of the window's depth or
more start a window that also starts elsewhere. Neighbouring leaves of a document join to the spans that are removed;
``maximal_repeats`` lists the deep nodes themselves.

Hashes only choose groups and leave out suffixes that can't repeat; what is removed is decided by the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions, slices, text_bytes
from .wordhash import Words, mixed, sliding_argmin

WINDOW = 35
ANCHOR = 12
#: Windows whose anchors, and whose suffixes with their words (some 70 MB), one task is meant to hold.
TASK_WINDOWS = 3_000_000
#: Text bytes that one partition of documents is meant to hold.
TASK_BYTES = 48 << 20
#: Bytes of suffixes that are sorted together; larger groups are sorted as a whole.
SORT_BYTES = 4 << 20
#: Bytes of text to a word, for the first estimate of the number of suffixes.
WORD_BYTES = 6
#: An anchor is overfull if it occurs more often than both this and one in ``OVERFULL_LIST`` of all anchors.
OVERFULL, OVERFULL_LIST = 50_000, 1 << 20
#: Of the anchors that a partition holds once, one in this many is counted, with that weight, to find the overfull ones.
COUNTED = 16

#: A document's key: two hashes of its id and text.
KEY = np.dtype([("one", "<i8"), ("two", "<i4")])
MARKS = "bucket int, keys binary, counts binary, at binary"
ENTRIES = f"{MARKS}, hashes binary, sizes binary, words binary"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for part in slices(batch):
            yield part, [x.encode() if x else b"" for x in part.column("text").to_pylist()]


def _keys(part: pa.RecordBatch) -> np.ndarray:
    keys = np.empty(part.num_rows, KEY)
    keys["one"], keys["two"] = np.asarray(part.column("one")), np.asarray(part.column("two"))
    return keys


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _anchors(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, position of each window's anchor)."""
    starts = words.starts(window)
    if not len(starts):
        return starts, starts
    grams = words.grams(np.arange(len(words) - k + 1), k)
    return starts, sliding_argmin(grams, window - k + 1)[starts]


def _counts(window: int, k: int):
    """``(value, n)``: how often a partition has an anchor, all that it has twice or more and a weighted share of the others; the number of windows beside a null value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, windows = [np.empty(0, np.uint64)], 0
        for _, texts in _texts(batches):
            words = Words(texts)
            starts, anchor = _anchors(words, window, k)
            found.append(words.grams(np.unique(anchor), k))
            windows += len(starts)
        values, n = np.unique(np.concatenate(found), return_counts=True)
        picked = mixed(values ^ np.uint64(TaskContext.get().partitionId())) % np.uint64(COUNTED) == 0
        kept, n = (n > 1) | picked, np.where(n > 1, n, COUNTED)
        values = [None, *values[kept].view(np.int64).tolist()]
        yield pa.record_batch([pa.array(values, pa.int64()), pa.array([windows, *n[kept].tolist()], pa.int64())], names=["value", "n"])

    return run


def _grouped(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows) of each bucket."""
    order = np.argsort(bucket, kind="stable")
    found, begin = np.unique(bucket[order], return_index=True)
    for b, rows in zip(found.tolist(), np.split(order, begin[1:])):
        yield b, rows


def _packed(keys: np.ndarray, at: np.ndarray, bucket: np.ndarray, hashes: np.ndarray | None = None, leaves: list[bytes] | None = None) -> pa.RecordBatch:
    """One row for each bucket: the keys of documents (in runs, with counts), positions in them, and for entries their hashes and words.

    Entries without a hash are settled: their positions only go back to their documents."""
    rows: list[tuple] = []
    for b, own in _grouped(bucket):
        k = keys[own]
        change = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        cells = [k[change].tobytes(), np.diff(np.r_[change, len(k)]).astype(np.int32).tobytes(), at[own].astype(np.int32).tobytes(), None, None, None]
        if hashes is not None:
            cells[3] = hashes[own].tobytes()
        if leaves is not None:
            some = [leaves[i] for i in own.tolist()]
            cells[4:] = np.fromiter(map(len, some), np.int32, len(some)).tobytes(), b"".join(some)
        rows.append((b, *cells))
    columns = list(zip(*rows)) or [()] * 7
    return pa.record_batch([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "keys", "counts", "at", "hashes", "sizes", "words"])


def _bucket(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(hashes.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _anchor_entries(window: int, k: int, overfull: np.ndarray, buckets: int):
    """Anchors with the places where they are. Overfull ones are known to occur elsewhere: they are settled, not gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            words = Words(texts)
            at = np.unique(_anchors(words, window, k)[1])
            hashes, doc = words.grams(at, k), words.doc[at]
            keys, local, settled = _keys(part)[doc], at - words.first[doc], _among(hashes, overfull)
            yield _packed(keys[~settled], local[~settled], _bucket(hashes[~settled], buckets), hashes[~settled])
            yield _packed(keys[settled], local[settled], _bucket(keys["one"][settled], buckets))

    return run


def _repeated_anchors(parts: int):
    """The places of anchors that occur more than once, packed by the partition of documents they go back to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, at, hashes = [np.empty(0, KEY)], [np.empty(0, np.int32)], [np.empty(0, np.uint64)]
        for batch in batches:
            for own, places, h, _, _ in _entries(batch):
                if h is None:
                    yield _packed(own, places, _bucket(own["one"], parts))
                else:
                    keys.append(own)
                    at.append(places)
                    hashes.append(h)
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes)
        same = hashes[order][1:] == hashes[order][:-1]
        rows = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
        yield _packed(own := np.concatenate(keys)[rows], np.concatenate(at)[rows], _bucket(own["one"], parts))

    return run


def _entries(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(keys, positions, hashes or None, sizes or None, words or None) of each row."""
    for k, n, p, h, s, w in zip(*(batch.column(c).to_pylist() for c in ("keys", "counts", "at", "hashes", "sizes", "words"))):
        own = np.repeat(np.frombuffer(k, KEY), np.frombuffer(n, np.int32))
        yield own, np.frombuffer(p, np.int32), None if h is None else np.frombuffer(h, np.uint64), None if s is None else np.frombuffer(s, np.int32), w


def _marked(found: pa.Array, words: Words) -> np.ndarray:
    """Words of a run of texts at the positions found for each text."""
    marks = np.zeros(len(words) + 1, bool)
    for i, places in enumerate(found.to_pylist()):
        marks[np.frombuffer(places or b"", np.int32) + words.first[i]] = True
    return marks


def _suffix_entries(window: int, k: int, overfull: np.ndarray, buckets: int):
    """The suffixes whose anchors occur elsewhere, in leaves: neighbours of one group with one copy of their words.

    A leaf whose words the partition has seen is settled, and so is the one seen first, which alone is gathered: so many
    copies of a leaf cost no more than one for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple | None] = {}
        for part, texts in _texts(batches):
            words = Words(texts)
            own = _keys(part)
            starts, anchor = _anchors(words, window, k)
            again = _marked(part.column("found"), words)[anchor]
            starts, anchor = starts[again], anchor[again]
            full = _among(words.grams(anchor, k), overfull)
            # a leaf is a run of windows with one anchor, or a single window where that is overfull
            head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | full[1:]]) if len(starts) else np.empty(0, np.int64)
            first, last = starts[head], starts[np.r_[head[1:], len(starts)] - 1] if len(starts) else starts
            hashes = np.where(full[head], words.grams(first, window), words.grams(anchor[head], k))
            doc = words.doc[first]
            local = first - words.first[doc]
            new, leaves, old = [], [], []
            for i, (b, e) in enumerate(zip(words.begin[first].tolist(), words.end[last + window - 1].tolist())):
                leaf = words.data[b:e]
                if leaf not in seen:
                    seen[leaf] = (own[doc[i]], local[i], last[i] - first[i] + 1)
                    new.append(i)
                    leaves.append(leaf)
                else:
                    old.append((own[doc[i]], local[i], last[i] - first[i] + 1))
                    if seen[leaf] is not None:
                        old.append(seen[leaf])
                        seen[leaf] = None
            new = np.array(new, np.int64)
            yield _packed(own[doc[new]], local[new], _bucket(hashes[new], buckets), hashes[new], leaves)
            if old:
                n = np.array([x[2] for x in old])
                keys = np.repeat(np.array([x[0] for x in old], KEY), n)
                at = _runs(np.array([x[1] for x in old]), n)
                yield _packed(keys, at, _bucket(keys["one"], buckets))

    return run


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` consecutive numbers from each first one."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


@dataclass
class SuffixTree:
    """The suffixes of some leaves in the order of their words, as (leaf, place in it), and the words that each shares with
    the one before it. Runs with shared words of some depth or more are the suffixes below an internal node there."""

    leaf: np.ndarray
    place: np.ndarray
    shared: np.ndarray

    def deep(self, depth: int) -> np.ndarray:
        """Suffixes below an internal node of at least this depth."""
        near = self.shared >= depth
        return near | np.r_[near[1:], False][: len(near)]

    def nodes(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(depth, begin, end) of all internal nodes of at least this depth, inner ones before those around them."""
        stack: list[tuple[int, int]] = []  # depth and begin of the nodes that are open
        for i, d in enumerate([*self.shared.tolist(), -1]):
            begin = i - 1
            while stack and stack[-1][0] > d:
                depth, begin = stack.pop()
                if depth >= least:
                    yield depth, begin, i
            if i < len(self.shared) and i and (not stack or stack[-1][0] < d):
                stack.append((d, begin))


def suffix_tree(leaves: list[list[bytes]], least: int) -> SuffixTree:
    """The tree of the leaves' suffixes of at least ``least`` words. No suffix goes on beyond its leaf.

    Suffixes are ranked by doubling the compared length; the ranks at all lengths then tell how many words neighbours share.
    Words are compared as bytes, by their rank among the words of the leaves."""
    lengths = np.fromiter(map(len, leaves), np.int64, len(leaves))
    flat = [w for x in leaves for w in x]
    names = {w: i for i, w in enumerate(sorted(set(flat)))}
    first = np.cumsum(lengths + 1) - (lengths + 1)  # an end of its own behind each leaf
    codes = np.empty(len(flat) + len(leaves), np.int64)
    codes[first + lengths] = np.arange(len(leaves))
    codes[_runs(first, lengths)] = np.fromiter(map(names.__getitem__, flat), np.int64, len(flat)) + len(leaves)
    ranks, have = [codes], 1
    while have <= int(lengths.max(initial=0)):
        last = ranks[-1]
        later = np.zeros(len(last), np.int64)
        later[: max(0, len(last) - have)] = last[have:] + 1
        ranks.append(np.unique(last * (int(last.max()) + 2) + later, return_inverse=True)[1])
        have *= 2
    n = np.maximum(lengths - least + 1, 0)
    leaf, place = np.repeat(np.arange(len(leaves)), n), _runs(np.zeros(len(leaves), np.int64), n)
    at = first[leaf] + place
    order = np.argsort(ranks[-1][at], kind="stable")
    leaf, place, at = leaf[order], place[order], at[order]
    shared = np.zeros(len(at), np.int64)
    if len(at) > 1:
        a, b, both = at[:-1], at[1:], np.zeros(len(at) - 1, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            both += np.where(ranks[k][a + both] == ranks[k][b + both], 1 << k, 0)
        shared[1:] = both
    return SuffixTree(leaf, place, shared)


def _repeats(window: int, parts: int):
    """Build the trees of one partition's groups and report the suffixes below their deep internal nodes, packed by the
    partition of documents they go back to."""

    def settle(keys: np.ndarray, at: np.ndarray, leaves: list[bytes]) -> pa.RecordBatch:
        first = {x: i for i, x in enumerate(dict.fromkeys(leaves))}
        kind = np.fromiter(map(first.__getitem__, leaves), np.int64, len(leaves))
        tree = suffix_tree([x.split() for x in first], window)
        n = np.bincount(tree.leaf, minlength=len(first))
        begin = np.cumsum(n) - n
        deep = np.zeros(len(tree.leaf), bool)
        deep[begin[tree.leaf] + tree.place] = tree.deep(window)
        deep |= np.repeat(np.bincount(kind, minlength=len(first)) > 1, n)  # the leaf as a whole is there more than once
        mark = deep[_runs(begin[kind], n[kind])]
        own, places = np.repeat(keys, n[kind])[mark], _runs(at.astype(np.int64), n[kind])[mark]
        return _packed(own, places, _bucket(own["one"], parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, at, hashes, leaves = [np.empty(0, KEY)], [np.empty(0, np.int32)], [np.empty(0, np.uint64)], []
        for batch in batches:
            for own, places, h, sizes, words in _entries(batch):
                if h is None:
                    yield _packed(own, places, _bucket(own["one"], parts))
                    continue
                keys.append(own)
                at.append(places)
                hashes.append(h)
                ends = np.cumsum(sizes).tolist()
                leaves += [words[b:e] for b, e in zip([0, *ends], ends)]
        keys, at, hashes = np.concatenate(keys), np.concatenate(at), np.concatenate(hashes)
        for rows in _together(hashes, leaves):
            yield settle(keys[rows], at[rows], [leaves[i] for i in rows.tolist()])

    return run


def _together(hashes: np.ndarray, leaves: list[bytes]) -> Iterator[np.ndarray]:
    """Rows of whole groups (of equal hashes), some groups together."""
    order = np.argsort(hashes, kind="stable")
    begin = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]]) if len(order) else order
    size = np.cumsum(np.fromiter((len(leaves[i]) for i in order.tolist()), np.int64, len(order)))
    low = 0
    while low < len(begin):
        base = size[begin[low] - 1] if begin[low] else 0
        high = max(low + 1, int(np.searchsorted(size[np.r_[begin[1:], len(order)] - 1], base + SORT_BYTES, side="right")))
        yield order[begin[low] : begin[high] if high < len(begin) else len(order)]
        low = high


_LEAF = "bucket int, hash long, before binary, words binary, n long"


def _counted_leaves(window: int, k: int, overfull: np.ndarray, buckets: int):
    """Each different leaf of a partition with the word before it (null at the begin of a document), once with its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for part, texts in _texts(batches):
            words = Words(texts)
            starts, anchor = _anchors(words, window, k)
            again = _marked(part.column("found"), words)[anchor]
            starts, anchor = starts[again], anchor[again]
            if not len(starts):
                continue
            full = _among(words.grams(anchor, k), overfull)
            head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | full[1:]])
            first, last = starts[head], starts[np.r_[head[1:], len(starts)] - 1]
            hashes = np.where(full[head], words.grams(first, window), words.grams(anchor[head], k)).view(np.int64)
            inner = first > words.first[words.doc[first]]
            for h, f, b, e, i in zip(hashes.tolist(), first.tolist(), words.begin[first].tolist(), words.end[last + window - 1].tolist(), inner.tolist()):
                key = (h, words.data[words.begin[f - 1] : words.end[f - 1]] if i else None, words.data[b:e])
                seen[key] = seen.get(key, 0) + 1
        rows = list(seen.items())
        for at in range(0, len(rows), 20_000):
            some = rows[at : at + 20_000]
            hashes = np.array([key[0] for key, _ in some], np.int64)
            yield pa.record_batch([pa.array(_bucket(hashes, buckets)), pa.array(hashes), pa.array([key[1] for key, _ in some], pa.binary()), pa.array([key[2] for key, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], names=["bucket", "hash", "before", "words", "n"])

    return run


def repeat_nodes(leaves: dict[tuple[bytes, ...], dict[bytes | None, int]], least: int) -> dict[tuple[bytes, ...], int]:
    """The maximal repeats of at least ``least`` words in a group and their numbers of places.

    ``leaves`` counts each leaf by the word before it. A repeat is what the suffixes below an internal node, or copies of one
    suffix, share; it is maximal if no word before it is common to all its places (the begin of a text is none)."""
    names = list(leaves)
    tree = suffix_tree([list(x) for x in names], least)
    out: dict[tuple[bytes, ...], int] = {}

    def before(i: int) -> set:
        leaf, place = names[tree.leaf[i]], int(tree.place[i])
        return set(leaves[leaf]) if place == 0 else {leaf[place - 1]}

    def told(depth: int, begin: int, end: int) -> None:
        places = sum(sum(leaves[names[k]].values()) for k in tree.leaf[begin:end].tolist())
        marks = set().union(*(before(i) for i in range(begin, end)))
        if places > 1 and (None in marks or len(marks) > 1):
            at = int(tree.place[begin])
            out[names[tree.leaf[begin]][at : at + depth]] = places

    for node in tree.nodes(least):
        told(*node)
    length = np.array([len(x) for x in names])[tree.leaf] - tree.place if names else tree.leaf
    following = np.r_[tree.shared[1:], 0][: len(length)]
    for i in np.flatnonzero((tree.shared < length) & (following < length)).tolist():  # what no node ends with
        told(int(length[i]), i, i + 1)
    return out


def _group_repeats(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("hash", "before", "words", "n")))]
        for some in _together(np.array([r[0] for r in rows], np.int64), [r[2] for r in rows]):
            groups: dict[int, dict] = {}
            for i in some.tolist():
                h, before, words, n = rows[i]
                own = groups.setdefault(h, {}).setdefault(tuple(words.split()), {})
                own[before] = own.get(before, 0) + n
            found = [(b" ".join(x).decode(), len(x), n) for leaves in groups.values() for x, n in repeat_nodes(leaves, window).items()]
            columns = list(zip(*found)) or [()] * 3
            yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["words", "n_words", "places"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of a partition: its key and the positions that all groups reported."""
    keys, at = [np.empty(0, KEY)], [np.empty(0, np.int32)]
    for batch in batches:
        for own, places, *_ in _entries(batch):
            keys.append(own)
            at.append(places)
    keys, at = np.concatenate(keys), np.concatenate(at)
    order = np.lexsort((at, keys["two"], keys["one"]))
    keys, at = keys[order], at[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    ends = [*begin[1:], len(keys)]
    for lo in range(0, len(begin), 5_000):
        some = begin[lo : lo + 5_000]
        cells = pa.array([at[b:e].tobytes() for b, e in zip(some, ends[lo : lo + 5_000])], pa.binary())
        yield pa.record_batch([pa.array(keys["one"][some]), pa.array(keys["two"][some]), cells], names=["one", "two", "found"])


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept, spans = [], [], [], []
            for text, places in zip(batch.column("text"), batch.column("found").to_pylist()):
                words = (text.as_py() or "").encode().split()
                total.append(len(words))
                own = []
                if places:
                    starts = np.frombuffer(places, np.int32)
                    change = np.zeros(len(words) + 1, np.int32)
                    change[starts] += 1
                    change[starts + window] -= 1
                    gone = np.r_[False, np.cumsum(change[:-1]) > 0, False]
                    edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
                    own = [{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])]
                    words = list(compress(words, (~gone[1:-1]).tolist()))
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
                spans.append(own)
            yield pa.record_batch([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept), pa.array(spans, _SPAN)], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return run


@dataclass
class _Plan:
    """What the trees of a corpus start from: the documents with the places of their repeated anchors."""

    keyed: DataFrame
    suffixes: DataFrame
    overfull: np.ndarray
    parts: int
    entry_parts: int

    def found(self, entries: DataFrame, settle) -> DataFrame:
        """The documents with the positions that ``settle`` reports for them."""
        marks = entries.repartition(self.entry_parts, "bucket").mapInArrow(settle, ENTRIES)
        places = marks.repartition(self.parts, "bucket").mapInArrow(_gathered, "one long, two int, found binary")
        return self.keyed.join(places.hint("shuffle_hash"), ["one", "two"], "left")


def _planned(docs: DataFrame, window: int, anchor: int, id_col: str, text_col: str) -> _Plan:
    spark = docs.sparkSession
    base = shuffle_partitions(spark)
    parts = max(base, text_bytes(docs, text_col) // TASK_BYTES)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    counted = checkpointed(source.select("text").mapInArrow(_counts(window, anchor), "value long, n long").groupBy("value").agg(F.sum("n").alias("n")))
    windows = counted.where("value is null").agg(F.sum("n")).first()[0] or 0
    least = max(OVERFULL, windows // (OVERFULL_LIST * 8))
    overfull = [r["value"] for r in counted.where(F.col("value").isNotNull() & (F.col("n") > least)).orderBy(F.desc("n")).limit(OVERFULL_LIST).collect()]
    overfull = np.sort(np.array(overfull, np.int64).view(np.uint64))
    entry_parts = max(base, windows // TASK_WINDOWS)

    # One shuffle of the texts, which the three uses below share.
    keyed = source.withColumns({"one": F.xxhash64("doc_id", "text"), "two": F.hash("text", "doc_id")}).repartition(parts, "one", "two")

    plan = _Plan(keyed, keyed, overfull, parts, entry_parts)
    entries = keyed.mapInArrow(_anchor_entries(window, anchor, overfull, entry_parts), ENTRIES)
    plan.suffixes = plan.found(entries, _repeated_anchors(parts)).where("found is not null")
    return plan


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, spans)``: each document without the words covered by a run of ``window``
    words that also starts anywhere else in the input, in the same document or another one. ``kept`` is the words left,
    joined by one space; ``spans`` lists the removed stretches (numbers of words, end exclusive).

    Words are runs of characters other than space and U+0009-U+000D, unchanged; all copies of a repeat go, as windows
    are judged on the input. Null and empty texts have no words (``kept`` is empty). Null ids and repeated rows are
    documents of their own, and repeated rows therefore lose all words in windows. Other columns are ignored. An empty
    table gives an empty result.

    A task holds the suffixes of some groups. A group has at most one leaf of each content for each partition of
    documents, and groups of anchors that are overfull (found by a count over all documents; at most ``OVERFULL_LIST``
    anchors, which is all that reaches the driver) are split by whole windows.
    """
    plan = _planned(docs, window, anchor, id_col, text_col)
    entries = plan.suffixes.mapInArrow(_suffix_entries(window, anchor, plan.overfull, plan.entry_parts), ENTRIES)
    return plan.found(entries, _repeats(window, plan.parts)).select("doc_id", "text", "found").mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>")


def maximal_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(words, n_words, places)``: the deep internal nodes of the groups' trees: every run of ``window`` words or more that
    starts at several places of the documents and is maximal to both sides, with its number of places.

    A tree sees the words of neighbouring windows of one anchor, ``2 * window - anchor`` at most: of a longer repeat it gives the stretches
    that these windows cover. Null and empty texts have no words; repeated rows are places of their own; an empty table gives
    an empty result. Each partition sends each different leaf once, with its number."""
    plan = _planned(docs, window, anchor, id_col, text_col)
    leaves = plan.suffixes.mapInArrow(_counted_leaves(window, anchor, plan.overfull, plan.entry_parts), _LEAF)
    return leaves.repartition(plan.entry_parts, "bucket").mapInArrow(_group_repeats(window), "words string, n_words int, places long")
