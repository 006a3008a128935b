"""SimHash near-duplicate detection with anchor points from a covering code.

Every document gets a 64-bit SimHash. Two fingerprints link when they differ in at most three bits; the documents
joined by links, directly or over others, form a component.

The anchors are the codewords of a covering code of the 64-bit cube: two perfect binary Golay codes (23 bits each,
covering radius 3) beside an 18-bit block whose only codeword is zero. A fingerprint lies within its block's radius
of exactly one Golay codeword, so every 64-bit value has a home anchor. For a pair at distance 3 or less there is a
midpoint z with one end within 1 and the other within 2 of it; both ends then lie within (covering radius + their
share of the threshold) of z's home anchor. So each fingerprint is replicated to all anchors within the covering
radius plus 2 (about 61 of 16.8 million), instead of plus 3 (about 300), and no pair within the threshold is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, fresh, shuffle_partitions

THRESHOLD = 3
SHINGLE = 3
SEED = 42
#: Generator polynomial of the binary Golay code (fixed value): x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY = 0b101011100011
#: Extra distance, beyond the covering radius, up to which a fingerprint is replicated.
REACH = 2
#: Groups with more fingerprints than this are linked by expanding from pivots, not by comparing all pairs.
PAIRWISE = 64
#: (first bit, bits) of four parts of the bits that no anchor tells apart: two linked fingerprints agree in one of them.
PARTS = ((46, 4), (50, 4), (54, 5), (59, 5))
#: Replicas that one reducing task is meant to hold (12 bytes each).
TASK_ENTRIES = 4_000_000
#: A fingerprint with more than one in this many of all rows is joined by broadcast (24 bytes each).
HOT = 10_000


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of one text: ASCII letters lower-cased, words split at ASCII white space, shingles of
    three words with repeats (all words if there are fewer), XXH64 with seed 42, a bit set if over half have it.
    A null text or one without words gives 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    grams = zip(*(words[i:] for i in range(SHINGLE)))
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
        kept = [i for i, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.record_batch([*(batch.column(i) for i in kept), pa.array(found.view(np.int64))], names=[*(batch.schema.names[i] for i in kept), "fp"])


@lru_cache(maxsize=1)
def _cosets() -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each cost 0..REACH the error patterns by syndrome (offsets, patterns), and the syndrome of each 23-bit value.

    Cost c > 0 stands for patterns of weight 3 + c; cost 0 for the one pattern of weight 3 or less."""
    power = []  # x^i modulo the generator
    r = 1
    for _ in range(23):
        power.append(r)
        r = (r << 1) ^ (GOLAY if r & 0x400 else 0)
    low = np.zeros(1 << 12, np.uint16)
    high = np.zeros(1 << 11, np.uint16)
    for i in range(12):
        low[1 << i : 2 << i] = low[: 1 << i] ^ power[i]
    for i in range(11):
        high[1 << i : 2 << i] = high[: 1 << i] ^ power[12 + i]

    def patterns(weights) -> tuple[np.ndarray, np.ndarray]:
        all_ = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(23), w)], np.uint32)
        s = low[all_ & 0xFFF] ^ high[all_ >> 12]
        order = np.argsort(s, kind="stable")
        return np.searchsorted(s[order], np.arange(2049)), all_[order]

    costs = [patterns(range(4))] + [patterns([3 + c]) for c in range(1, REACH + 1)]
    return costs, (low, high)


def _reach(values: np.ndarray, cost: int) -> tuple[np.ndarray, np.ndarray]:
    """(row index, 12-bit codeword number) of all Golay codewords whose distance from a value is its covering radius plus ``cost``."""
    costs, (low, high) = _cosets()
    begin, patterns = costs[cost]
    s = low[values & 0xFFF] ^ high[values >> 12]
    n = begin[s + 1] - begin[s]
    rows = np.repeat(np.arange(len(values)), n)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[s], n)
    return rows, (values[rows] ^ patterns[at]) >> 11  # the upper 12 bits tell a codeword apart


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row index, anchor number) of every anchor that each uint64 fingerprint is replicated to."""
    one, two = (fps & np.uint64(0x7FFFFF)).astype(np.uint32), ((fps >> np.uint64(23)) & np.uint64(0x7FFFFF)).astype(np.uint32)
    rows, keys = [], []
    first = [_reach(one, c) for c in range(REACH + 1)]
    for c, (r, word) in enumerate(first):
        for d in range(REACH + 1 - c):
            r2, word2 = _reach(two[r], d)
            rows.append(r[r2])
            keys.append(word[r2] << 12 | word2)
    return np.concatenate(rows), np.concatenate(keys).astype(np.int32)


def _replicas(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(fps), 8192):
                part = fps[at : at + 8192]
                rows, keys = anchors(part)
                bucket = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                found, begin = np.unique(bucket[order], return_index=True)
                ends = [*begin[1:], len(order)]
                yield pa.record_batch([
                    pa.array(found.astype(np.int32)),
                    pa.array([keys[order[b:e]].tobytes() for b, e in zip(begin, ends)], pa.binary()),
                    pa.array([part[rows[order[b:e]]].tobytes() for b, e in zip(begin, ends)], pa.binary()),
                ], names=["bucket", "anchors", "fps"])
    return run


def _expand(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the linked fingerprints of a large group: grow each component from a pivot over those not reached yet."""
    left, a, b = group, [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= THRESHOLD
            if near.any():
                met = left[near]
                a.append(np.full(len(met), x))
                b.append(met)
                front.extend(met)
                left = left[~near]
    none = np.empty(0, np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of each anchor, enough to join all that are linked there."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [], []
    for s, n in zip(starts[sizes > PAIRWISE], sizes[sizes > PAIRWISE]):
        for first, bits in PARTS:  # large groups fall apart by the bits that the anchor leaves open
            value = fps[s : s + n] >> np.uint64(first) & np.uint64((1 << bits) - 1)
            order = np.argsort(value, kind="stable")
            for own in np.split(fps[s : s + n][order], np.flatnonzero(np.diff(value[order].astype(np.int64))) + 1):
                x, y = _expand(own)
                a.append(x)
                b.append(y)
    small = np.repeat((sizes > 1) & (sizes <= PAIRWISE), sizes)
    keys, fps = keys[small], fps[small]
    for step in range(1, PAIRWISE):
        if len(keys) <= step:
            break
        same = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(same):
            break
        same = same[np.bitwise_count(fps[same] ^ fps[same + step]) <= THRESHOLD]
        a.append(fps[same])
        b.append(fps[same + step])
    none = np.empty(0, np.uint64)
    pairs = np.unique(np.stack([np.concatenate(a or [none]), np.concatenate(b or [none])]), axis=1)
    return _forest(pairs)


def _forest(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links, so that what leaves a task is less than the fingerprints it holds."""
    nodes, ends = np.unique(pairs, return_inverse=True)
    a, b = ends.reshape(pairs.shape).tolist()
    parent, kept = list(range(len(nodes))), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (x, y) in enumerate(zip(a, b)):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return pairs[0][kept], pairs[1][kept]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, fps = [], []
    for batch in batches:
        keys += [np.frombuffer(x.as_py(), np.int32) for x in batch.column(1)]
        fps += [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(2)]
    if keys:
        a, b = links(np.concatenate(keys), np.concatenate(fps))
        yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _rooted(rows: DataFrame) -> DataFrame:
    """``(fp, least, n, root)`` for every distinct fingerprint of ``rows(doc_id, fp)``: its smallest doc_id, its rows, and the fingerprint that names its component."""
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    distinct = classes.count()
    buckets = max(shuffle_partitions(rows.sparkSession), distinct * 61 // TASK_ENTRIES)
    packed = classes.select("fp").mapInArrow(_replicas(buckets), "bucket int, anchors binary, fps binary")
    found = packed.repartition(buckets, "bucket").mapInArrow(_linked, "a long, b long")
    roots = checkpointed(connected_components(found))
    return classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` the smallest doc_id among the documents that links
    (3 or fewer differing bits) reach, the document itself included. Exact copies share one fingerprint, which is
    replicated and compared once, so a hot group of copies costs no more than one document.

    Null or empty texts have fingerprint zero, linked like any other. A null doc_id stays in the result and takes part
    in linking, but is never a component_id unless no other id is reachable (then null). Repeated rows give repeated
    result rows. Other columns are ignored. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = checkpointed(source.mapInArrow(_fingerprints, "doc_id long, fp long"))
    rooted = checkpointed(_rooted(rows))
    components = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    mapped = checkpointed(rooted.join(components, "root").select("fp", "n", "component_id"))
    # fingerprints with more than one in HOT of all rows are fewer than HOT: they go to all tasks, so their rows stay where they are
    many = F.col("n") > F.lit((mapped.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = rows.join(F.broadcast(mapped.where(many).select(F.col("fp").alias("hot"), "component_id")), F.col("fp") == F.col("hot"), "left")
    rare = hot.where("hot is null").select("doc_id", "fp").join(mapped.where(~many).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
    named = hot.where("hot is not null").select("doc_id", "fp", "component_id").unionByName(rare)
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, unnamed: bool = False) -> DataFrame:
    """One row of ``docs``, with all columns, of each group of near copies: the one with the smallest doc_id.

    Rows are told apart by their doc_id and text together (96 bits of hashes), so rows with one doc_id and different
    texts each stand for their own group. A group without any doc_id keeps one of its rows where ``unnamed`` is set;
    else nothing could name it and it goes."""
    id_, text = F.col("doc_id").cast("long"), F.col("text")
    keys = [F.xxhash64(text, F.coalesce(id_, F.lit(0)), id_.isNull()), F.hash(text, F.coalesce(id_, F.lit(0)))]
    one, two = fresh(docs, "one"), fresh(docs, "two")
    source = docs.select(id_.alias("doc_id"), text, keys[0].alias("h1"), keys[1].alias("h2"))
    rows = checkpointed(source.mapInArrow(_fingerprints, "doc_id long, h1 long, h2 int, fp long"))
    # the first row of each fingerprint, then of each group: no copies meet
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")).alias("r"))
    first = first.join(_rooted(rows).select("fp", "root"), "fp").groupBy("root").agg(F.min("r").alias("r"))
    kept = first.where(F.lit(unnamed) | ~F.col("r.no_id")).select(F.col("r.h1").alias(one), F.col("r.h2").alias(two))
    return docs.withColumns({one: keys[0], two: keys[1]}).join(kept, [one, two], "left_semi").dropDuplicates([one, two]).select(*docs.columns)
