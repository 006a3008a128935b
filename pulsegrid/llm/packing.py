"""Best-fit packing of tokenised documents by minimum bin slack.

The packing is decided on the histogram of piece lengths, which has at most ``capacity`` entries whatever the corpus
size: for each bin a bitset subset-sum over the lengths still available finds the fullest combination that contains
the longest piece left, and the combination is used again for as long as its lengths last. Pieces then take their
places by rank within their length, which needs one small join and no global sort.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

CAPACITY = 2048
END = (0).to_bytes(4, "little")
#: Pre-token pattern of byte-level files (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_SPACE = re.compile(r"\s{1000}")


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Token ids of whole texts as little-endian uint32 bytes, by the vocabulary and merges of a ``tokenizers`` file.

    ``tiktoken`` runs the merges of a plain byte-level file, which it applies in the order of their ids, some five times
    as fast with the same result. Texts with very long white space, which overflow its pattern's stack, and files of
    another kind go through ``tokenizers`` itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = tokenizers.Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            self.fast = _merging(json.load(file))

    def encode(self, text: str) -> bytes:
        if self.fast is None or _LONG_SPACE.search(text):
            return _bytes(self.whole.encode(text, add_special_tokens=False).ids)
        return _bytes(self.fast.encode_ordinary(text))


def _merging(spec: dict) -> tiktoken.Encoding | None:
    """The encoding of a byte-level file whose merges are in the order of their ids; None for other files."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    kept = [b for b in range(256) if chr(b).isprintable() and b != 0x20]  # bytes that stand for themselves; the others are numbered from 256
    signs = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
    vocab = {t: i for t, i in model["vocab"].items() if i not in {a["id"] for a in spec.get("added_tokens", [])}}
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if made != sorted(made) or len(vocab) != 256 + len(made) or not all(set(t) <= signs.keys() for t in vocab):
        return None
    return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks={bytes(signs[c] for c in t): i for t, i in vocab.items()}, special_tokens={})


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one that may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, ranks, part = encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            rows, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = coder.encode(text.as_py() or "") + END
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
                    rank.append(ranks[n])
                    ranks[n] += 1
            yield pa.record_batch([
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()), pa.array(np.full(len(rows), part, np.int32)), pa.array(rank, pa.int64()),
            ], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])
    return run


def fullest(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """The fullest combination of available lengths that contains the longest: [(length, how many)].

    Subset sums are bits of one integer. Lengths enter from long to short, so that of equally full combinations one
    with long pieces is taken; the walk back over the kept bitsets tells how many of each it holds."""
    lengths = np.flatnonzero(counts)[::-1].tolist()
    longest, room = lengths[0], capacity - lengths[0]
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for n in lengths:
        if n > room:
            continue
        left = min(int(counts[n]) - (n == longest), room // n)
        before = reach
        for _ in range(left):
            after = (reach | reach << n) & mask
            if after == reach:
                break
            reach = after
        steps.append((n, left, before))
        if reach >> room & 1:
            break
    fill, chosen = reach.bit_length() - 1, {longest: 1}
    for n, left, before in reversed(steps):
        used = next(k for k in range(left + 1) if fill - k * n >= 0 and before >> (fill - k * n) & 1)
        if used:
            chosen[n] = chosen.get(n, 0) + used
            fill -= used * n
    return sorted(chosen.items(), reverse=True)


def pack(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int, int]]:
    """Minimum-bin-slack packing of a length histogram: [(combination, first bin, number of bins)].

    Each entry uses up at least one length, so there are at most ``capacity`` entries."""
    counts, bins, plan = counts.copy(), 0, []
    while counts.any():
        combination = fullest(counts, capacity)
        times = min(int(counts[n]) // k for n, k in combination)
        for n, k in combination:
            counts[n] -= k * times
        plan.append((combination, bins, times))
        bins += times
    return plan


def _slots(plan, capacity: int):
    """For each length the first rank, first bin and offset of each run of places, as flat arrays over all lengths."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks = np.zeros(capacity + 1, np.int64)
    for combination, first, times in plan:
        offset = 0
        for n, k in combination:
            for _ in range(k):
                runs.setdefault(n, []).append((int(ranks[n]), first, offset))
                ranks[n] += times
                offset += n
    return {n: np.array(r, np.int64) for n, r in runs.items()}


def _placed(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(lengths, kind="stable")
            found, begin = np.unique(lengths[order], return_index=True)
            for n, b, e in zip(found.tolist(), begin, [*begin[1:], len(order)]):
                rows, table = order[b:e], slots[n]
                at = np.searchsorted(table[:, 0], rank[rows], side="right") - 1
                sequence[rows], offset[rows] = table[at, 1] + rank[rows] - table[at, 0], table[at, 2]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack tokenised documents into sequences of at most ``capacity`` tokens:
    ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    A document is its text's token ids and id 0; only longer ones are cut, into full pieces after a first that may be
    shorter. Null and empty texts are the id 0 alone. Null ids and repeated rows are packed as documents of their own.
    Other columns are ignored. An empty table gives an empty result.
    Only the histogram of lengths (``capacity`` counts) reaches the driver, and only its plan goes back to the tasks.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = checkpointed(source.mapInArrow(_pieces(tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"))
    held = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in held.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    slots = _slots(pack(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.mapInArrow(_placed(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
