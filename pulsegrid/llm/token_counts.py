"""Token counts under a unigram model, with the dynamic program shared over a trie of pre-tokens.

The pieces are those of a public byte-level vocabulary; a piece of rank r has the Zipf log-probability
-log(r + 1) - log(sum of 1 / (k + 1)). For a prefix of a pre-token the forward score, the best log-probability of any
segmentation, and its number of pieces depend on the prefix alone, so they are computed once for each node of the trie
of distinct pre-tokens; the node where a pre-token ends stores its count. The trie is worked out level by level, all
nodes of one depth together, and a task keeps what its terminals store.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Distinct words, and their characters, whose counts a Python worker keeps.
CACHE_WORDS, CACHE_CHARS = 900_000, 16_000_000
#: Words that enter one trie together, and bytes of the longest of them; longer ones are worked out one by one.
TRIE_WORDS, TRIE_DEPTH = 50_000, 48
#: Pre-token pattern of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)
_FILTER_BITS = 16


def load_scores(path: str) -> dict[bytes, float]:
    """Log-probability of each piece of a rank file (a base64 piece and its rank on each line)."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    total = np.log(np.sum(1 / (np.fromiter(ranks.values(), float) + 1)))
    return {piece: float(-np.log(rank + 1) - total) for piece, rank in ranks.items()}


@dataclass
class Pieces:
    """The pieces of one length: as rows of bytes, in the order of their keys (eight bytes as one number, longer ones hashed), and their scores."""

    keys: np.ndarray
    rows: np.ndarray
    scores: np.ndarray
    known: np.ndarray  # which hash values any key has

    def find(self, keys: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the byte rows ``tails`` are pieces, their scores)."""
        rows = np.flatnonzero(self.known[_hashed(keys)])
        slot = np.minimum(np.searchsorted(self.keys, keys[rows]), len(self.keys) - 1)
        true = (self.rows[slot] == tails[rows]).all(axis=1)  # keys of longer pieces are hashes: the bytes decide
        return rows[true], self.scores[slot[true]]


def _hashed(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _next_key(keys: np.ndarray | int, column: np.ndarray, length: int) -> np.ndarray:
    """Keys of strings grown by one byte in front, from the keys of their tails of ``length`` bytes."""
    if length < 8:
        return keys | column.astype(np.uint64) << np.uint64(8 * length)
    return (keys ^ (keys >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + column


class Unigram:
    """Best segmentations under the scores of pieces."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores, self.by_length = scores, {}
        for n in sorted({len(p) for p in scores} & set(range(1, TRIE_DEPTH + 1))):
            own = [p for p in scores if len(p) == n]
            rows = np.frombuffer(b"".join(own), np.uint8).reshape(-1, n)
            keys = np.zeros(len(own), np.uint64)
            for k in range(n):
                keys = _next_key(keys, rows[:, n - 1 - k], k)
            order = np.argsort(keys)
            known = np.zeros(1 << _FILTER_BITS, bool)
            known[_hashed(keys)] = True
            assert len(np.unique(keys)) == len(keys)
            self.by_length[n] = Pieces(keys[order], rows[order], np.array([scores[p] for p in own])[order], known)
        self.tails = {p[k:] for p in scores for k in range(len(p))}

    def forward(self, words: list[bytes]) -> dict[bytes, tuple[int, float]]:
        """(number of pieces, log-probability) of the best segmentation of each distinct word; of equal ones the one with fewer pieces."""
        words = sorted(set(words))
        short = [w for w in words if len(w) <= TRIE_DEPTH]
        out = {w: self._alone(w) for w in words if len(w) > TRIE_DEPTH}
        for at in range(0, len(short), TRIE_WORDS):
            out.update(self._trie(short[at : at + TRIE_WORDS]))
        return out

    def _alone(self, word: bytes) -> tuple[int, float]:
        best, pieces = [0.0], [0]
        for end in range(1, len(word) + 1):
            top, n = -np.inf, 0
            for begin in range(end - 1, -1, -1):
                piece = word[begin:end]
                if piece not in self.tails:
                    break
                s = self.scores.get(piece)
                if s is not None and ((s := s + best[begin]) > top or (s == top and pieces[begin] + 1 < n)):
                    top, n = s, pieces[begin] + 1
            best.append(top)
            pieces.append(n)
        return pieces[-1], best[-1]

    def _trie(self, words: list[bytes]) -> Iterator[tuple[bytes, tuple[int, float]]]:
        """Of sorted words. A node is the first word that has its prefix; ``node`` names it for every word and depth."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        deep, here = int(lengths.max(initial=0)), np.arange(len(words))
        table = np.zeros((len(words), deep), np.uint8)
        table[np.arange(deep) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        differs = np.ones((len(words), deep), bool)
        differs[1:] = table[1:] != table[:-1]
        fresh = np.logical_or.accumulate(differs, axis=1)
        fresh[1:] |= np.arange(deep) >= lengths[:-1, None]
        best, pieces = np.zeros((len(words), deep + 1)), np.zeros((len(words), deep + 1), np.int32)
        for depth in range(1, deep + 1):
            rows = np.flatnonzero(fresh[:, depth - 1] & (lengths >= depth))
            top, n, keys = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int32), np.zeros(len(rows), np.uint64)
            for size in range(1, depth + 1):
                begin = depth - size
                keys = _next_key(keys, table[rows, begin], size - 1)
                if size not in self.by_length:
                    continue
                hit, s = self.by_length[size].find(keys, table[rows, begin:depth])
                s = s + best[rows[hit], begin]
                count = pieces[rows[hit], begin] + 1
                better = (s > top[hit]) | ((s == top[hit]) & (count < n[hit]))
                top[hit[better]], n[hit[better]] = s[better], count[better]
            node = np.zeros(len(words), np.int64)
            node[rows] = rows
            node = np.maximum.accumulate(node)
            values, counts = np.zeros(len(words)), np.zeros(len(words), np.int32)
            values[rows], counts[rows] = top, n
            best[:, depth], pieces[:, depth] = values[node], counts[node]  # words that share the prefix share its node
        return zip(words, zip(pieces[here, lengths].tolist(), best[here, lengths].tolist()))


class Counter:
    """Counts of words (a space and the characters up to the next one, a line's first word, or a pre-token), each distinct one worked out once."""

    def __init__(self, path: str):
        self.model = Unigram(load_scores(path))
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.counts, self.chars = np.zeros((1024, 3)), 0

    def _learn(self, words: list[str]) -> None:
        parts = [[p.encode() for p in _SPLIT.findall(w)] for w in words]
        found = self.model.forward([p for ps in parts for p in ps])
        rows = np.array([(len(ps), sum(found[p][0] for p in ps), sum(found[p][1] for p in ps)) for ps in parts]).reshape(-1, 3)
        have, need = len(self.place), len(self.place) + len(words)
        if need > len(self.counts):
            self.counts = np.concatenate([self.counts[:have], np.zeros((max(need, 2 * have) - have, 3))])
        self.counts[have:need] = rows
        self.place.update(zip(words, range(have, need)))
        self.chars += sum(map(len, words))

    def totals(self, texts: list[str]) -> np.ndarray:
        """(pre-tokens, tokens, log-probability) of each text."""
        cut = [_words(t) for t in texts]
        new = {w for ws in cut for w in ws}.difference(self.place)
        if new:
            if len(self.place) + len(new) > CACHE_WORDS or self.chars > CACHE_CHARS:
                self._clear()
                new = {w for ws in cut for w in ws}
            self._learn(sorted(new))
        out = np.zeros((len(texts), 3))
        for i, ws in enumerate(cut):
            if ws:
                out[i] = self.counts[np.fromiter(map(self.place.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
        return out


def _words(text: str) -> list[str]:
    """A text cut where no pre-token reaches over: before a lone space or line feed between other characters, and behind
    such a line feed; a text with other white space into its pre-tokens."""
    if not text:
        return []
    plain = text.replace("\n", " ")
    if " ".join(plain.split()) != plain or "\0" in text:
        return _SPLIT.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for part in slices(batch, rows=2000):
                totals = count.totals([t or "" for t in part.column("text").to_pylist()])
                yield pa.record_batch([part.column("doc_id"), *(pa.array(totals[:, i].round().astype(np.int64)) for i in (0, 1)), pa.array(totals[:, 2])], names=["doc_id", "n_pretokens", "n_tokens", "log_probability"])

    return run


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_pretokens, n_tokens, log_probability)`` for every whole text.

    Null and empty texts count zero. Null ids and repeated rows are kept as they are; other columns are ignored; an
    empty table gives an empty result. Nothing is shuffled: each task has its own trie, of bounded size.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_counted(vocabulary_path), "doc_id long, n_pretokens long, n_tokens long, log_probability double")
