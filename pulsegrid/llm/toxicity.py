"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier on hashed words and word beginnings is trained from confirmed toxic texts and unlabelled texts.
Its risk is pi * R+(toxic) + max(0, R-(unlabelled) - pi * R-(toxic)), with pi the share of toxic texts: the negative
part can't go below zero, which keeps the classifier from fitting the toxic texts hidden among the unlabelled ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .wordhash import Words

#: Bounds of the confirmed and of the unlabelled rows that the classifier is fitted on.
MAX_TOXIC = 3000
MAX_UNLABELLED = 6000
#: Hash space of the features, and how many of the most telling ones the classifier uses.
SPACE_BITS = 18
MAX_FEATURES = 2048
#: A feature must be more frequent in toxic texts by so many standard errors.
LEAST_Z = 5.0
#: Bytes of the word beginnings that count as features beside whole words.
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.3

_OUTSIDE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Model:
    place: np.ndarray  # hash -> feature number, -1 for none
    weight: np.ndarray
    bias: float


def _present(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of every word and word beginning."""
    words = Words(texts, _OUTSIDE)
    shift = np.uint64(64 - SPACE_BITS)
    kinds = [words.hashes, *(words.prefixes(n) * np.uint64(2 * n + 1) for n in PREFIXES)]
    return np.tile(words.doc, len(kinds)), (np.concatenate(kinds) >> shift).astype(np.int64)


def _lowered(part: pa.RecordBatch) -> list[bytes]:
    return [(t or "").lower().encode() for t in part.column("text").to_pylist()]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            doc, at = _present(_lowered(part))
            order = np.lexsort((at, doc))
            doc, at = doc[order], at[order]
            first = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])] if len(doc) else np.zeros(0, bool)
            doc, at = doc[first], at[first].astype(np.int32)
            cuts = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
            sets = [at[b:e].tobytes() for b, e in zip(cuts, cuts[1:])]
            yield pa.record_batch([part.column("order"), part.column("toxic"), pa.array(sets, pa.binary())], names=["order", "toxic", "x"])


def fit(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 1000, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Non-negative PU risk, by full-batch gradient steps (Adam)."""
    size = 1 << SPACE_BITS
    p, u = (np.bincount(np.concatenate(x), minlength=size) / len(x) for x in (toxic, unlabelled))
    both = (p * len(toxic) + u * len(unlabelled) + 1) / (len(toxic) + len(unlabelled) + 2)
    telling = (p - u) / np.sqrt(both * (1 - both) * (1 / len(toxic) + 1 / len(unlabelled)))  # standard errors above the unlabelled texts
    best = np.argsort(-telling, kind="stable")[:MAX_FEATURES]
    chosen = np.sort(best[telling[best] > LEAST_Z])
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def dense(rows: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(rows), len(chosen)), np.float32)
        for i, r in enumerate(rows):
            at = place[r]
            x[i, at[at >= 0]] = 1
        return x

    xp, xu = dense(toxic), dense(unlabelled)
    w, b = np.zeros(len(chosen), np.float32), np.float32(-1)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        sp, su = sigmoid(xp @ w + b), sigmoid(xu @ w + b)
        if t <= steps // 2:  # start: toxic against unlabelled, logistic loss
            gp, gu = -prior * (1 - sp) / len(sp), su / len(su)
        else:  # the corrected risk, sigmoid loss (bounded, so that a prior a little too high does no harm)
            rise, negative = sp * (1 - sp) / len(sp), su.mean() - prior * sp.mean()
            fall = su * (1 - su) / len(su)
            # below zero, step back on the negative part alone
            gp, gu = (-2 * prior * rise, fall) if negative >= 0 else (prior * rise, -fall)
        g, gb = xp.T @ gp.astype(np.float32) + xu.T @ gu.astype(np.float32) + decay * w, float(gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = np.maximum(w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8), 0)  # a feature of toxic texts never speaks against toxicity
        b = np.float32(b - rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8))
    return Model(place, w, float(b))


def learn(docs: DataFrame, labels: DataFrame, train: Column, max_toxic: int = MAX_TOXIC, max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    """Fit on at most ``max_toxic`` confirmed and ``max_unlabelled`` unlabelled texts that ``train`` (on doc_id) selects, picked by a hash.

    The class prior is the share of toxic rows among the labels of ``train``. A doc_id with several labels is toxic if
    one of them is. None if no confirmed or no unlabelled text exists."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(train & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    stats = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    texts = docs.select(F.col("doc_id").cast("long"), "text").where(train & F.col("text").isNotNull())
    if not stats["toxic"]:
        return None
    free = max(1, texts.count() - stats["n"])

    order = F.xxhash64("doc_id")

    def featured(rows: DataFrame, kind: int, most: int) -> list[np.ndarray]:
        found = rows.select(order.alias("order"), F.lit(kind).alias("toxic"), "text").mapInArrow(_featured, "order long, toxic int, x binary").orderBy("order", "x").limit(most).collect()  # rows with one id stand by their features
        return [np.frombuffer(r["x"], np.int32) for r in found]

    chosen = known.where("toxic = 1").orderBy(order).limit(max_toxic).select("doc_id")  # a bounded number of ids
    toxic = featured(texts.join(F.broadcast(chosen), "doc_id", "left_semi"), 1, max_toxic)
    rate, unlabelled = min(1.0, 1.2 * max_unlabelled / free), []
    while True:
        few = texts.where(order / F.lit(2.0**64) + 0.5 <= rate)
        unlabelled = featured(few.join(known, "doc_id", "left_anti"), 0, max_unlabelled)
        if rate == 1 or len(unlabelled) >= min(max_unlabelled, free) // 4:
            break
        rate = min(1.0, 8 * rate)  # the hash picked too few, as repeated ids share it
    if not toxic or not unlabelled:
        return None
    return fit(toxic, unlabelled, stats["toxic"] / stats["n"])


def _scored(model: Model | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                z = np.zeros(part.num_rows)
                if model:
                    doc, at = _present(_lowered(part))
                    at = model.place[at]
                    pairs = np.unique(doc[at >= 0] * np.int64(len(model.weight)) + at[at >= 0])
                    z = model.bias + np.bincount(pairs // len(model.weight), weights=model.weight[pairs % len(model.weight)], minlength=part.num_rows)
                score = 1 / (1 + np.exp(-np.clip(z, -40, 40))) if model else z
                yield pa.record_batch([part.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row of ``docs``: how likely the whole text is toxic.

    A score depends on the text alone, so repeated rows and ties get equal ones; ``predicted`` is 1 from the threshold on.
    Null and empty texts get the score of a text without features; without a model every score is 0. Null ids and
    repeated rows are kept as they are; other columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col("doc_id").cast("long"), "text")
    return source.mapInArrow(_scored(model, threshold), "doc_id long, score double, predicted int")
