"""Language identification with error-correcting output codes.

Each learned language gets a codeword; one binary classifier per code bit (logistic regression on hashed byte n-grams)
predicts that bit. Decoding compares the classifiers' margins with each codeword under a loss weighted by how well each
classifier does on each language in training (loss-weighted decoding). The nearest codeword wins; a small lead over the
next one flags the document as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

UNKNOWN = "und"
#: Bound of the labelled rows that the classifiers are fitted on, shared evenly by the languages.
MAX_ROWS = 3000
#: Hashed dimensions for n-grams of 1, 2 and 3 bytes.
SIZES = (256, 2048, 4096)
#: Least lead of the best codeword, as a share of probability, that is not flagged.
CLEAR_LEAD = 0.2
#: Below this score a document's language counts as unknown.
LEAST_SCORE = 0.28
#: Most classifiers in a code.
MAX_BITS = 63
#: Rows whose features are held at a time (25 kB each).
ROWS = 1024
_LETTER = regex.compile(r"\p{L}")


def features(texts: list[str]) -> np.ndarray:
    """Square roots of the shares of each text's hashed byte n-grams (lower case), one row per text."""
    coded = [x.lower().encode() for x in texts]
    out = np.zeros((len(texts), sum(SIZES)), np.float32)
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
    hashed = [data]
    for n, size in enumerate(SIZES[1:], 2):
        h = data[: max(0, len(data) - n + 1)]
        for k in range(1, n):
            h = h * 1_000_003 + data[k : len(data) - n + 1 + k]
        hashed.append((h * 0x9E3779B1 >> 15) % size)
    begin = 0
    for i, x in enumerate(coded):
        at = 0
        for n, (h, size) in enumerate(zip(hashed, SIZES), 1):
            if len(x) >= n:
                out[i, at : at + size] = np.bincount(h[begin : begin + len(x) - n + 1], minlength=size) / (len(x) - n + 1)
            at += size
        begin += len(x)
    return np.sqrt(out, out=out)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A +1/-1 code with a row for each of ``n`` classes: all distinct splits if they are few, else spread random ones."""
    if n < 3:
        return np.array([[1], [-1]][: max(n, 1)], np.float32)
    if 2 ** (n - 1) - 1 <= MAX_BITS:
        return np.array([[1, *x] for x in product((1, -1), repeat=n - 1)][1:], np.float32).T
    random = np.random.default_rng(seed)
    best = max((random.choice([-1, 1], (n, MAX_BITS)) for _ in range(200)), key=lambda c: MAX_BITS - np.max(c @ c.T - 2 * MAX_BITS * np.eye(n)))
    return best.astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # classes x bits
    weight: np.ndarray  # classes x bits: each row sums to 1
    linear: np.ndarray  # features x bits
    bias: np.ndarray

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, probability, lead over the next class) for each row; of codewords equally near the first language by name."""
        margin = np.clip(x @ self.linear + self.bias, -8, 8)
        loss = np.stack([np.log1p(np.exp(-margin * c)) @ w for c, w in zip(self.code, self.weight)], axis=1)
        likely = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        likely /= likely.sum(axis=1, keepdims=True)
        order = np.sort(likely, axis=1)
        return likely.argmax(axis=1), order[:, -1], order[:, -1] - (order[:, -2] if len(self.languages) > 1 else 0)


def fit(x: np.ndarray, languages: list[str], steps: int = 250, rate: float = 0.5, decay: float = 1e-5) -> Model:
    """Fit the classifiers of all bits at once by full-batch gradient steps (Adam)."""
    names = sorted(set(languages))
    y = np.searchsorted(names, languages)
    code = codewords(len(names))
    target = code[y]
    share = 1 / np.bincount(y, minlength=len(names))[y][:, None] / len(names)  # languages weigh alike
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = (-target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * share).astype(np.float32)
        gw = x.T @ g + decay * w
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.999 * m2 + 0.001 * gw * gw
        w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-7)
        b -= rate * g.sum(axis=0)
    right = (target * (x @ w + b)) > 0
    weight = np.stack([right[y == i].mean(axis=0) + 1e-3 for i in range(len(names))])
    return Model(names, code, (weight / weight.sum(axis=1, keepdims=True)).astype(np.float32), w, b)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, rows=ROWS):
            x = features([t or "" for t in part.column("text").to_pylist()]).astype(np.float16)
            yield pa.record_batch([part.column("lang"), part.column("order"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "order", "x"])


def learn(docs: DataFrame, train: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Model | None:
    """Fit on at most ``max_rows`` rows with a language and a letter that ``train`` selects, as many of each language,
    picked by a hash of id and text; repeated rows count once. A language of which the hash picks too few is picked from
    with a wider range of hashes, up to all its rows. None if there is no such row."""
    labelled = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = labelled.where(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count")).limit(max_rows).collect()}
    if not counts:
        return None
    each = max(1, max_rows // len(counts))
    ordered = labelled.withColumn("order", F.xxhash64("doc_id", "text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    rates, found = {lang: min(1.0, 1.2 * each / n) for lang, n in counts.items()}, {}
    while rates:
        bound = F.create_map(*[F.lit(v) for pair in rates.items() for v in pair])[F.col("lang")]
        picked = ordered.where(F.col("order") / F.lit(2.0**64) + 0.5 <= bound).dropDuplicates(["lang", "order"])
        picked = picked.withColumn("rank", rank).where(F.col("rank") <= each).drop("rank").mapInArrow(_featured, "lang string, order long, x binary")
        for r in picked.collect():  # at most max_rows
            found.setdefault(r["lang"], {})[r["order"]] = r
        rates = {lang: min(1.0, 8 * rate) for lang, rate in rates.items() if rate < 1 and len(found.get(lang, ())) < each // 4}
    rows = [found[lang][o] for lang in sorted(found) for o in sorted(found[lang])]
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    return fit(x, [r["lang"] for r in rows])


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows=ROWS):
                texts = part.column("text").to_pylist()
                known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model else []
                names, score, ambiguous = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if known:
                    found, score[known], lead = model.decide(features([texts[i] for i in known]))
                    ambiguous[known] = lead < CLEAR_LEAD
                    for i, k in zip(known, found):
                        names[i] = model.languages[k]
                yield pa.record_batch([part.column("doc_id"), pa.array(names), pa.array(score), pa.array(ambiguous)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` for every row: the language of each whole text.

    Null texts, texts without a letter (Unicode L) and all texts where nothing could be learned give ``und`` with score 0. Null ids
    and repeated rows are kept as they are; other columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, ambiguous boolean")


def _kept(model: Model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows=ROWS):
                texts = part.column("text").to_pylist()
                keep = np.array([bool(t and _LETTER.search(t)) for t in texts])
                if keep.any():
                    keep[keep] = model.decide(features([t for t, k in zip(texts, keep) if k]))[1] >= least
                yield part.filter(pa.array(keep))

    return run


def keep_identified(docs: DataFrame, model: Model | None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, with all columns, whose language can be told: those with a letter and a best score of at
    least ``least``. Without a model no row is rejected."""
    return docs if model is None else docs.mapInArrow(_kept(model, least), docs.schema)


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text modulo ``n``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
