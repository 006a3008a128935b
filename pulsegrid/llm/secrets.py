"""Secret scan with multipart credential linking.

Strong findings (assigned passwords and tokens, access key ids, long hex strings) stand by themselves. Weak parts
(account identifiers, opaque strings, endpoints) are credentials only together: an interval join of the parts of a
document, as one sweep over their starts and ends, reports a weak part when its complements lie in its scope.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Names of the span kinds, in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "identifier", "opaque", "endpoint")
ASSIGN, ACCESS, HEX, IDENTIFIER, OPAQUE, ENDPOINT = range(len(KINDS))
#: A part's scope reaches so many code points beyond its start and its end.
SCOPE = 200

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run that is too short holds no long enough one either
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENTIFIER = re.compile(
    r"""\b(?:user(?:_?name|_?id)?|login|account(?:_?id|_?name)?|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+""", re.I | re.A
)
_IDENTIFIER_HINTS = ("@", "user", "login", "account", "client", "access")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{16,}")
_ENDPOINT = re.compile(r"""\b(?:https?|jdbc:[a-z]+|ftp|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|\b(?:host|hostname|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::\d+)?""", re.I | re.A)

_ROW = "row_id long, doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, weak array<struct<start:int,kind:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong findings, in order."""
    found = []
    lowered = text.lower()
    if any(x in lowered for x in _ASSIGN_HINTS):
        found += [(m.start(), ASSIGN, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), ACCESS, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), HEX, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the weak parts of a text that has an account identifier, without those inside a strong finding or another part."""
    lowered = text.lower()
    named = [m.span() for m in _IDENTIFIER.finditer(text)] if any(x in lowered for x in _IDENTIFIER_HINTS) else []
    if not named and not any(k == ACCESS for _, k, _ in base):
        return []
    taken, parts = [(s, e) for s, _, e in base], []
    for kind, spans in ((ENDPOINT, [m.span() for m in _ENDPOINT.finditer(text)]), (IDENTIFIER, named), (OPAQUE, [m.span() for m in _OPAQUE.finditer(text)])):
        free = _outside(spans, taken)
        parts += [(s, kind, e) for s, e in free]
        taken = sorted(taken + free)
    return sorted(parts)


def _outside(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap no taken one; both lists are in order."""
    free, i, reach = [], 0, -1
    for s, e in spans:
        while i < len(taken) and taken[i][0] < e:
            reach, i = max(reach, taken[i][1]), i + 1
        if reach <= s:
            free.append((s, e))
    return free


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    names = ["row_id", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "weak"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        base, weak = [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            base.append(base_spans(text))
            weak.append(weak_parts(text, base[-1]))
        count = lambda kind: pa.array([sum(k == kind for _, k, _ in x) for x in base], pa.int64())
        sha = pa.array([hashlib.sha256(listed(x).encode()).hexdigest() for x in base])
        structs = [pa.array([[dict(zip(("start", "kind", "end"), s)) for s in x] for x in spans], span) for spans in (base, weak)]
        ids = pa.array(range(row, row + len(base)), pa.int64())
        row += len(base)
        yield pa.record_batch([ids, batch.column(0), count(ASSIGN), count(ACCESS), count(HEX), sha, *structs], names=names)


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts of ``parts(row_id, start, kind, end)`` in whose scope (``scope`` code points before their start
    to as many behind their end) a complement lies in part or in whole: an identifier or opaque string beside its
    opposite (a strong secret or access key id counts), and an endpoint beside both.

    The interval join is one sweep over each document: of the parts that begin up to the end of a scope, one lies in
    it if the furthest end among them reaches the scope's begin. No pairs are formed."""
    opened = parts.withColumns({"at": F.col("start"), "asks": F.lit(0)})
    asked = parts.where(F.col("kind").isin(IDENTIFIER, OPAQUE, ENDPOINT)).withColumns({"at": F.col("end") + scope, "asks": F.lit(1)})
    sweep = Window.partitionBy("row_id").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = lambda *kinds: F.max(F.when((F.col("asks") == 0) & F.col("kind").isin(*kinds), F.col("end"))).over(sweep)
    seen = opened.unionByName(asked).withColumns({"named": reach(IDENTIFIER, ACCESS), "secret": reach(ASSIGN, HEX, OPAQUE)}).where("asks = 1")
    seen = seen.withColumns({c: F.coalesce(F.col(c) >= F.col("start") - scope, F.lit(False)) for c in ("named", "secret")})
    kind = F.col("kind")
    kept = ((kind == IDENTIFIER) & F.col("secret")) | ((kind == OPAQUE) & F.col("named")) | ((kind == ENDPOINT) & F.col("named") & F.col("secret"))
    return seen.where(kept).select("row_id", "start", "kind", "end")


def scan_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, found)`` for every row of ``docs``.

    ``spans`` lists ``kind:start:end`` of all findings by start, then kind (code points, end exclusive); ``found`` has
    them as structs; ``base_sha256`` is the digest of the list of strong findings alone. Null and empty texts have no
    findings. Null ids and repeated rows give result rows of their own. Other columns are ignored. An empty table gives
    an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = checkpointed(source.mapInArrow(_scanned, _ROW))
    parts = rows.where(F.size("weak") > 0).select("row_id", F.explode(F.concat("base", "weak")).alias("p")).select("row_id", "p.*")
    added = link_parts(parts, scope).groupBy("row_id").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)"))))
    kinds = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("found", lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")
    return rows.join(added, "row_id", "left").withColumn("found", spans).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), "found")


def linked(base: list[tuple[int, int, int]], weak: list[tuple[int, int, int]], scope: int = SCOPE) -> list[tuple[int, int, int]]:
    """All findings of one text, in order: the strong ones and the weak parts that ``link_parts`` reports."""

    def sweep(*kinds: int) -> tuple[list[int], list[int]]:
        spans = sorted((s, e) for s, k, e in [*base, *weak] if k in kinds)
        return [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def near(of: tuple[list[int], list[int]], s: int, e: int) -> bool:
        i = bisect_right(of[0], e + scope)
        return i > 0 and of[1][i - 1] >= s - scope

    named, secret = sweep(IDENTIFIER, ACCESS), sweep(ASSIGN, HEX, OPAQUE)
    kept = [(s, k, e) for s, k, e in weak if (k == IDENTIFIER or near(named, s, e)) and (k == OPAQUE or near(secret, s, e))]
    return sorted(base + kept)


def _redacted(scope: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.schema.names, []
            for value in batch.column("text"):
                text = value.as_py()
                base = base_spans(text or "")
                out, at = [], 0
                for start, kind, end in linked(base, weak_parts(text or "", base), scope):
                    if start >= at:
                        out += [text[at:start], f"[{KINDS[kind]}]"]
                    at = max(at, end)
                texts.append("".join([*out, text[at:]]) if out else text)
            cells = dict(zip(names, batch.columns))
            cells["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in cells:
                cells["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
            yield pa.record_batch([cells[c] for c in names], names=names)

    return run


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``[kind]`` (``n_chars`` follows where there is such a column).

    Each row is scanned and cut in one task by its own findings, whatever its doc_id; null and empty texts stay as they are."""
    return docs.mapInArrow(_redacted(scope), docs.schema)
