"""Main-text extraction with a recurrent block labeller.

A page is read as the sequence of its leaf blocks. Each block has a vector of its hashed tag path (tags, classes, ids),
its hashed words and a few counts; a numpy bidirectional LSTM reads the sequence and classifies every block with the
whole page as context. The labeller is trained on a bounded sample of the pages themselves: their semantic tags give
the labels, and copies of them with other containers and with boilerplate of many kinds put in teach it what the
sample's own markup doesn't show.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .wordhash import Words

#: Bound of the pages, and of their characters, that the labeller is trained on.
TRAIN_PAGES = 300
TRAIN_CHARS = 100_000
PATH_DIMS = 96
WORD_DIMS = 32
HIDDEN = 24
#: Open elements, from the innermost on, that make a block's path.
DEPTH = 48
WIDTH = PATH_DIMS + WORD_DIMS + 8

_TOKEN = re.compile(
    r"""<(?P<raw>script|style)(?=[\s/>])[^<>]*+>.*?(?:</(?P=raw)\s*+>|\Z)|<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>(?:"[^"]*+"|'[^']*+'|[^'"<>]++)*+)>|<[!?/][^<>]*+>""", re.S | re.I
)
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "input", "math", "mi", "mn", "mo", "mrow", "msup", "msub", "mfrac", "msqrt", "mtext", "svg", "g", "path", "rect", "circle", "use"}
_ENDS_P = {"p", "div", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "aside", "header", "footer", "nav", "main", "form", "blockquote", "pre", "figure", "hr", "address", "fieldset"}
_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Names of containers that hold no main text (fixed values), and of those that do.
BOILERPLATE = ("nav", "menu", "header", "footer", "sidebar", "aside", "ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "cookie", "cookies", "notice", "consent", "alert", "popup", "modal", "form", "newsletter", "subscribe", "signup", "login", "search", "comments", "comment", "comment-list", "respond", "disqus", "related", "recommended", "share", "social", "breadcrumb", "breadcrumbs", "pagination", "copyright", "widget", "toolbar", "tags")
CONTENT = ("article", "content", "main", "post", "entry", "entry-content", "post-content", "article-body", "story", "main-content", "body-text", "page")
_PLAIN_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head", "title", "header"}


_BLOCKS = pa.list_(pa.struct([("path", pa.list_(pa.string())), ("text", pa.string()), ("linked", pa.float64())]))


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: float  # share of its characters inside links


def _names(attrs: str) -> list[str]:
    return [x for m in _NAMED.finditer(attrs) for x in (m[1] or m[2] or m[3] or "").lower().split()]


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order: runs of text without a block-level tag inside, references decoded, white space as
    single spaces. A block's path holds its innermost ``DEPTH`` open elements. A script or style is open up to its closing
    tag, or else to the end of the page, whether it ends in ``/>`` or not."""
    page = page or ""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    buffer: list[str] = []
    opened: Counter[str] = Counter()
    linked, at = 0, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                path = tuple(x for tag, own in stack[-DEPTH:] if tag not in _INLINE for x in own)
                found.append(Block(path, text, min(1.0, linked / max(1, len(text)))))
            buffer.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            buffer.append(text)
            if opened["a"]:
                linked += len(text)

    def pop_to(tags: set[str], stop: set[str]) -> None:
        if not any(opened[tag] for tag in tags):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                opened.subtract(tag for tag, _ in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        inline = tag in _INLINE
        if tag == "br":
            buffer.append(" ")
        elif m["close"]:
            if not inline:
                flush()
            pop_to({tag}, set() if not inline else _ENDS_P | {"li", "td", "th", "body"})
        else:
            if not inline:
                flush()
            if tag in _ENDS_P:
                pop_to({"p"}, {"td", "th", "li", "div", "article", "section", "body", "blockquote"})
            if tag in _SELF:
                pop_to(_SELF[tag], {"ul", "ol", "dl", "table", "tbody"} - _SELF[tag])
            if tag not in _VOID and not m["attrs"].endswith("/"):
                own = [tag, *(f"{tag}.{x}" for x in _names(m["attrs"])), *(f".{x}" for x in _names(m["attrs"]))] if "=" in m["attrs"] else [tag]
                stack.append((tag, tuple(own)))
                opened[tag] += 1
    add(page[at:])
    flush()
    return found


def _slot(token: str, of: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % of


class Vectors:
    """Block vectors; those of tag paths are kept, as pages share them."""

    def __init__(self) -> None:
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        vector = self.paths.get(path)
        if vector is None:
            vector = np.zeros(PATH_DIMS, np.float32)
            for token in path:
                vector[_slot(token, PATH_DIMS)] = 1
            vector[_slot("last " + (path[-1] if path else ""), PATH_DIMS)] += 1
            if len(self.paths) > 20_000:
                self.paths.clear()
            self.paths[path] = vector
        return vector

    def __call__(self, pages: list[list[Block]]) -> np.ndarray:
        flat = [b for page in pages for b in page]
        x = np.zeros((len(flat), WIDTH), np.float32)
        if not flat:
            return x
        words = Words([b.text.encode("utf-8", "replace") for b in flat])
        n = np.diff(words.first)
        slot = (words.hashes >> np.uint64(59)).astype(np.int64)
        x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.bincount(words.doc * WORD_DIMS + slot, minlength=len(flat) * WORD_DIMS).reshape(-1, WORD_DIMS) / np.maximum(n, 1)[:, None]
        size = np.array([len(b.text) for b in flat])
        place = np.concatenate([np.linspace(0, 1, len(p)) for p in pages if p])
        own = PATH_DIMS + WORD_DIMS
        for i, b in enumerate(flat):
            x[i, :PATH_DIMS] = self.path(b.path)
            x[i, own + 3] = b.linked
            x[i, own + 4] = b.text[-1] in ".!?…\"'"
        x[:, own], x[:, own + 1], x[:, own + 2] = np.log1p(size) / 8, np.log1p(n) / 6, place
        x[:, own + 5], x[:, own + 6], x[:, own + 7] = place == 0, place == 1, size > 80
        return x


@dataclass
class Model:
    """Weights by name: input, recurrent and bias of both directions, and the output layer."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 11) -> Model:
        random = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {}
        for side in "fb":
            w[f"x{side}"] = (random.standard_normal((WIDTH, 4 * HIDDEN)) * 0.15).astype(np.float32)
            w[f"h{side}"] = (random.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN) * 0.7).astype(np.float32)
            w[f"c{side}"] = np.zeros(4 * HIDDEN, np.float32)
            w[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        w["o"] = (random.standard_normal(2 * HIDDEN) * 0.2).astype(np.float32)
        w["d"] = np.zeros(1, np.float32)
        return Model(w)

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Log-odds that each block of padded pages (pages x blocks x width) is main text; ``keep`` gets what training needs."""
        n, t, _ = x.shape
        steps = np.arange(t)
        turned = np.where(steps < lengths[:, None], lengths[:, None] - 1 - steps, steps)
        states = []
        for side in "fb":
            own = x if side == "f" else np.take_along_axis(x, turned[:, :, None], 1)
            gates = own @ self.weights[f"x{side}"] + self.weights[f"c{side}"]
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            out, trail = np.empty((n, t, HIDDEN), np.float32), []
            for k in range(t):
                z = gates[:, k] + h @ self.weights[f"h{side}"]
                ifo = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
                i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
                g = np.tanh(z[:, 3 * HIDDEN :])
                before, c = c, f * c + i * g
                squashed = np.tanh(c)
                if keep is not None:
                    trail.append((h, before, i, f, o, g, squashed))
                h = o * squashed
                out[:, k] = h
            if keep is not None:
                keep.append((own, trail))
            states.append(out if side == "f" else np.take_along_axis(out, turned[:, :, None], 1))
        joined = np.concatenate(states, axis=2)
        if keep is not None:
            keep += [joined, turned]
        return joined @ self.weights["o"] + self.weights["d"]

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over the blocks, back through time."""
        keep: list = []
        z = self.forward(x, lengths, keep)
        (own_f, trail_f), (own_b, trail_b), joined, turned = keep
        mask = np.arange(x.shape[1]) < lengths[:, None]
        dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * mask / mask.sum()
        grads = {"o": np.einsum("nt,ntk->k", dz, joined), "d": np.array([dz.sum()])}
        dj = dz[:, :, None] * self.weights["o"]
        for side, own, trail in (("f", own_f, trail_f), ("b", own_b, trail_b)):
            dh_out = dj[:, :, :HIDDEN] if side == "f" else np.take_along_axis(dj[:, :, HIDDEN:], turned[:, :, None], 1)
            dgates = np.empty((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((len(x), HIDDEN), np.float32)
            wh = self.weights[f"h{side}"]
            gh = np.zeros_like(wh)
            for k in range(x.shape[1] - 1, -1, -1):
                h, before, i, f, o, g, squashed = trail[k]
                dh = dh + dh_out[:, k]
                dc = dc + dh * o * (1 - squashed**2)
                d = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                dgates[:, k] = d
                gh += h.T @ d
                dh, dc = d @ wh.T, dc * f
            grads[f"h{side}"] = gh
            grads[f"x{side}"] = np.einsum("ntw,ntk->wk", own, dgates, optimize=True)
            grads[f"c{side}"] = dgates.sum(axis=(0, 1))
        return grads

    def label(self, pages: list[list[Block]], vectors: Vectors, cells: int = 8192) -> list[np.ndarray]:
        """For each page which blocks are main text. Pages of like length go together, ``cells`` blocks at a time or one page."""
        x = vectors(pages)
        lengths = np.array([len(p) for p in pages], np.int64)
        first = np.cumsum(lengths) - lengths
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in np.argsort(lengths, kind="stable") if lengths[i]]
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and lengths[order[end]] * (end + 1 - at) <= cells:
                end += 1
            some = order[at:end]
            z = self.forward(_padded(x, first[some], lengths[some]), lengths[some])
            for row, i in zip(z, some):
                out[i] = row[: lengths[i]] > 0
            at = end
        return out


def _padded(x: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first), int(lengths.max()), x.shape[1]), np.float32)
    for row, (f, n) in enumerate(zip(first, lengths)):
        out[row, :n] = x[f : f + n]
    return out


def weak_label(path: tuple[str, ...], semantic: bool) -> bool:
    """What the markup of a training page says of a block: main text if inside an article-like container (on pages that
    have one) and inside nothing that is known not to be."""
    inside, tags = False, set(path)
    if any(t.startswith(".") and t[1:] in BOILERPLATE for t in tags):
        return False
    for token in path:
        if token in ("article", "main") or (token.startswith(".") and token[1:] in CONTENT):
            inside = True
        if token in _PLAIN_TAGS and not (token == "header" and inside):
            return False
    return inside or not semantic


def _disturbed(page: list[Block], semantic: bool, strangers: list[str], random: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A copy of a page in another main container and with boilerplate of other kinds put before, into and behind its main text."""
    out, labels = [], []
    box = str(random.choice(CONTENT))
    tag = str(random.choice(["article", "main", "div", "section"]))
    swap = random.random() < 0.7

    def stray(base: tuple[str, ...]) -> None:
        name = str(random.choice(BOILERPLATE))
        if name in ("nav", "header", "footer", "aside", "form", "menu") and random.random() < 0.5:
            path = (*base, name)
        else:
            outer = str(random.choice(["div", "section", "aside", "ul"]))
            path = (*base, outer, f"{outer}.{name}", f".{name}")
        inner = str(random.choice(["p", "div", "li", "span", "h3", ""]))
        for _ in range(int(random.integers(1, 5))):
            text = strangers[int(random.integers(len(strangers)))]
            if random.random() < 0.4:
                text = " ".join(text.split()[: int(random.integers(1, 8))])
            out.append(Block((*path, inner) if inner else path, text, float(random.random() < 0.3)))
            labels.append(False)

    seen = False
    for b in page:
        good = weak_label(b.path, semantic)
        path = b.path
        if good and swap:
            path = tuple(x for x in path if x not in ("article", "main"))
            base = next((i + 1 for i, x in enumerate(path) if x == "body"), 0)
            path = (*path[:base], *((tag,) if tag in ("article", "main") else (tag, f"{tag}.{box}", f".{box}")), *path[base:])
        if random.random() < (0.5 if good and not seen else 0.06):
            stray(path[:-1] if good and seen else ("html", "body"))
        seen = seen or good
        out.append(Block(path, b.text, b.linked))
        labels.append(good)
    if random.random() < 0.8:
        stray(("html", "body"))
    return out, labels


def fit(pages: list[list[Block]], semantic: list[bool] | None = None, epochs: int = 14, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Model:
    """Train the labeller by Adam on the pages and two disturbed copies of each; long pages in runs of 64 blocks.

    ``semantic`` says of each page whether it has an article-like container; without it the blocks given tell. There is no
    model of no blocks: that is an error."""
    random = np.random.default_rng(seed)
    known = semantic or [any(weak_label(b.path, True) for b in p) for p in pages]
    pages, known = [p for p in pages if p], [k for p, k in zip(pages, known) if p]
    if not pages:
        raise ValueError("there are no blocks to train on")
    strangers = [b.text for p in pages for b in p]
    samples = []
    for page, contained in zip(pages, known):
        samples.append((page, [weak_label(b.path, contained) for b in page]))
        samples += [_disturbed(page, contained, strangers, random) for _ in range(2)]
    runs = [(p[i : i + 64], y[i : i + 64]) for p, y in samples for i in range(0, len(p), 64)]
    x, lengths = Vectors()([p for p, _ in runs]), np.array([len(p) for p, _ in runs])
    first = np.cumsum(lengths) - lengths
    model = Model.fresh()
    m = {k: np.zeros_like(v) for k, v in model.weights.items()}
    v = {k: np.zeros_like(w) for k, w in model.weights.items()}
    t = 0
    for epoch in range(epochs):
        order = np.argsort(lengths + random.integers(0, 6, len(runs)), kind="stable")
        starts = np.arange(0, len(order), batch)
        random.shuffle(starts)
        for s in starts:
            some = order[s : s + batch]
            y = np.zeros((len(some), int(lengths[some].max())), np.float32)
            for row, i in enumerate(some):
                y[row, : lengths[i]] = runs[i][1]
            g = model.gradients(_padded(x, first[some], lengths[some]), lengths[some], y)
            t += 1
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            step = rate * (1 - epoch / epochs) + 1e-4
            for k, a in g.items():
                a = a * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                model.weights[k] = (model.weights[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return model


def _run(found: list[Block], begin: int, end: int, most: int) -> list[Block]:
    """Blocks of ``found[begin:end]`` from the first on with ``most`` characters at most; the last of them may be cut."""
    out = []
    for b in found[begin:end]:
        if most <= 0:
            break
        out.append(b if len(b.text) <= most else Block(b.path, b.text[:most], b.linked))
        most -= len(b.text)
    return out


def training_run(page: str, max_chars: int, seed: int) -> tuple[list[Block], bool]:
    """Blocks of a page to train on, ``max_chars`` characters at most, and whether the page has an article-like container.

    A longer page is parsed as a whole, too, and gives a third of the bound from its begin, from its end and from a place
    between that ``seed`` picks."""
    found = blocks(page)
    semantic = any(weak_label(b.path, True) for b in found)
    ends = np.cumsum([len(b.text) for b in found])
    if not found or ends[-1] <= max_chars:
        return found, semantic
    third = max(1, max_chars // 3)
    low = int(np.searchsorted(ends, third, side="right")) + 1
    high = max(low, int(np.searchsorted(ends, int(ends[-1]) - third, side="right")) + 1)
    place = int(np.searchsorted(ends, third + seed % max(1, int(ends[-1]) - 2 * third), side="right"))
    middle = min(max(low, place), high)
    return _run(found, 0, low, third) + _run(found, middle, high, third) + _run(found, high, len(found), third), semantic


def learn(pages: DataFrame, max_pages: int = TRAIN_PAGES, max_chars: int = TRAIN_CHARS, html_col: str = "html") -> Model | None:
    """Train on at most ``max_pages`` different pages, picked by a hash, and at most ``max_chars`` characters of each.

    The share of hashes that is looked at widens until there are enough different pages with text, so repeated and empty
    pages don't thin the sample. None only if no page has any text at all."""
    usable = pages.where(F.length(html_col) > 0).select(F.xxhash64(html_col).alias("order"), F.col(html_col).alias("html"))
    n, share = usable.count(), 1.5 * max_pages

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                runs = [training_run(x.as_py(), max_chars, o.as_py() & 0x7FFFFFFF) for o, x in zip(part.column("order"), part.column("html"))]
                rows = [[{"path": list(b.path), "text": b.text, "linked": b.linked} for b in run] for run, _ in runs]
                yield pa.record_batch([part.column("order"), pa.array(rows, _BLOCKS), pa.array([s for _, s in runs])], names=["order", "blocks", "semantic"])

    while n:
        picked = usable.where(F.col("order") / F.lit(2.0**64) + 0.5 <= min(1.0, share / n)).dropDuplicates(["order"])
        runs = picked.mapInArrow(parsed, "order long, blocks array<struct<path:array<string>,text:string,linked:double>>, semantic boolean").where(F.size("blocks") > 0)
        rows = runs.orderBy("order").limit(max_pages).collect()
        if len(rows) >= max_pages or share >= n:
            return fit([[Block(tuple(b["path"]), b["text"], b["linked"]) for b in r["blocks"]] for r in rows], [r["semantic"] for r in rows]) if rows else None
        share *= 8
    return None


def _extracted(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            for part in slices(batch, "html"):
                pages = [blocks(p) for p in part.column("html").to_pylist()]
                kept = model.label(pages, vectors) if model else [np.zeros(len(p), bool) for p in pages]
                texts = ["\n\n".join(b.text for b, y in zip(p, k) if y) for p, k in zip(pages, kept)]
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, model: Model | None) -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every page, blocks joined by an empty line.

    Null and empty pages, and pages whose blocks are all boilerplate, give an empty text; so do all pages without a
    model, which ``learn`` fails to give only where no page has text. Null ids and urls and repeated rows are kept as they are; other columns are ignored; an empty table gives an
    empty result.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return source.mapInArrow(_extracted(model), "page_id long, url string, text string, n_chars long")
