"""SimHash components and repeat removal against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import simhash, substring_dedup
from pulsegrid.llm.common import connected_components
from pulsegrid.llm.wordhash import Words


def brute_components(rows, threshold=3):
    """Smallest id reachable over pairs of fingerprints in threshold."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= threshold:
                parent[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [least.get(find(f)) for _, f in rows]


def plain_fingerprint(text):
    import xxhash

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    words = [w for part in words for w in part.replace("\t", "\n").replace("\x0b", "\n").replace("\x0c", "\n").replace("\r", "\n").split("\n") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("hot", [3, 40])
def test_hot_and_rare_fingerprints_give_the_same_rows(spark, docs, monkeypatch, hot):
    many = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, "copied text of some words") for i in range(90)] + [(None, "copied text of some words"), (None, None), (7, "")], "doc_id long, text string"))
    want = sorted(map(str, simhash.simhash_components(many).collect()))
    monkeypatch.setattr(simhash, "HOT", hot)  # a third of the rows, or more than seven
    assert sorted(map(str, simhash.simhash_components(many).collect())) == want and len(want) == many.count()


def test_components_equal_brute_force(spark, docs):
    got = simhash.simhash_components(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(int(r.fingerprint, 16) == plain_fingerprint(texts[r.doc_id]) for r in got)
    rows = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
    assert [r.component_id for r in got] == brute_components(rows)


def test_odd_documents(odd_docs, no_docs):
    got = simhash.simhash_components(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(len(r.fingerprint) == 16 for r in got)
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {2} and {r.doc_id for r in zero} == {2, 3, 5, None}
    assert [r.component_id for r in got if r.doc_id == 1] == [1, 1]
    assert simhash.simhash_components(no_docs).count() == 0
    kept = simhash.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 6]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_pairs_in_threshold_share_an_anchor(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    rows, keys = simhash.anchors(np.array([x, y], np.uint64))
    assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_dense_groups_link_like_brute_force():
    random = np.random.default_rng(5)
    base = random.integers(0, 2**63, 4, np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << random.integers(0, 12, 60).astype(np.uint64)) ^ (np.uint64(1) << random.integers(40, 64, 60).astype(np.uint64)) for b in base]))
    a, b = simhash.links(np.zeros(len(fps), np.int32), fps)
    assert len(fps) > simhash.PAIRWISE
    rows = [(i, int(f)) for i, f in enumerate(fps)]
    parent = {int(f): int(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        assert (x ^ y).bit_count() <= 3
        parent[find(x)] = find(y)
    want = brute_components(rows)
    for i, f in rows:
        for j, g in rows:
            assert (want[i] == want[j]) == (find(f) == find(g))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 530)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 530)}}
    assert connected_components(edges.limit(0)).count() == 0


def brute_kept(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_repeats_equal_brute_force(docs):
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], brute_kept([r.text for r in rows], 35)))
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == want and any(n for _, n, _ in got.values())


@pytest.mark.parametrize("overfull", [50_000, 0])
def test_short_windows_and_overfull_anchors(spark, monkeypatch, overfull):
    """Self-overlapping repeats and runs of one word; with a bound of zero every anchor counts as overfull that was counted."""
    monkeypatch.setattr(substring_dedup, "OVERFULL", overfull)
    random = np.random.default_rng(2)
    texts = [" ".join(random.choice(["a", "b", "c"], int(n))) for n in random.integers(0, 60, 40)] + ["a " * 50, "a " * 50, "x y z w " * 9, "", None, "é à " * 7, "a  b\t\na b"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = substring_dedup.remove_repeats(frame, window=6, anchor=3).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in rows] == brute_kept(texts, 6)
    for r, t in zip(rows, texts):
        words = (t or "").encode().decode().split(" ") if t and "\t" not in t else None
        if words:
            words = [w for w in words if w]
            gone = {i for s in r.spans for i in range(s.start, s.end)}
            assert r.kept == " ".join(w for i, w in enumerate(words) if i not in gone)
            assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def thue_morse(n):
    """Two words of n letters (a power of two, 1024 or more) that every polynomial hash modulo 2^64 takes for equal."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_equal_hashes_of_different_words_change_nothing(spark):
    rest = " ".join(f"w{i}" for i in range(34))
    one, two = thue_morse(4096)
    words = Words([one.encode(), two.encode()])
    assert words.hashes[0] == words.hashes[1]
    frame = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}x")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(frame).collect()] == [0, 0, 0]


def test_trees_order_suffixes_by_their_words():
    """Neighbours share what the tree says; suffixes below a node of some depth are those whose first words are equal."""
    random = np.random.default_rng(3)
    texts = [random.choice([b"aa", b"bb", b"cc"], int(n)).tolist() for n in random.integers(5, 40, 30)]
    tree = substring_dedup.suffix_tree(texts, 6)
    suffixes = [tuple(texts[a][b:]) for a, b in zip(tree.leaf.tolist(), tree.place.tolist())]
    assert len(suffixes) == sum(max(0, len(t) - 5) for t in texts)
    common = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert tree.shared.tolist() == [0, *(common(x, y) for x, y in zip(suffixes, suffixes[1:]))]
    seen = Counter(s[:6] for s in suffixes)
    assert tree.deep(6).tolist() == [seen[s[:6]] > 1 for s in suffixes] and [s[:6] for s in suffixes] == sorted(s[:6] for s in suffixes)
    nodes = set(tree.nodes(7))
    for depth, begin, end in nodes:
        below = {s[:depth] for s in suffixes[begin:end]}
        assert len(below) == 1 and end - begin > 1 and len({s[: depth + 1] for s in suffixes[begin:end]}) > 1
        assert all(common(suffixes[i], suffixes[begin]) < depth for i in (begin - 1, end) if 0 <= i < len(suffixes))
    want = {s[:d] for s in suffixes for d in range(7, len(s) + 1) if len({t[: d + 1] for t in suffixes if t[:d] == s[:d]}) > 1}
    assert {suffixes[b][:d] for d, b, _ in nodes} == want


def plain_maximal(texts, least):
    """Runs of words with several places that no place can be lengthened by a common word, by looking at every run."""
    places = {}
    for t in texts:
        for i in range(len(t)):
            for j in range(i + least, len(t) + 1):
                places.setdefault(tuple(t[i:j]), []).append((t[i - 1] if i else None, t[j] if j < len(t) else None))
    maximal = lambda marks: None in marks or len(marks) > 1
    return {x: len(p) for x, p in places.items() if len(p) > 1 and maximal({a for a, _ in p}) and maximal({b for _, b in p})}


def test_nodes_and_repeats_of_a_small_text():
    texts = ["a b c d e a b c d f a b c".split(), "x b c d e".split(), "x b c d e".split()]
    leaves = {}
    for t in texts:
        own = leaves.setdefault(tuple(w.encode() for w in t), {})
        own[None] = own.get(None, 0) + 1
    got = {" ".join(w.decode() for w in x): n for x, n in substring_dedup.repeat_nodes(leaves, 3).items()}
    assert got == {"a b c": 3, "a b c d": 2, "b c d": 4, "b c d e": 3, "x b c d e": 2}
    assert got == {" ".join(x): n for x, n in plain_maximal(texts, 3).items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=5))
def test_repeats_of_any_texts(texts):
    leaves = {}
    for t in texts:
        own = leaves.setdefault(tuple(w.encode() for w in t), {})
        own[None] = own.get(None, 0) + 1
    got = {tuple(w.decode() for w in x): n for x, n in substring_dedup.repeat_nodes(leaves, 2).items()}
    assert got == plain_maximal(texts, 2)


def test_maximal_repeats_of_documents(spark):
    """Repeats no longer than what one anchor's windows cover are found as they are."""
    random = np.random.default_rng(9)
    words = [f"w{i}" for i in range(4000)]
    shared = [random.choice(words, n).tolist() for n in (8, 9, 8, 10)]
    texts = [" ".join(w for k in random.permutation(4)[:3] for w in [*random.choice(words, 5), *shared[k]]) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(90, None), (91, "")]
    found = {(r.words, r.places) for r in substring_dedup.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=8, anchor=3).collect()}
    want = {(" ".join(x), n) for x, n in plain_maximal([t.split() for t in texts], 8).items()}
    assert {w for w in want if len(w[0].split()) == 8} <= found and all(sum(x[0] in " " + t + " " for t in texts) for x in found)
    assert substring_dedup.maximal_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_odd_documents_lose_repeats(odd_docs, no_docs):
    got = substring_dedup.remove_repeats(odd_docs, window=3, anchor=2)
    rows = [(r.doc_id, r.n_words, r.n_removed) for r in got.collect()]
    assert rows.count((1, 4, 4)) == 2 and rows.count((None, 3, 0)) == 1 and (2, 0, 0) in rows and (3, 0, 0) in rows
    assert {n for d, _, n in rows if d == 4} == {60_000}
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_words_are_split_at_ascii_space_only():
    words = Words(["a b c\x0bd".encode(), b"", b"  "])
    assert np.diff(words.first).tolist() == [3, 0, 0]
