"""Compression bands, filter audit and dataset manifest against brute force."""

import base64
import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import compression_bands as B
from pulsegrid.llm import filter_audit as A
from pulsegrid.llm import merkle as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def plain_verdict(text, base_failed):
    data, press = text.encode(), zstandard.ZstdCompressor(level=3)

    def fits(x):
        low, high = next(b[1:] for b in B.BANDS if len(x) <= b[0])
        return low <= len(x) / len(press.compress(x)) <= high

    chunks = [data[i : i + 2048] for i in range(0, len(data), 2048)]
    return not base_failed and bool(data) and fits(data) and (len(chunks) == 1 or 5 * sum(not fits(c) for c in chunks) <= len(chunks))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é#<\n \t\x0b😀", max_size=120), max_size=5))
def test_counts_of_any_texts(texts):
    got = B.counts([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert {k: int(v[i]) for k, v in got.items()} == plain_counts(t)


def test_query_equals_the_plain_rules(spark):
    from pulsegrid.llm.queries import QUERIES

    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = QUERIES["op12_compression_bands"](spark, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_counts(texts[r.doc_id])
        assert {k: r[k] for k in want} == want
        assert r.base_failed == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        assert r.kept == plain_verdict(texts[r.doc_id], r.base_failed)


@pytest.mark.parametrize("size", [300, 900, 3000, 30_000, 200_000])
def test_bands_tell_prose_from_noise_and_echo(size):
    rnd, press = random.Random(5), zstandard.ZstdCompressor(level=3)
    stems = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 7))) for _ in range(4000)]
    prose = " ".join(rnd.choices(stems, weights=[1 / (i + 3) for i in range(4000)], k=size // 4))[:size].encode()
    noise = base64.b64encode(np.random.default_rng(1).bytes(size))[:size]
    echo = (b"Click here to read more about it. " * size)[:size]
    assert [B.judge(x, press)[3] for x in (prose, noise, echo)] == [True, False, False]
    if size >= 30_000:  # a third is noise: the whole still compresses like prose, its chunks don't
        mixed = prose[: size * 2 // 3] + noise[: size // 3]
        assert not B.judge(mixed, press)[3]


def test_bands_with_odd_rows(spark, odd_docs, no_docs):
    rows = B.measure(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.n_words == 0 and r.base_failed and not r.kept and r.ratio is None for r in rows if r.doc_id in (2, 3))
    assert [r.n_words for r in rows if r.doc_id == 4] == [60_000]
    assert B.measure(no_docs).columns == B.measure(odd_docs).columns and B.measure(no_docs).count() == 0
    kept = B.keep_compressible(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.kept for r in rows)
    assert B.keep_compressible(no_docs).count() == 0


def plain_masks(docs):
    """(part, failed letters) of each (doc_id, text, lang), by definition."""
    out = []
    for d, text, lang in docs:
        text = text or ""
        words = WORD.findall(text)
        failed = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        failed += "E" * (d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in docs))
        out.append((lang or "", failed))
    return out


def plain_audit(docs, good, toxic):
    """Every order is applied filter by filter to the documents that are left."""
    masks, out = plain_masks(docs), {}
    for part in {p for p, _ in masks}:
        mine = [(f, d in good, d in toxic) for (p, f), (d, _, _) in zip(masks, docs) if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [m for m in left if x in m[0]]
                left = [m for m in left if x not in m[0]]
                fails = sum(x in m[0] for m in mine)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(m[0] == x for m in mine), sum(m[1] for m in gone), sum(m[2] for m in gone)]
                shapley[x] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit_with_odd_rows(spark):
    rnd = random.Random(11)
    texts = [" ".join(rnd.choices(["alpha", "Beta", "GAMMA", "d#lta", "eps", "zeta"], k=rnd.choice([0, 3, 230]))) for _ in range(12)] + [" ".join(f"w{i}" for i in range(300)), None, "", " \n"]
    docs = [(rnd.choice([None, *range(30)]), rnd.choice(texts), rnd.choice(["en", None, "", "de"])) for _ in range(150)]
    docs += docs[:20]
    labels = [(d, q, t) for d, q, t in ((rnd.randrange(30), rnd.choice([0, 1, None]), rnd.choice([0, 1])) for _ in range(25))] + [(None, 1, 1)]
    table = spark.createDataFrame([(d, t, x, 1, b"x", 2) for d, t, x in docs], "doc_id long, text string, lang string, mask int, digest binary, n int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in A.audit_filters(table, known).collect()}
    named = [x for x in labels if x[0] is not None]
    assert got == plain_audit(docs, {d for d, q, _ in named if q == 1}, {d for d, _, t in named if t == 1})
    assert A.audit_filters(table.limit(0), known).count() == 0
    assert A.audit_filters(table, known.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_potentials_are_the_recursion(spark):
    worth = [0, 5, 3, 7, 2, 6, 5, 9]
    want = [0.0] * 8
    for s in range(1, 8):
        inside = [1 << i for i in range(3) if s >> i & 1]
        want[s] = (worth[s] + sum(want[s - b] for b in inside)) / len(inside)
    got = spark.range(1).select(A.potentials(F.array(*(F.lit(x).cast("long") for x in worth)), 3)).first()[0]
    assert got == [round(6 * x) for x in want]


def test_filters_need_letters(spark):
    with pytest.raises(ValueError):
        A.audit_filters(spark.range(1), spark.range(1), {"AB": "true"})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain_proof(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        start = i - i % fanout
        out.append((level[start:i], level[i + 1 : start + fanout]))
        i //= fanout
    return out


def plain_manifest(docs, fanout):
    """Sorted (doc_id, leaf, subroot, root, proof) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in docs:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, plain_leaf(row)))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])], fanout) for g in order}
    top = plain_tree([trees[g][-1][0] for g in order], fanout)
    out = []
    for j, g in enumerate(order):
        for i, (named, key, leaf) in enumerate(sorted(groups[g])):
            out.append((key if named else None, leaf, trees[g][-1][0], top[-1][0], plain_proof(trees[g], i, fanout) + plain_proof(top, j, fanout)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fanout, block_levels, sizes", [(2, 1, [1, 2, 3, 13, 33, 7, 64, 5, 9]), (3, 1, [40, 1, 28, 3]), (8, 3, [5, 600, 1]), (2, 2, [9])])
def test_manifest_equals_plain_trees(spark, fanout, block_levels, sizes):
    rnd = random.Random(3)
    langs = [None, "", "en", "é", "Z", "zh", "aa", "b", "c"][: len(sizes)] if len(sizes) > 1 else ["en"]
    docs = [(rnd.choice([None, rnd.randrange(1000), rnd.randrange(10)]), rnd.choice(["s1", None, "ß"]), lang, rnd.choice([None, 5]), rnd.choice([None, "", "Text é", "x" * 50, "a\nb"])) for lang, n in zip(langs, sizes) for _ in range(n)]
    rnd.shuffle(docs)
    table = spark.createDataFrame([(*d, 1, "z", 2) for d in docs], "doc_id long, source string, lang string, n_chars long, text string, block int, leaf string, number int")
    rows = M.build_manifest(table, fanout=fanout, block_levels=block_levels).collect()
    got = [(r.key, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.proof]) for r in rows]
    assert sorted(got, key=repr) == plain_manifest(docs, fanout)


def test_manifest_detects_changes(spark, odd_docs):
    docs = odd_docs.withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1))
    rows = M.build_manifest(docs, claim=F.when(F.col("doc_id") == 4, "0" * 64))
    checked = rows.withColumn("good", M.fold(F.coalesce("claim", "leaf"), F.col("proof")) == F.col("root")).collect()
    assert {r.key: r.good for r in checked} == {None: True, 1: True, 2: True, 3: True, 4: False, 5: True, 6: True} and len(checked) == odd_docs.count()
    assert M.build_manifest(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.build_manifest(docs, fanout=1)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_merkle_manifest"])
def test_query_equals_its_sql(spark, name):
    from pulsegrid.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want, got = con.sql(ORACLES[name]), QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
