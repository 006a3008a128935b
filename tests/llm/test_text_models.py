"""Language, toxicity and HTML models: held-out quality and odd rows."""

import html
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import html_extraction as H
from pulsegrid.llm import language_id, toxicity
from pulsegrid.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.1"


def test_codewords_are_apart():
    for n in (1, 2, 3, 4, 6, 12, 40):
        code = language_id.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
        if n > 2:
            apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
            assert min(apart) >= 2


def test_language_of_held_out_documents(spark):
    got = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01")
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(known, "doc_id").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_documents(odd_docs, no_docs, docs):
    model = language_id.learn(docs, F.lit(True))
    rows = language_id.predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 5, 6)} == {"und"} and {r.score for r in rows if r.doc_id in (2, 3)} == {0.0}
    assert language_id.predict(no_docs, model).count() == 0
    assert language_id.learn(no_docs, F.lit(True)) is None
    assert {r.lang_pred for r in language_id.predict(odd_docs, None).collect()} == {"und"}
    assert language_id.keep_identified(odd_docs, model).columns == odd_docs.columns
    assert {r.doc_id for r in language_id.keep_identified(odd_docs, model).collect()} >= {1, 4}
    assert language_id.learn(odd_docs, F.lit(True)).languages == ["de", "en"]


def test_repeated_rows_and_letters(spark):
    rows = [(1, "one and the same text", "en")] * 3000 + [(2, "un texto", "es"), (3, "½ ² ٣ 12", "xx"), (4, "ʰ", None), (5, "漢字", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(frame, F.lit(True))
    assert model.languages == ["en", "es"]
    got = {r.doc_id: r.lang_pred for r in language_id.predict(frame, model).collect()}
    assert got[1] == "en" and got[2] == "es" and got[3] == "und" and got[4] != "und" and got[5] != "und"


def test_decoding_equals_a_plain_one():
    random = np.random.default_rng(3)
    texts = ["".join(random.choice(list(letters), 60)) for letters in ("abc ", "cde ", "efg ", "gha ", "bdf ") for _ in range(20)]
    names = [x for x in "pqrst" for _ in range(20)]
    x = language_id.features(texts)
    model = language_id.fit(x, names, steps=60)
    found, score, lead = model.decide(x)
    for row, k, p, d in zip(x, found, score, lead):
        margin = [min(8.0, max(-8.0, float(row @ model.linear[:, b] + model.bias[b]))) for b in range(model.code.shape[1])]
        loss = [sum(float(w) * np.log1p(np.exp(-m * c)) for m, c, w in zip(margin, code, weight)) for code, weight in zip(model.code, model.weight)]
        likely = np.exp(-4 * (np.array(loss) - min(loss)))
        likely /= likely.sum()
        assert k == int(np.argmin(loss)) and abs(p - likely[k]) < 1e-3 and abs(d - (likely[k] - sorted(likely)[-2])) < 1e-3
    assert np.mean([names[i] == model.languages[k] for i, k in enumerate(found)]) > 0.95


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = QUERIES["op3_toxicity"](spark, MIDDLE).where("held_out").join(labels, "doc_id").collect()
    caught = np.mean([r.predicted for r in rows if r.toxic])
    wrong = np.mean([r.predicted for r in rows if not r.toxic])
    assert caught > 0.9 and wrong < 0.03
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_negative_risk_does_not_fit_hidden_positives():
    random = np.random.default_rng(0)
    noise = lambda: random.integers(1000, 5000, 20)
    toxic = [np.unique(np.r_[1, 2, noise()]) for _ in range(200)]
    unlabelled = [np.unique(np.r_[1, 2, noise()]) for _ in range(100)] + [np.unique(noise()) for _ in range(900)]
    model = toxicity.fit(toxic, unlabelled, 0.1)
    both = model.weight[model.place[1]] + model.weight[model.place[2]] + model.bias
    assert both > 0 > model.bias


def plain_risk(model, toxic, unlabelled, prior):
    """pi R+(toxic) + max(0, R-(unlabelled) - pi R-(toxic)) with the sigmoid loss, text by text."""

    def score(row):
        z = model.bias + sum(float(model.weight[model.place[f]]) for f in row if model.place[f] >= 0)
        return 1 / (1 + np.exp(-z))

    p, u = [score(r) for r in toxic], [score(r) for r in unlabelled]
    return prior * np.mean([1 - x for x in p]) + max(0.0, np.mean(u) - prior * np.mean(p))


def test_fitted_classifier_is_near_the_least_risk():
    random = np.random.default_rng(2)
    noise = lambda: random.integers(1000, 3000, 10)
    toxic = [np.unique(np.r_[random.choice([1, 2, 3], 2), noise()]) for _ in range(120)]
    unlabelled = [np.unique(np.r_[random.choice([1, 2, 3], 2), noise()]) for _ in range(40)] + [np.unique(noise()) for _ in range(360)]
    model = toxicity.fit(toxic, unlabelled, 0.1)
    least = plain_risk(model, toxic, unlabelled, 0.1)
    assert least < 0.02
    for _ in range(20):
        other = toxicity.Model(model.place, np.maximum(model.weight + random.normal(0, 2, len(model.weight)), 0), model.bias + random.normal(0, 2))
        assert plain_risk(other, toxic, unlabelled, 0.1) > least - 0.005


def test_few_distinct_unlabelled_rows_are_still_found(spark):
    docs = spark.createDataFrame([(1, "bad awful words")] * 20 + [(2, "fine and good words")] * 30_000, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels, F.lit(True), max_unlabelled=50) is not None


def test_toxicity_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (None, 0, 1), (2, 1, None), (6, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(odd_docs, labels, F.lit(True))
    for m in (model, None):
        rows = toxicity.score(odd_docs, m).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.learn(no_docs, labels, F.lit(True)) is None and toxicity.score(no_docs, None).count() == 0


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a><li><a href="/x">More</a></ul></nav>
<article><h1>A &amp; B</h1><p>First <b>bold</b>
 line.<p>Second&nbsp;<a href="#">link</a><br>end.</article><footer>&copy; x</footer><!-- <p>gone</p> -->"""


def test_blocks():
    got = [(b.path[-1], b.text) for b in H.blocks(PAGE)]
    assert got == [("title", "T"), ("li", "Home"), ("li", "More"), ("h1", "A & B"), ("p", "First bold line."), ("p", "Second link end."), ("footer", "© x")]
    assert H.blocks(None) == [] and H.blocks("") == [] and [b.text for b in H.blocks("just < text")] == ["just < text"]
    assert len(H.blocks("<div>" * 3000 + "deep")) == 1


def test_broken_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for page in ("<p" * 500_000, "<!" * 300_000, "<script " * 100_000, "<p a='" * 100_000, '<p a="x ' + "<p>" * 100_000, "<div>a" * 50_000, "<div>" * 50_000 + "</x>" * 50_000, "<a href=x>b" * 50_000, "</script" + " " * 200_000, "<p><b>" * 30_000 + "<div>" * 30_000):
        H.blocks(page)
    assert time.perf_counter() - began < 30
    assert [b.text for b in H.blocks("x <p y <p>z")] == ["x <p y", "z"]


def test_gradients_are_right():
    random = np.random.default_rng(1)
    model = H.Model.fresh()
    for k, w in model.weights.items():
        model.weights[k] = w.astype(np.float64)
    x, lengths, y = random.standard_normal((2, 4, H.WIDTH)), np.array([4, 2]), random.integers(0, 2, (2, 4)).astype(float)
    mask = np.arange(4) < lengths[:, None]

    def loss():
        z = model.forward(x, lengths)
        return float((np.where(y == 1, np.log1p(np.exp(-z)), np.log1p(np.exp(z))) * mask).sum() / mask.sum())

    grads = model.gradients(x, lengths, y)
    for k, w in model.weights.items():
        at = tuple(int(random.integers(n)) for n in w.shape)
        old = w[at]
        w[at] = old + 1e-4
        up = loss()
        w[at] = old - 1e-4
        down = loss()
        w[at] = old
        assert abs((up - down) / 2e-4 - grads[k][at]) < 2e-4


def plain_article(page):
    inner = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(x for x in texts if x)


def test_articles_are_extracted_and_boilerplate_of_other_kinds_left_out(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = H.learn(pages.where("page_id % 2 = 0"))
    rows = {r.page_id: r for r in H.extract_text(pages, model).collect()}
    held = pages.where("page_id % 2 = 1").collect()
    assert all(rows[p.page_id].text == plain_article(p.html) and rows[p.page_id].n_chars == len(rows[p.page_id].text) for p in held)
    random = np.random.default_rng(9)
    strangers = [b.text for p in held for b in H.blocks(p.html)]
    right = total = 0
    for p in held[:60]:
        blocks, labels = H._disturbed(H.blocks(p.html), True, strangers, random)
        got = model.label([blocks], H.Vectors())[0]
        right, total = right + int((got == np.array(labels)).sum()), total + len(labels)
    assert right / total > 0.97


def test_odd_pages(spark):
    odd = spark.createDataFrame([(1, None, None, 1), (None, "u", "", 2), (2, "u", PAGE, 3), (2, "u", PAGE, 3), (3, "u", "<nav>a</nav>", 4)], "page_id long, url string, html string, text int")
    model = H.learn(odd)
    rows = H.extract_text(odd, model).collect()
    assert len(rows) == 5 and {(r.text, r.n_chars) for r in rows if r.page_id in (1, None)} == {("", 0)}
    assert H.extract_text(odd.limit(0), model).count() == 0 and H.learn(odd.limit(0)) is None
    assert {r.text for r in H.extract_text(odd, None).collect()} == {""}


def test_only_scripts_and_styles_are_skipped_as_raw_text():
    from pulsegrid.llm import html_extraction

    page = (
        "<p>a <svg-icon name='x'></svg-icon>b</p><p>c <svg width='1'/> d</p><p>e <math><mi>x</mi></math> f</p><noscript><p>g</p></noscript><object><p>h</p></object>"
        "<script src='s'></script><p>i</p><script>if (1 < 2) no()</script><style>no</style><script-note>j</script-note><!-- no --><template-part>k</template-part><p>l</p>"
    )
    words = " ".join(b.text for b in html_extraction.blocks(page)).split()
    assert words == list("abcdexfghijkl")
    assert "e x f" in [b.text for b in html_extraction.blocks(page)]
    assert [b.text for b in html_extraction.blocks("<p>a</p><script src='s'/>alert(1)</script><p>b</p>")] == ["a", "b"]  # as browsers read it


def simple_page(i, body):
    words = f"{i} one two three four five six seven eight nine ten."
    return f"<html><body><nav><ul><li><a href='x'>Menu {i}</a></li></ul></nav><div class='sidebar'><p>Side {i} notes here.</p></div><article><h1>Head {i}</h1>{body(words)}</article><footer><p>Foot {i} rights.</p></footer></body></html>"


def expected(i, n):
    return "\n\n".join([f"Head {i}", *[f"{i} one two three four five six seven eight nine ten."] * n])


def trained(model):
    return any(not np.array_equal(w, H.Model.fresh().weights[k]) for k, w in model.weights.items())


def test_many_copies_of_a_page_do_not_thin_the_training(spark):
    body = lambda w: f"<p>{w}</p>" * 4
    rows = [(i, "u", simple_page(0 if i < 2000 else i, body)) for i in range(2006)] + [(9000 + i, "u", "<p></p>") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = H.learn(pages)
    assert trained(model)
    texts = {r.page_id: r.text for r in H.extract_text(pages, model).collect()}
    assert all(texts[i] == expected(0 if i < 2000 else i, 4) for i in range(2006))


def test_long_pages_are_learned_from_and_extracted_whole(spark):
    n = 2500  # some 150,000 characters
    pages = spark.createDataFrame([(i, "u", simple_page(i, lambda w: f"<p>{w}</p>" * n)) for i in range(12)], "page_id long, url string, html string")
    model = H.learn(pages)
    assert trained(model)
    assert {r.page_id: r.text for r in H.extract_text(pages, model).collect()} == {i: expected(i, n) for i in range(12)}


def test_training_runs():
    page = simple_page(1, lambda w: f"<p>{w}</p>" * 100)
    whole, semantic = H.training_run(page, 10**6, 5)
    assert whole == H.blocks(page) and semantic
    for seed in range(0, 9000, 700):
        run, semantic = H.training_run(page, 1000, seed)
        assert semantic and 900 <= sum(len(b.text) for b in run) <= 1000
        assert run[:3] == whole[:3] and run[-1] == whole[-1]
        kept = [b.path for b in run]
        assert all(p in [b.path for b in whole] for p in kept)
    assert sum(len(b.text) for b in H.training_run("<article><p>" + "x" * 5000 + "</p></article>", 1000, 3)[0]) <= 1000
    with pytest.raises(ValueError):
        H.fit([[]])


def test_language_query_equals_each_text_by_itself(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = language_id.learn(docs, language_id.remainder("doc_id", 5) != 0)
    rows = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, path).collect()}
    for d in docs.collect():
        assert rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)
        margin = np.clip(language_id.features([d.text]) @ model.linear + model.bias, -8, 8)[0]
        loss = [sum(w * np.log1p(np.exp(-m * c)) for m, c, w in zip(margin, code, weight)) for code, weight in zip(model.code, model.weight)]
        assert rows[d.doc_id].lang_pred == model.languages[int(np.argmin(loss))]
        assert rows[d.doc_id].score == pytest.approx(1 / sum(np.exp(-4 * (x - min(loss))) for x in loss), rel=1e-3)


def test_toxicity_query_equals_each_text_by_itself(spark):
    path = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels, language_id.remainder("doc_id", 4) != 2)
    alone = {r.doc_id: r for r in toxicity.score(docs.repartition(40), model).collect()}
    for r in QUERIES["op3_toxicity"](spark, path).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.score == pytest.approx(alone[r.doc_id].score, abs=1e-9) and r.predicted == int(r.score >= 0.3)


def test_toxicity_does_not_depend_on_the_order_of_repeated_ids(spark):
    texts = [f"plain words number {i} of a text" for i in range(40)] + [f"vile nasty insult {i} here" for i in range(40)]
    rows = [(i % 8, t) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(4)], "doc_id long, toxic int")
    models = [toxicity.learn(spark.createDataFrame(some, "doc_id long, text string"), labels, F.lit(True), 5, 7) for some in (rows, rows[::-1])]
    assert np.array_equal(models[0].weight, models[1].weight) and models[0].bias == models[1].bias
