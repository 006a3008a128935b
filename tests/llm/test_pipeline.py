"""The pipeline's stages on the smallest documents and on odd rows."""

import corpus_pipeline
from pulsegrid.llm import decontamination, queries, secrets, simhash

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, docs):
    frame = docs
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = spark.createDataFrame(stage(spark, frame, SF).collect(), docs.schema)
        left = {r.doc_id for r in frame.collect()}
        assert frame.columns == docs.columns and left <= ids
        if name == "language_id":
            assert left == ids
        if name == "simhash_near_dedup":
            rows = simhash.simhash_components(docs).collect()
            assert left == {r.component_id for r in rows}
        if name == "benchmark_decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            gone = {r.doc_id for r in decontamination.find_contamination(docs, bench).collect()}
            assert left == ids - gone and decontamination.find_contamination(frame, bench).count() == 0
        if name == "secret_scan":
            assert left == ids and not any(secrets.base_spans(r.text) for r in frame.collect())
        ids = left
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
    assert {r.doc_id for r in packed} == ids


def test_run_equals_its_stages(spark, monkeypatch):
    """The whole of a larger table with odd rows in it, stage by stage against the operators' own results."""
    odd = [(None, "some words without an id " * 20, None, None, None), (None, None, "en", "x", 0), (5, "", None, "x", 0), (5, "another text under a taken id " * 9, "en", "x", 0), (70_000, "½ 12 ?!", "en", "x", 7)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    sf = "/root/testdata/sf0.01"
    rows = {0: docs}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        rows[i + 1] = spark.createDataFrame(stage(spark, rows[i], sf).collect(), docs.schema)
    texts = lambda frame: sorted((str(r.doc_id), str(r.text)) for r in frame.collect())
    assert (str(70_000), "½ 12 ?!") in texts(docs) and (str(70_000), "½ 12 ?!") not in texts(rows[1])
    want = simhash.simhash_components(rows[1]).select("component_id").distinct().count()
    assert abs(rows[2].count() - want) <= 1  # a group without any id is one more row
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    gone = {r.doc_id for r in decontamination.find_contamination(rows[2], bench).collect()}
    assert texts(rows[3]) == [x for x in texts(rows[2]) if x[0] not in set(map(str, gone))] and gone
    assert rows[4].count() == rows[3].count() and not any(secrets.base_spans(r.text or "") for r in rows[4].collect())
    table = spark.createDataFrame(docs.collect(), docs.schema)

    class Reader:
        def parquet(self, path):
            return table if "documents" in path else bench

    class Session:
        read = Reader()

        def __getattr__(self, name):
            return getattr(spark, name)

    packed = corpus_pipeline.run(Session(), sf).collect()
    assert sorted(str(r.doc_id) for r in packed if r.piece == 0) == sorted(str(r.doc_id) for r in rows[4].collect())


def test_odd_rows_go_through(spark, odd_docs, no_docs):
    for frame in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = spark.createDataFrame(stage(spark, frame, SF).collect(), odd_docs.schema)
        corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()


def test_every_operator_has_its_query():
    names = [n for n in queries.QUERIES]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_rows_without_own_ids_stay_and_are_redacted(spark):
    first, second = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    third = " ".join(f"c{i}" for i in range(60))
    rows = [(None, first), (None, first), (7, second), (7, third), (8, third), (9, ""), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, frame, SF).collect()]
    assert sorted(kept, key=str) == sorted([(None, first), (7, second), (7, third), (9, "")], key=str)
    texts = ["x password = hunter22 y", "login: carol key Ab1Cd2Ef3Gh4Ij5Kl6 end", "login: carol " + "x" * 300 + " Ab1Cd2Ef3Gh4Ij5Kl6"]
    clean = ["x [assign] y", "[identifier] key [opaque] end", texts[2]]
    for ids in ([None] * 3, [5] * 3):
        out = corpus_pipeline.remove_secrets(spark, spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), SF)
        assert sorted(r.text for r in out.collect()) == sorted(clean)
    for text in texts:
        frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
        base = secrets.base_spans(text)
        assert secrets.listed(secrets.linked(base, secrets.weak_parts(text, base))) == secrets.scan_secrets(frame).first().spans
