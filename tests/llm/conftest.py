import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in all columns, empty and long texts, repeated rows and columns whose names the operators use inside."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(1, "alpha beta gamma delta", "en", None), (1, "alpha beta gamma delta", "en", None), (2, "", "fr", 1.0), (3, None, None, 2.0), (None, "omega psi chi", "de", None), (None, None, None, None), (4, long, "en", 0.0), (5, " \n\t ", None, 0.5), (6, "12345 ?!", "es", 0.1)]
    return spark.createDataFrame([(d, t, lang, s, 7, "x", d, 3, "k", None) for d, t, lang, s in rows], "doc_id long, text string, lang string, score double, rank int, key string, component_id long, found int, fp string, toxic int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
