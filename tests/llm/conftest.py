import pytest

#: Nulls, empty and long texts, ties and repeated rows, in a table with extra columns of clashing names.
EDGES = [
    (1, ""), (2, None), (3, " "), (4, "a  b\n\n c"), (5, "the cat sat"), (5, "the cat sat"), (5, "another text"),
    (6, "naïve 😀 👍🏽 日本語　x"), (7, "word " * 30_000), (8, "a" * 5000), (9, "\t \tx \r\n y"), (None, "no id"), (10, "'s don't ▁x  <|endoftext|> </s>"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, None) for i, t in EDGES], "doc_id long, text string, ids string, part int, `n_tokens` string, base long, `a.b` int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
