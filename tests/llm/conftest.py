import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """documents from {doc_id: text} or (doc_id, text) pairs, dealt to several partitions."""

    def build(texts, lang="en", source="s"):
        pairs = texts.items() if isinstance(texts, dict) else texts
        rows = [(i, x, lang, source, None if x is None else len(x)) for i, x in pairs]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return build


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
