import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of texts, or of (doc_id, text) pairs."""

    def make(rows, source="s"):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t)) for i, t in pairs], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls, empty and repeated rows, a long text, text beyond ASCII."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return docs_of([(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, long), (None, "no id at all here"), (None, None), (6, "Ünïcödé wörds — 日本語 ▁mark 😀"), (7, "two words"), (8, long)])
