import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table from (doc_id, text) pairs, with columns that clash with the operators' own."""

    def build(rows, lang="en"):
        schema = DOCUMENTS + ", row string, fp string, edge string, words string, part string"
        filled = [(i, t, lang, None, None if t is None else len(t), "r", "f", "e", "w", "p") for i, t in rows]
        return spark.createDataFrame(filled, schema)

    return build
