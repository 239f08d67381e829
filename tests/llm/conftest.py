import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, words string, key int, score double"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text[, lang, source]) with extra columns whose names operators use inside."""

    def build(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None, 1, "w", 2, 0.5) for r in rows], SCHEMA)

    return build


EDGE = [(1, None), (2, ""), (2, ""), (None, "one two"), (5, "x" * 5000 + " " + "word " * 3000), (6, "one two")]
