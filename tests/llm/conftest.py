import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, node string, block string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents of (id, text) with columns whose names the operators use themselves."""

    def make(rows, parts=3):
        full = [(i, t, "en", "src0", len(t or ""), "b", "n", "k") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)

    return make


LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n "), (4, "a"), (5, "héllo wörld ☃ \U0001f600"), (6, LONG), (7, "same text here for two rows"), (7, "same text here for two rows"), (8, "same text here for two rows"), (None, "a row without an id"), (9, "  two  spaces \t\n\n tabs\x00 and\x1cmarks... don't 'll 123abc")]
