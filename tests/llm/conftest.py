import pytest

from pagelake.llm.common import with_package


@pytest.fixture(scope="session")
def llm(spark):
    """The session, its Python workers able to import the package."""
    return with_package(spark)


@pytest.fixture(scope="session")
def odd_documents(llm):
    """Nulls, empty and long texts, repeated rows, extra columns with clashing names."""
    rows = [
        (5, "one two three four five six seven", "en", "a", 1, "x"),
        (3, "one two three four five six seven", "en", "a", 1, "x"),
        (7, "ONE two three\tfour\nfive six seven", None, None, None, None),
        (9, None, "en", "a", 1, "x"),
        (8, "", "en", "a", 1, "x"),
        (8, "", "en", "a", 1, "x"),
        (None, "a word", "en", "a", 1, "x"),
        (11, "word " * 50_000, "en", "a", 1, "x"),
        (12, "x" * 100_000, "en", "a", 1, "x"),
        (13, "é ß 中文 😀  two  blanks   \x1c odd", "en", "a", 1, "x"),
        (14, "\n\t \r", "en", "a", 1, "x"),
    ]
    return llm.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score string"
    ).withColumnRenamed("lang", "row").withColumnRenamed("source", "node")
