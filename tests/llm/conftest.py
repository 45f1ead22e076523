import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, row string, key string"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of (doc_id, text[, lang]) with extra columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), 7, "r", "k") for r in rows], DOCS)

    return make


#: Nulls in every column, empty, blank and repeated texts, a repeated id, a long text, letters outside ASCII and the BMP.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t\n "),
    (4, "The same line of words here.\nAnother line that is long enough.\nend"),
    (5, "The same line of words here.\nAnother line that is long enough.\nend"),
    (5, "The same line of words here.\nAnother line that is long enough.\nend"),
    (6, "  THE SAME line of words here. \nÉtude ÉTUDE élan über naïve çà 日本語 テキスト \U0001f600 ok\n\n"),
    (7, "word " * 5000),
    (None, "The same line of words here.\nOnly this row has no id."),
    (8, None, None),
    (9, "x"),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
