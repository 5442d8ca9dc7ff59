import pytest

CLASHING = "row long, size long, key string, part int, blob string, node long, place string, bundle long, _w string, start long, root long, order long, digest string, shard int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text[, source]), with extra columns that operators name their own alike."""

    def make(rows):
        extra = (1, 2, "k", 3, "b", 4, "p", 5, "w", 6, 7, 8, "d", 9)
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), *extra) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")

    return make


#: Nulls, empty, white space, one word, repeats, a long word, a long text.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "Word"),
    (5, "The same text, twice.\nIn two lines."),
    (6, "The same text, twice.\nIn two lines."),
    (6, "The same text, twice.\nIn two lines."),
    (None, "No number at all é ü 漢字 🙂."),
    (8, "x" * 5000),
    (9, "many words in a long text. " * 4000),
    (10, "tab\tand  two spaces \r\n end"),
]


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def nothing(make_docs, odd):
    return odd.limit(0)
