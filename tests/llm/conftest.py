import pytest

#: Extra columns whose names the operators use themselves.
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, "
        "fp long, size long, row long, score double, length long")


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with columns of clashing names."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", 1, 7, 7, 7, 0.5, 7) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


#: Null and empty texts, white space, ties, repeated rows, a null id and a long text.
ODD = [
    (1, "the cat sat on the mat and the dog ran after it"), (2, None), (3, ""), (4, " \t\n\v\f\r "),
    (5, "the cat sat on the mat and the dog ran after it"), (5, "another text for the same id"),
    (6, "word"), (6, "word"), (None, "a text without an id"), (7, "x" * 30_000),
    (8, "ein ß 中文 \U0001f600 text\n\nwith  blanks   and <|endoftext|> in it end"),
    (9, "long text " * 20_000), (10, "12345 --- !!"), (11, "THE CAT sat\x1con the İstanbul mat"),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
