import pytest

MESSY = (
    "doc_id long, text string, source string, key string, text_key string, host string, fingerprint int, component int,"
    " start int, piece int, base string, spans string, leaks string, _k int, _removed int, `a.b` string, m map<string,int>"
)


def messy_rows():
    prose = " ".join(f"word{i % 97} and thing{i % 89}" for i in range(60))
    rows = [
        (1, prose),
        (1, prose),  # a repeated row
        (1, prose + " another text"),  # the same key again
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (None, prose + " of nobody, " + "x y z " * 30),
        (None, None),
        (5, "long " * 40_000),  # one word over and over
        (6, "x" * 200_000),  # one word
        (7, "mail me@x.org, token = abcdefghijkl, +1 (212) 555-1234"),
        (8, "Ünïcødé 日本語 😀 " * 20),
        (9, "\n".join(["same line of text"] * 40)),
        (10, "a\x00b <|endoftext|> <s> ▁"),
    ]
    return [
        (key, text, None if key == 2 else "s", "k", "t", "h", 1, None, 3, 4, "b", "sp", "l", 5, 6, "dot", {"a": 1})
        for key, text in rows
    ]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), MESSY).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], MESSY)
