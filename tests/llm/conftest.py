import pytest

#: Rows that every operator has to take: nulls, empty and blank texts, one word, repeated rows, a very long text.
ODD = [
    (1, ""), (2, None), (3, "   \n\t "), (4, "word"), (4, "word"), (None, "no id here"), (None, None),
    (5, "é" * 50 + " 𝒳𝒴 ünï   x"), (6, "long words here " * 20_000), (7, "a" * 100_000), (8, "same text twice over"), (9, "same text twice over"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names operators use themselves."""
    rows = [(i, t, "xx", 0.5, 7, "x") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, score double, n_words int, _group string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
