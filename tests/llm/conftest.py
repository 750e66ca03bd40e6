import pytest

#: Texts that every text operator has to stand, by id; ids repeat and may be null.
CASES = [
    (1, "The quick brown fox jumps over the lazy dog. " * 3),
    (1, "The quick brown fox jumps over the lazy dog. " * 3),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "one"),
    (None, "one"),
    (6, "Ünïcödé 測試 text with a tab\tand \x1c separator  and runs \n\n\n of space. "),
    (7, " ".join(f"word{k % 977}" for k in range(30_000))),
    (8, "x" * 50_000),
    (9, "1 2 3 4 5 6 7 8 9 " * 3000),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, with further columns named like those the operators make."""
    rows = [(i, t, "en", "s", 1, 0.5, "n", 7) for i, t in CASES]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node string, h bigint")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
