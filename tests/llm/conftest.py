import pytest

ODD_TEXTS = [None, "", " \n\t ", "a", "one two three four", "x" * 50_000, "wort " * 20_000, "é日本\U0001f642 \x00 z\x0b"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, and extra columns with clashing names."""
    rows = [(k, t, None, None if k % 3 == 0 else f"s{k % 2}", None, k, "x", 1.0) for k, t in enumerate(ODD_TEXTS)]
    rows += [(1, "", None, None, None, 1, "x", 1.0), (None, "null id text here now", "en", "s1", 3, 1, "y", 2.0),
             (20, "same words in a text " * 3, "en", "s0", 5, 1, "z", 0.0), (21, "same words in a text " * 3, "en", "s0", 5, 2, "z", 0.0)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, size long, ids string, base double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
