import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and odd texts, ties and repeated rows, and extra columns with the operators' own names."""
    text = "Plain words of a text that is long enough to be cut into several shingles and windows, once and again."
    rows = [(1, text, "en"), (2, text, "en"), (2, text, "en"), (None, text, None), (None, None, "en"), (3, None, None), (4, "", "fr"),
            (5, "  \n ", None), (6, "été 日本語 \U0001f600", "fr"), (7, "... !!! 123", "de"), (8, "one", "de"),
            (9, "a long word " + "x" * 30000, "en"), (10, "le la les une des " * 900, "fr")]
    names = ["key", "kept", "h", "k", "label", "chunk", "score", "lang_pred", "ids", "m", "n", "a", "t", "node", "url_extra"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, None, None, *["z"] * len(names)) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
