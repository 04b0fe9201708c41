import pytest

pytest.importorskip("glyphmill.llm")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, None, None, None), (2, "", "en", "s"), (3, "  \n\t ", None, "s"), (4, "one two", "en", None), (5, "long word " * 20000, "en", "s"),
        (6, "the same text of some six words", "en", "s"), (6, "the same text of some six words", "en", "s"), (None, "a row without an id of its own", "de", "s"), (7, "12 34 !!", "en", "s"),
    ]
    df = spark.createDataFrame([(*r, 0, "x", "y", 1.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string, leaks string, score double")
    return df.withColumns({c: df["ids"] for c in ("decoded", "n_tokens", "lang_pred", "base_spans", "all_spans", "licences", "sentence_ids")})
