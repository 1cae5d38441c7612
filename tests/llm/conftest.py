import pytest

#: Awkward texts: null, empty, blank, repeated, very long, odd characters.
TEXTS = [
    None,
    "",
    "   \n\t ",
    "one two three four five six seven",
    "one two three four five six seven",
    "One Two three four five six seven",
    "a",
    "…!? 12 %%",
    "long " * 60_000,
    "x" * 200_000,
    "naïve café au lait 漢字 \U0001f600",
    "line\r\nline\x0bline\x0cline",
    "one two three four five six seven",
]


@pytest.fixture()
def odd_docs(spark):
    """Rows with nulls in every column, ties, repeated rows, and columns that clash with inner names."""
    rows = [
        (None if i == 4 else i, t, [None, "en", "de"][i % 3], [None, "b", "a", "é"][i % 4], None, i, f"s{i}", None)
        for i, t in enumerate(TEXTS)
    ]
    rows += [rows[3], rows[4], (50, "lone text of its own here", None, None, 3, 1, "x", True)]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, fp int, body string, kept boolean",
    )


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.limit(0)
