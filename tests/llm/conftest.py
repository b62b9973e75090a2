import pytest

LOREM = "the quick brown fox jumps over the lazy dog while seven wizards quietly box with grumpy dwarves near the old stone bridge at dawn and nobody ever asks why they keep doing this every single morning of the year"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns
    whose names clash with those the operators use."""
    long = " ".join(f"w{i % 977} of{i % 13}" for i in range(30_000))
    rows = [
        (1, LOREM, "en"), (2, LOREM, "en"), (2, LOREM, "en"), (3, None, None), (4, "", "en"), (None, "lost id text here", None), (5, long, "xx"), (6, "one", "de"),
        (7, "ÉTÉ À LA PLAGE <|endoftext|> ok\u00a0nbsp\x1fsep", "fr"), (8, "a a a a a a a a", "en"), (9, LOREM.upper(), "en"), (None, None, None),
    ]
    df = spark.createDataFrame([(i, t, g, "s", 0, 0, "x", 7, "h", 1.0) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, _h int, words string, k0 long, start string, n double")
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
