from __future__ import annotations

import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, node long, k string, sketch int, slot int, `a.b` int"


@pytest.fixture(scope="session")
def hard(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows, and columns whose names the
    operators use inside."""
    plain = "The quick brown fox jumps over the lazy dog near the old river bank while seven more words follow here"
    rows = [
        (1, plain, "en", "a", 10, 1, "x", 1, 1, 1),
        (1, plain, "en", "a", 10, 1, "x", 1, 1, 1),
        (2, plain, "en", "a", 10, 2, "x", 1, 1, 1),
        (3, plain.replace("lazy", "idle"), "en", None, None, None, None, None, None, None),
        (4, "", "en", "a", 0, 1, "x", 1, 1, 1),
        (5, None, None, None, None, None, None, None, None, None),
        (None, "a text without a key but with some words in it that nothing else has got", None, "b", 1, 1, "y", 1, 1, 1),
        (None, None, None, None, None, None, None, None, None, None),
        (6, "word " * 30_000 + "end", "en", "a", 150_003, 1, "x", 1, 1, 1),
        (7, "\n \t\n", "fr", "b", 4, 1, "x", 1, 1, 1),
        (8, "Ünïcödé — “quotes” 日本語 🙂 <|endoftext|> \x00\x1c İ K ﬁ", "de", "b", 4, 1, "x", 1, 1, 1),
        (9, "x", "de", "b", 1, 1, "x", 1, 1, 1),
    ]
    return spark.createDataFrame(rows, FIELDS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], FIELDS)
