from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names the operators use inside; callers' tables may have them too.
CLASHING = "key string, size int, n long, value double, hashes string, word string, block int, held_out string, score string, slot int, bucket int"

EXTRA = ("k", 5, 6, 0.5, "h", "w", 7, "held", "s", 8, 9)


def base_rows():
    words = [f"w{i}x" for i in range(60)]
    long = " ".join(f"tok{i % 977}q{i}" for i in range(30_000))
    return [
        (1, " ".join(words), "en", "a", 0),
        (2, " ".join(words), "en", "b", 0),  # an exact copy
        (3, " ".join(words[:-2]), None, "a", 0),  # a near copy
        (4, None, "en", "a", 0),
        (5, "", None, None, 0),
        (6, "\n \t", "en", "b", 0),
        (7, "one two", "en", "b", 0),
        (8, "ONE two", "en", None, 0),
        (9, long, "de", "c", 0),
        (9, long, "de", "c", 0),  # a repeated row
        (10, "x" * 50_000, "de", "c", None),
        (None, "a row without an id and with some words in it", "en", "c", None),
        (11, "!!! 123 ...", "en", "c", None),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with everything that may go wrong, and columns whose names clash."""
    rows = [(*row, *EXTRA) for row in base_rows()]
    return spark.createDataFrame(rows, f"{SCHEMA}, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
