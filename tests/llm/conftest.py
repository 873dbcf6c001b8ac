from __future__ import annotations

import pytest

ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, "one", None, "a", 3), (4, "one", None, "a", 3),
    (5, "word " * 30_000, "de", "b", 150_000), (6, "x" * 100_000, "de", "b", 100_000), (7, "naïve café — 東京 😀 ١٢٣", "fr", "b", 20), (None, "no key here", "fr", "c", 11),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, a missing key."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
