from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrame

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_fixtures import SCHEMA, frame, prose  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark) -> DataFrame:
    """Nulls in every column, empty and very long texts, repeated rows and ids, line ends, no letters, non-Latin letters."""
    long_text = prose(1, 30_000)
    same = ("same line\n" * 3 + prose(2, 300), "en", "a")
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, long_text, "en", "b"), (4, long_text + " tail", None, "b"), (5, "12345 !!! ---", "de", None), (None, "a text without an id", "en", "c"), (None, None, None, None),
        (6, "\n\n\n", "fr", "c"), (7, "Σίσυφος ΟΔΟΣ İstanbul 日本語 😀😀 naïve", "es", "d"), (8, "tab\tand\x0bfeed\x0c \r\n CRLF\r\n", "en", "d"), (9, same[0], *same[1:]), (9, same[0], *same[1:]), (10, same[0], *same[1:]), (11, "don't can't o'clock <|endoftext|> it's", "en", "a"),
    ]
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def none(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
