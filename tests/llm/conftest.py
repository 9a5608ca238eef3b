"""Documents with the odd cases that every operator must take."""

from __future__ import annotations

import random

import public_tokenizers
import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Names that operators use inside; as columns of a table they must do no harm.
CLASHING = ("size", "component", "key", "place", "a", "b", "node", "label", "score", "part", "kept", "first", "n", "digest", "h", "_gone", "_copy")


def odd_rows() -> list[tuple]:
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    line = "The quick brown fox jumps over the lazy dog again and again"
    rows = [
        (1, line, "en", "a", 1),
        (2, line, "en", "a", 1),
        (3, line + "s", "en", None, 1),
        (4, None, "en", "b", None),
        (5, "", None, "b", 0),
        (6, " \n\t \n", "de", "b", 5),
        (7, "one", "de", "b", 3),
        (8, "ONE", "de", "c", 3),
        (9, "a  b\n a\u00a0b <|endoftext|> é日本 \U0001f642", "ja", "c", 9),
        (10, long, "en", "c", len(long)),
        (11, long + " tail", "en", "a", len(long)),
        (12, line + "\n\n" + line + "\nother words follow here to the end", "en", "a", 1),
        (None, line, "en", "a", 1),
        (13, "same row", "en", "a", 1),
        (13, "same row", "en", "a", 1),
        # Several rows without an id, and rows of one id with other texts and numbers of lines.
        (None, None, None, None, None),
        (None, "second text without an id\nits own second line\n" + line + "\nits fourth line", "en", "c", 1),
        (None, "second text without an id", "en", "c", 1),
        (13, "other text of this id\nwith its own words\n" + line + "\nfour\nfive", "de", "b", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def wide(odd):
    """The odd documents with columns whose names clash."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def rng():
    return random.Random(7)
