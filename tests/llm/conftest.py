from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

#: Cases that every operator on documents takes: nulls in any column, empty, white and long texts, ties, repeated rows.
ODD = [
    (1, "the cat sat on the mat and looked at the other cat. " * 3, "en", "a", 1),
    (2, "the cat sat on the mat and looked at the other cat. " * 3, "en", "a", 1),
    (2, "the cat sat on the mat and looked at the other cat. " * 3, "en", "a", 1),
    (None, "the cat sat on the mat and looked at the other cat. " * 3, None, None, None),
    (None, None, None, None, None),
    (3, None, "en", "b", 2),
    (4, "", "en", None, 2),
    (5, " \n\t ", "en", "b", 2),
    (6, "one two", "en", "c", 3),
    (7, "Ärger über Öl \U0001f642 日本語 \x00 \x1c x", "de", "c", 3),
    (8, "lorem ipsum dolor sit amet " * 4000, "la", "d", 4),
    (9, "x" * 30_000, "xx", "d", 4),
    (10, "the cat sat on the mat and looked at the other cat. " * 3 + "END", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    """Rows of the documents table, read outside Spark."""
    import pandas as pd

    return pd.read_parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def result(spark, sf):
    """The rows of a registered query, computed once."""
    from driftmeter.llm import queries

    done = {}

    def of(name):
        if name not in done:
            done[name] = queries.QUERIES[name](spark, sf).toPandas()
        return done[name]

    return of
