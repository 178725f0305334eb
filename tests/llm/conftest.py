from __future__ import annotations

import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, fp string, label string, uid string, language string, _id string"


@pytest.fixture(scope="session")
def rows(sf):
    """All documents as tuples (doc_id, text, lang, source)."""
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, columns with clashing names."""
    word = "Straße über die große Brücke und weiter in das Land "
    table = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n", "en", None), (4, "the the the " * 40, "en", "a"),
        (4, "the the the " * 40, "en", "a"), (5, "the the the" * 40, None, "b"), (None, word * 3, "de", "b"), (None, None, None, None),
        (6, word * 5000, "de", "b"), (7, word * 5000 + " ", "de", None), (8, "x" * 200_000, "en", "a"), (9, "😀 été 12.3.4.5 a@b.c +1 234 567 8901", "fr", "c"),
        (10, "4111 1111 1111 1111", "en", "c"), (-3, word, "de", "Z"), (11, "ab", "en", "é"),
    ]
    return spark.createDataFrame([(*r, None, *["x"] * 7) for r in table], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
