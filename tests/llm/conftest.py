import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, node string"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with columns whose names clash with inner ones."""
    def make(rows):
        return spark.createDataFrame([(*r, *(None, None)[len(r) - 2:], 0, "x", "y") for r in rows], DOCS)
    return make


@pytest.fixture
def odd_docs(make_docs):
    """Nulls, empty and repeated rows, repeated ids, one long text."""
    long_text = " ".join(f"w{i % 5000}" for i in range(60_000))
    return make_docs([
        (1, None, "en", "a"), (2, "", None, None), (None, "alpha beta gamma delta epsilon zeta", "en", "a"),
        (3, "alpha beta gamma delta epsilon zeta", "en", None), (3, "alpha beta gamma delta epsilon zeta", "en", None),
        (4, long_text, "en", "b"), (5, "   \n\t\n ", "de", "b"), (6, "one", "en", "a"), (6, "two", "en", "a"),
    ])
