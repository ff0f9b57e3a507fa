import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def documents(spark):
    """Build documents from (doc_id, text[, source]) rows."""
    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return build


LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(15_000))
EDGE_ROWS = [(1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "one", None), (5, LONG, "b"), (5, LONG, "b"), (None, "no id here", "b"),
             (7, "same words in both of these texts", "a"), (8, "same words in both of these texts", "b")]


@pytest.fixture(scope="session")
def edge_documents(spark, documents):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns whose names operators use inside."""
    from pyspark.sql import functions as F

    clash = ["score", "_text", "_size", "size", "ids", "document", "keys", "block", "_row", "_bucket", "letters"]
    return documents(EDGE_ROWS).withColumns({c: F.lit(f"own {c}") for c in clash})
