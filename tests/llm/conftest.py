"""Odd rows that every operator must take, and the small tables."""

import duckdb
import pytest

from tests.conftest import SF_DIR, spark  # noqa: F401

CLASH = ("row", "key", "rid", "id", "text_key", "print", "chunk", "spans", "removed_runs", "lang_pred", "tokens", "words", "part")
LONG = "Thin erand of the ouble. " * 9000
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "..."), (5, "word"), (6, LONG), (None, "an id that is null"), (None, None),
    (7, "twice the same row"), (7, "twice the same row"), (8, "ünïcödé Straße 漢字 \U0001f600 x"), (9, "a\nb\n\nc\n"), (10, "twice the same row"),
]


@pytest.fixture(scope="session")
def odd(spark):  # noqa: F811
    """Nulls, empty and long texts, repeated rows and columns with the names that operators use inside."""
    schema = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, " + ", ".join(f"{c} STRING" for c in CLASH)
    rows = [(i, t, None if i == 5 else "en", None, None if t is None else len(t), *["x"] * len(CLASH)) for i, t in ODD]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def texts():
    """doc_id -> text of the small table."""
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet' ORDER BY doc_id").fetchall())


@pytest.fixture(scope="session")
def languages():
    return dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF_DIR}/documents.parquet'").fetchall())


@pytest.fixture(scope="session")
def items():
    return dict(duckdb.sql(f"SELECT item_id, text FROM '{SF_DIR}/benchmark.parquet' ORDER BY item_id").fetchall())


@pytest.fixture(scope="session")
def result(spark):  # noqa: F811
    """result(name): the rows of a query over the small tables, run once."""
    from titleloom.llm.queries import QUERIES

    held = {}

    def run(name):
        if name not in held:
            held[name] = QUERIES[name](spark, SF_DIR).collect()
        return held[name]

    return run
