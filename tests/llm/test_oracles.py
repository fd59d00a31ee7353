"""Queries with an oracle against it."""

import duckdb
import pytest

from tests.conftest import SF_DIR
from tests.test_queries import canonical
from titleloom.llm.queries import ORACLES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_oracle(result, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    rows = result(name)
    assert sorted(rows[0].asDict()) == sorted(columns)
    assert canonical([tuple(r[c] for c in columns) for r in rows]) == canonical(found.fetchall())
