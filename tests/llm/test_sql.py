"""Queries of text operators against their SQL, as the driver compares them."""

from __future__ import annotations

import duckdb
import pytest

from gridrank.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = QUERIES[name](spark, DATA)
    cursor = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(cursor.fetchall())
