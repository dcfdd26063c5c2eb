"""Registered text queries against their SQL on the smallest tables."""

import duckdb
import pytest

from arborgrid.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    a, b = queries.QUERIES[name](spark, SF).toArrow(), con.sql(queries.ORACLES[name]).to_arrow_table()
    assert sorted(a.schema.names) == sorted(b.schema.names)
    rows = lambda t: sorted(map(repr, zip(*[t.column(c).to_pylist() for c in sorted(t.schema.names)], strict=True)))
    assert rows(a) == rows(b)
