"""The queries that SQL can express, against their SQL over whole tables."""

from __future__ import annotations

import duckdb
import pytest

from lodegraph.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rows = lambda t: (sorted(t.column_names), sorted((tuple(r[c] for c in sorted(t.column_names)) for r in t.to_pylist()), key=repr))
    assert rows(queries.QUERIES[name](spark, sf_dir).toArrow()) == rows(con.execute(queries.SQL[name]).to_arrow_table())
