"""The queries of this subpackage that SQL can express, against DuckDB on the same tables."""

import os

import duckdb
import pytest

from nearfold.llm import queries


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query(spark, small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    a, b = queries.queries()[name](spark, small).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b) > 0
    key = next(k for k in ("vec_id", "doc_id", "word") if k in cols)
    a, b = (x[cols].sort_values(key).reset_index(drop=True) for x in (a, b))
    assert all(((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all() for c in cols)
