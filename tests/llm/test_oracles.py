"""Operators that SQL can express, against DuckDB."""

import pytest

from panelspark.llm.queries import QUERIES, SQL
from querybook import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, name):
    con = check.duck(SF)
    got = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    want_cols, want = check._rows([d[0] for d in cur.description], cur.fetchall())
    cols, rows = check._rows(got.columns, [tuple(r) for r in got.collect()])
    assert cols == want_cols and rows == want and rows
