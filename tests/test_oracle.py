"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import functools
import os

import pytest

from querybook import check, load_all

SF = os.environ.get("PANELSPARK_TEST_SF", "/root/testdata/sf0.001")
REGISTRY = load_all()
# Written lines whose order depends on the file system; their cells are compared by A12_table_lines.
WITHOUT_SQL = {"A12_table_export"}
# No row of the smallest part table passes the filter.
MAY_BE_EMPTY = {"L2_health_index"}
# The smallest tables have no state with all that the cross-section needs.
LARGER = {"L24_state_iv_suite": "/root/testdata/sf0.01"}


duck = functools.cache(check.duck)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, name):
    place = LARGER.get(name, SF)
    got = check.compare(spark, duck(place), place, name)
    if name in WITHOUT_SQL:
        assert got.startswith("rows-only"), got
    else:
        assert got.startswith("ok") or (name in MAY_BE_EMPTY and got == "EMPTY"), got


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 150
