"""Every registered query runs at sf0.001; those with SQL give the SQL's rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from tools.check_oracles import compare, duck

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toArrow()
    if name not in ORACLES:
        assert got.num_rows > 0
        return
    assert compare(got, con.sql(ORACLES[name]).to_arrow_table()) is None


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert {r["split"] for r in rows} == {"train", "val", "test"}
    assert sum(r["n"] for r in rows) == 6000


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
