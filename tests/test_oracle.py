"""Every registered query against DuckDB, or at least for its rows."""

import oracle
import pytest

import __spark_entry__ as entry
import catalogue

QUERIES, SQL = catalogue.QUERIES, catalogue.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    found = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert oracle.compare(found, duck, SQL[name]) is None
    else:
        assert found.count() > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [r["column"] for r in rows] == ["value"] and rows[0]["outlier_count"] > 0
