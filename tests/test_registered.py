"""Every registered query against its DuckDB text on the smallest tables."""

import __spark_entry__ as entry
import pytest

from checks.compare import difference
from tests.conftest import SMALL

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert len(got) > 0
    assert difference(got, duck.execute(ORACLE[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_model_queries_have_rows(spark, name):
    frame = QUERIES[name](spark, SMALL)
    rows = frame.collect()
    assert rows and len(set(frame.columns)) == len(frame.columns)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
