"""Every registered query with SQL is checked against DuckDB on the supplied tables (sf0.001)."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tools.oracle_check import compare

SQL_NAMES = sorted(entry.oracle_sql())


def test_every_query_has_a_docstring_and_sql_names_exist():
    qs = entry.queries()
    assert set(SQL_NAMES) <= set(qs)
    for name, fn in qs.items():
        assert fn.__doc__, name


@pytest.mark.parametrize("name", SQL_NAMES)
def test_matches_oracle(spark, name):
    rep = compare(spark, SF_SMALL, [name], verbose=False)[name]
    assert rep.get("ok") is True, rep


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["providername", "row_cnt", "avg_los"]
    assert len(rows) > 0
