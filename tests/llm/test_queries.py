"""Registered queries: the full set, and SQL where there is some."""
import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import fingerprint

SF = "/root/testdata/sf0.001"


def test_every_operator_and_the_pipeline_are_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op2_benchmark_decontamination", "op6_secret_scans",
                                  "op11_ranked_search", "op12_conversation_repair"])
def test_against_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    res = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert fingerprint(df.columns, [tuple(r) for r in df.collect()]) == \
        fingerprint(cols, res.fetchall())
