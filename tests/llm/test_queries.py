import duckdb
import pytest

from sitegauge.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, name):
    got = Q.queries()[name](spark, SF)
    rows = got.collect()
    assert rows and len(set(got.columns)) == len(got.columns)
    if name in Q.oracle_sql():
        duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        want = duckdb.sql(Q.oracle_sql()[name])
        order = sorted(got.columns)
        assert sorted(want.columns) == order
        assert sorted(str([r[c] for c in order]) for r in rows) == sorted(str(list(r)) for r in want.select(", ".join(f'"{c}"' for c in order)).fetchall())
