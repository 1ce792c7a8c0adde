import datetime as dt
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from sitegauge.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return str(v.replace(tzinfo=None)) if isinstance(v, dt.datetime) else str(v) if isinstance(v, (dt.date, int)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_against_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in plans.SQL:
        assert rows
        return
    want = duck.sql(plans.SQL[name])
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    place = [want.columns.index(c) for c in order]
    assert sorted(str([plain(r[c]) for c in order]) for r in rows) == sorted(str([plain(r[i]) for i in place]) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_company_queries_read_all_customers(spark, duck):
    """A row for each customer, number 0 or not; and leads whose companies are missing from customer."""
    customers = duck.sql("SELECT count(*) FROM customer").fetchall()[0][0]
    assert plans.QUERIES["registry_companies"](spark, SF).count() == customers
    linked = {r.company_id for r in plans.QUERIES["linked_companies"](spark, SF).collect()}
    want = {r[0] for r in duck.sql("SELECT o_custkey FROM orders UNION SELECT p_partkey FROM part").fetchall()}
    assert linked == want and want - {r[0] for r in duck.sql("SELECT c_custkey FROM customer").fetchall()}
