"""Every registered query with a SQL oracle equals DuckDB on the same tables (sf0.001)."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from tools.oracle_check import coarse, rows_hash

SQL = entry.oracle_sql()
QUERIES = entry.queries()


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["threat_name", "success_rate", "n"]
    assert len(rows) <= 10


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    st = {c: coarse(t) for c, t in sdf.dtypes}
    dt = {d[0]: coarse(str(d[1])) for d in res.description}
    assert st == dt
    assert len(srows) == len(drows)
    assert rows_hash(sdf.columns, srows)[0] == rows_hash(dcols, drows)[0]
