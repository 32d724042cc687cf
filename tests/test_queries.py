import math
from pathlib import Path

import duckdb
import pytest

from braidwin import queries

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(value):
    return round(value, 9) if isinstance(value, float) and not math.isnan(value) else value


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ALL))
def test_query_equals_its_sql(spark, con, name):
    query, sql = queries.ALL[name]
    df = query(spark, str(DATA))
    rows = df.collect()
    if sql is None:
        assert rows
        return
    result = con.sql(sql)
    at = {c: i for i, c in enumerate(result.columns)}
    columns = sorted(df.columns)
    assert sorted(at) == columns
    assert sorted(repr([plain(r[c]) for c in columns]) for r in rows) == sorted(repr([plain(r[at[c]]) for c in columns]) for r in result.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_flagship(spark):
    assert queries.flagship(spark, str(DATA)).count() == 386


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(queries.queries()) <= set(entry.queries()) and set(queries.oracle_sql()) <= set(entry.oracle_sql())
