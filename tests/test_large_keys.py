"""Queries against their SQL on small tables whose keys are as large as in tables of many times the size."""

import duckdb
import pytest

from strata import queries
from tests.test_queries import SF, plain

SHIFTED = {
    "humanized_sizes": ("lineitem", "* REPLACE (l_partkey + k * 20000 AS l_partkey, l_suppkey + k * 1000 AS l_suppkey)"),
    "rfc3339_times": ("events", "* REPLACE (event_id + k * 100000 AS event_id)"),
}


@pytest.mark.parametrize("name", sorted(SHIFTED))
def test_large_keys(spark, tmp_path, name):
    table, columns = SHIFTED[name]
    con = duckdb.connect()
    con.execute(f"COPY (SELECT {columns} FROM (SELECT t.*, k FROM '{SF}/{table}.parquet' t, range(0, 60, 20) r(k))) TO '{tmp_path}/{table}.parquet'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    df = queries.queries()[name](spark, str(tmp_path))
    r = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})")
    assert sorted(str([plain(x) for x in row]) for row in df.collect()) == sorted(str([plain(x) for x in row]) for row in r.fetchall())
