"""Queries against their SQL on the smallest tables."""

import random
from collections import Counter

import duckdb
import pytest

from strata.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = con.execute(queries.SQL[name])
    columns = sorted(d[0] for d in r.description)
    at = [[d[0] for d in r.description].index(c) for c in columns]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(str(tuple(x[c] for c in columns)) for x in df.collect()) == sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())


def test_topk_equals_sql_on_other_rows(spark, tmp_path):
    """Rows without an id are candidates, last in ties; vectors that are null or hold nulls or non-finite components aren't."""
    rng = random.Random(9)
    rows = [(rng.choice((None, 25 * i, -100)), [rng.gauss(0, 0.03) for _ in range(rng.choice((7, 8)))]) for i in range(300)]
    rows += [(rng.choice((None, 100 * i)), rng.choice(([0.5, 0.5], [0.25, 0.25]))) for i in range(40)]
    rows += [(i, None) for i in (None, 0)] + [(i, [x, 1.0]) for i in (None, 0, 3) for x in (None, float("nan"), float("inf"))]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = Counter(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({queries.SQL['op9_topk']})").fetchall())
    assert any(r[2] is None for r in want)
    assert Counter(map(tuple, queries.QUERIES["op9_topk"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())) == want
