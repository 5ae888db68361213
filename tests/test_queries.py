"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from strata import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v if isinstance(v, bool) or v is None else str(v)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    r = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = sorted(str([plain(x[names.index(c)]) for c in columns]) for x in r.fetchall())
    assert rows == want
    kinds = {d[0]: str(d[1]) for d in r.description}
    assert {c: kinds[c] for c, k in df.dtypes if k in TYPES} == {c: TYPES[k] for c, k in df.dtypes if k in TYPES}


def test_every_query_has_rows(spark):
    few = [n for n, q in queries.queries().items() if n in ("gc_mark", "push_plan", "overlay_merge", "facts_to_fetch") and q(spark, SF).isEmpty()]
    assert not few


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_the_rest_works_without_the_training_data_part(tmp_path):
    """Without llm and corpus_pipeline.py the entry still imports and has the other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/strata", tmp_path / "strata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100 and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
