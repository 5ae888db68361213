"""Queries over whole tables against their SQL, at a size where an id or size limit would leave rows out."""

import duckdb
import pytest

from strata import queries
from tests.test_queries import TABLES, plain

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["gc_mark", "gc_live_blobs", "gc_sweep", "image_closure", "reverse_blob_index", "layer_handling", "blobs_to_create", "image_files", "reachable_facts", "facts_to_fetch", "manifest_rewrite", "layer_diff_ids", "unused_overrides", "tar_import", "merged_operations", "tree_dedup", "repeated_paths"])
def test_whole_tables(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    sql = queries.oracle_sql()
    rows = lambda q: sorted(str([plain(x) for x in r]) for r in con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({q})").fetchall())
    want = rows(sql[name])
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == want
