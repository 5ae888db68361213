"""Streams against their batch forms: the same rows in several micro-batches."""

import pytest

from strata.operators import cache, metrics
from strata.streaming import builds

KINDS = ["configured", "named_set", "completed", "completed", "other"]


@pytest.fixture(scope="module")
def events(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.randrange(4), i, rng.choice(KINDS), f"t{rng.randrange(3)}", rng.random() < 0.8, f"t{rng.randrange(3)}", f"d{i}", builds.PUSH_RULE if rng.random() < 0.7 else "cc_library rule") for i in range(400)]
    return spark.createDataFrame(rows, builds.EVENTS)


def stream(spark, df, tmp_path, order, parts=5):
    """df as a stream of files, in order."""
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def collect(spark, df, tmp_path, name):
    q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.schema(df.schema).parquet(f"{tmp_path}/out").collect()


def test_commits(spark, events, tmp_path):
    want = {tuple(r) for r in builds.commits(events).collect()}
    got = collect(spark, builds.commits_stream(stream(spark, events, tmp_path, "ord")), tmp_path, "commits")
    assert want and {tuple(r) for r in got} == want


def test_upload_sizes(spark, tmp_path):
    rows = [(i % 3, i, ("chunk", "chunk", "commit", "chunk", "cancel")[i * 7 % 5], i) for i in range(120)]
    df = spark.createDataFrame(rows, "session long, ord long, op string, bytes long")
    want = {tuple(r) for r in metrics.upload_sizes(df).collect()}
    got = collect(spark, builds.upload_sizes_stream(stream(spark, df, tmp_path, "ord")), tmp_path, "sizes")
    assert want and {tuple(r) for r in got} == want


def test_ttl(spark, tmp_path):
    rows = [(f"k{i % 5}", i, i * 3, False) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, ord long, ts long, deleted boolean")
    want = {(r["key"], r["ord"], r["hit"]) for r in cache.hits_if_misses_store(df, ["key"], "ts", 40, "ord").collect()}
    got = collect(spark, builds.ttl_hits_stream(stream(spark, df, tmp_path, "ord"), 40), tmp_path, "ttl")
    assert {tuple(r) for r in got} == want and {True, False} == {h for *_, h in want}


def test_flush(spark, events, tmp_path):
    seen = []
    q = builds.flush_batches(stream(spark, events, tmp_path, "ord").select("stream", "target", "ord", "kind"), ["stream", "target"], "ord", lambda df, n: seen.append((n, df.count(), df.groupBy("stream", "target").count().where("count > 1").count())), f"{tmp_path}/check")
    q.awaitTermination(120)
    assert len(seen) == 5 and all(n > 0 and twice == 0 for _, n, twice in seen)


def test_push_before_tag(spark, events, tmp_path):
    done = []
    q = builds.push_then_tag(stream(spark, events, tmp_path, "ord"), lambda df, n: done.append(("push", n, df.count())), lambda df, n: done.append(("tag", n, df.count())), f"{tmp_path}/check")
    q.awaitTermination(120)
    assert [d[0] for d in done] == ["push", "tag"] * 5
