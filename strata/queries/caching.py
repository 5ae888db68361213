"""Queries of caches, replicated events, metrics and build events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache, metrics
from ..streaming import builds
from .registry import query


def _secs():
    return F.unix_seconds(F.col("ts").cast("timestamp"))


_SECS = "CAST(epoch(date_trunc('second', ts)) AS BIGINT)"


@query("""
    SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type""")
def last_events(t):
    return cache.last_events(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query(f"""
    WITH e AS (SELECT *, {_SECS} AS s FROM events)
    SELECT event_id, coalesce(s < lag(s) OVER (PARTITION BY user_id, event_type ORDER BY s, event_id) + 86400, FALSE) AS hit FROM e""")
def ttl_hits(t):
    return cache.hits_if_all_store(t.events.withColumn("s", _secs()), ["user_id", "event_type"], F.col("s"), 86_400, "event_id").select("event_id", "hit")


@query(f"""
    WITH RECURSIVE e AS (SELECT user_id, event_id, {_SECS} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
         f AS (SELECT user_id, event_id, n, s + 43200 AS until, FALSE AS hit FROM e WHERE n = 1
               UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.s < f.until THEN f.until ELSE e.s + 43200 END, e.s < f.until FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT event_id, hit FROM f""")
def ttl_hits_on_miss(t):
    e = t.events.select("user_id", "event_id", _secs().alias("s"))
    return cache.hits_if_misses_store(e, ["user_id"], "s", 43_200, "event_id").select("event_id", "hit")


def _cache_events(t):
    return t.events.select(
        F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("registry"), F.col("event_type").alias("repository"), F.concat(F.lit("sha256:"), F.sha2(F.col("user_id").cast("string"), 256)).alias("digest"),
        F.col("event_id").alias("ord"), _secs().alias("ts"), (F.col("value") > 30).alias("deleted"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).otherwise(-1).cast("long").alias("length"))


@query(f"""
    WITH e AS (SELECT 'r' || (user_id % 3) AS registry, event_type AS repository, 'sha256:' || sha256(CAST(user_id AS VARCHAR)) AS digest, event_id AS ord, {_SECS} AS s, value > 30 AS deleted, CASE WHEN event_id % 3 = 0 THEN event_id ELSE -1 END AS length FROM events),
         g AS (SELECT registry, repository, digest, max(ord) AS gone FROM e WHERE deleted GROUP BY ALL),
         k AS (SELECT e.* FROM e LEFT JOIN g USING (registry, repository, digest) WHERE NOT deleted AND (gone IS NULL OR ord > gone))
    SELECT registry, repository, digest, coalesce(arg_max(length, CASE WHEN length >= 0 THEN ord END), -1) AS length, max(s) + 864000 AS expires FROM k GROUP BY ALL HAVING max(s) + 864000 > 1706000000""")
def cache_state(t):
    return cache.cache_state(cache.valid_events(_cache_events(t)), F.lit(1_706_000_000), 864_000)


@query(f"""
    WITH e AS (SELECT user_id, max({_SECS}) AS last_used FROM events GROUP BY user_id), l AS (SELECT user_id, last_used FROM e WHERE last_used + 432000 > 1706500000)
    SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY last_used DESC, CAST(user_id AS VARCHAR)) AS r FROM l) WHERE r <= 20""")
def hottest_entries(t):
    e = t.events.groupBy("user_id").agg(F.max(_secs()).alias("last_used")).select("user_id", F.col("user_id").cast("string").alias("key"), "last_used", (F.col("last_used") + 432_000).alias("expires"))
    return cache.hottest(e, 20, 1, F.lit(1_706_500_000)).select("user_id")


@query("""
    WITH e AS (SELECT l_suppkey AS store, l_partkey AS key, max(l_orderkey) AS used, max(CAST(l_quantity AS BIGINT)) AS size FROM lineitem GROUP BY ALL), p AS (SELECT *, key % 20 = 0 AS pinned FROM e),
         s AS (SELECT *, sum(size) OVER (PARTITION BY store) - 5000 AS over, coalesce(sum(CASE WHEN pinned THEN 0 ELSE size END) OVER (PARTITION BY store ORDER BY used, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cold FROM p)
    SELECT store, key FROM s WHERE NOT pinned AND over > 0 AND cold < over""")
def lru_eviction(t):
    e = t.lineitem.groupBy(F.col("l_suppkey").alias("store"), F.col("l_partkey").alias("key")).agg(F.max("l_orderkey").alias("last_used"), F.max(F.col("l_quantity").cast("long")).alias("size"))
    return cache.evict(e.withColumn("pinned", F.col("key") % 20 == 0), 5000, ["store"]).select("store", "key")


@query(f"""
    WITH RECURSIVE e AS (SELECT user_id, event_id, {_SECS} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
         f AS (SELECT user_id, event_id, n, s AS began, CAST(1 AS BIGINT) AS held, CAST(0 AS BIGINT) AS batch FROM e WHERE n = 1
               UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN f.held >= 4 OR e.s > f.began + 100000 THEN e.s ELSE f.began END, CASE WHEN f.held >= 4 OR e.s > f.began + 100000 THEN 1 ELSE f.held + 1 END,
                         CASE WHEN f.held >= 4 OR e.s > f.began + 100000 THEN f.batch + 1 ELSE f.batch END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT event_id, batch FROM f""")
def event_batches(t):
    return cache.batches(t.events.select("user_id", "event_id", _secs().alias("s")), "user_id", "s", "event_id", 4, 100_000).select("event_id", "batch")


@query("""
    SELECT p_partkey AS digest, p_type AS algorithm, CAST((row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1) // 100 AS INTEGER) AS batch_no FROM part
    WHERE p_size > 5 AND greatest(p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 500 ELSE p_partkey END) <= 1500""")
def due_blobs(t):
    b = t.part.select(F.col("p_partkey").alias("digest"), F.col("p_type").alias("algorithm"), F.when(F.col("p_size") > 5, F.col("p_size")).otherwise(0).alias("size"), F.col("p_partkey").alias("last_used"))
    kept = b.where("digest % 2 = 0").select("digest", (F.col("digest") + 500).alias("kept_at"))
    return cache.due_blobs(b, kept, F.lit(2000), 500, 100).select("digest", "algorithm", "batch_no")


@query("""
    SELECT n_name AS peer, CAST(row_number() OVER (ORDER BY n_nationkey % 3 <> 0 DESC, CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey END NULLS FIRST, CASE WHEN n_nationkey % 3 <> 0 THEN -n_nationkey END NULLS FIRST, n_name) AS INTEGER) AS rank FROM nation""")
def ranked_donors(t):
    n = t.nation.select(F.col("n_name").alias("peer"), (F.col("n_nationkey") % 3 != 0).alias("ok"), F.col("n_regionkey").alias("started"), F.col("n_nationkey").alias("entries"))
    return cache.rank_donors(n).select("peer", "rank")


@query("""
    WITH x AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders)
    SELECT o_custkey, o_orderkey, o_orderstatus FROM x WHERE b IS NULL OR b <> o_orderstatus""")
def tag_changes(t):
    return cache.tag_changes(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey", "o_orderstatus")


# ---- metrics ---------------------------------------------------------------------------------------------------

_BOUNDS = "[" + ", ".join(str(float(b)) for b in metrics.SECONDS) + "]"
_SIZES = "[" + ", ".join(str(float(b)) for b in metrics.BYTES) + "]"


def _histogram(table: str, by: str, value: str, bounds: str) -> str:
    return f"""
    WITH b AS (SELECT {by}, CAST(len(list_filter({bounds}, lambda x: x < {value})) AS INTEGER) AS bucket FROM {table}), c AS (SELECT {by}, bucket, count(*) AS n FROM b GROUP BY ALL)
    SELECT {by}, bucket, CAST(({bounds})[bucket + 1] AS DOUBLE) AS upper, n, CAST(sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS BIGINT) AS cumulative FROM c"""


@query(_histogram("events", "event_type", "value", _BOUNDS))
def duration_histogram(t):
    return metrics.histogram(t.events, F.col("value"), metrics.SECONDS, ["event_type"])


@query(_histogram("documents", "lang", "n_chars", _SIZES))
def size_histogram(t):
    return metrics.histogram(t.documents, F.col("n_chars"), metrics.BYTES, ["lang"])


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY ALL")
def counters(t):
    return metrics.counter(t.lineitem, F.col("l_quantity").cast("long"), ["l_returnflag", "l_linestatus"])


@query("""
    WITH l AS (SELECT event_id, CASE WHEN user_id % 11 = 0 THEN '' ELSE 'host' || user_id END AS h FROM events), f AS (SELECT h FROM l WHERE h <> '' GROUP BY h ORDER BY min(event_id), h LIMIT 20)
    SELECT CASE WHEN h = '' THEN 'unknown' WHEN h IN (SELECT h FROM f) THEN h ELSE '_other' END AS bounded, count(*) AS n FROM l GROUP BY 1""")
def bounded_labels(t):
    e = t.events.select("event_id", F.when(F.col("user_id") % 11 == 0, "").otherwise(F.concat(F.lit("host"), F.col("user_id").cast("string"))).alias("h"))
    return metrics.bounded_labels(e, "h", "event_id", 20).groupBy("bounded").agg(F.count("*").alias("n"))


@query(f"""
    WITH s AS (SELECT event_type, {_SECS} AS a, {_SECS} + CAST(floor(value * 100) AS BIGINT) + 1 AS b FROM events), e AS (SELECT event_type, a AS t, 1 AS d FROM s UNION ALL SELECT event_type, b, -1 FROM s),
         g AS (SELECT event_type, t, d, sum(d) AS ds, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT *, sum(ds) OVER (PARTITION BY event_type ORDER BY t, d) AS open FROM g)
    SELECT event_type, CAST(sum(CASE WHEN d > 0 THEN n ELSE 0 END) AS BIGINT) AS total, CAST(max(open) AS BIGINT) AS peak, CAST(coalesce(sum(CASE WHEN d > 0 THEN greatest(0, least(n, open - 2)) END), 0) AS BIGINT) AS over_limit FROM r GROUP BY event_type""")
def pool_stats(t):
    s = t.events.select("event_type", _secs().alias("a"), (_secs() + F.floor(F.col("value") * 100) + 1).alias("b"))
    return metrics.pool_stats(s, ["event_type"], "a", "b", 2)


_OPS = "CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'cancel' ELSE 'chunk' END"


@query(f"""
    WITH s AS (SELECT user_id AS session, event_id AS ord, {_OPS} AS op, CAST(floor(value) AS BIGINT) AS bytes FROM events),
         p AS (SELECT *, CAST(coalesce(sum(CASE WHEN op <> 'chunk' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS blob FROM s)
    SELECT session, blob, CAST(sum(bytes) AS BIGINT) AS bytes FROM p GROUP BY session, blob HAVING arg_max(op, ord) = 'commit'""")
def upload_sizes(t):
    op = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "cancel").otherwise("chunk")
    return metrics.upload_sizes(t.events.select(F.col("user_id").alias("session"), F.col("event_id").alias("ord"), op.alias("op"), F.floor("value").alias("bytes")))


@query("SELECT event_type, count(*) FILTER (value > 5) AS hits, count(*) FILTER (value <= 5) AS misses FROM events GROUP BY event_type")
def cache_stats(t):
    return metrics.cache_stats(t.events.withColumn("hit", F.col("value") > 5), ["event_type"])


# ---- build events: users are streams, event types the kinds of event -------------------------------------------


def _build_events(t):
    k = F.when(F.col("event_type") == "signup", "configured").when(F.col("event_type") == "click", "named_set").when(F.col("event_type") == "purchase", "completed").otherwise("other")
    target = F.concat(F.lit("t"), (F.floor("value") % 4).cast("string"))
    return t.events.select(F.col("user_id").alias("stream"), F.col("event_id").alias("ord"), k.alias("kind"), target.alias("target"), (F.col("event_id") % 5 != 0).alias("success"), target.alias("file_set"), F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("digest"), F.when(F.col("event_id") % 6 == 0, "cc_library rule").otherwise("image_push rule").alias("rule"))


@query("""
    WITH e AS (SELECT user_id AS s, event_id AS o, CASE event_type WHEN 'signup' THEN 'configured' WHEN 'click' THEN 'named_set' WHEN 'purchase' THEN 'completed' END AS k, 't' || (CAST(floor(value) AS BIGINT) % 4) AS t FROM events)
    SELECT s AS stream, o AS ord, t AS target, (SELECT 'd' || max(n.o) FROM e n WHERE n.s = e.s AND n.t = e.t AND n.k = 'named_set' AND n.o < e.o) AS digest FROM e
    WHERE k = 'completed' AND o % 5 <> 0 AND EXISTS (SELECT 1 FROM e c WHERE c.s = e.s AND c.t = e.t AND c.k = 'configured' AND c.o < e.o AND c.o % 6 <> 0) AND EXISTS (SELECT 1 FROM e n WHERE n.s = e.s AND n.t = e.t AND n.k = 'named_set' AND n.o < e.o)""")
def build_commits(t):
    return builds.commits(_build_events(t))


@query("""
    SELECT user_id % 7 AS registry, event_type AS repository, min(event_id) AS ord FROM events GROUP BY ALL""")
def uploads_once(t):
    e = t.events.select((F.col("user_id") % 7).alias("registry"), F.col("event_type").alias("repository"), F.col("event_id").alias("ord"))
    return builds.once(e, ["registry", "repository"], "ord")
