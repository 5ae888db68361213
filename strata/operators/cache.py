"""Existence caches and retention: time-to-live hits, replicated events, hottest entries, eviction, keep-alive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DIGEST
from .dedup import running_offsets

MAX_SNAPSHOT = 65_536


def last_events(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last event of each key. An aggregate, not a window: map tasks keep one row a key."""
    rest = [c for c in events.columns if c not in keys and c != order]
    return events.groupBy(*keys).agg(F.max(F.col(order)).alias("_o"), F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, F.col("_o").alias(order), "_r.*")


def hits_if_all_store(access: DataFrame, keys: list[str], time: Column, ttl: int, order: str) -> DataFrame:
    """access with hit, where every access stores: the one before is less than ttl seconds ago."""
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(time, order))
    return access.withColumn("hit", F.coalesce(time < before + ttl, F.lit(False)))


def hits_if_misses_store(access: DataFrame, keys: list[str], time: str, ttl: int, order: str) -> DataFrame:
    """access(keys, time in seconds, order) with hit, where only a miss stores: a hit doesn't extend the deadline, so the deadlines of a key are a fold over its accesses."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in access.schema.fields) + ", hit boolean"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, until, hit = pdf.sort_values([time, order]), None, []
        for t in pdf[time]:
            hit.append(until is not None and t < until)
            if not hit[-1]:
                until = t + ttl
        return pdf.assign(hit=hit)

    return access.groupBy(*keys).applyInPandas(fold, schema)


def cache_state(events: DataFrame, now: Column, ttl: int) -> DataFrame:
    """Live entries (registry, repository, digest, length, expires) after events(registry, repository, digest, ord, ts, deleted, length): an unknown length (-1) never overwrites a known one, a deletion forgets it."""
    keys = ["registry", "repository", "digest"]
    gone = events.where("deleted").groupBy(*keys).agg(F.max("ord").alias("gone"))
    kept = events.where("not deleted").join(gone, keys, "left").where("gone is null or ord > gone")
    state = kept.groupBy(*keys).agg(F.max("ts").alias("stored"), F.coalesce(F.max_by("length", F.when(F.col("length") >= 0, F.col("ord"))), F.lit(-1).cast("long")).alias("length"))
    return state.withColumn("expires", F.col("stored") + ttl).where(F.col("expires") > now).drop("stored")


def valid_events(events: DataFrame) -> DataFrame:
    """Events of a peer that can be applied: all names given, and a digest that is one."""
    return events.where((F.col("registry") != "") & (F.col("repository") != "") & F.col("digest").rlike(DIGEST))


def hottest(entries: DataFrame, limit: int, shards: int, now: Column) -> DataFrame:
    """Up to limit live entries(key, last_used, expires): from each shard its most recently used, an equal share, shards in order."""
    limit = min(limit, MAX_SNAPSHOT)
    share = -(-limit // shards)
    live = entries.where(F.col("expires") > now).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    ranked = live.withColumn("rank", F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("last_used"), "key"))).where(F.col("rank") <= share)
    return ranked.orderBy("shard", "rank").limit(limit)


def evict(entries: DataFrame, budget: int, group: list[str], size: str = "size", last_used: str = "last_used", tie: str = "key") -> DataFrame:
    """Entries that go, from the least recently used on, until the rest of a group fits the budget; entries in use (pinned) are passed over."""
    w = Window.partitionBy(*group)
    over = F.sum(size).over(w) - budget
    cold = F.coalesce(F.sum(F.when(~F.col("pinned"), F.col(size))).over(w.orderBy(last_used, tie).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return entries.withColumn("_go", ~F.col("pinned") & (over > 0) & (cold < over)).where("_go").drop("_go")


def batches(events: DataFrame, by: str, time: str, order: str, size: int, delay: float) -> DataFrame:
    """events with batch: a new one begins when the last has size events or its first is more than delay old. Where one ends depends on where it began, so it is a fold over each source's events."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields) + ", batch long"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, n, began, held = pdf.sort_values([time, order]), [], -1, None, 0
        for t in pdf[time]:
            if began is None or held >= size or t > began + delay:
                n, began, held = n + 1, t, 0
            held += 1
            out.append(n)
        return pdf.assign(batch=out)

    return events.groupBy(by).applyInPandas(fold, schema)


def due_blobs(blobs: DataFrame, kept: DataFrame, now: Column, age: int, batch: int) -> DataFrame:
    """(algorithm, digest, size, batch_no): live blobs(digest, algorithm, size, last_used) of known size, neither used nor refreshed for age seconds, in batches of one algorithm."""
    j = blobs.where("size > 0").join(kept.select("digest", "kept_at"), "digest", "left")
    due = j.where(F.greatest("last_used", F.coalesce("kept_at", "last_used")) <= now - age)
    # there are few algorithms: the place among all rows, by ranges of algorithm and digest, less that of the algorithm's first row
    placed = running_offsets(due.select("algorithm", "digest", "size"), ["algorithm", "digest"], F.lit(1))
    first = placed.groupBy(F.col("algorithm").alias("_a")).agg(F.min("offset").alias("_first"))
    n = F.col("offset") - F.col("_first")
    return placed.join(F.broadcast(first), F.col("algorithm").eqNullSafe(F.col("_a"))).select("algorithm", "digest", "size", F.floor(n / batch).cast("int").alias("batch_no"))


def rank_donors(peers: DataFrame) -> DataFrame:
    """peers(peer, ok, started, entries) with rank: those that answered first, of these the oldest, of these the fullest."""
    # a peer list is a handful of rows by its nature
    w = Window.orderBy(F.desc("ok"), F.when(F.col("ok"), F.col("started")), F.when(F.col("ok"), -F.col("entries")), "peer")
    return peers.withColumn("rank", F.row_number().over(w))


def tag_changes(tags: DataFrame, keys: list[str], order: str, digest: str = "digest") -> DataFrame:
    """Rows where a tag comes to point at another digest than before."""
    before = F.lag(digest).over(Window.partitionBy(*keys).orderBy(order))
    return tags.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(digest))).drop("_b")
