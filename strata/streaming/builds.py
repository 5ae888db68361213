"""Build events: which completed push targets are committed, as a batch and as a stream, and other stateful operators.

A stream's events are ordered. A target is tracked when its configuration names a push rule; a completion before that is
ignored. A successful completion of a tracked target commits the one file of its named set.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PUSH_RULE = "image_push rule"
EVENTS = "stream long, ord long, kind string, target string, success boolean, file_set string, digest string, rule string"
COMMITS = "stream long, ord long, target string, digest string"


def commits(events: DataFrame) -> DataFrame:
    """(stream, ord, target, digest) of events(stream, ord, kind, target, success, file_set, digest, rule), by running aggregates over each target's events."""
    w = Window.partitionBy("stream", "target").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    tracked = F.max(F.when((F.col("kind") == "configured") & (F.col("rule") == PUSH_RULE), True)).over(w)
    # the set a completion names is the last of that name before it
    named = F.last(F.when(F.col("kind") == "named_set", F.col("digest")), ignorenulls=True).over(Window.partitionBy("stream", "file_set").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    done = events.withColumn("_t", tracked).withColumn("_d", named).where("kind = 'completed' and success and _t and _d is not null")
    return done.select("stream", "ord", "target", F.col("_d").alias("digest"))


def once(requests: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first request of each key: an upload that another has done or is doing is not done again."""
    return requests.groupBy(*keys).agg(F.min(order).alias(order))


def _track(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    tracked, sets = (set(x) if i == 0 else dict(zip(*x)) for i, x in enumerate((state.get[0], state.get[1:]))) if state.exists else (set(), {})
    out = []
    for e in pd.concat(list(parts)).sort_values("ord").itertuples():
        if e.kind == "configured" and e.rule == PUSH_RULE:
            tracked.add(e.target)
        elif e.kind == "named_set":
            sets[e.file_set] = e.digest
        elif e.kind == "completed" and e.success and e.target in tracked and e.file_set in sets:
            out.append((key[0], e.ord, e.target, sets[e.file_set]))
    state.update((sorted(tracked), list(sets), list(sets.values())))
    yield pd.DataFrame(out, columns=["stream", "ord", "target", "digest"])


def commits_stream(events: DataFrame) -> DataFrame:
    """commits over a streaming table: the tracked targets and named sets of each stream are its state."""
    return events.groupBy("stream").applyInPandasWithState(_track, COMMITS, "tracked array<string>, sets array<string>, digests array<string>", "append", GroupStateTimeout.NoTimeout)


def _sizes(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, blob = state.get if state.exists else (0, 0)
    out = []
    for s in pd.concat(list(parts)).sort_values("ord").itertuples():
        held += int(s.bytes)
        if s.op in ("commit", "cancel"):
            if s.op == "commit":
                out.append((key[0], blob, held))
            held, blob = 0, blob + 1
    state.update((held, blob))
    yield pd.DataFrame(out, columns=["session", "blob", "bytes"])


def upload_sizes_stream(steps: DataFrame) -> DataFrame:
    """(session, blob, bytes) of streaming steps(session, ord, op, bytes): bytes add up until a commit, which emits them, or a cancel, which forgets them."""
    return steps.groupBy("session").applyInPandasWithState(_sizes, "session long, blob long, bytes long", "held long, blob long", "append", GroupStateTimeout.NoTimeout)


def _ttl(ttl: int):
    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else None
        out = []
        for e in pd.concat(list(parts)).sort_values(["ts", "ord"]).itertuples():
            if e.deleted:
                until = None
                continue
            hit = until is not None and e.ts < until
            out.append((key[0], e.ord, hit))
            if not hit:
                until = e.ts + ttl
        if until is None:
            if state.exists:
                state.remove()
        else:
            state.update((until,))
        yield pd.DataFrame(out, columns=["key", "ord", "hit"])

    return run


def ttl_hits_stream(access: DataFrame, ttl: int) -> DataFrame:
    """(key, ord, hit) of streaming access(key, ord, ts, deleted): a miss stores for ttl seconds, a hit doesn't extend, a deletion forgets."""
    return access.groupBy("key").applyInPandasWithState(_ttl(ttl), "key string, ord long, hit boolean", "until long", "append", GroupStateTimeout.NoTimeout)


def flush_batches(events: DataFrame, keys: list[str], order: str, sink, checkpoint: str):
    """Each micro-batch, reduced to the last event of each key, goes to sink(DataFrame, batch id): a streaming query that runs until its input is used up."""
    from ..operators.cache import last_events

    def flush(batch: DataFrame, n: int):
        sink(last_events(batch, keys, order), n)

    return events.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def push_then_tag(pushes: DataFrame, push, tag, checkpoint: str):
    """Commits of each micro-batch: all blobs are pushed before any tag is set."""
    def commit(batch: DataFrame, n: int):
        batch.persist()
        try:
            push(batch, n)
            tag(batch, n)
        finally:
            batch.unpersist()

    return pushes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
