"""Traffic metrics: histograms with fixed boundaries, counters by attributes, bounded labels, pool statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Boundaries of the duration (seconds) and size (bytes) histograms; a bucket includes its upper boundary.
SECONDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1, 2.5, 5, 7.5, 10, 30, 60, 300, 900]
BYTES = [1 << 10, 1 << 13, 1 << 16, 1 << 18, 1 << 20, 1 << 22, 1 << 24, 1 << 26, 1 << 28, 1 << 30, 1 << 32, 1 << 34]
MAX_LABELS = 128


def bucket(value: Column, bounds: list[float]) -> Column:
    """Number of the first boundary that is not below the value; len(bounds) beyond the last."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < value.cast("double")))


def histogram(df: DataFrame, value: Column, bounds: list[float], by: list[str] = ()) -> DataFrame:
    """(by, bucket, upper, n, cumulative) with a row for each bucket that has values."""
    counts = df.groupBy(*by, bucket(value, bounds).alias("bucket")).agg(F.count("*").alias("n"))
    upper = F.try_element_at(F.array(*[F.lit(float(b)) for b in bounds]), F.col("bucket") + 1)
    # at most len(bounds) + 1 rows an attribute set reach this window
    w = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(*by, "bucket", upper.alias("upper"), "n", F.sum("n").over(w).alias("cumulative"))


def counter(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).alias("total"))


def bounded_labels(df: DataFrame, label: str, order: str, limit: int = MAX_LABELS) -> DataFrame:
    """df with bounded: the first limit distinct labels as they are, later ones as _other, empty or null as unknown.

    The first labels are limit rows of an aggregate, so they are broadcast.
    """
    first = df.where(F.col(label) != "").groupBy(F.col(label).alias("_l")).agg(F.min(order).alias("_o")).orderBy("_o", "_l").limit(limit).select("_l")
    empty = F.col(label).isNull() | (F.col(label) == "")
    return df.join(F.broadcast(first), F.col(label) == F.col("_l"), "left").withColumn("bounded", F.when(empty, "unknown").when(F.col("_l").isNotNull(), F.col(label)).otherwise("_other")).drop("_l")


def pool_stats(spans: DataFrame, by: list[str], start: str, end: str, limit: int) -> DataFrame:
    """(by, total, peak, over_limit): how many spans there were, were open at once, and opened when limit were open already. Ends free their slot before starts at the same time."""
    e = spans.select(*by, F.col(start).alias("t"), F.lit(1).alias("d")).unionByName(spans.select(*by, F.col(end).alias("t"), F.lit(-1).alias("d")))
    steps = e.groupBy(*by, "t", "d").agg(F.sum("d").alias("d_sum"), F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    run = steps.withColumn("open", F.sum("d_sum").over(w))
    blocked = F.when(F.col("d") > 0, F.greatest(F.lit(0), F.least(F.col("n"), F.col("open") - limit)))
    return run.groupBy(*by).agg(F.sum(F.when(F.col("d") > 0, F.col("n")).otherwise(0)).alias("total"), F.max("open").alias("peak"), F.coalesce(F.sum(blocked), F.lit(0)).alias("over_limit"))


def upload_sizes(steps: DataFrame) -> DataFrame:
    """(session, blob, bytes): bytes of a session's steps(session, ord, op, bytes) up to each commit; a commit or cancel starts it anew."""
    closes = F.col("op").isin("commit", "cancel").cast("int")
    part = F.coalesce(F.sum(closes).over(Window.partitionBy("session").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return steps.withColumn("blob", part).groupBy("session", "blob").agg(F.sum("bytes").alias("bytes"), F.max_by("op", "ord").alias("last")).where("last = 'commit'").select("session", "blob", "bytes")


def cache_stats(lookups: DataFrame, by: list[str]) -> DataFrame:
    return lookups.groupBy(*by).agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("misses"))
