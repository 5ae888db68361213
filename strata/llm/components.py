"""Connected components of an edge table by alternating large-star and small-star rounds.

The rounds work on edges alone, so no task or driver holds a component. Each round is written to the shared
folder, which cuts the lineage; the loop ends when a round leaves the edges as they were.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, released

_CHUNK = 100_000


def _forest(batches):
    """Each chunk of a task's edges becomes stars around the chunk's own roots: connected as before, with an edge a node at most."""

    def flush(src, dst):
        root: dict[int, int] = {}

        def find(x):
            while (p := root.setdefault(x, x)) != x:
                root[x] = root[p]
                x = p
            return x

        for a, b in zip(src, dst):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        out = [(x, find(x)) for x in list(root)]
        out = [(x, r) for x, r in out if x != r]
        return pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], names=["src", "dst"])

    src: list[int] = []
    dst: list[int] = []
    for b in batches:
        src += b.column(0).to_pylist()
        dst += b.column(1).to_pylist()
        if len(src) >= _CHUNK:
            yield flush(src, dst)
            src, dst = [], []
    yield flush(src, dst)


def _hubs(e: DataFrame, edges: int) -> list[int]:
    """Nodes with over a five-hundredth of all edges: at most a thousand. Few edges need no search for them."""
    if edges < 10_000:
        return []
    degree = e.select(F.explode(F.array("src", "dst")).alias("u")).groupBy("u").agg(F.count("*").alias("n"))
    return [r["u"] for r in degree.where(F.col("n") > edges // 500).select("u").collect()]


def _large_star(e: DataFrame, hubs: list[int] = ()) -> DataFrame:
    """Larger neighbours go to the smallest neighbour. Edges of hubs are dealt over tasks by their other ends, and a hub's smallest neighbour is repeated as often."""
    both = e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m")).withColumnRenamed("src", "u")
    same = F.col("src") == F.col("u")
    up = both.where("dst > src")
    if hubs:
        parts = max(2, int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        hub = lambda c: F.col(c).isin(hubs)
        up = up.withColumn("_salt", F.when(hub("src"), F.pmod(F.xxhash64("dst"), F.lit(parts)).cast("int")).otherwise(0))
        least = least.withColumn("_copy", F.explode(F.when(hub("u"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
        same = same & (F.col("_salt") == F.col("_copy"))
    return up.join(least, same).select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("src").agg(F.min("dst").alias("m")).withColumnRenamed("src", "u")
    moved = e.join(least, F.col("src") == F.col("u")).where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.union(least.select(F.col("u").alias("src"), F.col("m").alias("dst"))).distinct()


def _mark(e: DataFrame):
    return e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of edges(src, dst) the smallest node that it is connected with. Self-links and repeated edges are allowed; nodes without links have no row."""
    e = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst")
    e = materialise(e.mapInArrow(released(_forest), "src long, dst long").distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        e = materialise(_small_star(_large_star(e, _hubs(e, mark[0]))), "edges")
        mark, last = _mark(e), mark
        if mark == last:
            break
    return e.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(e.select(F.col("dst"), F.col("dst")).distinct())
