"""Exact top-k search by distributed histogram selection.

Components are quantised to floor(1024 x). For a block of queries every pass scores all candidates and counts the
scores of each query in equal bins of an interval that is known to hold its kth value; the next pass looks at that
value's bin alone, until the bin is one score wide. Bins are powers of their number wide, so the next pass's bins fill exactly one: a wider
interval would count again what is above it. The last pass keeps the scores above the kth value and, of those
equal to it, the smallest ids that are still needed. A block has a bounded number of queries and a pass sends at
most queries x bins counts to the driver; scores are never stored or shuffled as a whole.

Inner products are exact at any size: in 64-bit floats or integers where the norms prove that these hold them, else in Python's
integers. Vectors long enough for that are set apart, so that a few of them don't slow the others down.

Cases. Vectors that are null or hold null or non-finite components take no part, nor do rows without an id, unless these are asked for: then they are candidates, after
those with an id in ties. Every other row does: rows that share an id are candidates of each other, and each is a query of its own where the id is one. Scores beyond 64 bits rank by their exact value and are shown as the
nearest 64-bit number. Vectors of another length than the query's are no candidates; the product of empty vectors is 0. Queries with fewer than k
candidates return them all, those with none have no row. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch

_RESULT = "query_id long, rank int, vec_id long, score long"
_FLOAT, _INT = 1 << 53, 1 << 62
_WIDE = 1 << 30  # vectors of a norm below it have products below 2^60
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _ceiling(norm: float, dim: int) -> int:
    """A bound of the norm of the quantised vector, from that of the vector in floats."""
    n = int(min(norm, 1e308)) + 1 if norm > 1e15 else norm
    return (n * 2048 * (dim + 1)) if norm > 1e15 else int(1024 * n * (1 + 1e-9)) + dim + 1


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 x) as Python integers; from 2^53 on a float is an integer."""
    return np.array([int(v) * 1024 if abs(v) >= _FLOAT else int(np.floor(1024 * v)) for v in x.ravel().tolist()], object).reshape(x.shape)


def _clipped(x: np.ndarray) -> np.ndarray:
    return np.array([min(max(int(v), _LOW), _HIGH) for v in x], np.int64)


def _vectors(batches):
    """Rows of (id, dimension, norm, whether its products may need more than 64 bits, components as little-endian doubles)."""
    for b in batches:
        ids, dims, norms, wide, blobs = [], [], [], [], []
        for i, v in zip(b.column(0).to_pylist(), b.column(1)):
            if not v.is_valid or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
            if not np.isfinite(x).all():
                continue
            top = float(np.abs(x).max()) if len(x) else 0.0
            with np.errstate(over="ignore"):
                norm = min(top * float(np.sqrt(np.square(x / top).sum())), 1.7e308) if top else 0.0
            ids.append(i)
            dims.append(len(x))
            norms.append(norm)
            wide.append(_ceiling(norm, len(x)) >= _WIDE)
            blobs.append(x.tobytes())
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(wide, pa.bool_()), pa.array(blobs, pa.binary())], names=["id", "dim", "norm", "wide", "v"])


def vectors_of(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", unnamed: bool = False) -> DataFrame:
    """The vectors that take part, with a number for each row; unnamed: those without an id too."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    v = (v if unnamed else v.where("id is not null")).mapInArrow(_vectors, "id long, dim int, norm double, wide boolean, v binary")
    return materialise(v.withColumn("row", F.monotonically_increasing_id()), "vectors")


class _Scorer:
    """Scores of a block of queries against batches of candidates, exactly, with each query's own row left out."""

    def __init__(self, rows: np.ndarray, mat: np.ndarray, bound: int, wide: bool):
        """bound: of the products with candidates that aren't wide, if the queries aren't; wide: whether the queries are."""
        self.at, self.wide, self.raw, self.big = {int(x): i for i, x in enumerate(rows)}, wide, mat, None
        self.exact = bound < _FLOAT
        self.mat = None if wide else np.floor(1024 * mat) if self.exact else np.floor(1024 * mat).astype(np.int64)
        self.step = max(16, (1 << 21) // max(1, len(rows)))

    def _scores(self, v: np.ndarray, wide: bool) -> np.ndarray:
        if wide or self.wide:
            if self.big is None:
                self.big = _whole(self.raw)
            return self.big @ _whole(v).T if v.shape[1] else np.zeros((len(self.raw), len(v)), object)
        x = np.floor(1024 * v)
        return (self.mat @ x.T).astype(np.int64) if self.exact else self.mat @ x.T.astype(np.int64)

    def __call__(self, batch):
        """(ids, whether there is one, scores of shape queries x candidates, whether each counts), in slices of bounded size."""
        named, ids, rows, wide = (c.to_numpy(zero_copy_only=False) for c in (batch.column(0).is_valid(), batch.column(0).fill_null(0), batch.column(1), batch.column(2)))
        for kind in (False, True):
            mine = np.flatnonzero(wide == kind)
            for a in range(0, len(mine), self.step):
                own = mine[a : a + self.step]
                v = np.frombuffer(b"".join(batch.column(3).take(pa.array(own)).to_pylist()), "<f8").reshape(len(own), self.raw.shape[1])
                s = self._scores(v, kind)
                counts = np.ones(s.shape, bool)
                for j, x in enumerate(rows[own].tolist()):
                    if x in self.at:
                        counts[self.at[x], j] = False
                yield ids[own], named[own], s, counts


def _widths(bound: np.ndarray, bins: int) -> np.ndarray:
    """For each bound the least power of bins that is wide enough for bins of them to hold -bound to bound."""
    w = np.ones_like(bound)
    while (small := (w <= 2 * bound // bins).astype(bool)).any():  # bins x w <= 2 x bound, which may need more than 64 bits
        w[small] *= bins
    return w


def _count(block, lo: np.ndarray, width: np.ndarray, open_: np.ndarray, bins: int):
    """How many scores fall in each bin of each open query. With limits beyond 64 bits 64-bit scores are looked up among the bins' edges."""

    def run(batches):
        score, total = _Scorer(*block.value), np.zeros((len(lo), bins), np.int64)
        which = np.flatnonzero(open_)
        edges = [_clipped(lo[i] + width[i] * np.arange(bins + 1, dtype=object)) for i in which] if lo.dtype == object else None
        for b in batches:
            for _, _, s, ok in score(b):
                s, ok = s[which], ok[which]
                if edges is not None and s.dtype != object:
                    at = np.array([np.searchsorted(e[:-1], x, "right") - 1 for e, x in zip(edges, s)])
                    ok &= s < np.array([e[-1] for e in edges])[:, None]
                else:
                    at = (s - lo[which, None]) // width[which, None]
                ok &= ((at >= 0) & (at < bins)).astype(bool)
                flat = (np.arange(len(which))[:, None] * bins + at)[ok].astype(np.int64)
                total[which] += np.bincount(flat, minlength=len(which) * bins).reshape(len(which), bins)
        q, n = np.nonzero(total)
        yield pa.record_batch([pa.array(q.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(total[q, n])], names=["q", "bin", "n"])

    return run


def _keep(block, kth: np.ndarray, need: np.ndarray, limit: int):
    """Scores above the kth value, and of those equal to it the smallest ids in the task that may be needed, rows without an id last. order is a score as bytes that sort like it, where 64 bits aren't enough."""
    size = (2 * limit).bit_length() // 8 + 1
    names = ["q", "vec_id", "score", "order"]

    def rows(q, ids, named, s):
        order = [(int(x) + limit).to_bytes(size, "big") for x in s] if kth.dtype == object else [None] * len(q)
        return pa.record_batch([pa.array(q.astype(np.int32)), pa.array(ids, mask=~named), pa.array(_clipped(s) if s.dtype == object else s), pa.array(order, pa.binary())], names=names)

    def run(batches):
        score, small = _Scorer(*block.value), _clipped(kth)
        tied, unnamed = [np.array([], np.int64) for _ in kth], np.zeros(len(kth), np.int64)
        for b in batches:
            for ids, named, s, ok in score(b):
                k = kth if s.dtype == object else small
                q, j = np.nonzero(ok & (s > k[:, None]).astype(bool))
                yield rows(q, ids[j], named[j], s[q, j])
                equal = ok & (s == k[:, None]).astype(bool) & (kth == k)[:, None]
                for i in np.flatnonzero(equal.any(axis=1)):
                    tied[i] = np.sort(np.concatenate((tied[i], ids[equal[i] & named])))[: need[i]]
                    unnamed[i] += (equal[i] & ~named).sum()
        n = np.array([len(t) for t in tied])
        last = np.minimum(unnamed, need - n)
        q = np.repeat(np.tile(np.arange(len(kth)), 2), np.concatenate((n, last)))
        yield rows(q, np.concatenate([*tied, np.zeros(last.sum(), np.int64)]), np.arange(len(q)) < n.sum(), kth[q])

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, block: int = 4096, bins: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", unnamed: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by every, its k highest inner products with the other rows, ties to smaller ids; unnamed: rows without an id are among these.

    With thousands of queries a block a pass over the candidates is bound by the products, not by reading them.
    """
    spark = vectors.sparkSession
    sc, out = spark.sparkContext, scratch(spark, "topk")
    table = vectors_of(vectors, id_col, vec_col, unnamed)
    queries = table.where(F.col("id") % every == 0)
    most = table.groupBy("dim").agg(F.max("norm").alias("most"), F.max(F.when(~F.col("wide"), F.col("norm"))).alias("narrow"))
    shapes = queries.groupBy("dim", "wide").agg(F.count("*").alias("n")).join(most, "dim").orderBy("dim", "wide")
    for shape in shapes.toLocalIterator():
        dim = shape["dim"]
        candidates, last = table.where(F.col("dim") == dim).select("id", "row", "wide", "v"), None
        mine = queries.where((F.col("dim") == dim) & (F.col("wide") == shape["wide"])).select("id", "row", "norm", "v")
        while True:
            rows = (mine if last is None else mine.where((F.col("id") > last[0]) | ((F.col("id") == last[0]) & (F.col("row") > last[1])))).orderBy("id", "row").limit(block).collect()
            if not rows:
                break
            last = rows[-1]["id"], rows[-1]["row"]
            ids = np.array([r["id"] for r in rows], np.int64)
            mat = np.frombuffer(b"".join(r["v"] for r in rows), "<f8").reshape(len(rows), dim)
            # no score is beyond the product of the norms
            own = [_ceiling(r["norm"], dim) for r in rows]
            bound = [x * _ceiling(shape["most"], dim) + 1 for x in own]
            limit = max(bound)
            kind = np.int64 if limit < _INT else object
            sent = sc.broadcast((np.array([r["row"] for r in rows], np.int64), mat, max(own) * _ceiling(shape["narrow"] or 0.0, dim), shape["wide"]))
            bound = np.array(bound, kind)
            lo, width = -bound, _widths(bound, bins)
            open_, above, kth = np.ones(len(ids), bool), np.zeros(len(ids), np.int64), np.array([-limit - 1] * len(ids), kind)
            while open_.any():
                counted = candidates.mapInArrow(_count(sent, lo, width, open_, bins), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow()
                hist = np.zeros((len(ids), bins), np.int64)
                hist[counted["q"].to_numpy(), counted["bin"].to_numpy()] = counted["n"].to_numpy()
                over = above[:, None] + np.cumsum(hist[:, ::-1], axis=1)[:, ::-1]  # candidates at or above each bin
                short = open_ & (over[:, 0] < k)  # fewer than k candidates: all stay
                open_ &= ~short
                at = (over >= k).sum(axis=1) - 1
                i = np.flatnonzero(open_)
                above[i] = over[i, at[i]] - hist[i, at[i]]
                lo[i] += at[i] * width[i]
                done = i[(width[i] == 1).astype(bool)]
                kth[done] = lo[done]
                open_[done] = False
                width = np.maximum(1, width // bins)
            kept = candidates.mapInArrow(_keep(sent, kth, k - above, limit), "q int, vec_id long, score long, order binary")
            best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("order"), F.asc_nulls_last("vec_id")))).where(F.col("rank") <= k)
            named = F.broadcast(spark.createDataFrame([(n, i) for n, i in enumerate(ids.tolist())], "n int, query_id long"))
            best.join(named, F.col("q") == F.col("n")).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
            sent.destroy()
            if len(rows) < block:
                break
    spark.createDataFrame([], _RESULT).write.mode("append").parquet(out)
    return spark.read.schema(_RESULT).parquet(out)
