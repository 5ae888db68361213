"""Quality classifier: Bradley-Terry ranking of documents.

Each pair of a good and a bad labelled document is a preference; logistic loss on the difference of their features
learns a linear score. The threshold is a quantile of the training documents' scores, the one between whose
neighbours the labels part best. Scores are mapped to 0..1 so that the threshold is 0.7.

Learning reads at most max_labelled labelled documents, those whose ids hash lowest, and each of their whole texts; scoring is a map
over all documents and shuffles nothing.

Cases. A null text is an empty one, and an empty text has a score like any other. Rows without doc_id are scored and not learned
from. Labels that are null, not 0 or 1, or contradict each other for one doc_id don't count; of texts that share a
doc_id one is learned from. Where one of the two labels is missing every score is 0.7. Other columns are ignored by the score and stay.
"""

from __future__ import annotations

import operator
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, released, with_fields
from .split import held_out

_CLASSES = [b"!", b"|", b"*#%&$@~^+=_<>/\\{}[]", b"0123456789", b".", b",", b"?;:", b"\"'`()", b"\n", bytes(range(65, 91)), bytes(range(128, 256)), bytes(range(0, 9)) + bytes(range(14, 32))]
_MEMBER = np.array([[b in c for c in _CLASSES] for b in range(256)], dtype=np.float64)
CUT = 0.7


def features(text: str | None) -> np.ndarray:
    """What a text looks like, whatever it is about: shares of kinds of characters, repetition and lengths."""
    b = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(b))
    shares = np.log1p(100 * (np.bincount(np.frombuffer(b, np.uint8), minlength=256) @ _MEMBER) / n)
    w = b.split()
    k = max(1, len(w))
    counts = Counter(w)
    lines = b.split(b"\n")
    more = [
        np.log1p(len(w)),
        np.log1p(100 * sum(map(operator.eq, w, w[1:])) / k),
        np.log1p(len(counts)) / np.log1p(k),
        np.log1p(10 * max(counts.values(), default=0) / k),
        np.log1p(len(b) / k),
        np.log1p(max(map(len, w), default=0)),
        1 - len(set(lines)) / len(lines),
    ]
    return np.concatenate((shares, more))


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.threshold) + np.log(CUT / (1 - CUT)), -500, 500)))


def learn(x: np.ndarray, y: np.ndarray, pairs: int = 100_000, ridge: float = 1e-3, seed: int = 7) -> Model | None:
    """Weights that rank good documents over bad ones, by Newton's method on the pairwise logistic loss."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, rng = (x - mean) / scale, np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -500, 500)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ (1 - p) / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    order = np.argsort(raw)
    # errors at each cut: good documents below it and bad ones above it, each as a share of its label
    wrong = np.concatenate(([0], np.cumsum(y[order] == 1))) / len(good) + (len(bad) - np.concatenate(([0], np.cumsum(y[order] == 0)))) / len(bad)
    at = np.flatnonzero(wrong == wrong.min())
    at = int(at[len(at) // 2])
    ends = raw[order]
    threshold = (ends[max(at - 1, 0)] + ends[min(at, len(ends) - 1)]) / 2
    return Model(mean, scale, w, float(threshold), float(4 / (raw.std() + 1e-9)))


def _features(batches):
    for b in batches:
        x = np.array([features(t.as_py()) for t in b.column(1)]).reshape(b.num_rows, -1)
        yield pa.record_batch([b.column(0), pa.array(list(x), pa.list_(pa.float64())), b.column(2)], names=["doc_id", "x", "y"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, part: int = 2, max_labelled: int = 20_000) -> Model | None:
    """The model of the labelled documents that aren't held out; None where they have one label only."""
    y = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("id"), parts, part))
    y = y.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    y = y.orderBy(F.xxhash64("id"), "id").limit(max_labelled)  # bounded, so it can be broadcast
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(y), F.col("doc_id") == F.col("id")).select("doc_id", "text", "y")
    rows = d.mapInArrow(released(_features), "doc_id long, x array<double>, y int").groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("m")).select("m.x", "m.y", "doc_id").orderBy("doc_id").toArrow()
    if not rows.num_rows:
        return None
    return learn(np.array(rows["x"].to_pylist()), rows["y"].to_numpy())


def _score(model: Model | None, text_at: int, schema: pa.Schema):
    def run(batches):
        for b in batches:
            if model is None or not b.num_rows:
                s = np.full(b.num_rows, CUT)
            else:
                s = model.score(np.array([features(t.as_py()) for t in b.column(text_at)]))
            yield pa.record_batch([*b.columns, pa.array(s), pa.array((s >= CUT).astype(np.int32))], schema=schema)

    return run


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, part: int = 2, max_labelled: int = 20_000) -> DataFrame:
    """docs with held_out, score (0..1, higher: label 1 likelier) and predicted (score >= 0.7)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = bound_batches(docs).drop("held_out", "score", "predicted")
    model = train(docs, labels, label, parts, part, max_labelled)
    docs = docs.withColumn("held_out", held_out(F.col("doc_id"), parts, part))
    schema = with_fields(docs, "score double, predicted int")
    return docs.mapInArrow(released(_score(model, docs.columns.index("text"), to_arrow_schema(schema))), schema)
