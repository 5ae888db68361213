"""Line dedup: lines that many documents share go, except in one document.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case. Keys of at least
min_chars code points that min_docs or more documents hold lose all their lines except in the largest doc_id.

Cases. A null or empty text is one empty line. A row with a null doc_id counts for no key and keeps its lines.
Rows that share a doc_id count as one document. If all lines go, the kept text is empty. Extra columns stay;
those named as the results are replaced.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_spread
from .common import bound_batches, materialise, released, with_fields

_BATCH = 20_000


def _long_enough(key: bytes, min_chars: int) -> bool:
    """Whether a UTF-8 key has min_chars code points, which are one to four bytes each."""
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def _keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """A 128-bit hash of each line's key, or None where the key is too short to count."""
    lines = (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")  # bytes.lower and strip know ASCII only, as the key does
    return [xxhash.xxh3_128_digest(k) if _long_enough(k := x.strip(), min_chars) else None for x in lines]


def _emit(min_chars: int):
    def run(batches):
        for b in batches:
            ids, keys = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                own = set(_keys(t.as_py(), min_chars)) - {None}
                ids += [i] * len(own)
                keys += own
                if len(keys) >= _BATCH:
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])
                    ids, keys = [], []
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    return run


def shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(key, docs, keeper): the keys that lose lines. Each document counts once for a key, and each map task adds up its own documents before the shuffle, so a line in a third of all documents is one row a task."""
    pairs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(_emit(min_chars)), "doc_id long, key binary")
    return pairs.groupBy("key", "doc_id").agg(F.count("*").alias("_")).groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs)


def _apply(min_chars: int, text_at: int, gone_at: int, schema: pa.Schema):
    def run(batches):
        for b in batches:
            texts, total, dropped, digests = [], [], [], []
            for t, gone in zip(b.column(text_at), b.column(gone_at)):
                text, gone = t.as_py() or "", set(gone.as_py() or ())
                lines = text.split("\n")
                if gone:
                    kept = [x for x, k in zip(lines, _keys(text, min_chars)) if k is None or k not in gone]
                else:
                    kept = lines
                new = "\n".join(kept)
                texts.append(new)
                total.append(len(lines))
                dropped.append(len(lines) - len(kept))
                digests.append(hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest())
            own = [c for i, c in enumerate(b.columns) if i not in (text_at, gone_at)]
            yield pa.record_batch([*own, pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())], schema=schema)

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with _kept_text, n_lines, n_dropped and kept_sha256 in place of text.

    What each document loses is settled on hashes, those of lines in very many documents dealt over tasks; texts move once, to meet the keys to drop, and not at all where Spark finds those few enough to broadcast.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = bound_batches(docs).drop("_kept_text", "n_lines", "n_dropped", "kept_sha256", "_of", "_gone")
    gone = materialise(shared_lines(docs, min_chars, min_docs), "lines")
    pairs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(_emit(min_chars)), "doc_id long, key binary")
    per_doc = join_spread(pairs, gone.withColumnRenamed("key", "_line"), ["key"], ["_line"], "docs", ["doc_id"]).where(F.col("doc_id") != F.col("keeper")).groupBy(F.col("doc_id").alias("_of")).agg(F.collect_set("key").alias("_gone"))
    joined = docs.join(per_doc, F.col("doc_id") == F.col("_of"), "left").drop("_of")
    schema = with_fields(docs.drop("text"), "_kept_text string, n_lines long, n_dropped long, kept_sha256 string")
    at = joined.columns
    return joined.mapInArrow(released(_apply(min_chars, at.index("text"), at.index("_gone"), to_arrow_schema(schema))), schema)
