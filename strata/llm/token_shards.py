"""Training-order materialisation of token ids in fixed-stride binary shards.

Each task encodes its documents, an end token after each, into one stream and cuts it into sequences of seq_len ids, which are
written to a table with what each document has in them. Sequences are numbered by task and place; a keyed Feistel permutation, walked
along its cycles until it falls below the number of sequences, gives each a global slot. Slots are range-partitioned into shards of
shard_slots: one file a shard, one record a slot, so that record k of the training order is at a known place and reading goes on from any slot.

A record is seq_len little-endian ids and the two bytes 0A 0A, which Spark's text writer puts after each row; that
writer makes whole files or none, on any store, when executors are lost. The last sequence of a task is filled with pad.
Texts are encoded once, and sequences cross one shuffle; the driver sees one number a task.

Cases. A null or empty text is its end token alone. Rows without doc_id have a null doc_id in the spans. Repeated rows are written as often as they occur. An empty table gives no shard.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import sys
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, scratch

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_TAIL = b"\n\n"
_LEVEL = 6  # of compression: ids take half their room for a few seconds a GB
U = np.uint64


# ---- the permutation -------------------------------------------------------------------------------------------


def _round(x: np.ndarray, key: int, r: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + U((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & (2**64 - 1))
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _feistel(x: np.ndarray, half: int, key: int, rounds, back: bool = False) -> np.ndarray:
    mask = U((1 << half) - 1)
    left, right = x >> U(half), x & mask
    for r in rounds:
        if back:
            left, right = right ^ (_round(left, key, r) & mask), left
        else:
            left, right = right, left ^ (_round(right, key, r) & mask)
    return (left << U(half)) | right


def permute(x: np.ndarray, n: int, key: int, rounds: int = 6, back: bool = False) -> np.ndarray:
    """Slots of sequence numbers x among n, or with back the numbers of slots. Values that fall beyond n walk on along their cycle."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    order = range(rounds)[::-1] if back else range(rounds)
    out = _feistel(x.astype(U), half, key, order, back)
    while len(far := np.flatnonzero(out >= U(n))):
        out[far] = _feistel(out[far], half, key, order, back)
    return out.astype(np.int64)


# ---- encoding --------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of texts by a byte-level merge vocabulary in rank order, with the first free id as the end of a text."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.words = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.end = max(table.values()) + 1
        self.kind = np.dtype("<u2" if self.end < 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 and sys.byteorder == "little" else ""  # array is faster than numpy from a list

    def __call__(self, text: str | None) -> bytes:
        ids = self.words.encode_ordinary(text) if text else []
        ids.append(self.end)
        return array(self.code, ids).tobytes() if self.code else np.array(ids, self.kind).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids without the end."""
        return self.words.decode(ids.tolist())


@cache
def _encoder(vocabulary: tuple[bytes, str]) -> Encoder:
    return Encoder(*vocabulary)


def read_vocabulary(spark: SparkSession, path: str = RANKS, pattern: str | None = None) -> tuple[bytes, str]:
    """A rank file and the pattern that cuts texts into words; without one, that of the public vocabularies' package."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]), pattern


_SEQUENCES = "task int, k int, record binary, doc_id long, start long, n long"


def _sequences(vocabulary, seq_len: int, pad: int):
    """A row for each sequence (task, k, record), and one for each document (task, doc_id, its place in the task's stream, ids)."""
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["task", "k", "record", "doc_id", "start", "n"]

    def rows(count: int, **columns):
        return pa.record_batch([columns[c] if c in columns else pa.nulls(count, kind) for c, kind in zip(names, kinds)], names=names)

    def run(batches):
        encode, task = _encoder(vocabulary), TaskContext.get().partitionId()
        width, size, stream, made, at = encode.kind.itemsize, seq_len * encode.kind.itemsize, bytearray(), 0, 0
        whose = lambda n: pa.array(np.full(n, task, np.int32))

        def cut(raw: bytes):
            nonlocal made
            n = len(raw) // size
            made += n
            return rows(n, task=whose(n), k=pa.array(np.arange(made - n, made, dtype=np.int32)), record=pa.array([raw[i : i + size] for i in range(0, n * size, size)], pa.binary()))

        for b in batches:
            sizes = []
            for t in b.column(1):
                ids = encode(t.as_py())
                stream += ids
                sizes.append(len(ids) // width)
                if len(stream) >= 1 << 20:
                    whole = len(stream) // size * size
                    yield cut(bytes(stream[:whole]))
                    del stream[:whole]
            n = np.array(sizes, np.int64)
            yield rows(len(n), task=whose(len(n)), doc_id=b.column(0), start=pa.array(at + np.cumsum(n) - n), n=pa.array(n))
            at += int(n.sum())
        if stream:
            stream += np.array([pad], encode.kind).tobytes() * (-len(stream) % size // width)
            yield cut(bytes(stream))

    return run


_BLOCKS = "shard int, slots binary, block binary"


def _slots(first: dict[int, int], meta: dict, held: int = 1 << 13):
    """(shard, slots, block) of (task, k, record): the records that go to one shard together, compressed, as ids of two or four bytes shrink little row by row."""

    def blocks(numbers: list[np.ndarray], records: list):
        codec = pa.Codec("zstd", compression_level=_LEVEL)
        slot = permute(np.concatenate(numbers), meta["sequences"], meta["key"])
        shard = (slot // meta["shard_slots"]).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        edges = np.concatenate(([0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]))
        groups = [order[i:j] for i, j in zip(edges, edges[1:])]
        packed = [codec.compress(b"".join([records[i] for i in g]), asbytes=True) for g in groups]
        return pa.record_batch([pa.array([shard[g[0]] for g in groups], pa.int32()), pa.array([slot[g].tobytes() for g in groups], pa.binary()), pa.array(packed, pa.binary())], names=["shard", "slots", "block"])

    def run(batches):
        numbers, records = [], []
        for b in batches:
            numbers.append(np.array([first[t] for t in b.column(0).to_pylist()], np.int64) + b.column(1).to_numpy())
            records += b.column(2).to_pylist()
            if len(records) >= held:
                yield blocks(numbers, records)
                numbers, records = [], []
        if records:
            yield blocks(numbers, records)

    return run


def _unpacked(size: int):
    """(shard, slot, record) of blocks."""

    def run(batches):
        for b in batches:
            for shard, slots, block in zip(*(b.column(i).to_pylist() for i in range(3))):
                slot = np.frombuffer(slots, np.int64)
                raw = pa.decompress(block, len(slot) * size, codec="zstd", asbytes=True)
                yield pa.record_batch([pa.array(np.full(len(slot), shard, np.int32)), pa.array(slot), pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())], names=["shard", "slot", "record"])

    return run


# ---- tables ----------------------------------------------------------------------------------------------------


def write_shards(docs: DataFrame, path: str, ranks_path: str = RANKS, pattern: str | None = None, seq_len: int = 1024, shard_slots: int = 8192, key: int = 20_240_601, pad: int = 0) -> dict:
    """Writes shards/shard=../, spans/ (which of a document's ids are in which slot) and meta/ at path, and the sequences/ they were made from; returns the meta data."""
    spark = docs.sparkSession
    vocabulary = read_vocabulary(spark, ranks_path, pattern)
    rows = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(_sequences(vocabulary, seq_len, pad), _SEQUENCES).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", _LEVEL).parquet(f"{path}/sequences")
    made = spark.read.schema(_SEQUENCES).parquet(f"{path}/sequences")
    first, total = {}, 0
    for r in made.where("k is not null").groupBy("task").agg(F.count("*").alias("n")).orderBy("task").collect():  # one row a task
        first[r["task"]] = total
        total += r["n"]
    width = _encoder(vocabulary).kind.itemsize
    meta = {"seq_len": seq_len, "width": width, "stride": seq_len * width + len(_TAIL), "shard_slots": shard_slots, "sequences": total, "key": key, "pad": pad}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")
    firsts = spark.createDataFrame(list(first.items()), "t int, first long")
    numbered = made.where("k is null").join(F.broadcast(firsts), F.col("task") == F.col("t")).select("doc_id", "first", "start", "n")
    numbered.mapInArrow(_spans(meta), _SPANS).write.option("compression", "zstd").parquet(f"{path}/spans")
    if total:
        shards = -(-total // shard_slots)
        blocks = made.where("k is not null").select("task", "k", "record").mapInArrow(_slots(first, meta), _BLOCKS)
        records = blocks.repartitionById(shards, F.col("shard")).mapInArrow(_unpacked(seq_len * width), "shard int, slot long, record binary")
        by_shard = records.sortWithinPartitions("shard", "slot")
        by_shard.select("shard", F.col("record").cast("string").alias("record")).write.partitionBy("shard").option("lineSep", _TAIL.decode()).text(f"{path}/shards")
    return meta


_SPANS = "doc_id long, slot long, at int, from_token long, n_tokens int"


def _spans(meta: dict):
    """For each document and sequence that it is in: the sequence's slot, where in it, from which of the document's tokens, and how many."""

    def run(batches):
        size = meta["seq_len"]
        for b in batches:
            doc, first, start, n = b.column(0), *(b.column(i).to_numpy() for i in (1, 2, 3))
            many = (start + n - 1) // size - start // size + 1
            row = np.repeat(np.arange(len(n)), many)
            k = start[row] // size + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            lo, hi = np.maximum(start[row], k * size), np.minimum(start[row] + n[row], (k + 1) * size)
            slot = permute(first[row] + k, meta["sequences"], meta["key"]) if len(row) else np.zeros(0, np.int64)
            yield pa.record_batch([doc.take(pa.array(row)), pa.array(slot), pa.array((lo - k * size).astype(np.int32)), pa.array(lo - start[row]), pa.array((hi - lo).astype(np.int32))], names=["doc_id", "slot", "at", "from_token", "n_tokens"])

    return run


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])


def _split_records(meta: dict, first_slot: int, sums_only: bool = False):
    def run(batches):
        stride, size = meta["stride"], meta["seq_len"] * meta["width"]
        for b in batches:
            for shard, blob in zip(b.column(0).to_pylist(), b.column(1)):
                raw = blob.as_buffer()
                if len(raw) % stride:
                    raise RuntimeError(f"shard {shard} isn't made of whole records")
                base = shard * meta["shard_slots"]
                for a in range(max(0, first_slot - base), len(raw) // stride, 256):
                    ids = [raw.slice(i * stride, size).to_pybytes() for i in range(a, min(a + 256, len(raw) // stride))]
                    slots, sums = pa.array(np.arange(base + a, base + a + len(ids))), pa.array(list(map(zlib.crc32, ids)), pa.int64())
                    yield pa.record_batch([slots, sums, pa.nulls(len(ids), pa.binary()) if sums_only else pa.array(ids, pa.binary())], names=["slot", "crc", "ids"])

    return run


def read_records(spark: SparkSession, path: str, first_slot: int = 0, sums_only: bool = False) -> DataFrame:
    """(slot, crc, ids as bytes) of all records from first_slot on; shards before it aren't opened. sums_only: without the ids."""
    meta = read_meta(spark, path)
    if not meta["sequences"]:
        return spark.createDataFrame([], "slot long, crc long, ids binary")
    files = spark.read.format("binaryFile").load(f"{path}/shards").where(F.col("shard") >= first_slot // meta["shard_slots"])
    return files.select(F.col("shard").cast("int"), "content").mapInArrow(_split_records(meta, first_slot, sums_only), "slot long, crc long, ids binary")


def shard_documents(docs: DataFrame, **settings) -> DataFrame:
    """Writes the shards of docs in the shared folder and reads them back: (doc_id, slot, at, from_token, n_tokens, shard, record_crc) for each sequence that a document is in."""
    spark = docs.sparkSession
    path = scratch(spark, "shards")
    meta = write_shards(docs, path, **settings)
    spans = spark.read.schema(_SPANS).parquet(f"{path}/spans")
    read = read_records(spark, path, sums_only=True).select(F.col("slot").alias("s"), "crc")
    lost = F.raise_error(F.lit("a sequence isn't in the shards")).cast("long")
    return spans.join(read, F.col("slot") == F.col("s"), "left").select("doc_id", "slot", "at", "from_token", "n_tokens", F.floor(F.col("slot") / meta["shard_slots"]).cast("int").alias("shard"), F.coalesce("crc", lost).alias("record_crc"))
