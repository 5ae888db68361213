"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint bit is 1 if it is set in over half of the XXH64 values (seed 42) of a text's word shingles. Two
fingerprints link at ``radius`` or fewer differing bits. Every fingerprint emits all variants within half the
radius; two that link meet in a variant. Over a whole 64-bit word and radius 4 that is 2,081 variants. With
``parts`` = 3 the word is cut in three: of 4 differing bits at least 2 fall in one part, so the fingerprints
differ in at most 2 bits of the other two parts, and the variants within 1 bit of those meet: 3 x 43 or so, 129 in all.
``parts`` = 1 is the whole word. Colliding fingerprints are verified; a bucket yields a spanning forest of its
links, never all of its pairs.

Cases. Null, empty and blank texts have fingerprint 0, linked like any other. Texts of fewer words than a shingle
have one shingle, the whole sequence. Rows with a null doc_id get a fingerprint and the component of their
fingerprint, and are nobody's component_id unless all rows of a component have null ids, whose component_id is null. Repeated rows are copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialise, released
from .components import components

_BLANKS = bytes(range(9, 14)) + b" "
_SOME = 1 << 15


def ones_of(h: np.ndarray) -> np.ndarray:
    """For each bit, in how many of the hashes it is set."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _SOME):
        ones += np.unpackbits(h[i : i + _SOME].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def majority(ones: np.ndarray, n: int) -> int:
    """The word of the bits that are set in over half of n hashes."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and split know ASCII only
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), 42)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[: -words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for i in range(0, n, _SOME):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + _SOME], stops[i : i + _SOME])], dtype="<u8")
        ones += ones_of(h)
    return majority(ones, n)


def _fingerprints(words: int):
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], dtype=np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    return bound_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(_fingerprints(words)), "doc_id long, fp long")


def cuts(parts: int) -> list[np.uint64]:
    """Masks over the word that leave out one part each; the whole word for one part."""
    if parts == 1:
        return [np.uint64(2**64 - 1)]
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    return [np.uint64((2**64 - 1) ^ sum(1 << j for j in range(a, b))) for a, b in zip(edges, edges[1:])]


def _flips(mask: int, reach: int) -> np.ndarray:
    """All words within mask of at most reach set bits."""
    bits, out, last = [1 << j for j in range(64) if mask >> j & 1], {0}, {0}
    for _ in range(reach):
        last = {x | b for x in last for b in bits}
        out |= last
    return np.array(sorted(out), dtype=np.uint64)


def reach_of(radius: int, parts: int) -> int:
    """Half of what is left of the radius when the part with the most differing bits is left out."""
    left = radius if parts == 1 else radius - -(-radius // parts)
    return -(-left // 2)


def _variants(radius: int, parts: int):
    flips = [(i, m, _flips(int(m), reach_of(radius, parts))) for i, m in enumerate(cuts(parts))]

    def run(batches):
        for b in batches:
            all_fp = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(all_fp), 2048):
                fp = all_fp[at : at + 2048]
                for i, m, f in flips:
                    v = ((fp & m)[:, None] ^ f).ravel()
                    yield pa.record_batch([pa.array(np.full(len(v), i, np.int8)), pa.array(v.view(np.int64)), pa.array(np.repeat(fp, len(f)).view(np.int64))], names=["cut", "variant", "fp"])

    return run


def _bucket_edges(fp: np.ndarray, radius: int) -> tuple[list, list]:
    """A spanning forest of the links among a large bucket's fingerprints.

    Each fingerprint is expanded once against those not yet reached, so nothing of the size of all pairs is ever held or emitted.
    """
    src, dst = [], []
    left = fp
    while len(left) > 1:
        seed, left = left[0], left[1:]
        front = np.array([seed])
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for x in front:
                rest = ~near
                near[rest] = np.bitwise_count(left[rest] ^ x) <= radius
                if near.all():
                    break
            front, left = left[near], left[~near]
            src.append(np.full(len(front), seed))
            dst.append(front)
    return src, dst


_SMALL = 8


def _links(radius: int):
    """From rows sorted by cut, variant and fingerprint: links that connect the fingerprints of each bucket. Only a bucket that goes on in the next batch is carried over."""

    def found(cut, var, fp):
        start = np.flatnonzero(np.concatenate(([True], (var[1:] != var[:-1]) | (cut[1:] != cut[:-1]))))
        sizes = np.diff(np.append(start, len(var)))
        size_of = np.repeat(sizes, sizes)
        bucket = np.repeat(np.arange(len(start)), sizes)
        src, dst = [], []
        for s in range(1, _SMALL):
            ok = (bucket[s:] == bucket[:-s]) & (size_of[s:] <= _SMALL)
            a, b = fp[:-s][ok], fp[s:][ok]
            ok = np.bitwise_count(a ^ b) <= radius
            src.append(a[ok])
            dst.append(b[ok])
        for at in np.flatnonzero(sizes > _SMALL):
            x, y = _bucket_edges(fp[start[at] : start[at] + sizes[at]], radius)
            src += x
            dst += y
        return src, dst

    def run(batches):
        cut, var, fp = np.array([], np.int8), np.array([], np.int64), np.array([], np.uint64)
        src, dst = [], []

        def out():
            pairs = np.unique(np.stack([np.concatenate(src), np.concatenate(dst)], axis=1), axis=0) if src else np.empty((0, 2), np.uint64)
            src.clear(), dst.clear()
            return pa.record_batch([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], names=["src", "dst"])

        held = 0
        for b in batches:
            cut, var, fp = (np.concatenate(x) for x in ((cut, b.column(0).to_numpy()), (var, b.column(1).to_numpy()), (fp, b.column(2).to_numpy().view(np.uint64))))
            if not len(var):
                continue
            whole = np.flatnonzero((var != var[-1]) | (cut != cut[-1]))
            end = whole[-1] + 1 if len(whole) else 0
            if end:
                x, y = found(cut[:end], var[:end], fp[:end])
                src, dst = src + x, dst + y
                held += sum(map(len, x))
                cut, var, fp = cut[end:], var[end:], fp[end:]
            if held > 200_000:
                yield out()
                held = 0
        if len(var):
            x, y = found(cut, var, fp)
            src, dst = src + x, dst + y
        yield out()

    return run


def links(prints: DataFrame, radius: int = 4, parts: int = 3) -> DataFrame:
    """(src, dst): links that connect whatever fingerprints of prints(fp), which must be distinct, are connected by differences of radius bits or fewer."""
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a fingerprint makes over a hundred rows: its few bytes say nothing of the work, so tasks aren't left to be sized by them
    v = prints.select("fp").repartition(n, "fp").mapInArrow(released(_variants(radius, parts)), "cut tinyint, variant long, fp long")
    return v.repartition("cut", "variant").sortWithinPartitions("cut", "variant", "fp").mapInArrow(released(_links(radius)), "src long, dst long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, parts: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Copies meet as one fingerprint before anything is compared; links and components are worked out among distinct fingerprints.
    """
    every = materialise(fingerprints(docs, words), "prints")
    prints = materialise(every.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    comp = components(links(prints, radius, parts))
    rooted = prints.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    by_fp = rooted.join(ids, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return every.join(by_fp, F.col("fp") == F.col("f")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
