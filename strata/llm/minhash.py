"""Near copies by Jaccard similarity of word shingles: SimHash fingerprints and MinHash bands find candidates, the shingles decide.

The links of ``simhash`` are candidates: fingerprints of the texts' shingles, repeats included, meet by ball hashing within ``radius`` bits. Most near copies
differ in more bits than that, so texts that agree in a MinHash band are candidates as well. Both are verified on the shingles, and components of what holds are the groups.

A text's shingles are the XXH64 values (seed 42) of its runs of ``words`` words. Its least values under 64 mixings of them form 16
bands of 4; texts that agree in a band are compared. Two texts with similarity 0.8 agree in none of the bands with probability 0.0002, so that is what is missed;
what links is verified on the whole shingle sets, so nothing below ``least`` links. Texts of the same shingles meet as one key before anything is compared.

A bucket of up to 32 texts yields all of its pairs. In a larger one each text is first paired with the next two by the buckets of the
next band. What connects by then needs no more pairs. Texts of larger buckets that still hold several groups go through an exact join:
texts of similarity 0.8 share one of the rarest fifth of their shingles, and share it early enough in that order for the rest to suffice, so
texts of different groups that do so are compared as well. No bucket's size drops a pair that could connect two groups.

Cases. Null, empty and blank texts are copies of each other. Texts of fewer words than a shingle have one, the whole sequence. Rows with a null doc_id are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bound_batches, materialise, released
from .components import components

_BANDS, _ROWS = 16, 4
_SMALL, _NEXT = 32, 2
_LONG = 1 << 18
_SLOTS = 1 << 20
_CHUNK = 1 << 12
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 2**64, _BANDS * _ROWS, np.uint64) | np.uint64(1)
_PLUS = _RANDOM.integers(0, 2**64, _BANDS * _ROWS, np.uint64)
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def hashes(text: str | None, words: int = 5) -> np.ndarray:
    """The shingles of a text in their order."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and split know ASCII only
    if not w:
        return np.array([], np.uint64)
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(starts))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(hashes(text, words))


def key_of(s: np.ndarray) -> int:
    """What stands for a set of shingles; 0 for none."""
    return xxhash.xxh64_intdigest(s.tobytes(), 42) if len(s) else 0


def buckets(s: np.ndarray) -> np.ndarray:
    """A value for each band of a set of shingles."""
    low = np.full(_BANDS * _ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(s), _CHUNK):
        low = np.minimum(low, (s[i : i + _CHUNK, None] * _TIMES + _PLUS).min(axis=0))
    low = low.reshape(_BANDS, _ROWS)
    out = low[:, 0].copy()
    for j in range(1, _ROWS):
        out = (out ^ (out >> _SHIFT)) * _MIX + low[:, j]
    return out


def _prints(words: int):
    def run(batches):
        for b in batches:
            keys, prints, bands = [], [], []
            for t in b.column(1):
                h = hashes(t.as_py(), words)
                s = np.unique(h)
                keys.append(key_of(s))
                prints.append(simhash.majority(simhash.ones_of(h), len(h)))
                bands.append(buckets(s).tobytes() if len(s) else None)
            words64 = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.record_batch([b.column(0), words64(keys), words64(prints), pa.array(bands, pa.binary())], names=["doc_id", "key", "fp", "bands"])

    return run


def _sets(words: int):
    def run(batches):
        for b in batches:
            sets = [shingles(t.as_py(), words) for t in b.column(0)]
            yield pa.record_batch([pa.array(np.array([key_of(s) for s in sets], np.uint64).view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "shingles"])

    return run


def _bands(batches):
    names = ["band", "bucket", "next", "key", "root"]
    for b in batches:
        key, root, all_of = b.column(0), b.column(1), b.column(2).to_pylist()
        if not len(key):
            continue
        m = np.frombuffer(b"".join(all_of), np.int64).reshape(-1, _BANDS)
        for i in range(_BANDS):
            yield pa.record_batch([pa.array(np.full(len(key), i, np.int8)), pa.array(m[:, i].copy()), pa.array(m[:, (i + 1) % _BANDS].copy()), key, root], names=names)


def _pairs(batches):
    """From rows sorted by band, bucket and next: the pairs to compare. Only a bucket that goes on in the next batch is carried over, and of a long one its last rows."""

    def found(band, bucket, key, long):
        start = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (band[1:] != band[:-1]))))
        sizes = np.diff(np.append(start, len(bucket)))
        large = sizes > _SMALL
        large[0] |= long
        reach = np.repeat(np.where(large, _NEXT, _SMALL - 1), sizes)
        group = np.repeat(np.arange(len(start)), sizes)
        src, dst = [], []
        for s in range(1, min(_SMALL, int(sizes.max()))):
            ok = (group[s:] == group[:-s]) & (reach[s:] >= s)
            src.append(key[:-s][ok])
            dst.append(key[s:][ok])
        a, b = (np.concatenate(x) if x else np.array([], np.int64) for x in (src, dst))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["src", "dst"])

    held, long = [np.array([], t) for t in (np.int8, np.int64, np.int64)], False
    for b in batches:
        held = [np.concatenate((x, b.column(i).to_numpy())) for i, x in enumerate(held)]
        band, bucket, key = held
        if not len(key):
            continue
        whole = np.flatnonzero((bucket != bucket[-1]) | (band != band[-1]))
        end = whole[-1] + 1 if len(whole) else 0
        if end:
            yield found(*(x[:end] for x in held), long)
            held, long = [x[end:] for x in held], False
        if len(held[0]) > _LONG:
            yield found(*held, long)
            held, long = [x[-_NEXT:] for x in held], True
    if len(held[0]):
        yield found(*held, long)


def _slot_counts(batches):
    """Of a task's shingles(binary): how many fall in each slot."""
    n = np.zeros(_SLOTS, np.int64)
    for b in batches:
        for s in b.column(0):
            n += np.bincount((np.frombuffer(s.as_buffer(), np.uint64) % np.uint64(_SLOTS)).astype(np.int64), minlength=_SLOTS)
    at = np.flatnonzero(n)
    yield pa.record_batch([pa.array(at), pa.array(n[at])], names=["slot", "n"])


def _early(counts, least: float):
    """From (key, root, shingles): the first n - ceil(least * n) + 1 shingles of each text by the counts of their slots and then by value, and their places. Those alone in a slot are left out."""

    def run(batches):
        f = counts.value
        for b in batches:
            out = []
            for key, root, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                v = np.frombuffer(s.as_buffer(), np.uint64)
                c = f[(v % np.uint64(_SLOTS)).astype(np.int64)]
                first = np.lexsort((v, c))[: len(v) - int(np.ceil(len(v) * least - 1e-6)) + 1]
                at = np.flatnonzero(c[first] > 1)
                out.append((v[first[at]].view(np.int64), np.full(len(at), key), np.full(len(at), root), np.full(len(at), len(v)), at + 1))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out)], names=["shingle", "key", "root", "n", "at"])

    return run


def _verified(least: float):
    def run(batches):
        for b in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in b.column(i)] for i in (2, 3))
            ok = []
            for s, t in zip(x, y):
                both = len(np.intersect1d(s, t, assume_unique=True)) if least * max(len(s), len(t)) <= min(len(s), len(t)) else 0
                ok.append(both >= least * (len(s) + len(t) - both))
            yield pa.record_batch([b.column(0), b.column(1)], names=["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    return run


def _sets_of(docs: DataFrame, prints: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(key, shingles) of the keys of wanted(key)."""
    first = prints.join(wanted, "key", "left_semi").select("first").distinct()
    texts = docs.join(first, F.col("doc_id") == F.col("first"), "left_semi").select("text")
    return materialise(texts.mapInArrow(released(_sets(words)), "key long, shingles binary").join(wanted, "key", "left_semi").groupBy("key").agg(F.min("shingles").alias("shingles")), "sets")


def _compared(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs(src, dst) whose sets(key, shingles) have a Jaccard similarity of least or more."""
    side = lambda c, s: sets.select(F.col("key").alias(c), F.col("shingles").alias(s))
    return pairs.join(side("src", "s"), "src").join(side("dst", "t"), "dst").select("src", "dst", "s", "t").mapInArrow(released(_verified(least)), "src long, dst long")


def _in_bands(prints: DataFrame) -> DataFrame:
    """(band, bucket, next, key, root): a row for each band of prints(key, root, bands)."""
    return prints.where("bands is not null").select("key", "root", "bands").mapInArrow(released(_bands), "band tinyint, bucket long, next long, key long, root long")


def _near(docs: DataFrame, prints: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs(src, dst) of keys of prints(key, first) whose shingles have a Jaccard similarity of least or more; first is a doc_id of docs(doc_id, text) with the key."""
    pairs = materialise(pairs.distinct(), "pairs")
    wanted = pairs.select(F.col("src").alias("key")).union(pairs.select("dst")).distinct()
    return _compared(pairs, _sets_of(docs, prints, wanted, words), least)


def by_fingerprints(prints: DataFrame, radius: int = 4, parts: int = 3) -> DataFrame:
    """(src, dst): pairs of keys of prints(key, fp) that connect all keys whose fingerprints are connected by differences of radius bits or fewer."""
    of = materialise(prints.groupBy("fp").agg(F.min("key").alias("least")), "by_fp")
    side = lambda c: of.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_key"))
    linked = simhash.links(of.select("fp"), radius, parts).join(side("src"), "src").join(side("dst"), "dst").select(F.col("src_key").alias("a"), F.col("dst_key").alias("b"))
    same = prints.join(of, "fp").where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    return linked.unionByName(same).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def by_buckets(prints: DataFrame) -> DataFrame:
    """(src, dst): keys of prints(key, bands) that are paired by their buckets."""
    rows = _in_bands(prints.withColumn("root", F.col("key")))
    dealt = rows.repartition("band", "bucket").sortWithinPartitions("band", "bucket", "next").select("band", "bucket", "key")
    return dealt.mapInArrow(released(_pairs), "src long, dst long")


def _undecided(prints: DataFrame) -> DataFrame:
    """(key, root): the members of buckets of over 32 texts in which prints(key, root, bands) have several roots."""
    rows = _in_bands(prints)
    roots = rows.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    several = materialise(roots.where(f"n > {_SMALL} and lo <> hi").select("band", "bucket"), "several")
    return rows.join(several, ["band", "bucket"], "left_semi").select("key", "root").distinct()


def _joined(sets: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(src, dst): the pairs of sets(key, shingles) with different roots(key, root) that may have a Jaccard similarity of least or more, none of these left out.

    In any one order of all shingles, the first one that such a pair shares is among the n - ceil(least * n) + 1 first of either, and from there on
    each has as many shingles as the two have to share. The order puts rare ones first, by counts of 2^20 slots, whatever the number of shingles.
    Of the texts that share a shingle those of its most frequent root meet the others alone, not one another.
    """
    slots = sets.select("shingles").mapInArrow(released(_slot_counts), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_SLOTS, np.int64)
    counts[slots.column(0).to_numpy()] = slots.column(1).to_numpy()
    sent = sets.sparkSession.sparkContext.broadcast(counts)
    each = sets.join(roots, "key").select("key", "root", "shingles")
    early = materialise(each.mapInArrow(released(_early(sent, least)), "shingle long, key long, root long, n long, at long"), "early")
    most = early.groupBy("shingle", "root").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("roots"))
    several = materialise(most.where("roots > 1").select("shingle", F.col("m.root").alias("_most")), "several")
    early = early.join(several, "shingle")
    x = early.where("root <> _most").select("shingle", *[F.col(c).alias(f"x_{c}") for c in ("key", "root", "n", "at")])
    need = F.ceil((F.col("n") + F.col("x_n")) * (least / (1 + least)) - 1e-6)
    may = (F.col("root") != F.col("x_root")) & (F.least(F.col("n") - F.col("at"), F.col("x_n") - F.col("x_at")) + 1 >= need)
    met = early.join(x, "shingle").where(may)
    return met.select(F.least("key", "x_key").alias("src"), F.greatest("key", "x_key").alias("dst")).distinct()


def _groups(docs: DataFrame, prints: DataFrame, words: int, least: float) -> DataFrame:
    """(key, first, root): prints(key, first, fp, bands), with the smallest key that each is connected with."""
    rooted = lambda comp: prints.join(comp, F.col("key") == F.col("node"), "left").select("key", "first", "bands", F.coalesce("root", "key").alias("root"))
    found = materialise(_near(docs, prints, by_fingerprints(prints).unionByName(by_buckets(prints)), words, least), "links")
    groups = materialise(rooted(components(found)), "groups")
    open_ = materialise(_undecided(groups), "open")
    if open_.isEmpty():
        return groups.drop("bands")
    sets = _sets_of(docs, prints, open_.select("key"), words)
    more = _compared(materialise(_joined(sets, open_, least), "pairs"), sets, least)
    return rooted(components(found.unionByName(more))).drop("bands")


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for every row of docs(doc_id, text) with a doc_id: the smallest doc_id among the near copies that it is connected with."""
    docs = bound_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    every = materialise(docs.mapInArrow(released(_prints(words)), "doc_id long, key long, fp long, bands binary"), "prints")
    prints = materialise(every.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "distinct")
    rooted = _groups(docs, prints, words, least)
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    by_key = rooted.join(ids, F.col("root") == F.col("r")).select(F.col("key").alias("k"), "component_id")
    return every.join(by_key, F.col("key") == F.col("k")).select("doc_id", "component_id")
