"""LM scoring with an n-gram trie in Elias-Fano levels.

The model is interpolated with absolute discounting up to order four: for a context v of one, two or three words,

    p(w | v) = max(c(v w) - D, 0) / c(v) + l(v) p(w | v without its first word),    p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),

over the n-grams of two and more words that occur at least ``least`` times (twice); l(v) is what they leave, 1 for a context that the trie doesn't have.
All words are kept. The trie is cut in segments by the first word's hash. A segment's first level has the 64-bit hashes of its words
and their counts (as sums, which are monotone); a node of a deeper level is a hash relative to its parent, of 40, 32 and 24 bits, found by a successor search among the
parent's children, and each level has monotone pointers to the next. Discounted shares and leftovers are quantised logarithms of 16 bits.

Learning sorts the windows of four words of each map task and shuffles them as packed runs, in which what two windows share is written once, by the first word's segment; those of frequent words, which
would swell one segment, are dealt by their first two words. A bucket's windows give the counts of all orders at once; what is kept of them, and the words' sums, then meet by segment, and each segment becomes a
file in the shared folder. There are as many segments as the learned bytes ask for. Frequent words are found in a bounded sample; which they are changes where counting is done, not what is counted.

Scoring is a map over all documents whose tasks map those files into memory; a folder that isn't mounted is fetched once by
each executor. Only pages that are looked up are read, and executors on a machine share them. Nothing of the size of the corpus is broadcast or comes to the driver.

Cases. A null or empty text is the one token end. Rows without doc_id are scored and not learned from, and held_out. Repeated rows count as often as they
occur. Without training documents N and V are 0, every text has the base p(w) = 1 and score 0. Other columns stay, those named as the results are replaced.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _fs, bound_batches, materialise, scratch, with_fields
from .elias_fano import Sequence, dump, load
from .split import held_out
from .words import END, START, mixed, runs, sequences

U = np.uint64
ORDER = 4
BITS = (40, 32, 24)  # of a child's hash, by level
_RUN = 1 << 22  # bytes of text worked on at once
_RESULTS = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


# ---- windows ---------------------------------------------------------------------------------------------------


def windows(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(second word, third and fourth word) of the window that begins at each place, as children's hashes; 0 for what is beyond a text's end."""
    live = seq != U(END)
    out = []
    for n, bits in enumerate(BITS, 1):
        child = np.zeros(len(seq), U)
        child[: max(0, len(seq) - n)] = np.maximum(seq[n:] >> U(64 - bits), U(1))
        live = live if n == 1 else live & np.concatenate((seq[n - 1 :] != U(END), np.zeros(n - 1, bool)))
        child[~live] = 0
        out.append(child)
    return out[0], (out[1] << U(BITS[2])) | out[2]


def sorted_windows(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """An order that brings windows of the same beginning together, but for rare ties of hashes, and segments in order."""
    return np.argsort((a & ~U((1 << 40) - 1)) | ((b >> U(20)) << U(20)) | ((c >> U(46)) << U(10)) | ((c >> U(14)) & U(1023)))


def starts_of(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """For each order whether a window in a sorted table has other first words than the one before it."""
    differs = lambda x: np.concatenate(([True], x[1:] != x[:-1])) if len(x) else np.zeros(0, bool)
    one = differs(a)
    two = one | differs(b)
    return [one, two, two | differs(c >> U(BITS[2])), two | differs(c)]


# ---- learning --------------------------------------------------------------------------------------------------


def _segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    bits = segments.bit_length() - 1
    return (h >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _slices(keys: np.ndarray):
    """(key, from, to) of the runs of equal keys."""
    edges = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
    return [(int(keys[i]), i, j) for i, j in zip(edges, edges[1:]) if i < j]


def _narrow(x: np.ndarray, bits: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : bits // 8]).ravel()


def _wide(x: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros((len(x) * 8 // bits, 8), np.uint8)
    out[:, : bits // 8] = x.reshape(-1, bits // 8)
    return out.view(U).ravel()


def _least_type(x: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def pack(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> bytes:
    """A run of sorted windows: what is new in each, and the counts of those that occur more than once."""
    s = starts_of(a, b, c)
    at = np.flatnonzero(s[3])
    n = np.diff(np.append(at, len(a)))
    many = np.flatnonzero(n > 1)
    third = c >> U(BITS[2])
    return dump([np.array([len(at)]), a[s[0]], _narrow(b[s[1]], BITS[0]), _narrow(third[s[2]], BITS[1]), _narrow((c & U((1 << BITS[2]) - 1))[at], BITS[2]), *(np.packbits(x[at]) for x in s[:3]), _least_type(many), _least_type(n[many])])


def unpack(run: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, third and fourth words, counts) of a run's windows."""
    n = int(run[0][0])
    one, two, three = (np.cumsum(np.unpackbits(x, count=n).astype(np.int64)) - 1 for x in run[5:8])
    counts = np.ones(n, np.int64)
    counts[run[8]] = run[9]
    return run[1][one], _wide(run[2], BITS[0])[two], (_wide(run[3], BITS[1])[three] << U(BITS[2])) | _wide(run[4], BITS[2]), counts


def _count(segments: int, limit: int, hot: np.ndarray):
    """(segment, packed run) of a task's windows, of limit words at a time."""

    def emit(parts: list[np.ndarray]):
        seq = np.concatenate(parts)
        parts.clear()
        b, c = windows(seq)
        order = sorted_windows(seq, b, c)
        a, b, c = seq[order], b[order], c[order]
        bucket = _segment_of(a, segments)
        groups = [(bucket, a, b, c)]
        if len(hot):
            spread = hot[np.minimum(np.searchsorted(hot, a), len(hot) - 1)] == a
            dealt = _segment_of(mixed(a[spread] ^ (b[spread] * U(0x9E3779B97F4A7C15))), segments)
            by = np.argsort(dealt, kind="stable")
            groups = [tuple(x[~spread] for x in groups[0]), (dealt[by], *(x[spread][by] for x in (a, b, c)))]
        for bucket, a, b, c in groups:
            cut = _slices(bucket)
            for i in range(0, len(cut), 64):
                yield pa.record_batch([pa.array([s for s, _, _ in cut[i : i + 64]], pa.int32()), pa.array([pack(a[x:y], b[x:y], c[x:y]) for _, x, y in cut[i : i + 64]], pa.binary())], names=["segment", "run"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for _, texts in runs(batch.column(0), _RUN):
                parts.append(sequences(texts)[0])
                held += len(parts[-1])
                if held >= limit:
                    yield from emit(parts)
                    held = 0
        if parts:
            yield from emit(parts)

    return run


def _frequent(batches):
    """(hash, n) of the first words of a task's windows."""
    for b in batches:
        for _, texts in runs(b.column(0), _RUN):
            h, n = np.unique(sequences(texts)[0], return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])


def hot_words(learn: DataFrame, segments: int, rows: int, max_docs: int = 10_000) -> np.ndarray:
    """Hashes of words with over a fourth of a segment's mean share of the windows, in about max_docs of the rows of learn(doc_id, text): at most four a segment."""
    low = F.xxhash64("doc_id").bitwiseAND((1 << 52) - 1) / float(1 << 52) < max_docs / max(rows, 1)
    n = learn.where(low).select("text").mapInArrow(_frequent, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = n.orderBy(F.desc("n"), "h").limit(4 * segments).toArrow()
    counts = top["n"].to_numpy()
    floor = n.agg(F.sum("n")).first()[0] or 0
    return np.sort(top["h"].to_numpy()[counts * 4 * segments > floor].view(U))


def quantise(x: np.ndarray) -> np.ndarray:
    """16 bits of a log10 from -16 to 0."""
    return np.clip(np.round(-x * 4096), 0, 65535).astype(np.uint16)


def dequantise(q: np.ndarray) -> np.ndarray:
    return q / -4096.0


def merged(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(first, second, third and fourth words, counts) of runs' windows in their exact order, each once."""
    a, b, c, n = (np.concatenate(x) for x in zip(*rows))
    rows.clear()
    words, place = np.unique(a, return_inverse=True)
    order = np.lexsort((c, (place.astype(U) << U(BITS[0])) | b))
    a, b, c, n = a[order], b[order], c[order], n[order]
    new = np.flatnonzero(starts_of(a, b, c)[3])
    return a[new], b[new], c[new], np.add.reduceat(n, new)


def kept_runs(rows: list[tuple[np.ndarray, ...]], segments: int, least: int) -> list[tuple[int, bytes]]:
    """What one bucket's windows leave for each segment: words and their sums, and level by level the n-grams that occur often enough: children, counts, and how many a parent has."""
    a, b, c, n = merged(rows)
    s = starts_of(a, b, c)
    first = np.flatnonzero(s[0])
    words, sums = a[first], np.add.reduceat(n, first)
    parent, levels = np.cumsum(s[0]) - 1, []  # of each window, at the level above
    for level, start in enumerate(s[1:]):
        child = (b, c >> U(BITS[2]), c & U((1 << BITS[2]) - 1))[level]
        at = np.flatnonzero(start)
        count = np.add.reduceat(n, at)
        keep = (count >= least) & (child[at] != 0) & (parent[at] >= 0)
        group = np.cumsum(start) - 1
        levels.append((child[at[keep]], count[keep], parent[at[keep]]))
        parent = np.where(keep, np.cumsum(keep) - 1, -1)[group]
    out = []
    for segment, i, j in _slices(_segment_of(words, segments)):  # words are in order, and so are their segments
        parts, lo, hi = [words[i:j], sums[i:j]], i, j
        for (child, count, up), bits in zip(levels, BITS):
            x, y = np.searchsorted(up, (lo, hi))
            parts += [_narrow(child[x:y], bits), _least_type(count[x:y]), _least_type(np.bincount(up[x:y] - lo, minlength=hi - lo))]
            lo, hi = x, y
        out.append((segment, dump(parts)))
    return out


def build_segment(rows: list[list[np.ndarray]], discount: float = 0.5) -> tuple[list[np.ndarray], int, int]:
    """(levels, tokens, words) of a segment from what the buckets left for it. A node is in one bucket with all below it; a word may be in several."""
    words = np.unique(np.concatenate([r[0] for r in rows]))
    total = np.zeros(len(words), np.int64)
    spots = [np.searchsorted(words, r[0]) for r in rows]
    for r, p in zip(rows, spots):
        total[p] += r[1]
    parts = Sequence.build(words, 2**64 - 1).parts() + Sequence.build(np.concatenate(([0], np.cumsum(total))), int(total.sum()) + 1).parts()
    above = total
    for level, bits in enumerate(BITS):
        child = np.concatenate([_wide(r[2 + 3 * level], bits) for r in rows])
        count = np.concatenate([r[3 + 3 * level].astype(np.int64) for r in rows])
        up = np.concatenate([np.repeat(p, r[4 + 3 * level]) for r, p in zip(rows, spots)])
        key = (up.astype(U) << U(bits)) | child
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        edges = np.cumsum([0, *(len(r[3 + 3 * level]) for r in rows)])
        spots = [rank[i:j] for i, j in zip(edges, edges[1:])]
        key, count, up = key[order], count[order], up[order]
        codes = quantise(np.log10((count - discount) / above[up]))
        left = np.clip(1 - np.bincount(up, 10 ** dequantise(codes), len(above)), 1e-9, 1)
        pointers = np.concatenate(([0], np.cumsum(np.bincount(up, minlength=len(above)))))
        parts += [quantise(np.log10(left)), *Sequence.build(pointers, len(key) + 1).parts(), *Sequence.build(key, max(1, len(above)) << bits).parts(), codes]
        above = count
    own = words != U(START)
    return parts, int(total[own].sum()), int(own.sum())


def _by_segment(read, one):
    """one(segment, rows) of each segment of a task; there is a task for each segment."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1)):
                held.setdefault(s, []).append(read(load(np.frombuffer(x.as_buffer(), np.uint8).copy())))
        for s in sorted(held):
            yield one(s, held.pop(s))

    return run


def _keep(segments: int, least: int):
    def one(bucket, rows):
        kept = kept_runs(rows, segments, least)
        return pa.record_batch([pa.array([s for s, _ in kept], pa.int32()), pa.array([x for _, x in kept], pa.binary())], names=["segment", "run"])

    return _by_segment(unpack, one)


def _build(discount: float):
    def one(segment, rows):
        levels, tokens, words = build_segment(rows, discount)
        return pa.record_batch([pa.array([segment], pa.int32()), pa.array([tokens], pa.int64()), pa.array([words], pa.int64()), pa.array([dump(levels)], pa.binary())], names=["segment", "tokens", "words", "levels"])

    return _by_segment(lambda x: x, one)


def train(docs: DataFrame, parts: int = 5, part: int = 1, discount: float = 0.5, least: int = 2, chunk: int = 1 << 21, segment_bytes: int = 16_000_000) -> str:
    """Learns from the documents that aren't held out and writes the model: levels/segment=../ with a file for each segment, and the totals."""
    spark = docs.sparkSession
    path = scratch(spark, "lm")
    learn = docs.where(~held_out(F.col("doc_id"), parts, part)).select("doc_id", F.col("text").cast("string").alias("text"))
    size = learn.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    segments = 1 << max(4, (int(size["bytes"]) // segment_bytes).bit_length())
    hot = hot_words(learn, segments, size["rows"])
    found = learn.select("text").mapInArrow(_count(segments, chunk, hot), "segment int, run binary").repartitionById(segments, F.col("segment"))
    kept = found.mapInArrow(_keep(segments, least), "segment int, run binary").repartitionById(segments, F.col("segment"))
    built = materialise(kept.mapInArrow(_build(discount), "segment int, tokens long, words long, levels binary"), "lm-segments")
    # a segment is one row and becomes the bytes of one file
    built.select("segment", F.col("levels").cast("string").alias("levels")).write.partitionBy("segment").text(f"{path}/levels")
    total = built.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
    meta = {"segments": segments, "tokens": total["tokens"] or 0, "words": total["words"] or 0}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")
    return path


# ---- scoring ---------------------------------------------------------------------------------------------------


class Segment:
    """A segment's levels, as views of its file."""

    def __init__(self, raw: np.ndarray):
        p = load(raw)
        sequence = lambda i: Sequence(int(p[i][0]), int(p[i][1]), *p[i + 1 : i + 4])
        self.words, self.sums = sequence(0), sequence(4)
        at = [8 + 10 * i for i in range(len(BITS))]
        self.left, self.pointers, self.children, self.codes = [p[i] for i in at], [sequence(i + 1) for i in at], [sequence(i + 5) for i in at], [p[i + 9] for i in at]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node or -1, count) of each word."""
        node, count = self.words.find(h), np.zeros(len(h), np.int64)
        ok = node >= 0
        count[ok] = (self.sums.get(node[ok] + 1) - self.sums.get(node[ok])).astype(np.int64)
        return node, count

    def leftover(self, level: int, node: np.ndarray) -> np.ndarray:
        """What the children of each node leave; 1 where there is no node."""
        out = np.ones(len(node))
        ok = np.flatnonzero(node >= 0)
        out[ok] = 10 ** dequantise(self.left[level][node[ok]])
        return out

    def child(self, level: int, node: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node or -1, discounted share or 0) of child h under each node. A key leads to its parent's children, whose first and last are the pointers'."""
        to, share = np.full(len(node), -1), np.zeros(len(node))
        own = np.flatnonzero((node >= 0) & (h != 0))
        own = own[self.left[level][node[own]] > 0]  # the others have no children
        if len(own):
            to[own] = self.children[level].find((node[own].astype(U) << U(BITS[level])) | h[own])
            ok = own[to[own] >= 0]
            share[ok] = 10 ** dequantise(self.codes[level][to[ok]])
        return to, share


class Model:
    """The segments' files, mapped into memory when they are first asked."""

    def __init__(self, files: dict[int, str], meta: dict):
        self.files, self.meta, self.open = files, meta, {}

    def segment(self, s: int) -> Segment | None:
        if s not in self.open:
            self.open[s] = Segment(np.asarray(np.memmap(self.files[s], np.uint8, "r"))) if s in self.files else None
        return self.open[s]

    def _walk(self, seq: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """For the window at each place: its first word's count, the shares of its second to fourth word, and what the children of its first to third word leave."""
        b, c = windows(seq)
        order = sorted_windows(seq, b, c)
        a, b, c = seq[order], b[order], c[order]
        starts = starts_of(a, b, c)
        back = lambda start, values: _placed(order, values[np.cumsum(start) - 1])
        at = np.flatnonzero(starts[0])
        count, shares, left = np.zeros(len(at), np.int64), [], []
        node = np.full(len(at), -1)
        cut = _slices(_segment_of(a[at], self.meta["segments"]))
        for s, i, j in cut:
            if self.segment(s) is not None:
                node[i:j], count[i:j] = self.segment(s).find(a[at[i:j]])
        for level in range(ORDER - 1):
            rest = np.ones(len(at))
            for s, i, j in cut:
                if self.segment(s) is not None:
                    rest[i:j] = self.segment(s).leftover(level, node[i:j])
            left.append(back(starts[level], rest))
            up, at = (np.cumsum(starts[level]) - 1)[starts[level + 1]], np.flatnonzero(starts[level + 1])
            child = (b, c >> U(BITS[2]), c & U((1 << BITS[2]) - 1))[level][at]
            above, node, share = node[up], np.full(len(at), -1), np.zeros(len(at))
            cut = [(s, *np.searchsorted(up, (i, j)).tolist()) for s, i, j in cut]
            for s, i, j in cut:
                if self.segment(s) is not None:
                    node[i:j], share[i:j] = self.segment(s).child(level, above[i:j], child[i:j])
            shares.append(back(starts[level + 1], share))
        return back(starts[0], count), shares, left

    def score(self, seq: np.ndarray, n: np.ndarray):
        """(tokens, known tokens, base, score) of each text of words.sequences."""
        if not self.meta["tokens"]:
            return n + 1, np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n))
        total = self.meta["tokens"] + 0.5 * (self.meta["words"] + 1)
        count, shares, left = self._walk(seq)
        base = (count + 0.5) / total
        p, doc = base.copy(), np.repeat(np.arange(len(n)), n + 2)
        for k, (share, rest) in enumerate(zip(shares, left), 1):  # a context of k words before each; windows end with their text
            p[k:] = share[:-k] + rest[:-k] * p[k:] if k == 1 else np.where(doc[k:] == doc[:-k], share[:-k] + rest[:-k] * p[k:], p[k:])
        start = np.cumsum(n + 2) - n - 2
        known, base, p = (count > 0).astype(np.float64), np.log10(base), np.log10(p)
        known[start] = base[start] = p[start] = 0
        add = lambda x: np.add.reduceat(x, start)
        return n + 1, add(known).astype(np.int64), add(base), add(p)


def _placed(order: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(values), values.dtype)
    out[order] = values
    return out


@cache
def _model(files: tuple[tuple[int, str], ...], meta: str, folder: str | None) -> Model:
    if folder:
        from pyspark import SparkFiles

        files = tuple((s, SparkFiles.get(f"{folder}/{name}")) for s, name in files)
    return Model(dict(files), json.loads(meta))


def _score(files, meta: str, folder: str | None, text_at: int, schema: pa.Schema):
    def run(batches):
        m = _model(files, meta, folder)
        for b in batches:
            for first, texts in runs(b.column(text_at), _RUN):
                n, known, base, score = m.score(*sequences(texts))
                own = [c.slice(first, len(texts)) for i, c in enumerate(b.columns) if i != text_at]
                yield pa.record_batch([*own, pa.array(n), pa.array(known), pa.array(np.full(len(n), m.meta["tokens"])), pa.array(base), pa.array(score)], schema=schema)

    return run


def _files(spark: SparkSession, path: str) -> tuple[tuple[tuple[int, str], ...], str | None]:
    """Segments' files as paths that executors can map: those of a mounted folder, or else the names under one that each executor fetches."""
    fs, p = _fs(spark, f"{path}/levels")
    p = fs.makeQualified(p)
    found = []
    for d in fs.listStatus(p):
        name = d.getPath().getName()
        if name.startswith("segment="):
            found += [(int(name[8:]), f.getPath()) for f in fs.listStatus(d.getPath()) if f.getPath().getName().startswith("part-")]
    if p.toUri().getScheme() == "file":
        return tuple(sorted((s, f.toUri().getPath()) for s, f in found)), None
    spark.sparkContext.addFile(p.toString(), recursive=True)
    return tuple(sorted((s, f"segment={s}/{f.getName()}") for s, f in found)), p.getName()


def score(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score in place of text, by the model at path."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score").withColumn("text", F.col("text").cast("string"))
    schema = with_fields(docs.drop("text"), _RESULTS)
    meta = spark.read.text(f"{path}/meta").first()[0]
    files, folder = _files(spark, path)
    return docs.mapInArrow(_score(files, meta, folder, docs.columns.index("text"), to_arrow_schema(schema)), schema)


def train_and_score(docs: DataFrame, parts: int = 5, part: int = 1) -> DataFrame:
    marked = bound_batches(docs, "16m").drop("held_out").withColumn("held_out", held_out(F.col("doc_id"), parts, part))
    return score(marked, train(docs, parts, part))
