"""Benchmark decontamination by template canonicalisation.

Every word becomes a token in two readings. In the typed one numbers, names (words with a capital) and units are
placeholders; in the plain one only numbers are, and the rest is in lower case. Windows of five tokens of either
reading are joined by hash with the benchmark's windows. An item is in a document if, in some stretch of
it, at least 0.8 of the item's windows are found whose slots are filled consistently: each value in the item stands
for one value in the document. That finds copies, and questions with other numbers, names or units in them.

Documents are read by a map that emits the windows that pass a filter of fixed size, made of the benchmark's windows; only these are shuffled, keyed by the SHA-256 of their
text, so that copies of a text are judged once. The benchmark is a table like any other and may be of any size: nothing depends on it but how many windows pass. Results come
back by the text's key; rows whose key isn't among them stay where they are, and results of texts with very many copies are broadcast.

Cases. Null texts on either side hold nothing. Items of fewer tokens than a window are found only in documents of
just these tokens; items without tokens never. Windows with fewer than two words that are no placeholders don't count in
the typed reading. Rows that repeat an item_id are items of their own under one id; rows without one don't count. Each row has the result of its own text, whatever
its doc_id: null and repeated ids are like others. Extra columns stay, those named as the results are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, in_ids, materialise, released

# Units that become a placeholder.
UNITS = frozenset(
    "km cm mm kg mg lb lbs oz ml kb mb gb tb hz khz mhz ghz kwh mph kph meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams kilogram "
    "kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees".split()
)
NUMBER, NAME, UNIT = "\x01n", "\x01p", "\x01u"
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(?:st|nd|rd|th|e[+-]?\d+)?")
_GLUED = re.compile(r"(?<=\d)(?=(?:km|cm|mm|kg|mg|lbs?|oz|ml|kb|mb|gb|tb|k?hz|mhz|ghz|kwh|mph|kph)\b)", re.IGNORECASE)
_DIGIT = re.compile(r"\d")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_COMMON = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_A, _SOME, _GATE = np.uint64(0x9E3779B97F4A7C15), 1 << 19, 25
_TYPED, _PLAIN, _SHORT = 0, 1, 2  # readings; the last is a whole text of fewer tokens than a window


def canonical(word: str) -> tuple[str, str, str]:
    """(typed, plain, value) tokens of a word; empty where it has no letter or digit."""
    core = word.strip(_COMMON)
    if not core or not (core[0].isalnum() and core[-1].isalnum()):
        core = _EDGES.sub("", core)
        if not core:
            return "", "", ""
    low = core.lower()
    if core[0].isdigit() and _NUMBER.fullmatch(low):
        return NUMBER, NUMBER, low
    if low in UNITS:
        return UNIT, low, low
    return (NAME if core[0].isupper() else low), low, low


def words_of(text: str | None) -> list[str]:
    text = text or ""
    return (_GLUED.sub(" ", text) if _DIGIT.search(text) else text).split()


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) | 1


class _Vocabulary(dict):
    """Numbers of words, and for each number the hashes of its tokens; starts anew when it has grown to its limit."""

    def __init__(self, limit: int = 200_000):
        self.limit = limit
        self._empty()

    def _empty(self):
        self.clear()
        self.new: list[tuple[int, int]] = []
        self.known = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def __missing__(self, word: str) -> int:
        typed, plain, _ = canonical(word)
        h = _hash(plain) if plain else 0
        self.new.append((h if typed is plain else _hash(typed), h) if plain else (0, 0))
        self[word] = n = len(self)
        return n

    def arrays(self, words: list[list[str]]) -> tuple[np.ndarray, ...]:
        """(typed hash, plain hash, document, place among its words) of all tokens of texts."""
        if len(self) > self.limit:
            self._empty()
        n = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        if self.new:
            self.known = tuple(np.concatenate((old, np.array(new, old.dtype))) for old, new in zip(self.known, zip(*self.new)))
            self.new = []
        typed, plain = self.known[0][ids], self.known[1][ids]
        doc, ok = np.repeat(np.arange(len(words)), n), plain != 0
        place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        return (typed, plain, doc, place) if ok.all() else (typed[ok], plain[ok], doc[ok], place[ok])


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size tokens."""
    with np.errstate(over="ignore"):
        out = h[: len(h) - size + 1].copy() if len(h) >= size else h[:0]
        for i in range(1, size):
            out = out * _A + h[i : i + len(out)]
            out ^= out >> np.uint64(29)
    return out


def _sequence(tokens: list[str]) -> int:
    return xxhash.xxh64_intdigest("\x02".join(tokens).encode("utf-8", "surrogatepass"))


# ---- the benchmark's windows -----------------------------------------------------------------------------------

_WINDOWS = "h long, reading tinyint, item long, item_id long, place int, total int, length int, slots array<string>"


def item_windows(text: str, size: int):
    """(hash, reading, place, windows of the reading, tokens, slots) of an item's windows, each hash once; a slot is its placeholder and value, or empty."""
    tokens = [c for w in words_of(text) if (c := canonical(w))[1]]
    if tokens and len(tokens) < size:
        yield _sequence([t[1] for t in tokens]), _SHORT, 0, 1, len(tokens), []
    for r in (_TYPED, _PLAIN) if len(tokens) >= size else ():
        h = windows(np.array([_hash(t[r]) for t in tokens], np.uint64), size).tolist()
        first = {x: at for at, x in reversed(list(enumerate(h)))}  # a window that an item repeats counts once
        kept = [(x, at) for x, at in first.items() if r == _PLAIN or sum(t[0][:1] != "\x01" for t in tokens[at : at + size]) >= 2]
        for x, at in kept:
            yield x, r, at, len(kept), len(tokens), [f"{t[r]}\x00{t[2]}" if t[r][:1] == "\x01" else "" for t in tokens[at : at + size]]


def _item_rows(size: int):
    def run(batches):
        for b in batches:
            rows = [(h - (1 << 64) if h >> 63 else h, r, n, i, at, total, length, slots) for n, i, t in zip(*(b.column(k).to_pylist() for k in range(3))) for h, r, at, total, length, slots in item_windows(t, size)]
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["h", "reading", "item", "item_id", "place", "total", "length", "slots"])

    return run


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    return materialise(items.mapInArrow(released(_item_rows(size)), _WINDOWS), "windows")


def gate_of(of_items: DataFrame) -> np.ndarray:
    """A filter of fixed size that every window of of_items passes: two bits a hash."""
    n = 1 << _GATE
    spots = of_items.select(F.explode(F.array(F.pmod("h", F.lit(n)), F.shiftrightunsigned("h", 32).bitwiseAND(n - 1))).alias("p"))
    rows = spots.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()  # at most n / 64 rows
    words = np.zeros(n >> 6, np.int64)
    words[rows["w"].to_numpy()] = rows["bits"].to_numpy()
    return words.view(np.uint64)


# ---- documents -------------------------------------------------------------------------------------------------


def passes(gate: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in h of hashes that the filter lets through."""
    mask = np.uint64((1 << _GATE) - 1)
    bit = lambda p: (gate[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    at = np.flatnonzero(bit(h & mask))
    return at[bit(h[at] >> np.uint64(32) & mask)]


def _hits(sent, size: int):
    """(key, h, reading, place, values of its placeholders) of the documents' windows that the filter lets through."""
    names = ["key", "h", "reading", "at", "said"]

    def run(batches):
        gate, vocabulary = sent.value, _Vocabulary()
        for b in batches:
            first = 0
            while first < b.num_rows:
                texts, held = [], 0
                for t in b.column(1)[first:]:
                    texts.append(t.as_py() or "")
                    held += len(texts[-1])
                    if held >= _SOME:
                        break
                words = [words_of(t) for t in texts]
                typed, plain, doc, place = vocabulary.arrays(words)
                starts, out = np.searchsorted(doc, np.arange(len(texts) + 1)), []
                if len(doc) >= size:
                    whole = doc[: len(doc) - size + 1] == doc[size - 1 :]
                    for r, h in ((_TYPED, typed), (_PLAIN, plain)):
                        w = windows(h, size)
                        at = passes(gate, w)
                        for a in at[whole[at]].tolist():
                            d = int(doc[a])
                            tokens = [canonical(words[d][i]) for i in place[a : a + size].tolist()]
                            out.append((d, int(w[a]), r, a - int(starts[d]), [t[2] if t[r][:1] == "\x01" else "" for t in tokens]))
                counts = np.diff(starts)
                for d in np.flatnonzero((counts > 0) & (counts < size)).tolist():
                    x = _sequence([c[1] for w in words[d] if (c := canonical(w))[1]])
                    if len(passes(gate, np.array([x], np.uint64))):
                        out.append((d, x, _SHORT, 0, []))
                keys = b.column(0).slice(first, len(texts))
                d, h, r, a, said = zip(*out) if out else [()] * 5
                yield pa.record_batch([keys.take(pa.array(d, pa.int64())), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(r, pa.int8()), pa.array(a, pa.int32()), pa.array(said, pa.list_(pa.string()))], names=names)
                first += len(texts)

    return run


def judge(pairs: list[tuple[int, int, list[str], list[str]]], total: int, length: int, size: int) -> tuple[float, bool]:
    """(share of an item's windows that one stretch of a document holds consistently, whether values differ), from (place in the document, place in the item, the document's values, the item's slots) of windows."""
    pairs.sort(key=lambda p: p[:2])
    places, best, kept, span = [p[0] for p in pairs], 0, False, length + length // 2
    for start, place in enumerate(places):
        if best >= total:
            break
        stretch = pairs[start : bisect_right(places, place + span)]
        if len({p[1] for p in stretch}) > best:
            good, differs = _consistent(stretch)
            if good > best:
                best, kept = good, differs
    return best / total, kept


def _consistent(pairs: list[tuple[int, int, list[str], list[str]]]) -> tuple[int, bool]:
    """How many of the item's windows are filled in line with the commonest reading of each slot value, and whether any value differs."""
    means: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    filled = [[(s, v) for v, s in zip(said, slots) if s] for _, _, said, slots in pairs]
    for own in filled:
        for slot, value in own:
            means[slot][value] += 1
    chosen = {slot: max(v.items(), key=lambda x: (x[1], x[0] == slot.split("\x00")[1], x[0]))[0] for slot, v in means.items()}
    good = {p[1] for p, own in zip(pairs, filled) if all(chosen[s] == v for s, v in own)}
    return len(good), any(s.split("\x00")[1] != v for s, v in chosen.items())


def _judged(size: int, share: float):
    """(key, item_id, cover, differs, copies) of the items that a text holds, from joined windows sorted by text, item and reading. Only a group that goes on in the next batch is carried over."""
    names = ["key", "item_id", "cover", "differs", "copies"]

    def run(batches):
        last, pairs, found, info = None, [], {}, None

        def close():
            key, item, r = last
            total, length, item_id, copies = info
            if r == _SHORT:
                result = (1.0, False)
            elif len({p[1] for p in pairs}) < share * total:
                return
            else:
                result = judge(pairs, total, length, size)
            old = found.get((key, item))
            if result[0] >= share and (old is None or (result[0], not result[1]) > (old[1], not old[2])):
                found[key, item] = (item_id, *result, copies)

        def rows():
            out = [(key, *v) for (key, _), v in found.items()]
            found.clear()
            columns = list(zip(*out)) or [()] * 5
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.float64(), pa.bool_(), pa.int64()))], names=names)

        for b in batches:
            for key, item, r, item_id, at, place, said, slots, total, length, copies in zip(*(b.column(i).to_pylist() for i in range(11))):
                if (key, item, r) != last:
                    if last is not None:
                        close()
                        if last[0] != key and len(found) >= 1000:
                            yield rows()
                    last, pairs, info = (key, item, r), [], (total, length, item_id, copies)
                pairs.append((at, place, said, slots))
        if last is not None:
            close()
        yield rows()

    return run


def items_in(texts: DataFrame, of_items: DataFrame, size: int = 5, share: float = 0.8) -> DataFrame:
    """(key, item_ids, reparameterised, coverage, copies) of the texts(key, text) that hold items."""
    sent = texts.sparkSession.sparkContext.broadcast(gate_of(of_items))
    hits = texts.mapInArrow(released(_hits(sent, size)), "key binary, h long, reading tinyint, at int, said array<string>")
    once = hits.groupBy("key", "h", "reading", "at").agg(F.first("said").alias("said"), F.count("*").alias("copies"))
    joined = once.join(of_items, ["h", "reading"]).select("key", "item", "reading", "item_id", "at", "place", "said", "slots", "total", "length", "copies")
    found = joined.repartition("key", "item").sortWithinPartitions("key", "item", "reading").mapInArrow(released(_judged(size, share)), "key binary, item_id long, cover double, differs boolean, copies long")
    return found.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.array_sort(F.collect_set(F.when(F.col("differs"), F.col("item_id")))).alias("reparameterised"), F.max("cover").alias("coverage"), F.max("copies").alias("copies"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 5, share: float = 0.8, keep_text: bool = False, many: int = 10_000) -> DataFrame:
    """docs with contaminated, item_ids (items found), reparameterised (those of them with other values in their slots) and coverage (the largest share), without text unless keep_text.

    The results of texts with over many copies, and over a thousandth of all copies, are broadcast: these are at most a thousand.
    """
    docs = bound_batches(docs).drop("contaminated", "item_ids", "reparameterised", "coverage", "_key").withColumn("text", F.col("text").cast("string"))
    keyed = docs.withColumn("_key", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    found = materialise(items_in(keyed.select(F.col("_key").alias("key"), "text"), benchmark_windows(benchmark, size), size, share), "matches")
    columns = [c for c in docs.columns if keep_text or c != "text"]
    clear, rest = in_ids(keyed.select(*columns, "_key"), found.select(F.col("key").alias("_id")), "_key")
    none = F.array().cast("array<long>")
    results = lambda ok, items, other, cover: (*columns, ok.alias("contaminated"), items.alias("item_ids"), other.alias("reparameterised"), cover.alias("coverage"))
    clear = clear.select(*results(F.lit(False), none, none, F.lit(0.0)))
    floor = max(many, (found.agg(F.sum("copies")).first()[0] or 0) // 1000)
    hot = found.where(F.col("copies") > floor)
    own = found.select(F.col("key").alias("_k"), *(F.col(c).alias(f"_{c}") for c in ("item_ids", "reparameterised", "coverage", "copies")))
    told = lambda d: results(F.col("_item_ids").isNotNull(), F.coalesce("_item_ids", none), F.coalesce("_reparameterised", none), F.coalesce("_coverage", F.lit(0.0)))
    if hot.isEmpty():
        joined = rest.join(own, F.col("_key") == F.col("_k"), "left")
        return clear.unionByName(joined.select(*told(joined)))
    often = F.broadcast(own.where(F.col("_copies") > floor))
    same = F.col("_key") == F.col("_k")
    first = rest.join(often, same)
    others = rest.join(F.broadcast(hot.select(F.col("key").alias("_k"))), same, "left_anti").join(own, same, "left")
    return clear.unionByName(first.select(*told(first))).unionByName(others.select(*told(others)))
