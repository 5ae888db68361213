"""Language identification by bit-sliced Bloom filters.

Position p of the filter holds a bit for each language; a lookup of an n-gram ANDs the words at its positions and
so returns all languages that contain it. A text's hits per language, corrected for each slice's rate of false
positives, decide. An n-gram belongs to a language if at least min_share of its training documents (and two, where it has two) hold it.

N-grams are three characters around a letter, of the lower-cased text with every other character as a blank.
Learning reads whole texts of a bounded sample of about max_docs documents a language, those whose ids hash lowest; the filter has a fixed
number of positions. Prediction is a map over all documents.

Cases. A text that is null or has no letters is ``und`` with score 0; so is every text where nothing could be
learned. Rows without lang or doc_id aren't learned from. Ties, and texts without any known n-gram, go to the
language with the most training documents, then the smallest name. Repeated rows count as often as they occur. Other columns stay.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, with_fields
from .split import held_out

BITS, HASHES, WORD = 18, 3, 62
_PIECE = 1 << 19


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, 64-bit hash) of each n-gram of an array of code points that has a blank at both ends."""
    ok = _letters()[code]
    a = np.where(ok, code, 0).astype(np.uint64)
    at = np.flatnonzero(ok[1:-1]) + 1
    with np.errstate(over="ignore"):
        h = (a[at - 1] << np.uint64(42)) ^ (a[at] << np.uint64(21)) ^ a[at + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        h ^= h >> np.uint64(33)
    return at, h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _texts(column):
    """(document, code points with a blank at both ends) in pieces of bounded size; pieces of one text overlap so that each n-gram is in one of them."""
    for i, t in enumerate(column):
        if (text := t.as_py()) is not None:
            code = np.concatenate(([32], _codes(text.lower()), [32])).astype(np.uint32)
            for a in range(0, max(1, len(code) - 2), _PIECE):
                yield i, code[a : a + _PIECE + 2]


def _joined(column):
    """(code points, index of the document of each) of several texts at once."""
    parts, docs, held = [], [], 0
    for i, code in _texts(column):
        parts.append(code)
        docs.append(i)
        held += len(code)
        if held >= _PIECE:
            yield np.concatenate(parts), np.repeat(docs, [len(p) for p in parts])
            parts, docs, held = [], [], 0
    if parts:
        yield np.concatenate(parts), np.repeat(docs, [len(p) for p in parts])


def _document_grams(batches):
    """(lang, gram, documents) of each task, each n-gram once a document."""
    for b in batches:
        own: dict[int, list] = {}
        for i, t in enumerate(b.column(1)):
            one = [np.unique(grams(code)[1]) for _, code in _texts([t])]
            own.setdefault(b.column(0)[i].as_py(), []).append(np.unique(np.concatenate(one)) if one else np.array([], np.uint64))
        for lang, found in own.items():
            g, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.record_batch([pa.array(np.full(len(g), lang, np.int32)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang_no", "gram", "docs"])


class Model:
    """langs in order; table[p, w]: the languages that have an n-gram at position p, in words of WORD bits."""

    def __init__(self, langs: list[str], docs: list[int], table: np.ndarray):
        self.langs, self.table = langs, table
        self.false = np.array([((table[:, i // WORD] >> (i % WORD) & 1).mean()) ** HASHES for i in range(len(langs))])
        self.order = np.array(sorted(range(len(langs)), key=lambda i: (-docs[i], langs[i])), dtype=np.int64)

    def hits(self, column, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, hits by language) of each of n texts."""
        total, hit = np.zeros(n), np.zeros((n, len(self.langs)))
        for code, doc in _joined(column):
            at, h = grams(code)
            d = doc[at]
            found = self.table[(h & np.uint64((1 << BITS) - 1)).astype(np.int64)]
            for k in range(1, HASHES):
                found = found & self.table[(h >> np.uint64(k * 21) & np.uint64((1 << BITS) - 1)).astype(np.int64)]
            total += np.bincount(d, minlength=n)
            for i in range(len(self.langs)):
                hit[:, i] += np.bincount(d[(found[:, i // WORD] >> (i % WORD) & 1).astype(bool)], minlength=n)
        return total, hit

    def predict(self, column, n: int) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        total, hit = self.hits(column, n)
        right = np.clip((hit - total[:, None] * self.false) / (1 - self.false + 1e-12), 0, None)
        best, every = self.order[right[:, self.order].argmax(axis=1)], right.sum(axis=1)
        score = np.where(every > 0, right.max(axis=1) / np.maximum(every, 1e-12), 1 / len(self.langs))
        return [self.langs[b] if t else "und" for b, t in zip(best, total)], np.where(total > 0, np.clip(score, 0, 1), 0.0)


def train(docs: DataFrame, parts: int = 4, part: int = 2, max_docs: int = 4000, min_share: float = 0.01) -> Model:
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), parts, part))
    sizes = sorted((r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect())
    langs = [lang for lang, _ in sizes]
    table = np.zeros((1 << BITS, max(1, -(-len(langs) // WORD))), np.int64)
    if langs:
        spark = docs.sparkSession
        share = spark.createDataFrame([(lang, i, min(1.0, max_docs / n), int(max(min(2, n), min_share * min(n, max_docs)))) for i, (lang, n) in enumerate(sizes)], "lang string, lang_no int, share double, least long")
        low = (F.xxhash64("doc_id").bitwiseAND((1 << 52) - 1) / float(1 << 52)) < F.col("share")
        sample = known.join(F.broadcast(share), "lang").where(low).select("lang_no", "text")
        counts = sample.mapInArrow(_document_grams, "lang_no int, gram long, docs long").groupBy("lang_no", "gram").agg(F.sum("docs").alias("docs"))
        member = counts.join(F.broadcast(share.select("lang_no", "least")), "lang_no").where("docs >= least")
        masks = member.groupBy("gram", F.floor(F.col("lang_no") / WORD).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, lang_no % {WORD})")).alias("mask"))
        spots = F.array(*[F.shiftrightunsigned("gram", k * 21).bitwiseAND((1 << BITS) - 1) for k in range(HASHES)])
        rows = masks.select("w", "mask", F.explode(spots).alias("p")).groupBy("p", "w").agg(F.bit_or("mask").alias("mask")).toArrow()
        table[rows["p"].to_numpy(), rows["w"].to_numpy()] = rows["mask"].to_numpy()
    return Model(langs, [n for _, n in sizes], table)


def _predict(sent, text_at: int, schema: pa.Schema):
    def run(batches):
        for b in batches:
            lang, score = sent.value.predict(b.column(text_at), b.num_rows)
            yield pa.record_batch([*b.columns, pa.array(lang, pa.string()), pa.array(score)], schema=schema)

    return run


def identify(docs: DataFrame, parts: int = 4, part: int = 2, max_docs: int = 4000, min_share: float = 0.01) -> DataFrame:
    """docs with held_out, lang_pred and score."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = bound_batches(docs).drop("held_out", "lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, parts, part, max_docs, min_share))
    docs = docs.withColumn("held_out", held_out(F.col("doc_id"), parts, part)).drop("lang")
    schema = with_fields(docs, "lang_pred string, score double")
    return docs.mapInArrow(_predict(sent, docs.columns.index("text"), to_arrow_schema(schema)), schema)
