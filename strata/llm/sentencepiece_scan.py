"""SentencePiece encoding and decoding, with a max-plus parallel scan over the chunks of giant documents.

A text is a path through the lattice of its pieces. A giant document is cut into chunks. What one chunk has to know of its neighbours is the state at a
cut: where the piece over the cut ends and, for merge models, which piece it is. Each chunk yields the matrix of best path
scores from every state at its first cut to every state at its last; max-plus products of these matrices settle
the states at all cuts; each chunk then traces its own pieces back between its two states, alone.

For unigram models a path may take any pieces and the best sum of scores is the encoding. For merge (BPE) models, such as the public
vocabulary that the query uses, the sum of scores doesn't decide: a sequence is the encoding exactly if each two
neighbouring pieces are the encoding of their joint text. The lattice then has only arcs between such pieces, at most one
path links two states, and all other entries are minus infinity. Either way the ids are those of the sentencepiece library.

Cuts are put where two characters meet that no piece holds side by side, if there is such a place near; there is one state there.
Stretches between two such places are encoded by the library; the lattice is walked only in stretches without one, such as long runs without blanks.

Cases. A null or empty text has no ids. Texts may hold any characters, control pieces' names are ordinary text, and unknown characters become byte pieces. U+2581 and a blank
are the same to the model, so U+2581 reads back as a blank and round_trip is false. Equal giant texts are encoded once; repeated rows each have their row. Extra columns stay, those named as the results are replaced.
"""

from __future__ import annotations

import hashlib
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, materialise, released, with_fields

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
_NONE = float("-inf")
_SLICE = 1 << 20
_ROWS = 32
_RESULTS = "n_tokens long, round_trip boolean, token_ids array<int>"


class Model:
    """Pieces and scores of a model file, and the library's processor of it."""

    def __init__(self, proto: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(proto)
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or not n.add_dummy_prefix:
            raise ValueError("only models that keep the text as it is and mark blanks are supported")
        if m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and merge models are supported")
        self.merges = m.trainer_spec.model_type == 2
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (1, 4)}
        self.score = {p.piece: p.score for p in m.pieces if p.type in (1, 4)}
        self.unknown = min(self.score.values()) - 10
        self.longest = max(map(len, self.id))
        self.inside = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.unk = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else m.trainer_spec.unk_surface.encode() if p.type == 2 else p.piece.replace(BLANK, " ").encode() for p in m.pieces]
        self._fit: dict[tuple[str, str], bool] = {}

    def merge(self, s: str) -> list[str]:
        """Merge encoding of a short string: again and again the best-scored neighbours, the leftmost of equals."""
        x = list(s)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(x, x[1:])) if a + b in self.score), default=None)
            if best is None:
                return x
            i = -best[1]
            x[i : i + 2] = [x[i] + x[i + 1]]

    def fits(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a, or any piece if a is empty."""
        if not self.merges:
            return True
        if (a, b) not in self._fit:
            if len(self._fit) > 100_000:
                self._fit.clear()
            self._fit[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return self._fit[a, b]

    def ids(self, piece: str) -> list[int]:
        if piece in self.id:
            return [self.id[piece]]
        return [self.bytes.get(x, self.unk) for x in piece.encode("utf-8", "replace")] if self.bytes else [self.unk]

    def decode(self, ids) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@cache
def model(proto: bytes) -> Model:
    return Model(proto)


def read_model(spark: SparkSession, path: str = MODEL) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


# ---- one chunk -------------------------------------------------------------------------------------------------
# s: a slice of the marked text; states are (end, piece) with end a place in s; ("" for any piece, at safe cuts and for unigram models)


def _safe(m: Model, s: str, i: int) -> bool:
    return i <= 0 or i >= len(s) or s[i - 1 : i + 1] not in m.inside


def _arcs(m: Model, s: str, i: int):
    for n in range(1, min(m.longest, len(s) - i) + 1):
        if n == 1 or s[i : i + n] in m.id:
            yield s[i : i + n]


def states(m: Model, s: str, cut: int) -> list[tuple[int, str]]:
    """All that may be at a cut: the one state of a safe cut, or each piece over or ending at the cut."""
    if _safe(m, s, cut):
        return [(cut, "")]
    found = {(a + len(p), p) for a in range(max(0, cut - m.longest), cut) for p in _arcs(m, s, a) if a + len(p) >= cut}
    return sorted(found if m.merges else {(e, "") for e, _ in found})


def _walk(m: Model, s: str, state: tuple[int, str], stop: int) -> dict[int, tuple[float, str, int]]:
    """From a state, for each place that a path reaches before one goes beyond stop: (best score, last piece, place before it)."""
    at = {state[0]: (0.0, state[1], -1)}
    for i in range(state[0], stop):
        if i in at:
            score, last, _ = at[i]
            for p in _arcs(m, s, i):
                if m.fits(last, p):
                    x = score + m.score.get(p, m.unknown)
                    if i + len(p) not in at or x > at[i + len(p)][0]:
                        at[i + len(p)] = (x, p if m.merges else "", i)
    return at


def _trace(s: str, at: dict, end: int) -> list[str]:
    out = []
    while at[end][2] >= 0:
        out.append(s[at[end][2] : end])
        end = at[end][2]
    return out[::-1]


def _safe_places(m: Model, s: str, lo: int, hi: int) -> tuple[int, int] | None:
    """The first and the last safe place from lo to hi."""
    first = next((i for i in range(lo, hi + 1) if _safe(m, s, i)), None)
    return None if first is None else (first, next(i for i in range(hi, lo - 1, -1) if _safe(m, s, i)))


def transfer(m: Model, s: str, lo: int, hi: int) -> list[tuple[int, int, float]]:
    """Entries above minus infinity of the chunk's matrix: (state at lo, state at hi, score). Scores of the stretch between its safe places are left out, as every path shares it."""
    enter, leave = states(m, s, lo), states(m, s, hi)
    places = _safe_places(m, s, lo, hi)
    out = []
    if places is None:
        for i, x in enumerate(enter):
            at = _walk(m, s, x, hi)
            out += [(i, j, at[e][0]) for j, (e, p) in enumerate(leave) if e in at and (not p or p == at[e][1] or not m.merges)]
        return out
    first, last = places
    head = [0.0 if x[0] == first else _walk(m, s, x, first).get(first, (_NONE,))[0] for x in enter]
    tail = _walk(m, s, (last, ""), hi)
    ends = [tail[e][0] if e in tail and (not p or p == tail[e][1] or not m.merges) else _NONE for e, p in leave]
    return [(i, j, a + b) for i, a in enumerate(head) for j, b in enumerate(ends) if a + b > _NONE]


def product(a: list[tuple[int, int, float]], b: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Max-plus product of two matrices; associative."""
    rows: dict[int, list] = {}
    for j, k, y in b:
        rows.setdefault(j, []).append((k, y))
    best: dict[tuple[int, int], float] = {}
    for i, j, x in a:
        for k, y in rows.get(j, ()):
            best[i, k] = max(best.get((i, k), _NONE), x + y)
    return [(i, k, v) for (i, k), v in sorted(best.items())]


def settle(matrices: list[list[tuple[int, int, float]]]) -> list[tuple[int, int]]:
    """The states at both cuts of each chunk on the best path from the text's start to its end."""
    prefix, at = [], None
    for x in matrices:
        at = x if at is None else product(at, x)
        prefix.append({j: v for i, j, v in at if i == 0})
    out, right = [], 0
    for n in range(len(matrices) - 1, -1, -1):
        into = {0: 0.0} if n == 0 else prefix[n - 1]
        left = max((into[i] + v, -i) for i, j, v in matrices[n] if j == right and i in into)[1] * -1
        out.append((left, right))
        right = left
    return out[::-1]


def backtrace(m: Model, s: str, lo: int, hi: int, enter: int, leave: int) -> list[int]:
    """Ids of the pieces after the one over lo up to the one over hi."""
    x, (end, _) = states(m, s, lo)[enter], states(m, s, hi)[leave]
    places = _safe_places(m, s, lo, hi)
    if places is None:
        return [i for p in _trace(s, _walk(m, s, x, hi), end) for i in m.ids(p)]
    first, last = places
    head = _trace(s, _walk(m, s, x, first), first) if x[0] < first else []
    tail = _trace(s, _walk(m, s, (last, ""), hi), end) if last < end else []
    return [i for p in head for i in m.ids(p)] + _between(m, s[first:last]) + [i for p in tail for i in m.ids(p)]


def _between(m: Model, s: str) -> list[int]:
    """Ids of a stretch between safe places. The library puts a mark before what it encodes, so it gets what starts with one; a start without is walked up to the first safe mark."""
    if not s:
        return []
    mark = next((i for i in range(len(s)) if s[i] == BLANK and _safe(m, s, i)), len(s))
    ids = [i for p in _trace(s[:mark], _walk(m, s[:mark], (0, ""), mark), mark) for i in m.ids(p)]
    if mark + 1 == len(s):  # the library takes an empty text for none at all
        return ids + m.ids(BLANK)
    return ids + (m.library.encode(s[mark + 1 :].replace(BLANK, " ")) if mark < len(s) else [])


def cut_places(m: Model, s: str, size: int, near: int = 512) -> list[int]:
    """Cuts of a marked text about every size characters, at the last safe mark, else the last safe place, of the near characters before."""
    cuts = [0]
    while len(s) - cuts[-1] > size:
        end = cuts[-1] + size
        window = range(end, max(end - near, cuts[-1]), -1)
        cuts.append(next((i for i in window if s[i] == BLANK and _safe(m, s, i)), None) or next((i for i in window if _safe(m, s, i)), end))
    return [*cuts, len(s)]


# ---- tables ----------------------------------------------------------------------------------------------------


def _slices(column, limit: int = _SLICE):
    """(first row, texts) in runs of bounded length."""
    first, texts, held = 0, [], 0
    for i, t in enumerate(column):
        x = t.as_py() or ""
        if texts and held + len(x) > limit:
            yield first, texts
            first, texts, held = i, [], 0
        texts.append(x)
        held += len(x)
    if texts:
        yield first, texts


def _whole(proto: bytes, text_at: int, schema: pa.Schema):
    def run(batches):
        m = model(proto)
        for b in batches:
            for first, texts in _slices(b.column(text_at)):
                ids = m.library.encode(texts, num_threads=1)
                own = [c.slice(first, len(texts)) for i, c in enumerate(b.columns) if i != text_at]
                more = [pa.array(list(map(len, ids)), pa.int64()), pa.array([m.decode(i) == t for i, t in zip(ids, texts)]), pa.array(ids, pa.list_(pa.int32()))]
                yield pa.record_batch([*own, *more], schema=schema)

    return run


def _chunks(proto: bytes, size: int):
    """(text_key, no, slice with its surroundings, first cut, last cut)."""

    def run(batches):
        m = model(proto)
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1)):
                s = BLANK + t.as_py().replace(" ", BLANK)
                cuts = cut_places(m, s, size)
                for no, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    a = max(0, lo - m.longest - 1)
                    yield pa.record_batch([pa.array([key]), pa.array([no], pa.int32()), pa.array([s[a : hi + m.longest + 1]]), pa.array([lo - a], pa.int32()), pa.array([hi - a], pa.int32())], names=["text_key", "no", "slice", "lo", "hi"])

    return run


_MATRIX = "array<struct<i:int,j:int,v:double>>"


def _parts(batches):
    """Batches of a few chunks: ids as Python numbers take ten times the room of their text."""
    for b in batches:
        for a in range(0, b.num_rows, _ROWS):
            yield b.slice(a, _ROWS)


def _transfers(proto: bytes):
    def run(batches):
        m = model(proto)
        kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())]))
        for b in _parts(batches):
            out = [[{"i": i, "j": j, "v": v} for i, j, v in transfer(m, s, lo, hi)] for s, lo, hi in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, kind)], names=["text_key", "no", "matrix"])

    return run


def _settled(batches):
    for b in batches:
        keys, nos, enter, leave = [], [], [], []
        for key, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows.sort(key=lambda r: r["no"])
            for r, (i, j) in zip(rows, settle([[(x["i"], x["j"], x["v"]) for x in r["matrix"]] for r in rows])):
                keys.append(key), nos.append(r["no"]), enter.append(i), leave.append(j)
        yield pa.record_batch([pa.array(keys, pa.string()), pa.array(nos, pa.int32()), pa.array(enter, pa.int32()), pa.array(leave, pa.int32())], names=["k", "n", "enter", "leave"])


def _traced(proto: bytes):
    def run(batches):
        m = model(proto)
        for b in _parts(batches):
            ids = [backtrace(m, *r) for r in zip(*(b.column(i).to_pylist() for i in range(2, 7)))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["text_key", "no", "ids"])

    return run


def _checked(proto: bytes, key_at: int, ids_at: int, schema: pa.Schema):
    def run(batches):
        m = model(proto)
        for b in batches:
            for r in range(b.num_rows):
                one = b.slice(r, 1)
                ids = one.column(ids_at)[0].as_py()
                same = hashlib.sha256(m.decode(ids).encode("utf-8", "surrogatepass")).hexdigest() == one.column(key_at)[0].as_py()
                own = [c for i, c in enumerate(one.columns) if i not in (key_at, ids_at)]
                yield pa.record_batch([*own, pa.array([len(ids)], pa.int64()), pa.array([same]), pa.array([ids], pa.list_(pa.int32()))], schema=schema)

    return run


def encode_giants(giants: DataFrame, proto: bytes, size: int) -> DataFrame:
    """(text_key, ids) of the distinct texts of giants(text_key, text), by the scan over chunks of size characters."""
    n = int(giants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = materialise(giants.dropDuplicates(["text_key"]).select("text_key", "text").mapInArrow(released(_chunks(proto, size)), "text_key string, no int, slice string, lo int, hi int").repartition(n, "text_key", "no"), "chunks")
    matrices = chunks.mapInArrow(released(_transfers(proto)), f"text_key string, no int, matrix {_MATRIX}")
    cuts = matrices.groupBy("text_key").agg(F.collect_list(F.struct("no", "matrix")).alias("rows")).mapInArrow(released(_settled), "k string, n int, enter int, leave int")
    traced = chunks.join(cuts, (F.col("text_key") == F.col("k")) & (F.col("no") == F.col("n"))).drop("k", "n").mapInArrow(released(_traced(proto)), "text_key string, no int, ids array<int>")
    return traced.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("c")).select("text_key", F.flatten(F.transform("c", lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, model_path: str = MODEL, giant: int = 32_768, size: int = 8_192) -> DataFrame:
    """docs with n_tokens, round_trip (whether decoding gives the text again) and token_ids in place of text. Texts of over giant characters go through the scan."""
    from pyspark.sql.pandas.types import to_arrow_schema

    proto = read_model(docs.sparkSession, model_path)
    docs = bound_batches(docs).drop("n_tokens", "round_trip", "token_ids", "text_key", "_ids").withColumn("text", F.col("text").cast("string"))
    schema = with_fields(docs.drop("text"), _RESULTS)
    arrow = to_arrow_schema(schema)
    long = F.coalesce(F.char_length("text") > giant, F.lit(False))
    small = docs.where(~long).mapInArrow(released(_whole(proto, docs.columns.index("text"), arrow)), schema)
    giants = docs.where(long).withColumn("text_key", F.sha2("text", 256))
    ids = encode_giants(giants, proto, size).select(F.col("text_key").alias("_k"), F.col("ids").alias("_ids"))
    joined = giants.drop("text").join(ids, F.col("text_key") == F.col("_k")).drop("_k")
    return small.unionByName(joined.mapInArrow(released(_checked(proto, joined.columns.index("text_key"), joined.columns.index("_ids"), arrow)), schema))


def decode(tokens: DataFrame, model_path: str = MODEL) -> DataFrame:
    """tokens(.., token_ids) with the decoded text in place of token_ids; null ids give null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    proto = read_model(tokens.sparkSession, model_path)
    tokens = tokens.drop("text")
    schema, at = with_fields(tokens.drop("token_ids"), "text string"), tokens.columns.index("token_ids")
    arrow = to_arrow_schema(schema)

    def run(batches):
        m = model(proto)
        for b in batches:
            text = [None if not t.is_valid else m.decode(t.values.to_pylist()) for t in b.column(at)]
            yield pa.record_batch([*[c for i, c in enumerate(b.columns) if i != at], pa.array(text, pa.string())], schema=arrow)

    return tokens.mapInArrow(released(run), schema)
