"""Operators against plain versions of themselves, round trips and held-out labels."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from strata.llm import components, decontam, elias_fano, langid, linededup, ngram_lm, quality, sentencepiece_scan, simhash, token_shards, topk, warc
from strata.llm import words as word_hashes
from strata.llm.common import table

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(s or ""))


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


# ---- near duplicates -------------------------------------------------------------------------------------------


def brute_fingerprint(text, size=4):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + size]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - size + 1))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_groups(rows, radius=4):
    fp = {i: brute_fingerprint(t) for i, t in rows}
    s = Sets()
    ids = sorted(fp)
    for n, a in enumerate(ids):
        s.find(a)
        for b in ids[:n]:
            if (fp[a] ^ fp[b]).bit_count() <= radius:
                s.join(a, b)
    return {i: (f"{fp[i]:016x}", s.find(i)) for i in ids}


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_simhash(spark, parts):
    rng = random.Random(parts)
    vocabulary = ["w%d" % i for i in range(60)]
    rows = []
    for i in range(40):
        w = [rng.choice(vocabulary) for _ in range(rng.choice((2, 3, 8, 60, 200)))]
        for k in range(rng.choice((1, 1, 3))):
            v = list(w)
            if k and len(v) > 5:
                v[rng.randrange(len(v))] = "changed%d" % k
            rows.append((len(rows), " ".join(v)))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), parts=parts).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == brute_groups(rows)


def test_links_of_dense_buckets(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**62))
    near = {base ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in (0, 1, 2, 3, 4, 5, 6) for _ in range(60)}
    prints = np.array(sorted(near | {int(x) for x in rng.integers(0, 2**62, 200)}), dtype=np.uint64)
    got = components.components(simhash.links(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long"))).collect()
    s = Sets()
    for i, a in enumerate(prints.view(np.int64).tolist()):
        for b in prints[:i][np.bitwise_count(prints[:i] ^ prints[i]) <= 4].view(np.int64).tolist():
            s.join(a, b)
    assert {r["node"]: r["root"] for r in got} == {x: s.find(x) for x in s.up}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + rng.randrange(400)) for _ in range(400)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(180)] + [(5, 5), (-7, -9)]
    rng.shuffle(edges)
    s = Sets()
    for a, b in edges:
        if a != b:
            s.join(a, b)
    got = components.components(spark.createDataFrame(edges, "src long, dst long").repartition(4)).collect()
    assert {r["node"]: r["root"] for r in got} == {x: s.find(x) for x in s.up}


def test_components_with_hubs(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(3), 10 + i) for i in range(12_000)] + [(20_000 + i, 20_001 + i) for i in range(20)]
    rng.shuffle(edges)
    e = spark.createDataFrame([(max(x), min(x)) for x in edges], "src long, dst long").repartition(4)
    hubs = components._hubs(e, len(edges))
    assert sorted(hubs) == [0, 1, 2]
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(components._large_star(e, hubs)) == rows(components._large_star(e))


# ---- search ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 2, 2048])
def test_topk(spark, block):
    rng = np.random.default_rng(block)
    v = rng.normal(size=(250, 6)).astype(np.float32).round(2)
    v[40:90] = v[7]  # many equal vectors
    ids = rng.permutation(1000)[:250] * 5
    q = np.floor(1024 * v.astype(np.float64)).astype(np.int64)
    want = []
    for i, x in zip(ids, q):
        if i % 100 == 0:
            best = sorted(((-int(x @ y), int(j)) for j, y in zip(ids, q) if j != i))[:10]
            want += [(int(i), n + 1, j, -s) for n, (s, j) in enumerate(best)]
    df = spark.createDataFrame([(int(i), [float(a) for a in x]) for i, x in zip(ids, v)], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, block=block).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("block,bins", [(3, 256), (4096, 16)])
def test_topk_of_large_components_and_repeated_ids(spark, block, bins):
    """Exact scores beyond 2^53 and 2^63, with rows that share an id, queries among them."""
    rng = random.Random(block)
    rows = []
    for i in range(160):
        size = rng.choice((1.0, 1.0, 1.0, 1e3, 3e6, 1e9, 1e18, 1e30, 3e38, 1e300, 1.7e308) if i % 3 == 0 else (1.0, 1e4, 2e6))
        rows.append((rng.choice((0, 100, 200, 300)) if i % 9 == 0 else rng.randrange(40), [rng.choice((1.0, rng.uniform(-1, 1), -0.5)) * size for _ in range(3)]))
    rows += rows[:30]
    floor = lambda x: int(x) * 1024 if abs(x) >= 2**53 else math.floor(x * 1024)
    q = [(i, [floor(x) for x in v]) for i, v in rows]
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    want = []
    for n, (i, v) in enumerate(q):
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(q) if m != n)[:10]
            want += [(i, r + 1, j, clip(-s)) for r, (s, j) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, block=block, bins=bins).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("scale,giant,bins", [(0.01, 1, 256), (1.0, 1, 7), (0.01, 1e18, 256)])
def test_topk_of_close_scores(spark, scale, giant, bins):
    """Scores just above the kth value's bin, which a pass must not count again. With a giant vector limits are beyond 64 bits."""
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(400, 16)) * scale).tolist()
    v[7] = [x * giant for x in v[7]]
    q = [[int(x) * 1024 if abs(x) >= 2**53 else math.floor(x * 1024) for x in y] for y in v]
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    want = []
    for i in range(0, 400, 5):
        best = sorted((-sum(a * b for a, b in zip(q[i], x)), j * 20) for j, x in enumerate(q) if j != i)[:10]
        want += [(i * 20, r + 1, j, clip(-s)) for r, (s, j) in enumerate(best)]
    df = spark.createDataFrame([(i * 20, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, bins=bins).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("bins", [2, 7, 256])
def test_topk_bins_fill_one_bin(bins):
    for kind, bounds in ((np.int64, [1, 127, 128, 129, 10**6, 2**62 - 1]), (object, [1, 2**62, 2**63, 10**40])):
        for b, w in zip(bounds, topk._widths(np.array(bounds, kind), bins).tolist()):
            assert bins * w > 2 * b and (w == 1 or w <= 2 * b)
            while w > 1:
                assert w % bins == 0
                w //= bins


# ---- tokens ----------------------------------------------------------------------------------------------------


def scan(m, text, size, near):
    s = sentencepiece_scan.BLANK + text.replace(" ", sentencepiece_scan.BLANK)
    cuts = sentencepiece_scan.cut_places(m, s, size, near)
    rows = []
    for lo, hi in zip(cuts, cuts[1:]):
        a = max(0, lo - m.longest - 1)
        rows.append((s[a : hi + m.longest + 1], lo - a, hi - a))
    states = sentencepiece_scan.settle([sentencepiece_scan.transfer(m, *r) for r in rows])
    return [i for r, (x, y) in zip(rows, states) for i in sentencepiece_scan.backtrace(m, *r, x, y)]


def random_texts(rng, n):
    for _ in range(n):
        yield "".join(rng.choice("abcdeinthre    \n.,éß漢😀") for _ in range(rng.randint(1, 150))), rng.randint(1, 40), rng.choice((0, 3, 512))
        yield "".join(rng.choice("aeinthrs") for _ in range(rng.randint(50, 250))), rng.randint(3, 60), 0
        yield "a" * rng.randint(1, 90) + " " * rng.randint(0, 30) + "the" * 20, rng.randint(1, 30), 0


def test_sentencepiece_merges():
    m = sentencepiece_scan.Model(open(sentencepiece_scan.MODEL, "rb").read())
    for text, size, near in random_texts(random.Random(2), 60):
        ids = scan(m, text, size, near)
        assert ids == m.library.encode(text), (text, size, near)
        assert m.decode(ids) == text == m.library.decode(ids)


def test_sentencepiece_unigram():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(sentencepiece_scan.MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.type == 1:
            p.score = -1 - abs(p.score) % 4096 / 512  # small enough for the library's single precision
    m = sentencepiece_scan.Model(proto.SerializeToString())
    total = lambda ids: sum(proto.pieces[i].score for i in ids)
    for text, size, near in random_texts(random.Random(4), 30):
        if all(c in m.id for c in text.replace(" ", sentencepiece_scan.BLANK)):
            ids = scan(m, text, size, near)
            assert m.decode(ids) == text and total(ids) == pytest.approx(total(m.library.encode(text)))


def test_product_is_associative():
    rng = random.Random(5)
    a, b, c = ([(i, j, rng.random()) for i in range(4) for j in range(4) if rng.random() < 0.7] for _ in range(3))
    p = sentencepiece_scan.product
    left, right = p(p(a, b), c), p(a, p(b, c))
    assert [(i, j) for i, j, _ in left] == [(i, j) for i, j, _ in right] and [v for *_, v in left] == pytest.approx([v for *_, v in right])


def test_sentencepiece_of_tables(spark):
    import sentencepiece

    docs = table(spark, SF, "documents").select("doc_id", "text")
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.MODEL)
    out = sentencepiece_scan.encode(docs, giant=3000, size=700)
    got = {r["doc_id"]: r for r in out.collect()}
    for r in docs.collect():
        ids = library.encode(r["text"])
        assert list(got[r["doc_id"]]["token_ids"]) == ids and got[r["doc_id"]]["n_tokens"] == len(ids) and got[r["doc_id"]]["round_trip"]
    back = sentencepiece_scan.decode(out.select("doc_id", "token_ids"))
    assert back.join(docs.withColumnRenamed("text", "was"), "doc_id").where("text <> was").count() == 0


def test_permutation():
    for n in (1, 2, 3, 5, 100, 1000, 4097):
        p = token_shards.permute(np.arange(n), n, 77)
        assert sorted(p) == list(range(n)) and (token_shards.permute(p, n, 77, back=True) == np.arange(n)).all()
    assert (token_shards.permute(np.arange(100), 100, 1) != token_shards.permute(np.arange(100), 100, 2)).any()


def test_token_shards(spark, tmp_path):
    import tiktoken
    from public_tokenizers import PATTERN

    docs, path = table(spark, SF, "documents"), f"file://{tmp_path}/shards"
    meta = token_shards.write_shards(docs, path, seq_len=128, shard_slots=300)
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(token_shards.RANKS, "rb"))}
    library = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    records = {r["slot"]: np.frombuffer(bytes(r["ids"]), "<u2") for r in token_shards.read_records(spark, path).collect()}
    assert sorted(records) == list(range(meta["sequences"]))
    parts = defaultdict(list)
    for r in spark.read.parquet(f"{path}/spans").collect():
        parts[r["doc_id"]].append((r["from_token"], records[r["slot"]][r["at"] : r["at"] + r["n_tokens"]]))
    for r in docs.collect():
        assert np.concatenate([x for _, x in sorted(parts[r["doc_id"]], key=lambda x: x[0])]).tolist() == [*library.encode_ordinary(r["text"]), 50256]
    rest = token_shards.read_records(spark, path, first_slot=meta["sequences"] - 40)
    assert sorted(r["slot"] for r in rest.collect()) == list(range(meta["sequences"] - 40, meta["sequences"]))
    # a shard is a plain file of records of one stride
    first = next((tmp_path / "shards/shards/shard=0").glob("part-*")).read_bytes()
    assert len(first) == min(300, meta["sequences"]) * meta["stride"] and first[: meta["stride"] - 2] == records[0].tobytes()


# ---- lines, archives -------------------------------------------------------------------------------------------


def brute_lines(rows):
    split = {i: (t or "").split("\n") for i, t in rows}
    key = lambda x: lower(x.strip(BLANK))
    held = defaultdict(set)
    for i, lines in split.items():
        for x in lines:
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    go = {k: max(v) for k, v in held.items() if len(v) >= 3}
    return {i: [x for x in lines if key(x) not in go or go[key(x)] == i] for i, lines in split.items()}


def test_line_dedup(spark):
    rng = random.Random(6)
    pool = ["short", "exactly twenty chars", "ÄÖÜ of twenty chars!", "é" * 19, "é" * 20, "A shared line that is long enough", "another line that is long enough to count", "\tPadded and UPPER case line here ", "padded and upper case line here", ""]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(("", "", " ", str(rng.random()))) for _ in range(rng.randint(0, 7)))) for i in range(60)]
    want = brute_lines(rows)
    for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["_kept_text"] == "\n".join(want[r["doc_id"]])
        assert r["kept_sha256"] == hashlib.sha256(r["_kept_text"].encode()).hexdigest()


def test_warc_records(spark, tmp_path):
    pages = table(spark, SF, "pages").unionByName(table(spark, SF, "pages").selectExpr("page_id + 100000 as page_id", "url", "html"))
    path = warc.write_archive(pages, f"file://{tmp_path}/warc", min_bytes=2000)
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    assert spark.read.parquet(f"{path}/payloads").count() == len(set(html.values()))
    for r in warc.read_records(spark, path).collect():
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        payload = html[r["page_id"]]
        first = min(i for i, h in html.items() if h == payload)
        revisit = len(payload) >= 2000 and first != r["page_id"]
        assert fields["WARC-Type"] == ("revisit" if revisit else "response")
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert int(fields["Content-Length"]) == len(block) - 4 and block.endswith(b"\r\n\r\n")
        assert block.partition(b"\r\n\r\n")[2][:-4] == (b"" if revisit else payload)
    assert {r["page_id"]: bytes(r["payload"]) for r in warc.read_payloads(spark, path).collect()} == html


def test_damaged_payload_ends_the_job(spark, tmp_path):
    path = warc.write_archive(table(spark, SF, "pages"), f"file://{tmp_path}/warc")
    spark.read.parquet(f"{path}/payloads").selectExpr("key", "concat(payload, cast('x' as binary)) as payload").write.parquet(f"file://{tmp_path}/bad/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"file://{tmp_path}/bad/headers")
    with pytest.raises(Exception, match="differs"):
        warc.read_index(spark, f"file://{tmp_path}/bad").collect()


# ---- models ----------------------------------------------------------------------------------------------------


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((0, 1), (1, 1), (1, 2**63), (5, 3), (1000, 2**40), (20000, 2**62), (20000, 30000), (3000, 7)):
        v = np.sort(rng.integers(0, u, n, dtype=np.uint64))
        p = elias_fano.load(np.frombuffer(elias_fano.dump(elias_fano.Sequence.build(v, u).parts()), np.uint8))
        s = elias_fano.Sequence(int(p[0][0]), int(p[0][1]), *p[1:])
        assert (s.get(np.arange(n)) == v).all()
        q = np.concatenate([v, rng.integers(0, u, 500, dtype=np.uint64)])
        at, found = s.successor(q)
        assert (at == np.searchsorted(v, q)).all() and (found == np.isin(q, v)).all()
        place = s.find(q)
        assert ((place >= 0) == found).all() and (v[place[found]] == q[found]).all()


def test_lm(spark):
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: r for r in ngram_lm.train_and_score(docs.select("doc_id", "text")).collect()}
    rows = docs.collect()
    tokens = {r["doc_id"]: ["^", *words(r["text"]), "\n"] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter()
    for i, w in tokens.items():
        if not held[i]:
            for k in range(1, 5):
                c.update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    single = {g[0]: n for g, n in c.items() if len(g) == 1 and g != ("^",)}
    n, v = sum(single.values()), len(single)
    kids = defaultdict(dict)
    for g, k in c.items():
        if len(g) > 1 and k >= 2:
            kids[g[:-1]][g[-1]] = (k - 0.5) / c[g[:-1]]
    left = {g: 1 - sum(x.values()) for g, x in kids.items()}

    def p(context, w):
        if not context:
            return (single.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))
        return kids.get(context, {}).get(w, 0) + left.get(context, 1) * p(context[1:], w)

    # the model is a distribution: over all words and the unknown one
    context = max((g for g in kids if len(g) == 3), key=lambda g: len(kids[g]))
    assert sum(p(context, w) for w in single) + p(context, "no such word") == pytest.approx(1)
    gain = 0
    for i, w in tokens.items():
        r = got[i]
        base = sum(math.log10(p((), x)) for x in w[1:])
        score = sum(math.log10(p(tuple(w[max(0, j - 3) : j]), w[j])) for j in range(1, len(w)))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w) - 1, sum(x in single for x in w[1:]), n, held[i])
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and abs(r["score"] - score) < 1e-3 * len(w)
        gain += (r["score"] - r["base_score"]) * held[i]
    assert gain > 0  # better than words alone on documents that it hasn't seen


def test_lm_counts_beyond_32_bits():
    big = 3_000_000_000
    seq, _ = word_hashes.sequences(pa.array(["a b", "a c"]))
    b, c = ngram_lm.windows(seq)
    rows = [(seq, b, c, np.where(np.arange(len(seq)) < 4, big, 1)) for _ in range(2)]
    (segment, run), *more = ngram_lm.kept_runs(rows, 1, 2)
    assert not more
    levels, tokens, found = ngram_lm.build_segment([elias_fano.load(np.frombuffer(run, np.uint8))])
    assert tokens == 2 * (3 * big + 3) and found == 4
    s = ngram_lm.Segment(np.frombuffer(elias_fano.dump(levels), np.uint8))
    a, b = seq[1:2], seq[2:3]
    node, count = s.find(a)
    assert count[0] == 2 * big + 2
    _, share = s.child(0, node, b >> np.uint64(24))
    assert share[0] == pytest.approx((2 * big - 0.5) / (2 * big + 2), rel=1e-3)


def test_word_hashes():
    texts = ["Hello  World\n foo", "", None, " ", "x" * 700_000 + " b " + "c" * 300_000, "hello WORLD", "Ä ä é", "\x1c\x85 x"]
    seq, n = word_hashes.sequences(pa.array(["zz", *texts]).slice(1))
    flat = [w for t in texts for w in ["<", *words(t), ">"]]
    assert n.tolist() == [len(words(t)) for t in texts] and len(seq) == len(flat)
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(flat, seq.tolist())) and len(set(seen.values())) == len(seen)


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.classify(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))
    rows = out.join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in out.collect())


def test_pairwise_ranking():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 5))
    y = (x @ [1, -2, 0, 0.5, 0] + 0.1 * rng.normal(size=600) > 0.8).astype(int)
    m = quality.learn(x, y)
    s = m.score(x)
    assert (s[y == 1][:, None] > s[y == 0]).mean() > 0.99 and ((s >= quality.CUT) == y).mean() > 0.95


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)


def test_many_languages(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    langs = {f"l{i:03d}": [rng.choice(letters) + rng.choice(letters) + rng.choice(letters) for _ in range(6)] for i in range(130)}
    rows = [(n * 1000 + i, " ".join(rng.choices(w, k=40)), lang) for n, (lang, w) in enumerate(langs.items()) for i in range(12)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    right = {i: lang for i, _, lang in rows}
    assert sum(r["lang_pred"] == right[r["doc_id"]] for r in out if r["held_out"]) >= 0.9 * sum(r["held_out"] for r in out)


# ---- decontamination -------------------------------------------------------------------------------------------

ITEM = "Alice has 5 apples and gives 3 apples to Bob before walking 12 km home with Alice and Bob today."
TEXTS = {
    1: ("Before it. " + ITEM + " After it.", [1], []),
    2: ("Maria has 9 apples and gives 4 apples to Tom before walking 30 miles home with Maria and Tom today.", [1], [1]),
    3: (ITEM.upper(), [1], []),
    4: ("Alice has 5 apples and gives 3 pears to a friend who lives far away from all of them.", [], []),
    5: ("Yes, no!", [2], []),
    6: ("yes no maybe", [], []),
    # the names don't stay the same: no one reading of the slots fits enough windows
    7: ("Ann has 5 apples and gives 3 apples to Ben before walking 12 km home with Cat and Dan today.", [], []),
    8: ("Alice has 5 apples and gives 3 apples to Bob before\nwalking 12km home, with Alice and Bob, today...", [1], []),
}


@pytest.mark.parametrize("many", [10_000, 0])
def test_decontamination(spark, many):
    bench = spark.createDataFrame([(1, ITEM), (2, "yes no")], "item_id long, text string")
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in TEXTS.items()], "doc_id long, text string")
    out = {r["doc_id"]: (list(r["item_ids"]), list(r["reparameterised"])) for r in decontam.decontaminate(docs, bench, many=many).collect()}
    assert {i: out[i] for i in TEXTS if i != 7} == {i: (a, b) for i, (_, a, b) in TEXTS.items() if i != 7}


@pytest.mark.parametrize("many", [10_000, 0])
def test_each_row_is_judged_by_its_own_text(spark, many):
    bench = spark.createDataFrame([(1, ITEM), (2, "yes no"), (3, ITEM), (3, "yes no")], "item_id long, text string")
    rows = [(10, ITEM), (10, "clean text of some words that no item has"), (None, ITEM), (None, "clean text of some other words"), (11, "yes no"), (11, None), (12, ""), (10, ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = decontam.decontaminate(docs, bench, keep_text=True, many=many).collect()
    want = {ITEM: [1, 3], "yes no": [2, 3]}
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out) == sorted((str(i), str(t)) for i, t in rows)
    assert all(r["item_ids"] == want.get(r["text"], []) and r["contaminated"] == (r["text"] in want) for r in out)


def brute_items(text, items, size=5, share=0.8):
    """Items in a text by comparing each of its windows with each of theirs, token by token."""
    tokens = [c for w in decontam.words_of(text) if (c := decontam.canonical(w))[1]]
    found = {}
    for item, (item_id, item_text) in enumerate(items):
        own = [c for w in decontam.words_of(item_text) if (c := decontam.canonical(w))[1]]
        if 0 < len(own) < size:
            if [t[1] for t in own] == [t[1] for t in tokens]:
                found[item] = (item_id, 1.0, False)
            continue
        best = (0.0, False)
        for r in (0, 1):
            seen, windows = set(), []
            for at in range(len(own) - size + 1):
                w = tuple(t[r] for t in own[at : at + size])
                if w not in seen and (r or sum(t[0][0] != "\x01" for t in own[at : at + size]) >= 2):
                    windows.append((at, w))
                seen.add(w)
            pairs = [(a, at, w) for a in range(len(tokens) - size + 1) for at, w in windows if tuple(t[r] for t in tokens[a : a + size]) == w]
            for start, _, _ in pairs:
                stretch = [p for p in pairs if start <= p[0] <= start + len(own) + len(own) // 2]
                votes = defaultdict(Counter)
                slots = lambda a, at, w: [((w[i], own[at + i][2]), tokens[a + i][2]) for i in range(size) if w[i][0] == "\x01"]
                for p in stretch:
                    for slot, value in slots(*p):
                        votes[slot][value] += 1
                chosen = {slot: max(v, key=lambda x: (v[x], x == slot[1], x)) for slot, v in votes.items()}
                good = {p[1] for p in stretch if all(chosen[slot] == value for slot, value in slots(*p))}
                differs = any(slot[1] != v for slot, v in chosen.items())
                if windows and (len(good) / len(windows), not differs) > (best[0], not best[1]):
                    best = (len(good) / len(windows), differs)
        if best[0] >= share:
            found[item] = (item_id, *best)
    return found


def test_decontamination_by_brute_force(spark):
    rng = random.Random(31)
    vocabulary = "Ann Bob Cleo has had 3 7 12 4.5 km miles apples pears gives takes the a of to and then walks home runs today kg".split()
    items = [(i // 2, " ".join(rng.choices(vocabulary, k=rng.choice((2, 4, 9, 20, 30))))) for i in range(40)]
    names, numbers = ["Ann", "Bob", "Cleo", "Dora"], ["3", "7", "12", "4.5", "99"]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.choice((0, 1, 2))):
            t = rng.choice(items)[1].split()
            swap = {x: rng.choice(names) for x in names} | {x: rng.choice(numbers) for x in numbers}
            kind = rng.random()
            t = [swap.get(w, w) if kind < 0.5 else w for w in t]
            if kind > 0.8 and len(t) > 6:
                t[rng.randrange(len(t))] = "other"
            parts.append(" ".join(t))
        texts.append(" ".join([*rng.choices(vocabulary, k=rng.choice((0, 0, 6, 30))), *parts, *rng.choices(vocabulary, k=rng.choice((0, 0, 10)))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.decontaminate(docs, bench).collect()}
    hit = 0
    for i, t in enumerate(texts):
        want = brute_items(t, items)
        hit += bool(want)
        assert list(got[i]["item_ids"]) == sorted({x for x, _, _ in want.values()}), (t, want, got[i])
        assert got[i]["coverage"] == pytest.approx(max((c for _, c, _ in want.values()), default=0.0))
    assert 40 < hit < 120


def test_planted_passages(spark):
    bench, docs = table(spark, SF, "benchmark"), table(spark, SF, "documents")
    out = {r["doc_id"]: set(r["item_ids"]) for r in decontam.decontaminate(docs, bench).collect()}
    flat = lambda s: " ".join(s.split())
    items = [(r["item_id"], flat(r["text"])) for r in bench.collect()]
    found = 0
    for r in docs.collect():
        text = flat(r["text"])
        whole = {i for i, t in items if t in text}
        found += bool(whole)
        assert whole <= out[r["doc_id"]]
    assert found and sum(map(bool, out.values())) < 0.2 * len(out)


# ---- pipeline --------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import sentencepiece

    import corpus_pipeline

    docs = table(spark, SF, "documents")
    good = quality.classify(docs, table(spark, SF, "labels")).where("predicted = 1").collect()
    lines = brute_lines([(r["doc_id"], r["text"]) for r in good])
    runs = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in ((i, words("\n".join(x))) for i, x in lines.items())}
    groups = Sets()
    for i in sorted(runs):  # the stage's rule: five words, Jaccard similarity 0.8 or more
        groups.find(i)
        for j in runs:
            if j < i and len(runs[i] & runs[j]) >= 0.8 * len(runs[i] | runs[j]):
                groups.join(i, j)
    kept = {i: "\n".join(lines[i]) for i in runs if groups.find(i) == i}
    flat = lambda s: " ".join(s.split())
    items = [flat(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.MODEL)
    want = {i: library.encode(t) for i, t in kept.items() if not any(x in flat(t) for x in items)}
    got = {r["doc_id"]: list(r["token_ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) <= set(want) and len(want) - len(got) <= 1  # an item with its punctuation changed is found as well
    assert all(want[i] == ids for i, ids in got.items())


def test_pipeline_near_copies(spark):
    """The stage keeps one of each group of texts of Jaccard similarity 0.8 or more on five words, and no fewer."""
    import corpus_pipeline

    rng = random.Random(21)
    texts = []
    for _ in range(60):
        w = ["w%d" % rng.randrange(5000) for _ in range(rng.choice((4, 30, 100, 300)))]
        for k in range(rng.choice((1, 2, 4))):
            v = list(w)
            for _ in range(k * len(v) // 70):
                v[rng.randrange(len(v))] = "changed%d" % rng.randrange(5000)
            texts.append(" ".join(v))
    rng.shuffle(texts)
    texts += [" ".join(["group"] * 3 + ["g%d" % j for j in range(90)] + ["end%d" % i]) for i in range(100)]  # one bucket of many
    runs = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    s, far = Sets(), 0
    for a in range(len(texts)):
        s.find(a)
        for b in range(a):
            if len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]):
                s.join(a, b)
                far += (simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count() > 4
    assert far > 10  # pairs that op6's links leave
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, SF).collect()}
    assert got == {i for i in range(len(texts)) if s.find(i) == i}


def test_near_copies_in_large_buckets(spark):
    """Buckets of over 32 texts that hold many groups: no link between two groups is lost, however many texts share a bucket."""
    from strata.llm import minhash

    rng = random.Random(33)
    base = ["b%d" % i for i in range(120)]
    texts = []
    for g in range(50):
        own = ["g%d_%d" % (g, i) for i in range(rng.choice((8, 20, 30, 45)))]
        for k in range(rng.choice((1, 2, 5))):
            texts.append(" ".join(base + own + ["k%d_%d_%d" % (g, k, i) for i in range(rng.randrange(8))]))
    texts += [" ".join(base)] * 40 + ["", "one", "one"]
    rng.shuffle(texts)
    sets = [minhash.shingles(t) for t in texts]
    jaccard = lambda a, b: (lambda n: n >= 0.8 * (len(a) + len(b) - n))(len(np.intersect1d(a, b)))
    s, near = Sets(), set()
    for a in range(len(texts)):
        s.find(a)
        for b in range(a):
            if jaccard(sets[a], sets[b]):
                s.join(a, b)
                near.add(tuple(sorted((minhash.key_of(sets[a]), minhash.key_of(sets[b])))))
    assert 5 < len({s.find(i) for i in range(len(texts))}) < len(texts) / 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_copies(docs).collect()}
    assert got == {i: s.find(i) for i in range(len(texts))}

    signed = lambda k: k - 2**64 if k >= 2**63 else k
    by_key = {minhash.key_of(x): x for x in sets if len(x)}
    prints = spark.createDataFrame([(signed(k), signed(k), bytearray(minhash.buckets(x).tobytes())) for k, x in by_key.items()], "key long, root long, bands binary")
    assert minhash._undecided(prints).count() > 32
    table_of = spark.createDataFrame([(signed(k), bytearray(x.tobytes())) for k, x in by_key.items()], "key long, shingles binary")
    for n in (1, 3, 1000):  # texts that have a root in common already needn't be paired
        root = {k: k % n if n < 1000 else i for i, k in enumerate(by_key)}
        roots = spark.createDataFrame([(signed(k), r) for k, r in root.items()], "key long, root long")
        met = {(r["src"], r["dst"]) for r in minhash._joined(table_of, roots, 0.8).collect()}
        want = {tuple(sorted((signed(a), signed(b)))) for a, b in near if a != b and root[a] != root[b]}
        assert want <= met and (n == 1 or len(want) > 20)
        assert all(a < b for a, b in met) and (n > 1 or not met)


def test_repetitive_items_and_documents(spark):
    bench = spark.createDataFrame([(1, "again " * 60), (2, "one two three four five six seven eight " * 3)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "again " * 30_000), (2, "one two three four five six seven eight " * 4_000), (3, "one two three nine " * 4_000)], "doc_id long, text string")
    assert {r["doc_id"]: list(r["item_ids"]) for r in decontam.decontaminate(docs, bench).collect()} == {1: [1], 2: [2], 3: []}


@pytest.mark.parametrize("slots", [64, 1 << 12])
def test_without_ids(spark, slots):
    from strata.llm.common import without_ids

    rows = [(i % 500, f"t{i}") for i in range(1000)] + [(None, "none")]
    ids = spark.createDataFrame([(i,) for i in range(0, 700, 7)], "_id long")
    got = without_ids(spark.createDataFrame(rows, "doc_id long, text string"), ids, "doc_id", slots).collect()
    assert sorted(r["text"] for r in got) == sorted(t for i, t in rows if i is None or i % 7)


def test_pipeline_groups_by_fingerprints(spark, monkeypatch):
    """The pipeline's near-dedup gets groups from op6's ball hashing, verified on the shingles; MinHash adds what these leave."""
    import corpus_pipeline
    from strata.llm import minhash

    rng = random.Random(8)
    texts = []
    for _ in range(40):
        w = ["w%d" % rng.randrange(3000) for _ in range(rng.choice((30, 200, 400)))]
        for k in range(3):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = "changed%d" % rng.randrange(5000)
            texts.append(" ".join(v))
    texts += ["", " ", "one", "ONE", "one two one two one two one", "one two one two one two one two one"]  # the last two: the same distinct shingles
    sets = [minhash.shingles(t) for t in texts]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    close = lambda a, b: (lambda n: n >= 0.8 * (len(sets[a]) + len(sets[b]) - n))(len(np.intersect1d(sets[a], sets[b])))
    near, every = Sets(), Sets()
    for a in range(len(texts)):
        near.find(a), every.find(a)
        for b in range(a):
            if close(a, b):
                every.join(a, b)
                if (prints[a] ^ prints[b]).bit_count() <= 4 or list(sets[a]) == list(sets[b]):
                    near.join(a, b)
    roots = lambda s: [s.find(i) for i in range(len(texts))]
    assert len(set(roots(every))) < len(set(roots(near))) < len(texts) - 10  # either step has its links
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda: {r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, SF).collect()}
    assert kept() == set(roots(every))
    none = spark.createDataFrame([], "src long, dst long")
    with monkeypatch.context() as m:
        m.setattr(minhash, "by_buckets", lambda prints: none)
        m.setattr(minhash, "_undecided", lambda prints: none)
        assert kept() == set(roots(near))
    with monkeypatch.context() as m:
        m.setattr(minhash.simhash, "links", lambda *a: none)
        assert kept() == set(roots(every))
