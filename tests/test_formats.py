"""Readers against bytes that are put together here by hand, and what the writers make read back."""

import hashlib
import json
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.sources import formats, mtree


def sha(b):
    return hashlib.sha256(b).hexdigest()


def content_manifest(blobs, nodes, trees):
    pad = lambda b: b + bytes(-len(b) % 128)
    a, b, c = (b"".join(map(bytes.fromhex, x)) for x in (blobs, nodes, trees))
    at_nodes = 128 + len(pad(a))
    at_trees = at_nodes + len(pad(b))
    toc = b"".join(struct.pack(">cQQ", k, at, len(x)) for k, at, x in ((b"b", 128, a), (b"n", at_nodes, b), (b"t", at_trees, c)))
    return (b"imgv1+contentmanifest+sha256\0" + toc).ljust(128, b"\0") + pad(a) + pad(b) + c


def test_content_manifests(spark):
    h = [sha(b"%d" % i) for i in range(12)]
    files = {"a": (h[:5], h[5:6], h[6:]), "b": ([], h[:9], []), "c": ([], [], [])}
    raw = {k: content_manifest(*v) for k, v in files.items()}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in raw.items()], "manifest string, content binary")
    got = sorted(tuple(r) for r in formats.read_content_manifests(df).collect())
    assert got == sorted((k, kind, i, x) for k, v in files.items() for kind, hashes in zip(("blob", "node", "tree"), v) for i, x in enumerate(hashes))
    assert {r["kind"] for r in formats.read_content_manifests(df, "node").collect()} == {"node"}
    rows = spark.createDataFrame([(k, kind, i, x) for k, v in files.items() for kind, hashes in zip(("blob", "node", "tree"), v) for i, x in enumerate(hashes)], "manifest string, kind string, ord long, hash string")
    made = {r["manifest"]: bytes(r["content"]) for r in formats.content_manifests(rows).collect()}
    assert made == {k: raw[k] for k in ("a", "b")}
    with pytest.raises(Exception, match="no content manifest"):
        formats.read_content_manifests(spark.createDataFrame([("x", bytearray(raw["a"].replace(b"sha256", b"sha512")))], "manifest string, content binary")).collect()


def compact_stream(refs, inline, compression=0, info=None):
    table = b"".join(struct.pack(">Q32sQ", o, bytes.fromhex(d), s) for o, d, s in refs)
    head = b"CASSTR\0\1" + struct.pack(">HHBB?bB3xI", 1, 32, compression, 1, True, -1, 16, 7) + struct.pack(">QQQQ", 128, len(table), 128 + len(table), len(inline))
    head += b"\1".ljust(8, b"\0") + struct.pack(">Q", info[0]) + bytes.fromhex(info[1]) if info else b""
    return head.ljust(128, b"\0") + table + inline


def test_compact_streams(spark):
    refs = [(512, sha(b"a"), 10), (2**40, sha(b"b"), 2**33)]
    raw = {1: compact_stream(refs, b"inline bytes"), 2: compact_stream([], b""), 3: compact_stream(refs[:1], pa.compress(b"x" * 5000, codec="zstd", asbytes=True), 1, (77, sha(b"c")))}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in raw.items()], "stream long, content binary")
    assert sorted(tuple(r) for r in formats.read_references(df).collect()) == [(1, 0, *refs[0]), (1, 1, *refs[1]), (3, 0, *refs[0])]
    h = {r["stream"]: r for r in formats.read_stream_headers(df).collect()}
    assert (h[1]["original_compression"], h[1]["seekable"], h[1]["compression_level"], h[1]["compressor_jobs"], h[1]["end_padding"], h[1]["compressed_digest"]) == (1, True, -1, 16, 7, None)
    assert (h[3]["compressed_size"], h[3]["compressed_digest"], h[3]["stream_compression"]) == (77, sha(b"c"), 1)
    assert sorted(tuple(r) for r in formats.inspect_streams(df).collect()) == [(1, 2, 10 + 2**33, 12, 22 + 2**33), (2, 0, 0, 0, 0), (3, 1, 10, 5000, 5010)]
    rows = spark.createDataFrame([(1, refs, bytearray(b"inline bytes"))], "stream long, refs array<struct<offset:long,digest:string,size:long>>, inline binary")
    made = bytes(formats.compact_streams(rows).first()["content"])
    assert made[24:] == raw[1][24:] and made[:13] == raw[1][:13]
    for bad in (b"X" + raw[1][1:], raw[1][:140], raw[1][:7] + b"\2" + raw[1][8:]):
        with pytest.raises(Exception, match="compact stream|cut short"):
            formats.read_references(spark.createDataFrame([(1, bytearray(bad))], "stream long, content binary")).collect()


def test_image_layout_of_files(spark, tmp_path):
    """A layout put together file by file."""
    blobs = tmp_path / "blobs" / "sha256"
    blobs.mkdir(parents=True)
    add = lambda b: (blobs / sha(b)).write_bytes(b) and {"mediaType": "m", "digest": f"sha256:{sha(b)}", "size": len(b)}
    manifest = json.dumps({"schemaVersion": 2, "config": add(b"{}"), "layers": [add(b"one"), add(b"two")]}).encode()
    entry = add(manifest) | {"annotations": {"org.opencontainers.image.ref.name": "v1"}, "platform": {"os": "linux", "architecture": "arm64", "variant": "v8"}}
    (tmp_path / "index.json").write_text(json.dumps({"schemaVersion": 2, "manifests": [entry, add(b"other")]}))
    (tmp_path / "oci-layout").write_text('{"imageLayoutVersion":"1.0.0"}')
    root = f"file://{tmp_path}"
    index = formats.read_layout(spark, root)
    assert [tuple(r) for r in index.orderBy("ord").collect()] == [(0, "v1", "m", sha(manifest), len(manifest), "linux", "arm64", "v8"), (1, None, "m", sha(b"other"), 5, None, None, None)]
    parts = formats.layout_parts(formats.layout_blobs(spark, root, index.where("ref = 'v1'")))
    assert sorted((r["part"], r["part_idx"], r["blob"], r["size"]) for r in parts.collect()) == [("config", 0, sha(b"{}"), 2), ("layer", 0, sha(b"one"), 3), ("layer", 1, sha(b"two"), 3)]
    (blobs / sha(b"one")).write_bytes(b"changed")
    with pytest.raises(Exception, match="damaged blob"):
        formats.layout_blobs(spark, root).collect()
    (tmp_path / "oci-layout").write_text('{"imageLayoutVersion":"2.0.0"}')
    with pytest.raises(Exception, match="no image layout"):
        formats.read_layout(spark, root).collect()


def test_written_layout_is_one_of_files(spark, tmp_path):
    m = spark.createDataFrame([(1, "a", "k", "body one"), (0, None, "k", "body two")], "ord long, ref string, media_type string, body string")
    formats.write_layout(m, spark.createDataFrame([("blob",), ("blob",)], "content string"), f"file://{tmp_path}/x")
    root = tmp_path / "x"
    assert json.loads((root / "oci-layout").read_text()) == {"imageLayoutVersion": "1.0.0"}
    index = json.loads((root / "index.json").read_text())
    assert [x["digest"] for x in index["manifests"]] == [f"sha256:{sha(b'body two')}", f"sha256:{sha(b'body one')}"] and index["manifests"][1]["annotations"] == {"org.opencontainers.image.ref.name": "a"}
    assert {p.name: p.read_bytes() for p in (root / "blobs/sha256").iterdir() if p.name[0] != "."} == {sha(b): b for b in (b"body one", b"body two", b"blob")}


def test_content_addressed_folder(spark, tmp_path):
    formats.write_cas(spark.createDataFrame([(sha(b"x"), bytearray(b"x")), (sha(b""), bytearray()), (sha(b"x"), bytearray(b"x"))], "digest string, content binary"), f"file://{tmp_path}")
    assert (tmp_path / "cas" / sha(b"x")[:2] / sha(b"x")).read_bytes() == b"x"
    assert {r["digest"]: bytes(r["content"]) for r in formats.read_cas(spark, f"file://{tmp_path}").collect()} == {sha(b"x"): b"x", sha(b""): b""}
    one = formats.read_cas(spark, f"file://{tmp_path}", spark.createDataFrame([(sha(b"x"),)], "digest string"))
    assert [r["digest"] for r in one.collect()] == [sha(b"x")]


SPEC = r"""#mtree v2.0
# a comment

/set type=file uid=0 gid=0 mode=0644
.  type=dir
f0 size=1
dir1  type=dir mode=0755 \
      uname=root
    f1 size=2
    sub type=dir
        caf\303\251 size=3 mode=0600
    ..
    f\0402
..
/unset uid
f3
/set gid=7
a/b/./f4 type=link link=x
f5 uid=9
/unset all
f6
""".replace("\\\\", "\\")


def test_whole_specs(spark):
    got = [(r["path"], r["keywords"]) for r in mtree.parse_specs(spark.createDataFrame([("s", SPEC)], "spec string, content string")).orderBy("ord").collect()]
    base = {"type": "file", "uid": "0", "gid": "0", "mode": "0644"}
    rest = {"type": "file", "gid": "0", "mode": "0644"}
    assert got == [
        ("f0", base | {"size": "1"}), ("dir1", base | {"type": "dir", "mode": "0755", "uname": "root"}), ("dir1/f1", base | {"size": "2"}), ("dir1/sub", base | {"type": "dir"}),
        ("dir1/sub/café", base | {"size": "3", "mode": "0600"}), ("dir1/f 2", base), ("f3", rest), ("a/b/f4", rest | {"gid": "7", "type": "link", "link": "x"}), ("f5", rest | {"gid": "7", "uid": "9"}), ("f6", {}),
    ]


def test_names_with_escapes(spark):
    rows = {r"a\040b": "a b", r"caf\303\251": "café", r"\134\043": "\\#", r"x\sy\tz\n": "x y\tz\n", r"\^A\^?": "\x01\x7f", r"\M-C\M-)": "é", r"\M^C": "\ufffd", "plain": "plain", r"a\$b": "ab"}
    df = spark.createDataFrame([(k.replace("\\\\", "\\"),) for k in rows], "v string")
    got = df.select("v", mtree.unvis(F.col("v")).alias("x")).collect()
    want = {k.replace("\\\\", "\\"): v for k, v in rows.items()}
    assert {r["v"]: r["x"] for r in got if r["v"] != r"\M^C"} == {k: v for k, v in want.items() if k != r"\M^C"}


def test_lines_that_depend_on_others_end_the_flat_parse(spark):
    for line in ("/set type=file", "..", "name type=file"):
        with pytest.raises(Exception, match="depends on the lines before"):
            mtree.parse(spark.createDataFrame([(line,)], "value string")).collect()
    assert [r["path"] for r in mtree.parse(spark.createDataFrame([("./x y=1",), ("# c",), ("",), ("./ type=dir",)], "value string")).collect()] == ["x"]
