"""Files whose bytes others fix: image layouts, content-addressed folders, content manifests and compact streams.

Whole files come as rows of path and content and are parsed and made by column functions, so nothing here collects on the driver. Files are
written at their exact names by the tasks, each first under a name of its own and then moved into place: what a repeated task writes is the same file again.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- files -----------------------------------------------------------------------------------------------------


def _folder(root: str) -> tuple[pafs.FileSystem, str]:
    if root.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    return (pafs.LocalFileSystem(), root) if root.startswith("/") else pafs.FileSystem.from_uri(root)


def write_files(files: DataFrame, root: str) -> None:
    """files(path, content) as files below root. Where rows share a path one of them stays."""

    def run(batches):
        fs, base = _folder(root)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = f"{base}/{path}"
                folder = at.rpartition("/")[0]
                fs.create_dir(folder, recursive=True)
                own = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as out:
                    out.write(content)
                fs.move(own, at)
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_files(spark: SparkSession, root: str, below: str = "") -> DataFrame:
    """(path, content) of all files in a folder below root, by their paths from there."""
    top = f"{root.rstrip('/')}/{below}".rstrip("/")
    raw = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(top)
    return raw.select(F.substring_index("path", f"{top.rpartition('/')[2]}/", -1).alias("path"), "content")


def _number(raw: Column, at, size: int) -> Column:
    """A big-endian number of a binary column, at a place counted from 0."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(raw, at + 1, F.lit(size))), 16, 10).cast("long")


def _bytes(number: Column, size: int) -> Column:
    """Hex digits of a number of so many bytes, big-endian."""
    return F.lpad(F.hex(number.cast("long")), 2 * size, "0")


def _ends(condition: Column, value: Column, message: Column) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(message))


# ---- content-addressed folders ---------------------------------------------------------------------------------


def write_cas(blobs: DataFrame, root: str) -> None:
    """blobs(digest, content) as cas/<first two digits>/<digest>, each once."""
    distinct = blobs.dropDuplicates(["digest"])
    write_files(distinct.select(F.concat(F.lit("cas/"), F.substring("digest", 1, 2), F.lit("/"), F.col("digest")).alias("path"), "content"), root)


def read_cas(spark: SparkSession, root: str, digests: DataFrame | None = None) -> DataFrame:
    """(digest, content); with digests(digest) only those. A blob that differs from its digest ends the job."""
    return _blobs(spark, root, "cas", f"cas/{_EMPTY[:2]}/{_EMPTY}", digests)


_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _blobs(spark: SparkSession, root: str, below: str, empty: str, digests: DataFrame | None) -> DataFrame:
    """The files below a folder, the empty blob among them, whose file the scan passes over for it has nothing to read."""
    blobs, p = read_files(spark, root, below), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{empty}")
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        blobs = blobs.unionByName(spark.createDataFrame([(empty, bytearray())], "path string, content binary"))
    return _verified(blobs, digests)


def _verified(files: DataFrame, digests: DataFrame | None) -> DataFrame:
    blobs = files.withColumn("digest", F.substring_index("path", "/", -1)).where(F.length("digest") == 64)
    if digests is not None:
        blobs = blobs.join(digests.select("digest").distinct(), "digest", "left_semi")
    return blobs.select("digest", _ends(F.sha2("content", 256) == F.col("digest"), F.col("content"), F.concat(F.lit("damaged blob "), F.col("digest"))).alias("content"))


# ---- image layouts ---------------------------------------------------------------------------------------------

# The marker, names and media types of an image layout.
MARKER = '{\n  "imageLayoutVersion": "1.0.0"\n}'
REF_NAME = "org.opencontainers.image.ref.name"
INDEX_TYPE = "application/vnd.oci.image.index.v1+json"
_DESCRIPTOR = "mediaType string, digest string, size long, annotations map<string,string>, platform struct<os:string,architecture:string,variant:string>"


def write_layout(manifests: DataFrame, blobs: DataFrame, root: str) -> None:
    """An image layout: oci-layout, index.json with the descriptors of manifests(ord, ref, media_type, body), and their bodies and blobs(content) as blobs/sha256/<digest>.

    index.json is one file that names each manifest, and is put together by one aggregate.
    """
    bodies = manifests.select(F.col("body").cast("binary").alias("content")).unionByName(blobs.select(F.col("content").cast("binary").alias("content")))
    named = bodies.select(F.sha2("content", 256).alias("digest"), "content").dropDuplicates(["digest"])
    write_files(named.select(F.concat(F.lit("blobs/sha256/"), F.col("digest")).alias("path"), "content"), root)
    body = F.col("body").cast("binary")
    names = F.when(F.col("ref").isNotNull(), F.create_map(F.lit(REF_NAME), F.col("ref")))
    one = F.struct(F.col("media_type").alias("mediaType"), F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("digest"), F.octet_length(body).cast("long").alias("size"), names.alias("annotations"))
    rows = manifests.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.to_json(one).alias("d")))), lambda x: x["d"]), ",").alias("all"))  # a map has no order, its JSON has
    index = rows.select(F.lit("index.json").alias("path"), F.concat(F.lit(f'{{"schemaVersion":2,"mediaType":"{INDEX_TYPE}","manifests":['), "all", F.lit("]}")).alias("content"))
    marker = manifests.sparkSession.createDataFrame([("oci-layout", MARKER)], "path string, content string")
    write_files(index.unionByName(marker), root)


def read_layout(spark: SparkSession, root: str) -> DataFrame:
    """(ord, ref, media_type, digest, size, os, architecture, variant) of the descriptors of a layout's index.json; a folder without the marker's version ends the job."""
    marker = spark.read.text(f"{root}/oci-layout", wholetext=True).select(F.get_json_object("value", "$.imageLayoutVersion").alias("version"))
    index = spark.read.text(f"{root}/index.json", wholetext=True).select(F.from_json("value", f"manifests array<struct<{_DESCRIPTOR.replace(' ', ':').replace(',:', ', ')}>>").alias("i"))
    checked = index.crossJoin(F.broadcast(marker)).select(_ends(F.col("version") == "1.0.0", F.col("i.manifests"), F.lit("no image layout of version 1.0.0")).alias("m"))  # a row each
    d = checked.select(F.posexplode("m").alias("ord", "d"))
    return d.select(F.col("ord").cast("long").alias("ord"), F.col("d.annotations")[REF_NAME].alias("ref"), F.col("d.mediaType").alias("media_type"), F.substring_index("d.digest", ":", -1).alias("digest"), F.col("d.size").alias("size"), "d.platform.*")


def layout_blobs(spark: SparkSession, root: str, digests: DataFrame | None = None) -> DataFrame:
    """(digest, content) of a layout's blobs, verified."""
    return _blobs(spark, root, "blobs/sha256", f"blobs/sha256/{_EMPTY}", digests)


def layout_parts(manifests: DataFrame) -> DataFrame:
    """(digest, part, part_idx, media_type, blob, size) of the config and layers that manifests(digest, content) name."""
    kind = "struct<mediaType:string, digest:string, size:long>"
    m = manifests.select("digest", F.from_json(F.col("content").cast("string"), f"config {kind}, layers array<{kind}>").alias("m"))
    all_of = F.concat(F.array(F.struct(F.lit("config").alias("part"), F.lit(0).alias("part_idx"), F.col("m.config").alias("d"))), F.transform(F.col("m.layers"), lambda x, i: F.struct(F.lit("layer").alias("part"), i.alias("part_idx"), x.alias("d"))))
    e = m.select("digest", F.inline(all_of))
    return e.select("digest", "part", "part_idx", F.col("d.mediaType").alias("media_type"), F.substring_index("d.digest", ":", -1).alias("blob"), F.col("d.size").alias("size"))


# ---- content manifests -----------------------------------------------------------------------------------------

# The magic, the letters of the sections and the records that they are padded to.
MANIFEST_MAGIC, SECTIONS, RECORD = "imgv1+contentmanifest+sha256", {"blob": "b", "node": "n", "tree": "t"}, 128


def content_manifests(hashes: DataFrame) -> DataFrame:
    """(manifest, content) of hashes(manifest, kind, ord, hash): magic, table of contents and three padded sections of raw SHA-256 hashes."""
    of = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "hash")))), lambda x: x["hash"]), "").alias(kind)
    rows = hashes.groupBy("manifest").agg(*map(of, SECTIONS))
    padded = lambda x: F.rpad(x, (F.ceil(F.length(x) / (2 * RECORD)) * 2 * RECORD).cast("int"), F.lit("0"))
    toc, at, body = [], F.lit(RECORD).cast("long"), []
    for kind, letter in SECTIONS.items():
        size = (F.length(kind) / 2).cast("long")
        toc += [F.lit(letter.encode().hex()), _bytes(at, 8), _bytes(size, 8)]
        at = (F.ceil((at + size) / RECORD) * RECORD).cast("long")
        body.append(F.col(kind) if kind == "tree" else F.when(F.length(kind) > 0, padded(F.col(kind))).otherwise(""))
    head = F.rpad(F.concat(F.lit(MANIFEST_MAGIC.encode().hex() + "00"), *toc), 2 * RECORD, "0")
    return rows.select("manifest", F.unhex(F.concat(head, *body)).alias("content"))


def read_content_manifests(files: DataFrame, *kinds: str) -> DataFrame:
    """(manifest, kind, ord, hash) of files(manifest, content), of the kinds asked for or of all; other magic and a wrong table of contents end the job."""
    raw, start = F.col("content"), len(MANIFEST_MAGIC) + 1
    good = F.substring(raw, 1, start) == F.lit(MANIFEST_MAGIC.encode() + b"\0")
    sections = []
    for i, (kind, letter) in enumerate(SECTIONS.items()):
        at = start + 17 * i
        good = good & (F.substring(raw, at + 1, 1) == F.lit(letter.encode()))
        sections.append(F.struct(F.lit(kind).alias("kind"), _number(raw, at + 1, 8).alias("at"), _number(raw, at + 9, 8).alias("size")))
    wanted = [s for s, kind in zip(sections, SECTIONS) if not kinds or kind in kinds]
    s = files.select("manifest", "content", F.inline(_ends(good, F.array(*wanted), F.lit("no content manifest of SHA-256 hashes")))).where("size > 0")
    h = s.select("manifest", "kind", "at", "content", F.explode(F.sequence(F.lit(0), (F.col("size") / 32).cast("long") - 1)).alias("ord"))
    return h.select("manifest", "kind", "ord", F.lower(F.hex(F.substring("content", (F.col("at") + 32 * F.col("ord") + 1).cast("int"), F.lit(32)))).alias("hash"))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """(manifest) paths of a collection file, one a line; blank lines don't count."""
    return spark.read.text(path).select(F.btrim("value").alias("manifest")).where("manifest <> ''")


# ---- compact streams -------------------------------------------------------------------------------------------

# The header is 128 bytes; a reference is its offset, a SHA-256 digest and a size.
STREAM_MAGIC, STREAM_HEADER, REFERENCE = b"CASSTR\x00\x01", 128, 48


def compact_streams(streams: DataFrame) -> DataFrame:
    """(stream, content) of streams(stream, refs: array of (offset, digest, size), inline): header, reference table, inline bytes as they are."""
    table = F.array_join(F.transform("refs", lambda r: F.concat(_bytes(r["offset"], 8), F.lower(r["digest"]), _bytes(r["size"], 8))), "")
    size = F.size("refs").cast("long") * REFERENCE
    head = F.concat(F.lit(STREAM_MAGIC.hex()), _bytes(F.lit(1), 2), _bytes(F.lit(32), 2), F.lit("00" * 12), _bytes(F.lit(STREAM_HEADER), 8), _bytes(size, 8), _bytes(size + STREAM_HEADER, 8), _bytes(F.octet_length("inline"), 8))
    return streams.select("stream", F.unhex(F.concat(F.rpad(head, 2 * STREAM_HEADER, "0"), table, F.hex("inline"))).alias("content"))


def read_stream_headers(files: DataFrame) -> DataFrame:
    """A row for each of files(stream, content) with its header's fields; another magic, version, hash or a table of broken size ends the job."""
    raw = F.col("content")
    number = lambda at, size: _number(raw, at, size)
    good = (F.substring(raw, 1, 8) == F.lit(STREAM_MAGIC)) & (number(8, 2) == 1) & (number(10, 2) == 32) & (number(32, 8) % REFERENCE == 0)
    level = number(15, 1)
    own = F.when(number(56, 1) % 2 == 1, F.struct(number(64, 8).alias("size"), F.lower(F.hex(F.substring(raw, 73, 32))).alias("digest")))
    fields = F.struct(
        number(12, 1).alias("stream_compression"), number(13, 1).alias("original_compression"), (number(14, 1) == 1).alias("seekable"), F.when(level > 127, level - 256).otherwise(level).alias("compression_level"),
        number(16, 1).alias("compressor_jobs"), number(20, 4).alias("end_padding"), number(24, 8).alias("table_at"), number(32, 8).alias("table_size"), number(40, 8).alias("stream_at"), number(48, 8).alias("stream_size"),
        own["size"].alias("compressed_size"), own["digest"].alias("compressed_digest"))
    return files.select("stream", _ends(good, fields, F.lit("no compact stream that can be read")).alias("h"), "content").select("stream", "h.*", "content")


def read_references(files: DataFrame) -> DataFrame:
    """(stream, ord, offset, digest, size) of the reference tables of files(stream, content); a table that the file cuts short ends the job."""
    h = read_stream_headers(files)
    whole = F.octet_length("content") >= F.col("table_at") + F.col("table_size")
    n = _ends(whole, (F.col("table_size") / REFERENCE).cast("long"), F.lit("a reference table is cut short"))
    r = h.withColumn("n", n).where("n > 0").select("stream", "content", "table_at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ord"))
    at = F.col("table_at") + REFERENCE * F.col("ord")
    return r.select("stream", "ord", _number(F.col("content"), at.cast("int"), 8).alias("offset"), F.lower(F.hex(F.substring("content", (at + 9).cast("int"), F.lit(32)))).alias("digest"), _number(F.col("content"), (at + 40).cast("int"), 8).alias("size"))


def _inflated(batches):
    for b in batches:
        sizes = []
        for raw in b.column(1):
            n, source = 0, pa.input_stream(pa.BufferReader(raw.as_buffer()), compression="zstd")
            while part := source.read(1 << 20):
                n += len(part)
            sizes.append(n)
        yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64())], names=["stream", "inline"])


def inspect_streams(files: DataFrame) -> DataFrame:
    """(stream, refs, referenced, inline, reconstructed): how many references, the bytes behind them, the inline bytes (of a zstd stream: once unpacked) and both together."""
    h = read_stream_headers(files)
    of = F.col("content").substr((F.col("stream_at") + 1).cast("int"), F.col("stream_size").cast("int"))
    key = h.schema["stream"].dataType.simpleString()
    plain = h.where("stream_compression = 0").select("stream", F.col("stream_size").alias("inline"))
    packed = h.where("stream_compression = 1").select("stream", of.alias("raw")).mapInArrow(_inflated, f"stream {key}, inline long")
    refs = read_references(files).groupBy("stream").agg(F.count("*").alias("refs"), F.sum("size").alias("referenced"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return plain.unionByName(packed).join(refs, "stream", "left").select("stream", none("refs"), none("referenced"), "inline", (F.coalesce("referenced", F.lit(0)) + F.col("inline")).alias("reconstructed"))
