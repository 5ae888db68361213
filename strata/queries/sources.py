"""Queries that scan what they have written: archives, specs, parameter files, layouts, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kv
from ..operators import dedup, images
from ..session import scratch
from ..sources import archives, formats, layouts, mtree, params
from .layers import files
from .registry import query

NUL = "\0"


def _lines(df, *values):
    """df's values as lines of a parameter file."""
    return df.select("ord", F.concat(*[F.lit(v) if isinstance(v, str) else v for v in values]).alias("value"))


def _parts(t):
    return t.part.select(F.col("p_partkey").alias("ord"), "p_name", "p_type", "p_brand", "p_size")


@query("SELECT p_partkey AS ord, 'opt/' || p_name AS path, CASE WHEN p_size % 2 = 0 THEN 'regular' ELSE 'directory' END AS file_type, 'src/' || p_brand AS source FROM part")
def file_params(t):
    p = _parts(t)
    return params.add_files(_lines(p, F.lit("opt/"), F.col("p_name"), NUL, F.when(F.col("p_size") % 2 == 0, "f").otherwise("d"), F.lit("src/"), F.col("p_brand")))


@query("SELECT p_partkey AS ord, 'bin/' || p_name AS link, '/opt/' || p_type AS target FROM part")
def symlink_params(t):
    return params.symlinks(_lines(_parts(t), F.lit("bin/"), F.col("p_name"), NUL, F.lit("/opt/"), F.col("p_type")))


@query("SELECT p_partkey AS ord, p_name AS path FROM part WHERE p_size % 2 = 0")
def path_params(t):
    return params.paths(_lines(_parts(t), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("")))


@query("SELECT p_partkey + 1 AS ord, 'opt/' || p_type || '/f' || p_partkey AS path, 'regular' AS file_type, 's' AS source FROM part WHERE p_partkey <> 7")
def placement_params(t):
    head = t.spark.createDataFrame([(0, "relative\0/opt\0pkg\0pkg/" + "skipped")], "ord long, value string")
    p = _parts(t)
    name = F.when(F.col("ord") == 7, "skipped").otherwise(F.concat("p_type", F.lit("/f"), F.col("ord").cast("string")))
    rows = p.select((F.col("ord") + 1).alias("ord"), F.concat(F.lit("pkg/"), name, F.lit(NUL + "fs")).alias("value"))
    return params.placement(head.unionByName(rows))


@query("""
    SELECT sha256(text) AS digest, list_sort(list(DISTINCT source)) AS paths FROM documents GROUP BY 1""")
def layer_hints(t):
    h = t.documents.select(F.sha2("text", 256).alias("digest"), F.col("source").alias("path"))
    first = params.hints_by_digest(h.where("path < 'src5'"))
    again = params.reread_hints(params.render_hints(first)).unionByName(h.where("path >= 'src5'"))
    return params.hints_by_digest(again)


@query("SELECT CAST(p_size AS INTEGER) AS layer_idx, 'meta/' || p_name AS path FROM part")
def required_layer_params(t):
    return params.required_layers(_lines(_parts(t), F.col("p_size").cast("string"), NUL, F.lit("meta/"), F.col("p_name")))


@query("SELECT 'KEY' || user_id AS key, 'value of ' || arg_max(event_type, event_id) AS value FROM events WHERE event_id % 5 <> 0 GROUP BY user_id")
def stamp_lines(t):
    e = t.events
    line = F.when(F.col("event_id") % 5 == 0, "# comment").otherwise(F.concat(F.lit("KEY"), F.col("user_id").cast("string"), F.lit(" value of "), "event_type"))
    return params.stamps(e.select(F.col("event_id").alias("ord"), line.alias("value")))


@query("""SELECT DISTINCT 'K' || p_size AS key, 'v ' || p_size AS value FROM part""")
def env_file_lines(t):
    line = F.concat(F.lit("K"), F.col("p_size").cast("string"), F.lit('="v '), F.col("p_size").cast("string"), F.lit('"'))
    return params.env_file(t.part.select(line.alias("value")).distinct())


@query("SELECT s_name AS name, 'x' AS password, s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS gid, '/home/' || s_name AS home FROM supplier")
def account_lines(t):
    line = F.concat_ws(":", "s_name", F.lit("x"), F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"), F.lit(""), F.concat(F.lit("/home/"), "s_name"), F.lit("/bin/sh"))
    return params.accounts(t.supplier.select(line.alias("value"))).select("name", "password", "id", "gid", "home")


@query("""SELECT user_id, ['a=' || count(*), 'b=1', 'b=2'] AS items FROM events GROUP BY user_id""")
def kv_objects(t):
    e = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    text = F.concat(F.lit('{"b":["1","2"],"a":"'), F.col("n").cast("string"), F.lit('"}'))
    return e.select("user_id", F.transform(kv.object_pairs(text), lambda p: F.concat(p["key"], F.lit("="), p["value"])).alias("items"))


@query("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS VARCHAR) AS value FROM events")
def json_reroot(t):
    return layouts.inject(t.events.select("event_id", F.concat(F.lit('{"a":{"b":'), "props", F.lit("}}")).alias("value")), "a.b.k").select("event_id", "value")


@query("SELECT event_id, '{\"outer\":{\"k\":\"' || event_type || '\"},\"list\":[{\"x\":1}]}' AS value FROM events")
def json_lower_keys(t):
    v = F.concat(F.lit('{"Outer":{"K":"'), "event_type", F.lit('"},"LIST":[{"X":1}]}'))
    return layouts.lower_keys(t.events.select("event_id", v.alias("value")))


# ---- archives and specs ----------------------------------------------------------------------------------------


def _archive(t):
    """The files of each layer as an archive, with hard links for repeated contents, as binary files."""
    f = files(t).join(t.documents.select(F.col("doc_id").alias("d"), F.col("text").cast("binary").alias("content")), F.col("ord") == F.col("d"))
    linked = dedup.link_repeats(f, ["layer", "digest"]).select(F.col("layer").cast("long").alias("layer"), "ord", "path", F.lit(0o755).alias("mode"), "content", "link")
    return archives.write_layers(linked)


@query("""
    WITH f AS (SELECT CAST(substr(source, 4) AS BIGINT) AS layer, doc_id, 'srv/' || lang || '/f' || doc_id AS path, text, sha256(text) AS digest FROM documents),
         l AS (SELECT *, min(doc_id) OVER w AS o, first_value(path) OVER (PARTITION BY layer, digest ORDER BY doc_id) AS p, row_number() OVER (PARTITION BY layer ORDER BY doc_id) - 1 AS n FROM f WINDOW w AS (PARTITION BY layer, digest))
    SELECT layer, n AS ord, path, CASE WHEN doc_id <> o THEN '1' ELSE '0' END AS typeflag, CASE WHEN doc_id <> o THEN CAST(0 AS BIGINT) ELSE CAST(strlen(text) AS BIGINT) END AS size, CASE WHEN doc_id <> o THEN p ELSE '' END AS linkname, CASE WHEN doc_id = o THEN digest END AS digest FROM l""")
def tar_scan(t):
    path = scratch(t.spark, "tars")
    _archive(t).select("layer", "tar").write.parquet(f"{path}/table")
    raw = t.spark.read.parquet(f"{path}/table")
    # an archive's bytes go to a row of their own, which the scan reads as a file's content
    return _scan_rows(raw).select("layer", "ord", "path", "typeflag", "size", "linkname", "digest")


def _scan_rows(raw):
    def run(parts):
        import pandas as pd

        for p in parts:
            for layer, blob in zip(p["layer"], p["tar"]):
                yield pd.DataFrame([(layer, *r[1:]) for r in archives._rows("", bytes(blob))], columns=["layer", *[c.split()[0] for c in archives.ENTRY.split(", ")[1:]]])

    return raw.mapInPandas(run, archives.ENTRY.replace("archive string", "layer long"))


@query("""
    WITH f AS (SELECT 'srv/' || lang || '/f' || doc_id AS path, n_chars, sha256(text) AS digest FROM documents)
    SELECT path, ['type=file', 'size=' || n_chars, 'mode=0755', 'sha256digest=' || digest] AS items FROM f""")
def mtree_round_trip(t):
    f = files(t).select("path", F.lit("file").alias("type"), "size", F.lit(0o755).alias("mode"), F.lit(0).alias("uid"), F.lit(0).alias("gid"), F.lit("").alias("uname"), F.lit("").alias("gname"), "digest", F.lit(0).alias("mtime"), F.lit("").alias("linkname"), F.lit(1).alias("nlink"))
    path = scratch(t.spark, "mtree")
    mtree.write(f, ["uid", "type", "size", "mode", "sha256", "uname"], path)
    back = mtree.parse(t.spark.read.option("recursiveFileLookup", "true").text(path))
    return back.select("path", mtree.keep(F.col("keywords"), ["type", "size", "mode", "sha256", "xattr"]).alias("items"))


@query("""
    SELECT source AS spec, lang AS path, 'dir' AS type, '0755' AS mode, CAST(NULL AS VARCHAR) AS size FROM documents GROUP BY ALL
    UNION ALL SELECT source, lang || '/café ' || doc_id, 'file', '0644', CAST(n_chars AS VARCHAR) FROM documents UNION ALL SELECT DISTINCT source, 'full/name', 'file', '0600', '1' FROM documents""")
def mtree_relative(t):
    """Specs with settings, folders that are entered and left, and escaped names; a spec for each source."""
    line = F.concat(F.lit("caf\\303\\251\\040"), F.col("doc_id").cast("string"), F.lit(" size="), F.col("n_chars").cast("string"))
    folders = t.documents.groupBy("source", "lang").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))
    folder = F.concat("lang", F.lit(" type=dir \\\n    mode=0755\n"), "body", F.lit("\n..\n"))
    spec = folders.groupBy(F.col("source").alias("spec")).agg(F.concat(F.lit("#mtree v2.0\n/set type=file mode=0644\n"), F.array_join(F.sort_array(F.collect_list(folder)), ""), F.lit("/unset mode\n./full/name mode=0600 size=1\n")).alias("content"))
    k = lambda c: F.col("keywords")[c].alias(c)
    return mtree.parse_specs(spec).select("spec", "path", k("type"), k("mode"), k("size"))


@query("""
    SELECT p_partkey, CASE p_size % 7 WHEN 5 THEN 'dir' WHEN 2 THEN 'link' WHEN 3 THEN 'char' WHEN 4 THEN 'block' WHEN 6 THEN 'fifo' ELSE 'file' END AS type, ['xattr.a=' || to_base64(encode(p_type)), 'xattr.b=' || to_base64(encode(p_brand))] AS attributes FROM part""")
def mtree_types(t):
    pax = F.create_map(F.lit("SCHILY.xattr.b"), "p_brand", F.lit("mtime"), F.lit("0"), F.lit("SCHILY.xattr.a"), "p_type")
    return t.part.select("p_partkey", mtree.entry_type((F.col("p_size") % 7).cast("string")).alias("type"), mtree.xattrs(pax).alias("attributes"))


@query("""
    WITH a AS (SELECT doc_id, doc_id AS ord FROM documents), m AS (SELECT max(ord) AS m FROM a)
    SELECT doc_id, ord FROM a UNION ALL SELECT page_id, page_id + m + 1 FROM pages, m""")
def tar_import(t):
    own = t.documents.select("doc_id", F.col("doc_id").alias("ord"))
    return archives.import_entries(own, t.pages.select(F.col("page_id").alias("doc_id"), F.col("page_id").alias("ord")))


# ---- layouts and manifests -------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS digest, length(any_value(text)) AS n FROM documents GROUP BY 1")
def cas_folder(t):
    path = scratch(t.spark, "cas")
    formats.write_cas(t.documents.select(F.sha2("text", 256).alias("digest"), F.col("text").alias("content")), path)
    return formats.read_cas(t.spark, path).select("digest", F.char_length(F.decode("content", "UTF-8")).cast("long").alias("n"))


_IMAGES = """
    WITH p AS (SELECT page_id, html, '{"architecture":"amd64","os":"linux","page":' || page_id || '}' AS config FROM pages),
         i AS (SELECT *, '{"schemaVersion":2,"config":{"mediaType":"c","digest":"sha256:' || sha256(config) || '","size":' || strlen(config) || '},"layers":[{"mediaType":"l","digest":"sha256:' || sha256(html) || '","size":' || strlen(html) || '}]}' AS body FROM p)"""


def _layout(t):
    """A layout with an image for each page: a config of its own and the page as its layer."""
    path, digest = scratch(t.spark, "layout"), lambda c: F.concat(F.lit('"sha256:'), F.sha2(c, 256), F.lit('","size":'), F.octet_length(c).cast("string"))
    p = t.pages.select("page_id", "html", F.concat(F.lit('{"architecture":"amd64","os":"linux","page":'), F.col("page_id").cast("string"), F.lit("}")).alias("config"))
    body = F.concat(F.lit('{"schemaVersion":2,"config":{"mediaType":"c","digest":'), digest("config"), F.lit('},"layers":[{"mediaType":"l","digest":'), digest("html"), F.lit("}]}"))
    m = p.select(F.col("page_id").alias("ord"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("ref"), F.lit("application/vnd.oci.image.manifest.v1+json").alias("media_type"), body.alias("body"))
    formats.write_layout(m, p.select(F.col("html").alias("content")).union(p.select("config")), path)
    return path


@query(f"""{_IMAGES}
    SELECT row_number() OVER (ORDER BY page_id) - 1 AS ord, 'p' || page_id AS ref, sha256(body) AS digest, strlen(body) AS size FROM i""")
def oci_layout(t):
    return formats.read_layout(t.spark, _layout(t)).select("ord", "ref", "digest", "size")


@query(f"""{_IMAGES}
    SELECT DISTINCT sha256(body) AS digest, 'config' AS part, sha256(config) AS blob, strlen(config) AS size FROM i UNION SELECT sha256(body), 'layer', sha256(html), strlen(html) FROM i""")
def oci_layout_parts(t):
    path = _layout(t)
    index = formats.read_layout(t.spark, path)
    parts = formats.layout_parts(formats.layout_blobs(t.spark, path, index))
    blobs = formats.layout_blobs(t.spark, path).select(F.col("digest").alias("blob"), F.octet_length("content").cast("long").alias("n"))
    return parts.join(blobs, "blob").where("size = n").select("digest", "part", "blob", "size")


@query("SELECT source AS manifest, 'blob' AS kind, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ord, sha256(text) AS hash FROM documents")
def content_manifest_blobs(t):
    return formats.read_content_manifests(_manifest_files(t), "blob")


@query("SELECT kind, hash, count(*) AS n FROM (SELECT 'blob' AS kind, sha256(text) AS hash FROM documents UNION ALL SELECT 'node', sha256(lang) FROM documents UNION ALL SELECT 'tree', sha256(source) FROM (SELECT DISTINCT source FROM documents)) GROUP BY ALL")
def content_manifests(t):
    return formats.read_content_manifests(_manifest_files(t)).groupBy("kind", "hash").agg(F.count("*").alias("n"))


def _manifest_files(t):
    """A content manifest for each source, written to files and read back."""
    path = scratch(t.spark, "manifests")
    row = lambda kind, c: t.documents.select(F.col("source").alias("manifest"), F.lit(kind).alias("kind"), F.col("doc_id").alias("ord"), F.sha2(c, 256).alias("hash"))
    trees = t.documents.select("source").distinct().select(F.col("source").alias("manifest"), F.lit("tree").alias("kind"), F.lit(0).cast("long").alias("ord"), F.sha2("source", 256).alias("hash"))
    made = formats.content_manifests(row("blob", "text").unionByName(row("node", "lang")).unionByName(trees))
    formats.write_files(made.select(F.concat("manifest", F.lit(".manifest")).alias("path"), "content"), path)
    return formats.read_files(t.spark, path).select(F.regexp_replace("path", r"\.manifest$", "").alias("manifest"), "content")


def _streams(t):
    """A compact stream for each conversation: its turns are references, its id the inline bytes."""
    c = t.conversations.select("conv_id", (F.col("turn") * 1000).cast("long").alias("offset"), F.sha2("text", 256).alias("digest"), F.char_length("text").cast("long").alias("size"))
    g = c.groupBy(F.col("conv_id").alias("stream")).agg(F.array_sort(F.collect_list(F.struct("offset", "digest", "size"))).alias("refs"))
    return formats.compact_streams(g.withColumn("inline", F.encode(F.col("stream").cast("string"), "UTF-8")))


@query("""
    SELECT conv_id AS stream, row_number() OVER (PARTITION BY conv_id ORDER BY turn, sha256(text), length(text)) - 1 AS ord, turn * 1000 AS "offset", sha256(text) AS digest, length(text) AS size FROM conversations""")
def reference_tables(t):
    return formats.read_references(_streams(t))


@query("""
    SELECT conv_id AS stream, count(*) AS refs, CAST(sum(length(text)) AS BIGINT) AS referenced, length(CAST(conv_id AS VARCHAR)) AS inline, CAST(sum(length(text)) + length(CAST(conv_id AS VARCHAR)) AS BIGINT) AS reconstructed FROM conversations GROUP BY conv_id""")
def compact_stream_sizes(t):
    return formats.inspect_streams(_streams(t))


def _deploy(t):
    n = F.col("n_nationkey").cast("string")
    push = F.concat(F.lit('{"command":"push","registry":"r'), n, F.lit('","repository":"p","tags":["a","b'), n, F.lit('"]}'))
    tag = F.concat(F.lit('{"command":"registry_tag","registry":"r'), n, F.lit('","repository":"q","tags":["t"]}'))
    load = F.concat(F.lit('{"command":"load","tags":["l'), n, F.lit('"],"daemon":"docker"}'))
    ops = F.when(F.col("n_nationkey") % 2 == 0, F.concat_ws(",", push, load)).otherwise(F.concat_ws(",", load, tag, push))
    return t.nation.select(F.col("n_nationkey").alias("manifest"), F.concat(F.lit('{"operations":['), ops, F.lit("]}")).alias("body"))


@query("SELECT n_nationkey AS manifest, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 2 END AS op_idx, 'r' || n_nationkey AS registry, 'p' AS repository, ['a', 'b' || n_nationkey] AS tags FROM nation")
def push_operations(t):
    return layouts.push_operations(_deploy(t))


@query("SELECT n_nationkey AS manifest, 1 AS op_idx, 'r' || n_nationkey AS registry, 'q' AS repository, ['t'] AS tags FROM nation WHERE n_nationkey % 2 = 1")
def tag_operations(t):
    return layouts.tag_operations(_deploy(t))


@query("SELECT n_nationkey AS manifest, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS op_idx, ['l' || n_nationkey] AS tags, 'docker' AS daemon FROM nation")
def load_operations(t):
    return layouts.load_operations(_deploy(t))


@query("""SELECT '{"operations":[' || string_agg('{"command":"push","registry":"' || n_name || '"}', ',' ORDER BY n_nationkey) || '],"settings":{"blob_repository":"blobs","forbid_layer_push":true}}' AS body FROM nation""")
def merged_manifest(t):
    ops = t.nation.select(F.col("n_nationkey").alias("ord"), F.concat(F.lit('{"command":"push","registry":"'), "n_name", F.lit('"}')).alias("op"))
    settings = t.spark.createDataFrame([("blobs", True)], "blob_repository string, forbid_layer_push boolean")
    return layouts.write_merged(ops, settings)


@query("SELECT p_partkey, p_type AS media_type, 'd' || p_partkey AS digest, 'i' || p_partkey AS diff_id, CAST(p_size AS BIGINT) AS size FROM part")
def layer_metadata(t):
    n = F.col("p_partkey").cast("string")
    layers = t.part.select("p_partkey", F.col("p_type").alias("media_type"), F.concat(F.lit("d"), n).alias("digest"), F.concat(F.lit("i"), n).alias("diff_id"), F.col("p_size").cast("long").alias("size"), F.lit(None).cast("array<string>").alias("history"))
    return layouts.read_descriptors(layouts.layer_metadata(layers).select("p_partkey", "metadata"))


@query("""
    WITH x AS (SELECT l_orderkey AS image, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS layers FROM lineitem WHERE l_quantity >= 40 GROUP BY l_orderkey)
    SELECT image, CAST(len(layers) AS BIGINT) AS n, layers[1] AS first FROM x""")
def seekable_index(t):
    li = t.lineitem.select(F.col("l_orderkey").alias("image"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("layer_idx"), F.lit("ztoc").alias("media_type"), F.col("l_partkey").alias("digest"), F.col("l_partkey").alias("diff_id"), F.col("l_quantity").alias("size"))
    return images.layer_descriptors(li, 40).select("image", F.size("layers").cast("long").alias("n"), F.element_at("layers", 1)["digest"].alias("first"))
