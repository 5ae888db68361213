"""Queries of assembly: headers, manifests, indexes, accounts, targets, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kv, scalars
from ..operators import assembly
from .registry import query


def _pairs(m):
    return F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])))


@query("""
    SELECT doc_id AS path, CASE WHEN quality = 1 THEN CAST(493 AS BIGINT) ELSE 420 END AS mode, CASE WHEN quality IS NOT NULL THEN CAST(toxic AS BIGINT) ELSE 7 END AS uid, CASE WHEN quality IS NOT NULL THEN 'own' ELSE lang END AS uname,
           CASE WHEN quality = 1 THEN TIMESTAMP '2024-05-06 07:08:09' ELSE TIMESTAMP '1970-01-01 00:00:00' END AS mtime, CASE WHEN quality = 1 THEN ['a=2', 'b=1', 'c=3'] ELSE ['a=1', 'b=1'] END AS pax FROM documents LEFT JOIN labels USING (doc_id)""")
def field_application(t):
    nul = F.lit(None)
    e = t.documents.select(F.col("doc_id").alias("path"), F.lit(420).cast("long").alias("mode"), F.lit(7).cast("long").alias("uid"), F.lit(0).cast("long").alias("gid"), F.col("lang").alias("uname"), F.lit("").alias("gname"), F.timestamp_seconds(F.lit(0)).alias("mtime"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")).alias("pax"))
    good = F.col("quality") == 1
    f = t.labels.select(F.col("doc_id").alias("path"), F.when(good, "0755").alias("mode"), F.col("toxic").cast("long").alias("uid"), nul.cast("long").alias("gid"), F.lit("own").alias("uname"), nul.cast("string").alias("gname"), F.when(good, "2024-05-06T07:08:09Z").alias("mtime"), F.when(good, F.create_map(F.lit("a"), F.lit("2"), F.lit("c"), F.lit("3"))).alias("pax"))
    out = assembly.apply_fields(e, f)
    return out.select("path", "mode", "uid", "uname", F.col("mtime").cast("timestamp_ntz").alias("mtime"), _pairs(F.col("pax")).alias("pax"))


@query("""
    SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '5' WHEN 1 THEN '0' ELSE '2' END AS typeflag, p_type || '/' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '/' ELSE '' END AS name, ['SCHILY.xattr.user=' || p_brand, 'comment=x'] AS pax FROM part""")
def base_headers(t):
    k = F.col("p_size") % 3
    e = t.part.select("p_partkey", F.concat(F.lit("/"), "p_type", F.lit("/"), F.col("p_partkey").cast("string"), F.lit("/")).alias("path"), F.when(k == 0, "dir").when(k == 1, "file").otherwise("symlink").alias("entry_type"), F.create_map(F.lit("comment"), F.lit("x"), F.lit("SCHILY.xattr.user"), F.lit("old")).alias("pax"), F.create_map(F.lit("user"), "p_brand").alias("xattrs"))
    return assembly.to_headers(e).select("p_partkey", "typeflag", "name", _pairs(F.col("pax")).alias("pax"))


@query("SELECT p_partkey, ['file', 'dir', 'hardlink', 'symlink', 'fifo'][p_size % 5 + 1] AS entry_type FROM part WHERE p_size % 5 IN (0, 3)")
def entries_of_types(t):
    e = t.part.select("p_partkey", F.element_at(F.array(*map(F.lit, ("file", "dir", "hardlink", "symlink", "fifo"))), F.col("p_size") % 5 + 1).alias("entry_type"))
    return assembly.of_types(e, assembly.TYPE_BITS["file"] | assembly.TYPE_BITS["symlink"])


@query("SELECT doc_id FROM documents WHERE lang = 'fr' OR lang = 'de' AND doc_id % 10 = 1")
def entries_with_prefixes(t):
    e = t.documents.select("doc_id", F.when((F.col("lang") == "de") & (F.col("doc_id") % 10 == 1), F.lit("exact/de")).otherwise(F.concat_ws("/", F.lit("srv"), "lang", F.col("doc_id").cast("string"))).alias("path"))
    return assembly.with_prefixes(e, ["/srv/fr/", "exact/de", "srv/f"]).select("doc_id")


@query("""
    SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN ['roots'] WHEN 1 THEN ['child_manifests', 'referrers', 'roots'] WHEN 2 THEN ['referrers', 'roots'] ELSE ['referrers'] END AS targets FROM nation""")
def signing_targets(t):
    k = F.col("n_nationkey") % 4
    asked = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("all"))).otherwise(F.array(F.lit("referrers")))
    return t.nation.select("n_nationkey", assembly.signing_targets(asked, F.when(k == 3, F.array(F.lit("referrers")))).alias("targets"))


@query("""
    WITH l AS (SELECT l_orderkey AS image, string_agg('{"digest":"d' || l_partkey || '"}', ',' ORDER BY l_linenumber, '{"digest":"d' || l_partkey || '"}') AS l FROM lineitem GROUP BY l_orderkey),
         b AS (SELECT o_orderkey AS image, '{"schemaVersion":2,"layers":[' || coalesce(l, '') || ']' || CASE WHEN o_orderkey % 2 = 0 THEN ',"x":{"kept":1}' ELSE '' END || '}' AS body FROM orders LEFT JOIN l ON image = o_orderkey)
    SELECT image, 'sha256:' || sha256(body) AS digest, CAST(strlen(body) AS INTEGER) AS size FROM b""")
def manifest_rewrite(t):
    m = t.orders.select(F.col("o_orderkey").alias("image"), F.lit('"schemaVersion":2').alias("head"), F.when(F.col("o_orderkey") % 2 == 0, '"x":{"kept":1}').otherwise("").alias("tail"))
    layers = t.lineitem.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("layer_idx"), F.concat(F.lit('{"digest":"d'), F.col("l_partkey").cast("string"), F.lit('"}')).alias("descriptor"))
    return assembly.rewrite_manifests(m, layers).select("image", "digest", "size")


@query("SELECT n_regionkey AS idx, list(n_name ORDER BY n_nationkey % 3 = 0, n_nationkey) AS digests FROM nation GROUP BY n_regionkey")
def index_assembly(t):
    c = t.nation.select(F.col("n_regionkey").alias("index"), F.when(F.col("n_nationkey") % 3 == 0, "seekable").otherwise("manifest").alias("kind"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("digest"))
    return assembly.assemble_index(c).select(F.col("index").alias("idx"), "digests")


@query("SELECT n_regionkey AS idx, n_nationkey AS pos, CASE WHEN n_nationkey % 2 = 0 THEN 'new ' || n_name ELSE n_name END AS digest FROM nation")
def index_rewrite(t):
    i = t.nation.select(F.col("n_regionkey").alias("index"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("digest"))
    changed = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("old"), F.concat(F.lit("new "), "n_name").alias("new"))
    return assembly.rewrite_indexes(i, changed).select(F.col("index").alias("idx"), "pos", "digest")


@query("SELECT s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN s_name || ':hash:1::::::' ELSE s_name || ':!*:::::::' END AS line FROM supplier")
def shadow_lines(t):
    own = t.supplier.where("s_suppkey % 4 = 0").select(F.col("s_name").alias("name"), F.concat("s_name", F.lit(":hash:1::::::")).alias("line"))
    return assembly.shadow_lines(t.supplier.select(F.col("s_name").alias("name")), own)


@query("""
    SELECT 'home/' || s_nationkey AS path, min(s_suppkey) AS uid, arg_min(s_name, s_suppkey) AS uname, CAST(CASE WHEN min(s_suppkey) = 0 THEN 448 ELSE 493 END AS INTEGER) AS mode FROM supplier WHERE s_nationkey <> 3 GROUP BY s_nationkey""")
def home_folders(t):
    home = F.when(F.col("s_nationkey") == 3, "/").otherwise(F.concat(F.lit("/home/"), F.col("s_nationkey").cast("string"), F.lit("/")))
    a = t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("gid"), home.alias("home"))
    return assembly.home_folders(a).select("path", "uid", "uname", "mode")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'repo/' || p_name ELSE '_main/' || p_name END AS rebased, CASE p_type WHEN 'SMALL' THEN CAST(0 AS BIGINT) WHEN 'LARGE' THEN 1 ELSE -1 END AS grp FROM part")
def rebased_paths(t):
    short = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("../repo/"), "p_name")).otherwise(F.col("p_name"))
    groups = F.array(F.lit("SMALL"), F.lit("LARGE"), F.lit("SMALL"))
    return t.part.select("p_partkey", assembly.rebase(short).alias("rebased"), assembly.group_index(groups, "p_type").alias("grp"))


@query("""
    SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN ['a=file', 'b=own', 'n=' || n_name] ELSE ['a=own', 'b=own'] END AS map, CASE WHEN n_nationkey % 3 = 1 THEN ['first', n_name, 'last'] ELSE ['first'] END AS list FROM nation""")
def merged_files(t):
    k, n = F.col("n_nationkey") % 3, F.col("n_name")
    key = F.col("n_nationkey").cast("string")
    templates = t.nation.select(key.alias("key"), F.create_map(F.lit("a"), F.lit("own"), F.lit("b"), F.lit("own")).alias("map"), F.array(F.lit("first")).alias("list"))
    text = F.when(k == 0, F.concat(F.lit("a=gone\nn="), n)).when(k == 1, n).otherwise(" # nothing\n")
    more = F.when(k == 0, "a=file").when(k == 1, "last").otherwise("")
    rows = t.nation.select(key.alias("key"), F.posexplode(F.array(text, more)).alias("ord", "text")).withColumn("i", kv.items("text")).withColumn("kind", kv.kind("i"))
    files = rows.select("key", "ord", "kind", F.when(F.col("kind") == "kv", kv.pairs("i")).alias("pairs"), F.when(F.col("kind") == "list", F.col("i")).alias("items"))
    m = assembly.merge_files(files, templates)
    return m.select(F.col("key").cast("int").alias("n_nationkey"), _pairs(F.col("map")).alias("map"), "list")


@query("""
    SELECT count(*) FILTER (event_type = 'view') AS disk, CAST(sum(event_id) FILTER (event_type = 'view') AS BIGINT) AS disk_bytes, count(*) FILTER (event_type = 'click') AS registry, CAST(sum(event_id) FILTER (event_type = 'click') AS BIGINT) AS registry_bytes FROM events""")
def transfer_stats(t):
    e = t.events.select(F.when(F.col("event_type") == "view", "disk").when(F.col("event_type") == "click", "registry").otherwise("other").alias("source"), F.col("event_id").alias("size"))
    return assembly.transfer_stats(e, ["disk", "registry"])


@query("SELECT page_id AS layer, sha256('gz' || html) AS outer_hash, sha256(html) AS inner_hash, CAST(strlen(html) + 2 AS BIGINT) AS outer_size, CAST(strlen(html) AS BIGINT) AS inner_size FROM pages")
def layer_hashes(t):
    p = t.pages.select(F.col("page_id").alias("layer"), F.concat(F.lit("gz"), "html").cast("binary").alias("raw"), F.col("html").cast("binary").alias("content"))
    return assembly.summary(p).select("layer", F.col("outer").alias("outer_hash"), F.col("inner").alias("inner_hash"), "outer_size", "inner_size")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def custom_digests(t):
    d = t.documents.select("doc_id", F.col("text").cast("binary").alias("raw"))
    other = assembly.digest_with(d, "raw", "long_digest", assembly.sha512)
    return assembly.digest_with(other.where(F.length("long_digest") == 128), "raw", "digest").select("doc_id", "digest")


@query("""
    WITH f AS (SELECT CAST(substr(source, 4) AS INTEGER) AS layer, unnest(['srv', 'srv/' || lang]) AS path FROM documents) SELECT layer, path, CAST(CASE WHEN path = 'srv' THEN 448 WHEN count(*) > 10 THEN 493 ELSE 420 END AS INTEGER) AS mode FROM f GROUP BY layer, path""")
def parents_with_metadata(t):
    from .layers import files

    return assembly.parents_with(files(t), "layer", "path", lambda p, n: F.when(p == "srv", 0o700).when(n > 10, 0o755).otherwise(0o644))


@query("""
    SELECT p_partkey, 'name ' || p_name || '; brand ' || p_brand || '+x; ' || CASE WHEN starts_with(p_type, 'S') THEN 'true' ELSE 'false' END || '; ' || replace(p_name, ' ', '-') || '; 1970-01-01T00:00:' || lpad(CAST(p_size AS VARCHAR), 2, '0') || 'Z' AS text FROM part""")
def templates(t):
    columns = {"name": F.col("p_name"), "kv": F.array(F.concat(F.lit("BRAND="), "p_brand")), "type": F.col("p_type"), "words": F.split("p_name", " "), "size": F.col("p_size")}
    text = assembly.compile_template('name {{.name}}; brand {{ appendkv .kv "BRAND" "+x" }}; {{hasprefix .type "S"}}; {{join .words "-"}}; {{rfc3339 .size}}', columns)
    return t.part.select("p_partkey", text.alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS created FROM orders")
def parsed_timestamps(t):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" "))).otherwise("  ")
    return t.orders.select("o_orderkey", scalars.timestamp_or_null(text).cast("timestamp_ntz").alias("created"))


@query("SELECT count(*) AS keys, TRUE AS within, 16 AS shards FROM (SELECT DISTINCT user_id, event_type FROM events)")
def sharded_keys(t):
    k = t.events.select("user_id", "event_type").distinct().withColumn("s", assembly.shard(["user_id", "event_type"], 16))
    return k.agg(F.count("*").alias("keys"), (F.min("s") >= 0).alias("a"), (F.max("s") < 16).alias("b"), F.count_distinct("s").cast("int").alias("shards")).select("keys", (F.col("a") & F.col("b")).alias("within"), "shards")
