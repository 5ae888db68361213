"""Queries of layers: deduplication, offsets, overlays, hashes, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import ancestors
from ..operators import dedup, images, overlay, streams
from .registry import query

LAYER = "CAST(substr(source, 4) AS INTEGER)"


def files(t):
    """documents as entries of layers."""
    d = t.documents
    layer = F.substring("source", 4, 10).cast("int")
    return d.select(layer.alias("layer"), F.col("doc_id").alias("ord"), F.concat_ws("/", F.lit("srv"), "lang", F.concat(F.lit("f"), F.col("doc_id").cast("string"))).alias("path"), F.sha2("text", 256).alias("digest"), F.col("n_chars").alias("size"), "lang")


_FILES = f"SELECT {LAYER} AS layer, doc_id AS ord, 'srv/' || lang || '/f' || doc_id AS path, sha256(text) AS digest, n_chars AS size, lang FROM documents"


@query(f"""
    WITH f AS ({_FILES}) SELECT ord, path, digest, CASE WHEN ord <> min(ord) OVER (PARTITION BY digest) THEN first_value(path) OVER (PARTITION BY digest ORDER BY ord) END AS link FROM f""")
def blob_dedup(t):
    return dedup.link_repeats(files(t), ["digest"]).select("ord", "path", "digest", "link")


@query(f"""
    WITH f AS ({_FILES}) SELECT ord, lang, CASE WHEN ord <> min(ord) OVER (PARTITION BY lang, size, digest) THEN first_value(path) OVER (PARTITION BY lang, size, digest ORDER BY ord) END AS link FROM f""")
def node_dedup(t):
    keyed = files(t).withColumn("node", dedup.node_key("lang", "size"))
    return dedup.link_repeats(keyed, ["node", "digest"]).select("ord", "lang", "link")


@query(f"""
    WITH f AS (SELECT *, layer % 2 = 0 AS b FROM ({_FILES})),
         g AS (SELECT *, CASE WHEN b THEN 'b' ELSE lang END AS k FROM f)
    SELECT layer, ord, b AS is_blob, CASE WHEN ord <> min(ord) OVER w THEN first_value(path) OVER (PARTITION BY layer, b, k, digest ORDER BY ord) END AS link FROM g WINDOW w AS (PARTITION BY layer, b, k, digest)""")
def layer_dedup(t):
    f = files(t)
    default = F.when(F.col("layer") % 2 == 0, 0o755).otherwise(0o644)
    f = f.withColumn("is_blob", dedup.is_blob(F.lit("file"), default, F.lit(0), F.lit(0), F.lit(""), F.lit(""), F.lit(None), F.lit(None)))
    return dedup.link_repeats(f.withColumn("_node", F.when(~F.col("is_blob"), F.struct("lang"))), ["layer", "is_blob", "_node", "digest"]).select("layer", "ord", "is_blob", "link")


@query(f"WITH f AS ({_FILES}) SELECT digest, min(ord) AS first_ord FROM f GROUP BY digest")
def dedup_state(t):
    return dedup.export_state(files(t))


@query(f"""
    WITH f AS ({_FILES}), t AS (SELECT 'L' || layer || lang AS tree, min(ord) AS o, sha256(array_to_string(list_sort(list(CAST(size % 7 AS VARCHAR))), ',')) AS h FROM f GROUP BY ALL)
    SELECT tree, CASE WHEN o <> min(o) OVER (PARTITION BY h) THEN first_value(tree) OVER (PARTITION BY h ORDER BY o) END AS link FROM t""")
def tree_dedup(t):
    f = files(t).withColumn("tree", F.concat(F.lit("L"), F.col("layer").cast("string"), "lang"))
    trees = dedup.link_repeated_trees(f.withColumn("kind", (F.col("size") % 7).cast("string")).withColumn("none", F.lit(None).cast("string")), "tree", "none", "kind", "ord")
    return trees.select("tree", "link")


@query("""
    WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'opt/' || p_brand AS path, 'src/' || l_orderkey || '.' || l_linenumber || '.' || l_suppkey || '.' || l_partkey AS source FROM lineitem JOIN part ON l_partkey = p_partkey),
         c AS (SELECT *, count(*) OVER (PARTITION BY path, l_suppkey) AS n FROM e)
    SELECT l_suppkey, source, CASE WHEN n > 1 THEN path || '/' || substr(source, 5) ELSE path END AS path FROM c""")
def repeated_paths(t):
    e = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    e = e.select("l_suppkey", F.concat(F.col("l_suppkey").cast("string"), F.lit(":opt/"), "p_brand").alias("path"), F.concat(F.lit("src/"), F.concat_ws(".", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")).alias("source"))
    return dedup.rewrite_repeated_paths(e).select("l_suppkey", "source", F.regexp_replace("path", "^[0-9]+:", "").alias("path"))


@query(f"""
    WITH f AS ({_FILES}) SELECT layer, ord, CAST(coalesce(sum((size + 511) // 512 * 512) OVER (PARTITION BY layer ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM f""")
def layer_offsets(t):
    return dedup.running_offsets(files(t), ["ord"], F.col("size"), ["layer"], align=512).select("layer", "ord", "offset")


@query(f"""
    WITH f AS ({_FILES}) SELECT ord, CAST(coalesce(sum(size) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM f""")
def stream_offsets(t):
    return dedup.running_offsets(files(t), ["ord"], F.col("size")).select("ord", "offset")


def _refs(t):
    f = files(t)
    return dedup.running_offsets(f, ["ord"], F.col("size") + F.col("ord") % 100, ["layer"]).select(F.col("layer").alias("stream"), "ord", "offset", "digest", "size")


_REFS = f"""SELECT layer AS stream, ord, digest, size, CAST(coalesce(sum(size + ord % 100) OVER (PARTITION BY layer ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM ({_FILES})"""


@query(f"""
    WITH r AS ({_REFS}) SELECT stream, ord, "offset" - lag("offset" + size, 1, 0) OVER (PARTITION BY stream ORDER BY "offset", size) AS gap, "offset" < lag("offset" + size, 1, 0) OVER (PARTITION BY stream ORDER BY "offset", size) AS overlaps FROM r""")
def stream_gaps(t):
    return dedup.gaps(streams.check_refs(_refs(t)), ["stream"]).select("stream", "ord", "gap", "overlaps")


@query(f"""
    WITH r AS ({_REFS}) SELECT stream, count(*) AS refs, CAST(sum(size) AS BIGINT) AS referenced_bytes, CAST(sum(ord % 100) AS BIGINT) AS inline_bytes, CAST(sum(size + ord % 100) AS BIGINT) AS reconstructed_size FROM r GROUP BY stream""")
def stream_inspect(t):
    r = _refs(t)
    return streams.inspect(r, r.select("stream", (F.col("ord") % 100).alias("size")))


@query("""
    SELECT conv_id AS stream, sha256(string_agg(role || ':' || text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def stream_reconstruct(t):
    c = t.conversations
    inline = c.select(F.col("conv_id").alias("stream"), (F.col("turn") * 2).alias("offset"), F.concat("role", F.lit(":")).alias("content"))
    stored = c.select(F.col("conv_id").alias("stream"), (F.col("turn") * 2 + 1).alias("offset"), F.col("text").alias("content"))
    return streams.reconstruct(inline.unionByName(stored)).select("stream", "digest")


@query(f"""
    WITH RECURSIVE f AS (SELECT layer, ord, CAST(sum(size) OVER (PARTITION BY layer ORDER BY ord) AS BIGINT) AS pos, row_number() OVER (PARTITION BY layer ORDER BY ord) AS n FROM ({_FILES})),
         c AS (SELECT layer, n, ord, pos, pos AS last, TRUE AS checkpoint FROM f WHERE n = 1
               UNION ALL SELECT f.layer, f.n, f.ord, f.pos, CASE WHEN f.pos - c.last > 20000 THEN f.pos ELSE c.last END, f.pos - c.last > 20000 FROM c JOIN f ON f.layer = c.layer AND f.n = c.n + 1)
    SELECT layer, ord, checkpoint FROM c""")
def checkpoints(t):
    f = dedup.running_offsets(files(t), ["ord"], F.col("size"), ["layer"]).withColumn("pos", F.col("offset") + F.col("size"))
    return streams.checkpoints(f, 20_000, "layer", "ord", "pos").select("layer", "ord", "checkpoint")


@query(f"""
    WITH f AS (SELECT layer, ord, CAST(sum(size) OVER (PARTITION BY layer ORDER BY ord) AS BIGINT) AS pos, CAST(sum(size) OVER (PARTITION BY layer) AS BIGINT) AS total FROM ({_FILES}))
    SELECT layer, pos, coalesce(lead(pos) OVER (PARTITION BY layer ORDER BY pos), total) AS until FROM f""")
def span_ranges(t):
    f = files(t)
    total = f.groupBy(F.col("layer").alias("l")).agg(F.sum("size").alias("total"))
    marks = dedup.running_offsets(f, ["ord"], F.col("size"), ["layer"]).withColumn("pos", F.col("offset") + F.col("size")).join(total, F.col("layer") == F.col("l"))
    return streams.spans(marks, "layer", "pos", "total").select("layer", "pos", "until")


@query(f"""
    WITH f AS (SELECT *, CASE WHEN size % 3 = 0 THEN 'symlink' ELSE 'file' END AS entry_type FROM ({_FILES}))
    SELECT layer, ord, entry_type, CAST(row_number() OVER (PARTITION BY layer ORDER BY entry_type <> 'file', ord) - 1 AS INTEGER) AS place FROM f""")
def flush_order(t):
    f = files(t).withColumn("entry_type", F.when(F.col("size") % 3 == 0, "symlink").otherwise("file"))
    return streams.flush_order(f).select("layer", "ord", "entry_type", "place")


@query(f"""
    WITH f AS ({_FILES}),
         leaf AS (SELECT layer, lang, sha256(array_to_string(list_sort(list('f:f' || ord || ':' || size || ':' || digest)), chr(10))) AS h FROM f GROUP BY ALL),
         srv AS (SELECT layer, sha256(array_to_string(list_sort(list('d:' || lang || ':' || h)), chr(10))) AS h, count(*) AS n FROM leaf GROUP BY layer)
    SELECT layer, sha256('d:srv:' || h) AS root_hash, CAST(n + 2 AS BIGINT) AS n_dirs FROM srv""")
def merkle_roots(t):
    return dedup.merkle(files(t), "layer")


@query("""
    WITH h AS (SELECT conv_id AS image, turn AS ord, role <> 'user' AS empty_layer FROM conversations),
         b AS (SELECT *, coalesce(sum(CASE WHEN empty_layer THEN 0 ELSE 1 END) OVER (PARTITION BY image ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(CASE WHEN empty_layer THEN 0 ELSE 1 END) OVER (PARTITION BY image) AS t, 1 + image % 3 AS n FROM h)
    SELECT image, ord, CAST(CASE WHEN empty_layer AND b = t THEN greatest(least(t, n) - 1, 0) ELSE b END AS INTEGER) AS layer_idx FROM b WHERE CASE WHEN empty_layer AND b = t THEN greatest(least(t, n) - 1, 0) ELSE b END < n""")
def history_split(t):
    h = t.conversations.select(F.col("conv_id").alias("image"), F.col("turn").alias("ord"), (F.col("role") != "user").alias("empty_layer"))
    n = h.select("image").distinct().withColumn("n_layers", F.lit(1) + F.col("image") % 3)
    return images.split_history(h, n).select("image", "ord", "layer_idx")


def _mtime(t):
    e = t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select(
        "event_id", F.when(F.col("event_id") % 4 == 0, "char").when(F.col("event_id") % 4 == 1, "symlink").otherwise("file").alias("entry_type"), F.when(F.col("event_id") % 4 == 2, "x/").otherwise("x").alias("path"), F.col("ts").alias("mtime"),
        F.lit("t").alias("linkname"), F.lit(7).alias("devmajor"), F.lit(9).alias("devminor"))


@query("""
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'char' WHEN 1 THEN 'symlink' WHEN 2 THEN 'dir' ELSE 'file' END AS entry_type, CAST(date_trunc('second', ts + INTERVAL 500 MILLISECONDS) AS TIMESTAMP) AS mtime,
           CASE WHEN event_id % 4 = 1 THEN 't' ELSE '' END AS linkname, CASE WHEN event_id % 4 = 0 THEN 7 ELSE 0 END AS devmajor FROM events""")
def normalized_headers(t):
    return dedup.normalize_header(_mtime(t)).select("event_id", "entry_type", "mtime", "linkname", "devmajor")


# ---- overlays --------------------------------------------------------------------------------------------------


def overlay_entries(t):
    """conversations as images of layers: each turn is a layer, which makes a folder, a file of its role and one of its own, and now and then takes something of an earlier one away. Markers come first."""
    c = t.conversations.select(F.col("conv_id").alias("image"), F.col("turn").cast("int").alias("layer"), "role", F.char_length("text").alias("n"))
    rows = F.array(
        F.struct(F.lit(0).alias("k"), F.when((F.col("layer") > 1) & (F.col("n") % 4 == 1), F.lit("app/.wh..wh..opq")).when((F.col("layer") > 0) & (F.col("n") % 4 == 2), F.lit("app/.wh.user")).when((F.col("layer") > 0) & (F.col("n") % 4 == 3), F.lit(".wh.etc")).alias("path"), F.lit("file").alias("entry_type")),
        F.struct(F.lit(1).alias("k"), F.concat(F.lit("app/"), "role").alias("path"), F.lit("dir").alias("entry_type")),
        F.struct(F.lit(2).alias("k"), F.concat(F.lit("app/"), "role", F.lit("/main")).alias("path"), F.lit("file").alias("entry_type")),
        F.struct(F.lit(3).alias("k"), F.concat(F.lit("etc/l"), F.col("layer").cast("string"), F.lit("/conf")).alias("path"), F.lit("file").alias("entry_type")),
    )
    e = c.select("image", "layer", "n", F.explode(rows).alias("r")).where("r.path is not null")
    return e.select("image", "layer", (F.col("layer") * 10 + F.col("r.k")).cast("long").alias("ord"), "r.path", "r.entry_type", F.concat_ws(":", F.col("layer").cast("string"), F.col("n").cast("string")).alias("attrs"))


# every event of these images touches at most three levels, so the touches and their ancestors are spelled out
_OVERLAY = """
    c AS (SELECT conv_id AS image, CAST(turn AS INTEGER) AS layer, role, length(text) AS n FROM conversations),
    e AS (SELECT image, layer, layer * 10 AS ord, 'opaque' AS op, 'app' AS target, NULL AS entry_type, NULL AS attrs FROM c WHERE layer > 1 AND n % 4 = 1
          UNION ALL SELECT image, layer, layer * 10, 'whiteout', 'app/user', NULL, NULL FROM c WHERE layer > 0 AND n % 4 = 2
          UNION ALL SELECT image, layer, layer * 10, 'whiteout', 'etc', NULL, NULL FROM c WHERE layer > 0 AND n % 4 = 3
          UNION ALL SELECT image, layer, layer * 10 + 1, 'upsert', 'app/' || role, 'dir', layer || ':' || n FROM c
          UNION ALL SELECT image, layer, layer * 10 + 2, 'upsert', 'app/' || role || '/main', 'file', layer || ':' || n FROM c
          UNION ALL SELECT image, layer, layer * 10 + 3, 'upsert', 'etc/l' || layer || '/conf', 'file', layer || ':' || n FROM c),
    t AS (SELECT image, target AS path, ord, layer, TRUE AS explicit, entry_type, attrs FROM e WHERE op = 'upsert'
          UNION ALL SELECT image, unnest(list_transform(range(1, len(string_split(target, '/')) + CASE WHEN op = 'opaque' THEN 1 ELSE 0 END), lambda i: array_to_string(string_split(target, '/')[1:i], '/'))), ord, layer, FALSE, NULL, NULL FROM e),
    a AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM e d WHERE d.image = t.image AND d.ord > t.ord AND (
              (d.op = 'whiteout' AND (t.path = d.target OR starts_with(t.path, d.target || '/'))) OR (d.op = 'opaque' AND starts_with(t.path, d.target || '/') AND t.layer < d.layer))))"""


@query(f"""
    WITH {_OVERLAY} SELECT image, path, coalesce(arg_max(entry_type, CASE WHEN explicit THEN ord END), 'dir') AS entry_type, coalesce(arg_max(attrs, CASE WHEN explicit THEN ord END), '') AS attrs FROM a GROUP BY image, path""")
def overlay_merge(t):
    return overlay.merge_layers(overlay_entries(t))


@query(f"""
    WITH {_OVERLAY} SELECT image, path, coalesce(arg_max(entry_type, CASE WHEN explicit THEN ord END), 'dir') AS entry_type, coalesce(arg_max(attrs, CASE WHEN explicit THEN ord END), '') AS attrs FROM a GROUP BY image, path""")
def overlay_plan(t):
    return overlay.merge_layers(overlay_entries(t), fold_limit=0)


@query(f"""
    WITH {_OVERLAY.replace(" AND t.layer < d.layer", "")} SELECT image, path, coalesce(arg_max(entry_type, CASE WHEN explicit THEN ord END), 'dir') AS entry_type, coalesce(arg_max(attrs, CASE WHEN explicit THEN ord END), '') AS attrs FROM a GROUP BY image, path""")
def overlay_all_before(t):
    return overlay.apply_fold(overlay.events(overlay_entries(t)), all_before=True)


@query(f"""
    WITH f AS ({_FILES}) SELECT DISTINCT layer, unnest(['srv', 'srv/' || lang]) AS path FROM f""")
def synthesized_parents(t):
    return overlay.missing_parents(files(t), "layer", "path")


@query(f"""
    WITH f AS ({_FILES}), g AS (SELECT layer, min(ord) AS o FROM f GROUP BY layer)
    SELECT layer, ord, CASE WHEN ord % 5 = 0 AND ord <> o THEN (SELECT digest FROM f x WHERE x.ord = g.o) ELSE digest END AS attrs,
           CASE WHEN ord % 5 = 0 AND ord <> o OR ord = o THEN 1 + (SELECT count(*) FROM f y WHERE y.layer = f.layer AND y.ord % 5 = 0 AND y.ord <> o) ELSE 1 END AS nlink FROM f JOIN g USING (layer)""")
def hardlinks(t):
    f = files(t)
    first = f.groupBy(F.col("layer").alias("l")).agg(F.min("ord").alias("o"))
    e = f.join(first, F.col("layer") == F.col("l"))
    link = (F.col("ord") % 5 == 0) & (F.col("ord") != F.col("o"))
    e = e.select(F.col("layer").alias("image"), "layer", "ord", F.concat(F.lit("p"), F.col("ord").cast("string")).alias("path"), F.when(link, "hardlink").otherwise("file").alias("entry_type"), F.concat(F.lit("p"), F.col("o").cast("string")).alias("linkname"), F.col("digest").alias("attrs"), "size")
    return overlay.hardlinks(e).select("layer", "ord", "attrs", "nlink")


@query("""
    SELECT 'u' || user_id || '/' || event_type AS path, max(event_id) AS ord, arg_max(value, event_id) AS attrs FROM events GROUP BY user_id, event_type""")
def merged_streams(t):
    e = t.events.select(F.concat(F.lit("/u"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("path"), F.col("event_id").alias("ord"), F.lit("file").alias("entry_type"), F.col("value").alias("attrs"))
    return overlay.merge_streams(e).select("path", "ord", "attrs")


@query("""
    WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
    SELECT 'u' || user_id AS path, b AS before, event_type AS after FROM e WHERE b <> event_type""")
def type_conflicts(t):
    e = t.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("ord"), F.col("event_type").alias("entry_type"))
    return overlay.type_conflicts(e)


@query(f"""
    WITH f AS ({_FILES}) SELECT path, 'srv/fr' AS ancestor, 'symlink' AS ancestor_type FROM f WHERE lang = 'fr'""")
def beneath_files(t):
    f = files(t).select("path", F.lit("file").alias("entry_type"))
    above = f.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().select("path", F.when(F.col("path") == "srv/fr", "symlink").otherwise("dir").alias("entry_type"))
    return overlay.beneath_files(f.unionByName(above))
