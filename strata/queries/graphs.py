"""Queries of reference graphs: collection, closures, reverse indexes, pull declarations, platforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import INDEX_TYPES, MANIFEST_TYPES
from ..operators import graph, images
from .registry import query

NOW, DAYS = "2001-06-01 00:00:00", 86_400
REPOSITORY = "CAST((({}) + 100000) // 100 % 7 AS INTEGER)"  # of a digest, in SQL

# orders are manifests of seven repositories, by hundreds; every tenth is an index of the nine after it, every seventh refers to the one before it


def repository(digest):
    return (F.floor((digest + 100_000) / 100) % 7).cast("int")


def manifests(t):
    o, k = t.orders, F.col("o_orderkey")
    kind = F.when(k % 10 == 0, "index").otherwise("manifest")
    return o.select(repository(k).alias("repo"), k.alias("digest"), kind.alias("kind"), F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("o_orderdate")).alias("last_used"))


def edges(t):
    m = manifests(t)
    k = F.col("digest")
    child = m.where("kind = 'index'").select("repo", k.alias("src"), F.explode(F.sequence(k + 1, k + 9)).alias("dst"), F.lit("manifest").alias("kind"))
    back = m.where("digest % 7 = 0").select("repo", k.alias("src"), (k - 1).alias("dst"), F.lit("subject").alias("kind"))
    loop = m.where("digest % 500 = 0").select("repo", k.alias("src"), k.alias("dst"), F.lit("manifest").alias("kind"))
    blob = t.lineitem.where("l_orderkey % 10 <> 0").select(repository(F.col("l_orderkey")).alias("repo"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("blob").alias("kind"))
    return child.unionByName(back).unionByName(loop).unionByName(blob.distinct())


def tags(t):
    o = t.orders
    return o.select(repository(F.col("o_orderkey") - 1000).alias("repo"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("tag"), (F.col("o_orderkey") - 1000).alias("digest"), F.when(F.col("o_orderkey") % 13 == 0, F.lit(None)).otherwise(F.col("o_orderdate")).alias("last_used"))


_M = f"SELECT {REPOSITORY.format('o_orderkey')} AS repo, o_orderkey AS digest, CASE WHEN o_orderkey % 10 = 0 THEN 'index' ELSE 'manifest' END AS kind, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS last_used FROM orders"
_T = f"SELECT {REPOSITORY.format('o_orderkey - 1000')} AS repo, 't' || o_orderkey AS tag, o_orderkey - 1000 AS digest, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS last_used FROM orders"
_B = "SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey % 10 <> 0"
_FRESH = f"(last_used IS NULL OR TIMESTAMP '{NOW}' - last_used < INTERVAL 60 DAY)"


def _live_sql(m, t, b):
    return f"""
    RECURSIVE m AS ({m}), t AS ({t}), b AS ({b}),
    e AS (SELECT repo, digest AS src, unnest(range(digest + 1, digest + 10)) AS dst FROM m WHERE kind = 'index' UNION ALL SELECT repo, digest - 1, digest FROM m WHERE digest % 7 = 0 UNION ALL SELECT repo, digest, digest FROM m WHERE digest % 500 = 0),
    live AS (SELECT repo, digest FROM m WHERE {_FRESH} UNION SELECT t.repo, t.digest FROM t JOIN m USING (repo, digest) WHERE t.last_used IS NULL OR TIMESTAMP '{NOW}' - t.last_used < INTERVAL 30 DAY
             UNION SELECT e.repo, e.dst FROM live JOIN e ON e.src = live.digest AND e.repo = live.repo JOIN m ON m.digest = e.dst AND m.repo = e.repo),
    parts AS (SELECT p_partkey AS digest, p_size FROM part), live_blobs AS (SELECT dst AS digest FROM b WHERE src IN (SELECT digest FROM live) UNION SELECT digest FROM parts WHERE p_size = 1)"""


_LIVE = _live_sql(_M, _T, _B)


def _live(t):
    return graph.mark(manifests(t), tags(t), edges(t), NOW, 60 * DAYS, 30 * DAYS)


def _blobs(t):
    old = F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 400 days")
    return t.part.select(F.col("p_partkey").alias("digest"), F.when(F.col("p_size") == 1, F.lit(NOW).cast("timestamp_ntz")).otherwise(old).alias("last_used"))


def _live_blobs(t):
    return graph.live_blobs(_live(t), edges(t), _blobs(t), NOW, 60 * DAYS)


def _sweep_sql(live):
    return f"""
    WITH {live},
    gone AS (SELECT 'manifest' AS what, CAST(digest AS VARCHAR) AS name FROM m WHERE digest NOT IN (SELECT digest FROM live)
             UNION ALL SELECT 'tag', tag FROM t WHERE NOT (last_used IS NULL OR TIMESTAMP '{NOW}' - last_used < INTERVAL 30 DAY) OR digest NOT IN (SELECT digest FROM live)
             UNION ALL SELECT 'blob', CAST(digest AS VARCHAR) FROM parts WHERE digest NOT IN (SELECT digest FROM live_blobs))
    SELECT what, count(*) AS removed, min(name) AS first FROM gone GROUP BY what"""


def _sweep(t):
    live = _live(t)
    digests = graph.live_blobs(live, edges(t), _blobs(t), NOW, 60 * DAYS)
    s = graph.sweep(manifests(t), tags(t), _blobs(t), live, digests, NOW, 30 * DAYS)
    named = [s[k].select(F.lit(w).alias("what"), F.col(c).cast("string").alias("name")) for k, w, c in (("manifests", "manifest", "digest"), ("tags", "tag", "tag"), ("blobs", "blob", "digest"))]
    return named[0].unionByName(named[1]).unionByName(named[2]).groupBy("what").agg(F.count("*").alias("removed"), F.min("name").alias("first"))


@query(f"WITH {_LIVE} SELECT repo, digest FROM live")
def gc_mark(t):
    return _live(t)


@query(f"WITH {_LIVE} SELECT DISTINCT digest FROM live_blobs")
def gc_live_blobs(t):
    return _live_blobs(t)


@query(_sweep_sql(_LIVE))
def gc_sweep(t):
    return _sweep(t)


@query(f"""
    WITH r AS (SELECT p_partkey AS k, p_size FROM part)
    SELECT k AS src, 'child' || k AS dst, 'manifest' AS kind, CAST(p_size AS BIGINT) AS size FROM r WHERE k % 3 = 0 UNION ALL SELECT k, 'other' || k, 'blob', CAST(7 AS BIGINT) FROM r WHERE k % 3 = 0
    UNION ALL SELECT k, 'config' || k, 'blob', CAST(p_size AS BIGINT) FROM r WHERE k % 3 = 1 UNION ALL SELECT k, 'layer' || k, 'blob', CAST(9 AS BIGINT) FROM r WHERE k % 3 = 1 UNION ALL SELECT k, 'subject' || k, 'subject', CAST(1 AS BIGINT) FROM r WHERE k % 3 = 1""")
def manifest_references(t):
    n, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    d = lambda kind, name, s: F.concat(F.lit(f'{{"mediaType":"{kind}","digest":"{name}'), n, F.lit('","size":'), s, F.lit("}"))
    index = F.concat(F.lit('{"manifests":['), d(MANIFEST_TYPES[0], "child", size), F.lit(","), d("text/plain", "other", F.lit("7")), F.lit("]}"))
    man = F.concat(F.lit('{"config":'), d("c", "config", size), F.lit(',"layers":['), d("l", "layer", F.lit("9")), F.lit('],"subject":'), d(INDEX_TYPES[0], "subject", F.lit("1")), F.lit("}"))
    k = F.col("p_partkey") % 3
    m = t.part.select(F.lit("r").alias("repo"), F.col("p_partkey").alias("digest"), F.when(k == 0, "index").otherwise("manifest").alias("kind"), F.when(k == 0, index).when(k == 1, man).otherwise("broken").alias("body"))
    return graph.references(m).drop("repo")


# ---- pulled images: orders; multiples of 10 are indexes of the next 3, others manifests -------------


def entries(t):
    o, li = t.orders, t.lineitem
    k = F.col("o_orderkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    layers = li.groupBy(F.col("l_orderkey").alias("lk")).agg(F.array_sort(F.collect_set(F.concat(F.lit("l"), F.col("l_suppkey").cast("string")))).alias("layers"))
    kids = F.transform(F.sequence(k + 1, k + 3), lambda c: F.concat(F.lit("m"), c.cast("string")))
    none = F.array().cast("array<string>")
    index = k % 10 == 0
    e = o.join(layers, k == F.col("lk"), "left")
    return e.select(name("m", k).alias("digest"), F.when(index, "index").otherwise("manifest").alias("kind"), F.when(~index, name("c", k % 100)).alias("config"), F.when(index, none).otherwise(F.coalesce("layers", none)).alias("layers"), F.when(index, kids).otherwise(none).alias("manifests"), k.alias("k"))


def tops(t):
    k = F.col("k")
    return entries(t).where("k % 10 in (0, 2, 5)").select("digest", k.alias("ord"), F.element_at(F.array(*map(F.lit, ("shallow", "lazy", "eager"))), (k % 3 + 1).cast("int")).alias("handling"))



def _images_sql():
    return f"""
    e AS (SELECT o_orderkey AS k, 'm' || o_orderkey AS digest, o_orderkey % 10 = 0 AS idx FROM orders),
    l AS (SELECT DISTINCT l_orderkey AS k, 'l' || l_suppkey AS layer FROM lineitem WHERE l_orderkey % 10 <> 0),
    top AS (SELECT k, digest, idx, ['shallow', 'lazy', 'eager'][k % 3 + 1] AS handling FROM e WHERE k % 10 IN (0, 2, 5)),
    img AS (SELECT k AS root, k AS man, handling FROM top WHERE NOT idx UNION ALL SELECT k, unnest([k + 1, k + 2, k + 3]), handling FROM top WHERE idx),
    clo AS (SELECT 'm' || k AS root, 'm' || k AS blob, 'manifest' AS part, handling FROM top UNION ALL SELECT 'm' || root, 'm' || man, 'manifest', handling FROM img WHERE root <> man
            UNION ALL SELECT 'm' || root, 'c' || (man % 100), 'config', handling FROM img JOIN e ON e.k = man UNION ALL SELECT 'm' || root, layer, 'layer', handling FROM img JOIN l ON l.k = man)"""


_E = _images_sql()


def _image_closure(t):
    c = graph.closure(tops(t).select(F.col("digest").alias("root")), entries(t))
    return c.groupBy("root", "blob", "part").agg(F.count("*").alias("n"))


@query(f"WITH {_E} SELECT root, blob, part, count(*) AS n FROM clo GROUP BY ALL")
def image_closure(t):
    return _image_closure(t)


def _reverse_blob_index(t):
    return graph.images_of_blobs(tops(t), entries(t))


@query(f"WITH {_E} SELECT blob, list_sort(list(root)) AS images FROM clo GROUP BY blob")
def reverse_blob_index(t):
    return _reverse_blob_index(t)


def _layer_handling(t):
    e = entries(t)
    return graph.layer_handling(e.where("kind = 'manifest'"), tops(t), e)


@query(f"""
    WITH {_E}, c AS (SELECT man AS k, root AS o, handling FROM img) SELECT 'm' || e.k AS digest, coalesce(arg_min(handling, o), 'shallow') AS handling FROM e LEFT JOIN c ON c.k = e.k WHERE NOT idx GROUP BY e.k""")
def layer_handling(t):
    return _layer_handling(t)


def _blobs_to_create(t):
    return graph.blobs_to_create(entries(t), tops(t))


@query(f"""
    WITH {_E}, h AS (SELECT e.k, coalesce((SELECT arg_min(handling, root) FROM img WHERE man = e.k), 'shallow') AS handling FROM e WHERE NOT idx)
    SELECT digest AS blob, 'manifest' AS kind FROM e UNION SELECT 'c' || (k % 100), 'file' FROM e WHERE NOT idx UNION SELECT layer, CASE WHEN handling = 'eager' THEN 'file' ELSE 'lazy_file' END FROM h JOIN l USING (k) WHERE handling <> 'shallow'""")
def blobs_to_create(t):
    return _blobs_to_create(t)


def _image_files(t):
    return graph.image_files(tops(t), entries(t))


@query(f"""
    WITH {_E} SELECT DISTINCT root, blob, '@' || CASE WHEN part = 'layer' AND handling = 'lazy' THEN 'lazy_' ELSE 'blob_' END || blob || CASE WHEN part = 'manifest' THEN '//:manifest.json' ELSE '//:blob' END AS label FROM clo WHERE part <> 'layer' OR handling <> 'shallow'""")
def image_files(t):
    return _image_files(t)


def _reachable_facts(t):
    return graph.reachable_facts(tops(t), entries(t)).select("digest")


@query(f"WITH {_E} SELECT DISTINCT e.digest FROM e WHERE k IN (SELECT k FROM top) OR k IN (SELECT man FROM img JOIN top ON top.k = root WHERE idx)")
def reachable_facts(t):
    return _reachable_facts(t)


def _facts_to_fetch(t):
    from ..operators.lookups import missing

    e = entries(t)
    return missing(e.select(F.concat(F.lit("m"), (F.col("k") + 1).cast("string")).alias("digest")), e, on=["digest"])


@query(f"WITH {_E} SELECT 'm' || (k + 1) AS digest FROM e WHERE k + 1 NOT IN (SELECT k FROM e)")
def facts_to_fetch(t):
    return _facts_to_fetch(t)


@query("""
    SELECT l_partkey AS blob, l_suppkey AS repository, list_sort(list(DISTINCT n_name)) AS registries FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = (s_nationkey + l_linenumber) % 25 GROUP BY ALL""")
def blob_sources(t):
    j = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, (F.col("s_nationkey") + F.col("l_linenumber")) % 25 == F.col("n_nationkey"))
    return graph.blob_sources(j.select(F.col("l_partkey").alias("blob"), F.col("l_suppkey").alias("repository"), F.col("n_name").alias("registry")))


@query("""
    WITH p AS (SELECT o_custkey AS digest, o_orderkey AS ord, o_orderkey % 9 = 0 AS root, 'r' || (o_orderkey % 2) AS repository, o_orderstatus AS reg, ['shallow', 'lazy', 'eager'][o_orderkey % 3 + 1] AS h FROM orders),
         b AS (SELECT digest, arg_max(h, struct_pack(a := CASE WHEN h = 'shallow' THEN 0 WHEN root THEN 10 + ord WHEN h = 'eager' THEN 2 ELSE 1 END, b := -ord)) AS handling, arg_max(repository, CASE WHEN root THEN ord ELSE -ord - 1 END) AS repository FROM p GROUP BY digest)
    SELECT b.digest, b.handling, b.repository, list_sort(list(DISTINCT p.reg)) AS registries FROM b JOIN p ON p.digest = b.digest AND p.repository = b.repository GROUP BY ALL""")
def merged_pulls(t):
    k = F.col("o_orderkey")
    h = F.element_at(F.array(*map(F.lit, ("shallow", "lazy", "eager"))), (k % 3 + 1).cast("int"))
    p = t.orders.select(F.col("o_custkey").alias("digest"), k.alias("ord"), (k % 9 == 0).alias("is_root"), F.concat(F.lit("r"), (k % 2).cast("string")).alias("repository"), F.array("o_orderstatus").alias("registries"), h.alias("handling"))
    return graph.merge_pulls(p).select("digest", "handling", "repository", "registries")


_VECTOR = """
    CASE WHEN a = 'amd64' AND v <> '' THEN list_concat([v], list_concat(CASE WHEN n > 1 THEN list_transform(range(n - 1, 0, -1), lambda x: 'v' || x) ELSE [] END, ['']))
         WHEN a = 'arm' AND v <> '' THEN list_concat([v], CASE WHEN n > 5 THEN list_transform(range(n - 1, 4, -1), lambda x: 'v' || x) ELSE [] END)
         WHEN a = 'arm64' AND v = 'v9' THEN ['v9', 'v8'] ELSE [v] END"""
_WANTED = "SELECT p_partkey AS id, ['amd64', 'arm', 'arm64'][p_size % 3 + 1] AS a, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'v' || (1 + p_size % 9) END AS v, 1 + p_size % 9 AS n FROM part"


def _wanted(t):
    s = F.col("p_size")
    return t.part.select(F.col("p_partkey").alias("id"), F.lit("linux").alias("os"), F.element_at(F.array(*map(F.lit, ("amd64", "arm", "arm64"))), s % 3 + 1).alias("architecture"), F.when(s % 4 == 0, "").otherwise(F.concat(F.lit("v"), (s % 9 + 1).cast("string"))).alias("variant"))


@query(f"WITH w AS ({_WANTED}) SELECT id, {_VECTOR} AS variants FROM w")
def platform_vectors(t):
    w = _wanted(t)
    return w.select("id", F.transform(images.platform_vector(F.col("os"), F.col("architecture"), F.col("variant")), lambda p: p["variant"]).alias("variants"))


@query(f"""
    WITH w AS ({_WANTED}), x AS (SELECT id, a, {_VECTOR} AS vs FROM w), y AS (SELECT id, a, unnest(vs) AS v, generate_subscripts(vs, 1) AS rank FROM x),
         m AS (SELECT n_nationkey AS pos, n_name AS manifest, ['amd64', 'arm', 'arm64'][n_nationkey % 3 + 1] AS a, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'v' || (1 + n_nationkey % 8) END AS v FROM nation),
         h AS (SELECT id, arg_min(manifest, rank * 1000 + pos) AS manifest FROM y JOIN m USING (a, v) GROUP BY id)
    SELECT w.id, manifest FROM w LEFT JOIN h ON w.id = h.id""")
def base_selection(t):
    k = F.col("n_nationkey")
    m = t.nation.select(k.alias("pos"), F.col("n_name").alias("manifest"), F.lit("linux").alias("os"), F.element_at(F.array(*map(F.lit, ("amd64", "arm", "arm64"))), k % 3 + 1).alias("architecture"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("v"), (k % 8 + 1).cast("string"))).alias("variant"))
    return images.select_base(_wanted(t), m).select("id", "manifest")


@query("SELECT n_regionkey AS idx, n_nationkey AS pos, n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) AS is_default FROM nation WHERE n_nationkey % 2 = n_regionkey % 2")
def index_platforms(t):
    c = t.nation.select(F.col("n_regionkey").alias("index"), F.col("n_nationkey").alias("pos"))
    return images.index_children(c, F.col("pos") % 2 == F.col("index") % 2).select(F.col("index").alias("idx"), "pos", F.col("default").alias("is_default"))


@query("""
    WITH d AS (SELECT o_custkey AS digest, CASE WHEN o_custkey % 4 = 0 THEN [NULL] ELSE list_sort(list(DISTINCT o_orderpriority)) END AS tags FROM orders GROUP BY o_custkey)
    SELECT digest, tag, CASE WHEN tag IS NULL THEN ['base=x'] ELSE ['base=x', 'org.opencontainers.image.ref.name=' || tag] END AS annotations FROM (SELECT digest, unnest(tags) AS tag FROM d)""")
def descriptors_per_tag(t):
    i = t.orders.groupBy(F.col("o_custkey").alias("digest")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("tags"))
    i = i.withColumn("tags", F.when(F.col("digest") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("tags"))).withColumn("annotations", F.create_map(F.lit("base"), F.lit("x")))
    return images.descriptors(i).select("digest", "tag", F.array_sort(F.transform(F.map_entries("annotations"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("annotations"))


@query("SELECT user_id AS idx, event_type AS ref, min(event_id) AS ord FROM events GROUP BY user_id, event_type")
def index_upserts(t):
    e = t.events.select(F.col("user_id").alias("index"), F.col("event_id").alias("ord"), F.col("event_type").alias("digest"), F.col("event_type").alias("ref"))
    return images.index_entries(e).select(F.col("index").alias("idx"), "ref", "ord")


@query("""
    SELECT l_orderkey AS image, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS digests FROM lineitem WHERE l_quantity >= 20 GROUP BY l_orderkey""")
def layer_descriptors(t):
    li = t.lineitem.select(F.col("l_orderkey").alias("image"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("layer_idx"), F.lit("layer").alias("media_type"), F.col("l_partkey").alias("digest"), F.col("l_suppkey").alias("diff_id"), F.col("l_quantity").alias("size"))
    return images.layer_descriptors(li, 20).select("image", F.transform("layers", lambda x: x["digest"]).alias("digests"))
