"""Queries of lookups, listings, pages and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images, lookups, sets
from .registry import query


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_blobs(t):
    return lookups.missing(t.documents, t.labels, on=["doc_id"])


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT page_id FROM pages)")
def missing_blobs_cached(t):
    return lookups.missing(t.documents, t.pages.select(F.col("page_id").alias("doc_id")), t.labels, on=["doc_id"])


@query("""
    WITH l AS (SELECT l_orderkey AS image, l_linenumber AS layer_idx, l_partkey % 40 AS digest FROM lineitem),
         r AS (SELECT DISTINCT l_orderkey AS image, l_linenumber AS layer_idx, l_suppkey % 40 AS digest FROM lineitem),
         p AS (SELECT image, digest, min(layer_idx) AS p FROM l GROUP BY ALL)
    SELECT r.image, r.layer_idx, r.digest, CASE WHEN p <= r.layer_idx THEN 'correct' WHEN p IS NOT NULL THEN 'misordered' ELSE 'missing' END AS status FROM r LEFT JOIN p USING (image, digest)""")
def required_layers(t):
    li = t.lineitem
    have = li.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("layer_idx"), (F.col("l_partkey") % 40).alias("digest"))
    need = li.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("layer_idx"), (F.col("l_suppkey") % 40).alias("digest")).distinct()
    return lookups.required_layers(need, have).select("image", "layer_idx", "digest", "status")


@query("SELECT doc_id, doc_id * 2 AS subject FROM documents WHERE doc_id * 2 NOT IN (SELECT doc_id FROM labels UNION SELECT page_id FROM pages)")
def unknown_subjects(t):
    known = lookups.known_digests(t.labels.select(F.col("doc_id").alias("digest")), t.pages.select(F.col("page_id").alias("digest")))
    return lookups.unknown_subjects(t.documents.select("doc_id", (F.col("doc_id") * 2).alias("subject")), known).select("doc_id", "subject")


@query("SELECT DISTINCT digest FROM (SELECT doc_id AS digest FROM labels UNION ALL SELECT page_id FROM pages UNION ALL SELECT vec_id FROM embeddings)")
def known_digests(t):
    return lookups.known_digests(t.labels.select(F.col("doc_id").alias("digest")), t.pages.select(F.col("page_id").alias("digest")), t.embeddings.select(F.col("vec_id").alias("digest")))


@query("""
    WITH s AS (SELECT l_partkey, s_nationkey % 5 AS registry, min(struct_pack(a := l_orderkey, b := l_linenumber, c := l_suppkey, d := s_name)).d AS repository FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
    SELECT p_partkey, registry, repository FROM part LEFT JOIN s ON p_partkey = l_partkey AND registry = p_size % 5""")
def upstream_source(t):
    src = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    src = src.select(F.col("l_partkey").alias("p_partkey"), (F.col("s_nationkey") % 5).alias("registry"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("pos"), F.col("s_name").alias("repository"))
    out = lookups.first_source(t.part.select("p_partkey", (F.col("p_size") % 5).alias("registry")), src, ["p_partkey", "registry"])
    return out.select("p_partkey", F.when(F.col("repository").isNotNull(), F.col("registry")).alias("registry"), "repository")


@query("""
    SELECT r_regionkey, min(s_name) AS repository FROM region LEFT JOIN (SELECT s_name, s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def cross_mount_source(t):
    cand = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("registry"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("repository"))
    return lookups.cross_mount_source(t.region.select(F.col("r_regionkey").alias("registry")), cand).select(F.col("registry").alias("r_regionkey"), "repository")


@query("""
    WITH m AS (SELECT o_custkey AS repo, o_orderkey AS digest, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 2 END AS subject, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS a FROM orders)
    SELECT repo, subject, digest, coalesce(nullif(a, ''), 'config') AS artifact_type FROM m WHERE subject IS NOT NULL""")
def referrers(t):
    o = t.orders
    m = o.select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("digest"), F.when(F.col("o_orderkey") % 3 == 0, F.expr("o_orderkey div 2")).alias("subject"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("").alias("artifact_type"), F.lit("config").alias("config_type"))
    return lookups.referrers(m)


def _tags(t):
    return t.orders.select(F.col("o_custkey").alias("repo"), F.concat(F.lit("v"), (F.col("o_orderkey") % 40).cast("string")).alias("tag"), (F.col("o_orderkey") % 200).alias("digest"), F.col("o_orderkey").alias("ord"))


_TAGS = "SELECT o_custkey AS repo, 'v' || (o_orderkey % 40) AS tag, o_orderkey % 200 AS digest, o_orderkey AS ord FROM orders"


@query(f"SELECT repo, digest, list_sort(list(DISTINCT tag)) AS tags FROM ({_TAGS}) GROUP BY repo, digest")
def tags_of_digest(t):
    tags = _tags(t)
    return lookups.tags_of(tags, tags.select("repo", "digest").distinct())


@query(f"""
    WITH t AS (SELECT repo, tag, arg_max(digest, ord) AS digest FROM ({_TAGS}) GROUP BY ALL)
    SELECT repo, tag AS target, digest FROM t UNION ALL SELECT DISTINCT repo, CAST(digest AS VARCHAR), digest FROM t UNION ALL SELECT DISTINCT repo, 'none', CAST(NULL AS BIGINT) FROM t""")
def resolve_tags(t):
    from ..operators.dedup import last_by

    tags = last_by(_tags(t), ["repo", "tag"], "ord").select("repo", "tag", F.col("digest").cast("string").alias("digest"))
    manifests = tags.select("repo", "digest").distinct()
    targets = tags.select("repo", F.col("tag").alias("target")).unionByName(manifests.select("repo", F.col("digest").alias("target"))).unionByName(tags.select("repo").distinct().withColumn("target", F.lit("none")))
    return lookups.resolve(targets, tags, manifests).withColumn("digest", F.col("digest").cast("long"))


@query("""
    SELECT o_orderkey AS digest, CASE WHEN o_orderkey % 4 = 0 THEN 'tracked' ELSE 'r' || o_custkey END AS repo, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0 THEN o_orderkey * 10 ELSE o_orderkey END AS size, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS last_used FROM orders""")
def enriched_blobs(t):
    o = t.orders.withColumn("digest", F.col("o_orderkey"))
    tracked = o.where("digest % 2 = 0").select("digest", F.when(F.col("digest") % 4 == 0, "tracked").otherwise("").alias("repo"), F.when(F.col("digest") % 6 == 0, 0).otherwise(F.col("digest") * 10).alias("size"), F.col("o_orderdate").alias("last_used"))
    return lookups.enrich_blobs(o.select(F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("repo"), "digest", F.col("digest").alias("size")), tracked)


@query("SELECT c_custkey FROM customer WHERE c_custkey * 3 NOT IN (SELECT o_orderkey FROM orders)")
def unused_overrides(t):
    return lookups.unused(t.customer.select((F.col("c_custkey") * 3).alias("path"), "c_custkey"), t.orders.select(F.col("o_orderkey").alias("path")), "path").select("c_custkey")


@query("""
    SELECT doc_id, CASE WHEN quality IS NOT NULL THEN 'q' || quality ELSE 'root' END AS uname, CAST(coalesce(toxic, 420) AS INTEGER) AS mode FROM documents LEFT JOIN labels USING (doc_id)""")
def metadata_overrides(t):
    e = t.documents.select("doc_id", F.lit("me").alias("uname"), F.lit(0).alias("mode"))
    o = t.labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("uname"), F.col("toxic").alias("mode"))
    return lookups.apply_overrides(e, o, "doc_id", {"uname": "root", "mode": 420})


@query("""
    SELECT DISTINCT l_partkey AS layer, l_suppkey AS diff_id FROM lineitem""")
def layer_diff_ids(t):
    m = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    return lookups.diff_ids(m.select(F.transform("x", lambda s: s["l_partkey"]).alias("layers"), F.transform("x", lambda s: s["l_suppkey"]).alias("diff_ids")))


@query("""
    WITH s AS (SELECT doc_id, 0 AS p, CASE WHEN doc_id % 2 = 0 THEN 'not_found' WHEN doc_id % 7 = 1 THEN 'error' ELSE 'found' END AS s, n_chars AS z FROM documents
               UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 3 = 0 THEN 'not_found' ELSE 'found' END, n_chars + 1 FROM documents),
         f AS (SELECT doc_id, arg_min(s, p) AS status, arg_min(z, p) AS z, CAST(min(p) AS INTEGER) AS priority FROM s WHERE s <> 'not_found' GROUP BY doc_id)
    SELECT doc_id AS digest, coalesce(status, 'not_found') AS status, CASE WHEN status = 'found' THEN z END AS size, priority FROM documents LEFT JOIN f USING (doc_id)""")
def combined_store(t):
    d = t.documents.select(F.col("doc_id").alias("digest"), "n_chars")
    k = F.col("digest")
    one = d.select("digest", F.lit(0).alias("priority"), F.when(k % 2 == 0, "not_found").when(k % 7 == 1, "error").otherwise("found").alias("status"), F.col("n_chars").alias("size"))
    two = d.select("digest", F.lit(1).alias("priority"), F.when(k % 3 == 0, "not_found").otherwise("found").alias("status"), (F.col("n_chars") + 1).alias("size"))
    return lookups.first_store(d.select("digest"), one.unionByName(two))


@query("""
    WITH s AS (SELECT image, m, CASE WHEN m = 0 THEN [[], ['a']] ELSE [['b', 'c']] END AS s FROM (SELECT n_nationkey AS image, unnest([0, 1]) AS m FROM nation WHERE n_nationkey % 2 = 0))
    SELECT image, CAST(m AS INTEGER) AS manifest_idx, CAST(i AS INTEGER) AS layer_idx, x AS source FROM (SELECT image, m, unnest(s) AS l, generate_subscripts(s, 1) - 1 AS i FROM s), unnest(l) AS u(x)""")
def layer_sources(t):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    empty = F.array().cast("array<string>")
    some = F.array(F.array(empty, arr("a")), F.array(arr("b", "c")))
    return images.layer_sources(t.nation.select(F.col("n_nationkey").alias("image"), F.when(F.col("n_nationkey") % 2 == 0, some).otherwise(F.array(F.array(empty))).alias("sources")))


# ---- pages, order, sets ----------------------------------------------------------------------------------------


@query(f"WITH t AS (SELECT DISTINCT tag FROM ({_TAGS})) SELECT tag FROM t WHERE tag > 'v2' ORDER BY tag LIMIT 12")
def tag_page(t):
    return images.tag_page(_tags(t), "v2", 12)


@query(f"WITH t AS (SELECT DISTINCT tag FROM ({_TAGS})) SELECT tag FROM t ORDER BY tag LIMIT 5")
def tag_page_past_end(t):
    return images.tag_page(_tags(t), "zzz", 5)


@query("SELECT DISTINCT s_name AS repo FROM supplier ORDER BY repo LIMIT 10000")
def catalog(t):
    return images.catalog(t.supplier.select(F.col("s_name").alias("repo")))


@query("SELECT DISTINCT sha256(text) AS digest FROM documents ORDER BY digest")
def digest_listing(t):
    return t.documents.select(F.sha2("text", 256).alias("digest")).distinct().orderBy("digest")


@query("SELECT 'srv/' || lang || '/f' || doc_id AS path FROM documents ORDER BY path")
def path_order(t):
    return t.documents.select(F.concat_ws("/", F.lit("srv"), "lang", F.concat(F.lit("f"), F.col("doc_id").cast("string"))).alias("path")).orderBy("path")


@query("SELECT digest, count(*) AS n FROM (SELECT doc_id AS digest FROM documents UNION ALL SELECT doc_id FROM labels UNION ALL SELECT page_id FROM pages) GROUP BY digest")
def hash_union(t):
    u = sets.union_all(t.documents.select(F.col("doc_id").alias("digest")), t.labels.select(F.col("doc_id").alias("digest")), t.pages.select(F.col("page_id").alias("digest")))
    return u.groupBy("digest").agg(F.count("*").alias("n"))


@query("SELECT doc_id, doc_id IN (SELECT page_id FROM pages) AS handled FROM documents")
def handled_targets(t):
    return sets.marked(t.documents.select("doc_id"), t.pages.select(F.col("page_id").alias("doc_id")), ["doc_id"], "handled")


@query("SELECT text, min(doc_id) AS ord, arg_min(source, doc_id) AS origin FROM documents GROUP BY text")
def first_origin(t):
    return sets.first_of(t.documents.select("text", F.col("doc_id").alias("ord"), F.col("source").alias("origin")), ["text"], "ord")


@query("""
    SELECT conv_id, list_sort(list(DISTINCT role)) AS sorted_roles, len(list_distinct(list(role ORDER BY turn))) AS n_roles, list(role ORDER BY turn)[1] AS first_role FROM conversations GROUP BY conv_id""")
def distinct_lists(t):
    c = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    first = sets.ordered_distinct(F.concat(F.array(F.lit("")), F.col("r")))
    return c.select("conv_id", sets.sorted_distinct(F.col("r")).alias("sorted_roles"), F.size(first).cast("long").alias("n_roles"), F.try_element_at(first, F.lit(1)).alias("first_role"))


@query("SELECT p_type, p_partkey, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS INTEGER) AS suffix FROM part")
def collision_suffixes(t):
    return images.numbered_by_hash(t.part, "p_type", "p_partkey").select("p_type", "p_partkey", "suffix")


@query("""
    WITH f AS (SELECT n_regionkey, s_name, min(s_suppkey) AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
    SELECT n_regionkey, s_name, CAST(coalesce(sum(strlen(s_name) + 1) OVER (PARTITION BY n_regionkey ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM f""")
def interned_strings(t):
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return images.intern_strings(s, "n_regionkey", "s_suppkey", "s_name").select("n_regionkey", "s_name", F.col("offset").cast("long").alias("offset"))


@query("""
    SELECT CAST(CASE p_type WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 1 ELSE 2 END AS INTEGER) AS group_idx, count(DISTINCT p_name) AS n, min(p_name) AS first FROM part GROUP BY 1""")
def grouped_layers(t):
    g = images.group_layers(t.part.select(F.col("p_type").alias("group"), F.col("p_name").alias("path")), ["SMALL", "LARGE"])
    return g.select("group_idx", F.size("files").cast("long").alias("n"), F.element_at("files", 1).alias("first"))
