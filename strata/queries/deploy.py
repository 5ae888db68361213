"""Queries of deploys: working sets, the push plan, merged operations, config overlays, accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import _none
from ..operators import images
from ..plans import push
from .registry import query


def operations(t):
    o = t.orders
    k = F.col("o_orderkey")
    return o.select(
        k.alias("op_idx"), F.element_at(F.array(*map(F.lit, ("docker.io", "", "index.docker.io", "ghcr.io"))), (k % 4 + 1).cast("int")).alias("registry"), F.concat(F.lit("r"), (F.col("o_custkey") % 20).cast("string")).alias("repository"), (k % 50).alias("manifest"),
        F.array(F.concat(F.lit("l"), k.cast("string"))).alias("layers"), F.when(k % 5 == 0, F.concat(F.lit("h"), (k % 3).cast("string"))).otherwise("").alias("home"), (k % 17 == 0).alias("artificial"), (k % 19 == 0).alias("lenient"), (k % 3 != 0).alias("enabled"), F.when(k % 2 == 0, "push").when(k % 7 == 0, "registry_tag").when(k % 11 == 0, "sign").otherwise("load").alias("command"))


_OPS = """
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 3 THEN 'ghcr.io' ELSE 'index.docker.io' END AS registry, 'r' || (o_custkey % 20) AS repository, o_orderkey % 50 AS manifest, CASE WHEN o_orderkey % 5 = 0 THEN 'h' || (o_orderkey % 3) END AS home,
           o_orderkey % 17 = 0 AS artificial, o_orderkey % 19 = 0 AS lenient, o_orderkey % 3 <> 0 AS enabled, CASE WHEN o_orderkey % 2 = 0 THEN 'push' WHEN o_orderkey % 7 = 0 THEN 'registry_tag' WHEN o_orderkey % 11 = 0 THEN 'sign' ELSE 'load' END AS command FROM orders"""


@query(f"""
    WITH o AS ({_OPS}) SELECT registry, repository, manifest, list('l' || k ORDER BY k) AS layers, coalesce(min(home), '') AS home, count(DISTINCT home) > 1 AS conflict, bool_or(artificial) AS artificial, bool_or(lenient) AS lenient FROM o WHERE enabled GROUP BY registry, repository, manifest""")
def working_set(t):
    return push.working_set(operations(t))


@query(f"WITH o AS ({_OPS}) SELECT k AS op_idx FROM o WHERE NOT enabled")
def staging_operations(t):
    return push.staging(operations(t)).select("op_idx")


@query(f"WITH o AS ({_OPS}) SELECT k AS op_idx, command FROM o WHERE command <> 'load'")
def kept_operations(t):
    return push.keep_operations(operations(t), ["push"]).select("op_idx", "command")


@query(f"WITH o AS ({_OPS}) SELECT command, count(*) AS n, CAST(sum(k) AS BIGINT) AS checksum FROM o GROUP BY command")
def merged_operations(t):
    from ..operators.sets import union_all

    o = operations(t)
    return union_all(o.where("op_idx < 4000"), o.where("op_idx >= 4000")).groupBy("command").agg(F.count("*").alias("n"), F.sum("op_idx").alias("checksum"))


@query("SELECT 'blobs' AS blob_repository, TRUE AS forbid_layer_push, '' AS sign_setting")
def merged_settings(t):
    n = F.col("n_nationkey")
    return push.merge_settings(t.nation.select(F.when(n % 2 == 0, "blobs").otherwise("").alias("blob_repository"), (n == 3).alias("forbid_layer_push"), F.lit("").alias("sign_setting")))


def needs(t):
    """lineitem as what manifests need: the region is the registry, the supplier the repository, the part the blob."""
    li, s, n = t.lineitem, t.supplier, t.nation
    j = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("l_orderkey")
    return j.select(
        F.concat(F.lit("reg"), F.col("n_regionkey").cast("string")).alias("registry"), (F.col("l_partkey")).alias("blob"), F.concat(F.lit("r"), (F.col("l_suppkey") % 12).cast("string")).alias("repository"), (k % 13 == 0).alias("present"),
        F.when(F.col("l_partkey") % 3 == 0, F.lit("base")).when(F.col("l_partkey") % 3 == 1, F.when(k % 2 == 0, "base").otherwise("")).otherwise("").alias("upstream"), F.when((F.col("l_partkey") % 10 == 0) & (k % 4 == 0), F.concat(F.lit("pin"), (k % 2).cast("string"))).otherwise("").alias("home"),
        (F.col("l_linenumber") == 7).alias("artificial"), (k % 101 == 0).alias("lenient"))


_NEEDS = """
    SELECT 'reg' || n_regionkey AS registry, l_partkey AS blob, 'r' || (l_suppkey % 12) AS repository, l_orderkey % 13 = 0 AS present,
           CASE l_partkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'base' ELSE '' END ELSE '' END AS upstream, CASE WHEN l_partkey % 10 = 0 AND l_orderkey % 4 = 0 THEN 'pin' || (l_orderkey % 2) ELSE '' END AS home, l_linenumber = 7 AS artificial, l_orderkey % 101 = 0 AS lenient
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""


def _plan_sql(staged: str = "NULL", kind: str = "upload", incremental: str = "FALSE") -> str:
    return f"""
    n AS ({_NEEDS}), c AS (SELECT registry, blob, min(repository) AS confirmed FROM n WHERE present GROUP BY ALL),
    w AS (SELECT registry, blob, list(DISTINCT repository) AS needing, CASE WHEN min(upstream) = max(upstream) THEN nullif(min(upstream), '') END AS upstream, min(nullif(home, '')) AS pin, bool_or(artificial) AS artificial, bool_or(lenient) AS lenient FROM n WHERE NOT present GROUP BY ALL),
    h AS (SELECT w.*, coalesce(pin, confirmed, upstream, {staged}, list_min(needing)) AS home, CASE WHEN pin IS NOT NULL THEN 'pinned' WHEN confirmed IS NOT NULL THEN 'confirmed' WHEN upstream IS NOT NULL THEN 'upstream' ELSE '{kind}' END AS kind FROM w LEFT JOIN c USING (registry, blob)),
    m AS (SELECT *, len(list_filter(needing, lambda r: r <> home)) AS mounted FROM h), s AS (SELECT *, NOT {incremental} AND mounted = 0 AS skipped FROM m),
    plan AS (SELECT registry, blob, len(needing) AS n_needing, kind, home, mounted, skipped, kind NOT IN ('confirmed', 'upstream') AND NOT skipped AS upload, kind NOT IN ('confirmed', 'upstream') AND NOT skipped AND mounted > 0 AND NOT lenient AS mount_only, artificial, lenient FROM s)"""


@query(f"WITH {_plan_sql()} SELECT * FROM plan")
def push_plan(t):
    return push.plan(needs(t))


@query(f"WITH {_plan_sql(chr(39) + 'stage' + chr(39), 'staging', 'TRUE')} SELECT * FROM plan")
def push_plan_staged(t):
    return push.plan(needs(t), "stage", incremental=True)


@query(f"""
    WITH {_plan_sql()} SELECT count(*) FILTER (upload) AS uploaded, count(*) FILTER (kind = 'pinned' AND NOT skipped) AS pinned, count(*) FILTER (kind = 'confirmed' AND NOT skipped) AS confirmed, count(*) FILTER (kind = 'upstream' AND NOT skipped) AS upstream,
           CAST(sum(mounted) FILTER (NOT skipped) AS BIGINT) AS mounted, count(*) FILTER (upload AND artificial) AS artificial, count(*) FILTER (skipped) AS skipped FROM plan""")
def push_report(t):
    return push.report(push.plan(needs(t)))


@query(f"WITH {_plan_sql()} SELECT registry || '/' || home AS target, list_sort(list(DISTINCT blob)) AS blobs FROM plan WHERE upload GROUP BY 1")
def push_uploads(t):
    return push.uploads(push.plan(needs(t)))


@query(f"WITH {_plan_sql()} SELECT DISTINCT registry || '/' || home AS target FROM plan WHERE upload ORDER BY target")
def upload_repositories(t):
    return push.upload_repositories(push.plan(needs(t))).orderBy("target")


@query(f"WITH n AS ({_NEEDS}) SELECT registry, blob, min(repository) AS home FROM n WHERE present AND blob % 2 = 1 GROUP BY ALL")
def seeded_homes(t):
    n = needs(t)
    return push.seed_confirmed(n.where("present"), n.where("blob % 2 = 0").select("registry", "blob").distinct())


@query(f"""
    WITH {_plan_sql()}, k AS (SELECT registry, blob, 'known' AS h, blob % 4 = 0 AS present FROM plan WHERE blob % 2 = 0)
    SELECT registry, blob, CASE WHEN h IS NOT NULL AND kind <> 'pinned' THEN h ELSE home END AS home, h IS NOT NULL AND kind <> 'pinned' AS cached, coalesce(NOT k.present, FALSE) AND kind <> 'pinned' AS joined FROM plan LEFT JOIN k USING (registry, blob)""")
def resolved_locations(t):
    p = push.plan(needs(t))
    known = p.where("blob % 2 = 0").select("registry", "blob", F.lit("known").alias("home"), F.when(F.col("blob") % 4 == 0, "present").otherwise("inflight").alias("state"))
    return push.resolve_locations(p, known)


@query("""
    WITH s AS (SELECT s_suppkey, unnest([s_name, s_name || 'x']) AS r FROM supplier) SELECT s_suppkey, list_sort(list(r)) AS needing, min(r) AS smallest, count(*) - 1 AS mounted FROM s GROUP BY s_suppkey""")
def smallest_repositories(t):
    r = t.supplier.select("s_suppkey", F.explode(F.array("s_name", F.concat("s_name", F.lit("x")))).alias("r"))
    g = r.groupBy("s_suppkey").agg(F.array_sort(F.collect_set("r")).alias("needing"), F.min("r").alias("smallest"))
    return g.withColumn("mounted", F.size(F.filter("needing", lambda x: x != F.col("smallest"))).cast("long"))


# ---- configs ---------------------------------------------------------------------------------------------------


@query("""
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ['base'] WHEN 1 THEN NULL WHEN 2 THEN ['a', 'base', 'z'] ELSE ['new'] END AS entrypoint, CASE p_size % 4 WHEN 0 THEN ['cmd'] WHEN 1 THEN ['cmd'] ELSE NULL END AS cmd, CASE p_size % 3 WHEN 0 THEN 'root' WHEN 1 THEN NULL ELSE p_brand END AS "user" FROM part""")
def config_commands(t):
    k, s = F.col("p_size") % 4, F.lit(images.INHERIT)
    arr = lambda *x: F.array(*[v if not isinstance(v, str) else F.lit(v) for v in x])
    entry = F.when(k == 0, arr(s)).when(k == 1, _none()).when(k == 2, arr("a", s, "z")).otherwise(arr("new"))
    c = images.overlay_command(arr("base"), arr("cmd"), entry, arr(s))
    user = images.overlay_scalar(F.lit("root"), F.when(F.col("p_size") % 3 == 0, s).when(F.col("p_size") % 3 == 1, "").otherwise(F.col("p_brand")))
    return t.part.select("p_partkey", c["entrypoint"].alias("entrypoint"), c["cmd"].alias("cmd"), user.alias("user"))


@query("""
    SELECT p_partkey, list_concat(['PATH=' || CASE WHEN p_size % 2 = 0 THEN '/new' ELSE '/bin' END, 'HOME=/'], CASE WHEN p_size % 2 = 0 THEN ['A=1', 'B=' || p_type] ELSE ['B=' || p_type] END) AS env FROM part""")
def config_env(t):
    even = F.col("p_size") % 2 == 0
    env = F.when(even, F.create_map(F.lit("B"), "p_type", F.lit("PATH"), F.lit("/new"), F.lit("A"), F.lit("1"))).otherwise(F.create_map(F.lit("B"), "p_type"))
    return t.part.select("p_partkey", images.overlay_env(F.array(F.lit("PATH=/bin"), F.lit("HOME=/")), env).alias("env"))


@query("""
    SELECT p_partkey AS image, 'linux' AS os, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'base' END AS "user", CASE WHEN p_size % 3 = 0 THEN ['80'] ELSE ['22'] END AS ports, CASE WHEN p_size % 5 = 0 THEN ['a=2', 'b=1', 'c=' || p_type] ELSE ['a=1', 'b=1'] END AS labels FROM part""")
def config_fragments(t):
    p = t.part
    nul = lambda kind: F.lit(None).cast(kind)
    base = p.select(F.col("p_partkey").alias("image"), F.lit("linux").alias("os"), F.lit("").alias("architecture"), F.lit("base").alias("user"), F.lit("/").alias("workdir"), F.lit("").alias("stop_signal"), F.array(F.lit("22")).alias("ports"), nul("array<string>").alias("volumes"), nul("array<string>").alias("entrypoint"), nul("array<string>").alias("cmd"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")).alias("labels"))
    frag = p.select(F.col("p_partkey").alias("image"), F.lit("linux").alias("os"), F.lit("amd64").alias("architecture"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("user"), F.lit("").alias("workdir"), F.lit("").alias("stop_signal"), F.when(F.col("p_size") % 3 == 0, F.array(F.lit("80"))).alias("ports"), nul("array<string>").alias("volumes"), nul("array<string>").alias("entrypoint"), nul("array<string>").alias("cmd"), F.when(F.col("p_size") % 5 == 0, F.create_map(F.lit("a"), F.lit("2"), F.lit("c"), "p_type")).alias("labels"))
    o = images.overlay_fragment(base, frag)
    return o.select("image", "os", "user", "ports", F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("labels"))


@query("""
    SELECT s_name AS name, s_suppkey AS id, 'x' AS password, CASE WHEN s_suppkey % 2 = 0 THEN '/bin/sh' ELSE '/sbin/nologin' END AS shell, '/' AS home FROM supplier ORDER BY id""")
def merged_accounts(t):
    a = t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), F.lit("").alias("password"), F.when(F.col("s_suppkey") % 2 == 0, "/bin/sh").alias("shell"), F.lit("").alias("home"))
    return images.merge_accounts(a, {"password": "x", "shell": "/sbin/nologin", "home": "/"})


@query("""
    SELECT 'name' AS field, p_name AS value, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1 UNION ALL SELECT 'id', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size HAVING count(*) > 1""")
def account_conflicts(t):
    return images.account_conflicts(t.part.select(F.col("p_name").alias("name"), F.col("p_size").alias("id")))
