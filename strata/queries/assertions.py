"""Queries of structure tests and access policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asserts, policy
from .registry import query

URL = r"^https?://([^/?#]+)([^?#]*)"


@query("""
    SELECT doc_id AS test_id, CASE WHEN doc_id % 7 = 0 THEN q IS NULL WHEN q IS NULL THEN FALSE WHEN doc_id % 3 = 0 AND x <> 1 THEN FALSE WHEN doc_id % 2 = 0 AND q <> 1 THEN FALSE ELSE TRUE END AS passed,
           CASE WHEN doc_id % 7 = 0 THEN CASE WHEN q IS NOT NULL THEN '"d' || doc_id || '" exists' ELSE '' END WHEN q IS NULL THEN '"d' || doc_id || '" does not exist'
                WHEN doc_id % 3 = 0 AND x <> 1 THEN 'permissions "-rw-r--r--", want "-rwxr-xr-x"' WHEN doc_id % 2 = 0 AND q <> 1 THEN 'uid 0, want 1' ELSE '' END AS message
    FROM (SELECT d.doc_id, l.quality AS q, l.toxic AS x FROM documents d LEFT JOIN labels l USING (doc_id))""")
def file_assertions(t):
    k = F.col("doc_id")
    name = F.concat(F.lit("d"), k.cast("string"))
    tests = t.documents.select(k.alias("test_id"), name.alias("path"), (k % 7 != 0).alias("should_exist"), F.when(k % 3 == 0, "-rwxr-xr-x").otherwise("").alias("permissions"), F.when(k % 2 == 0, F.lit(1).cast("long")).alias("uid"), F.lit(None).cast("long").alias("gid"), F.lit("").alias("executable_by"))
    entries = t.labels.select(name.alias("path"), F.lit("file").alias("type"), F.when(F.col("toxic") == 1, "0755").otherwise("0644").alias("mode"), F.col("quality").cast("long").alias("uid"), F.lit(0).cast("long").alias("gid"))
    return asserts.check_files(tests, entries)


@query("""
    SELECT p_partkey AS test_id, CASE WHEN p_size % 3 = 0 THEN p_size % 5 <> 4 AND regexp_matches(p_type, '^' || substr(p_type, 1, 2)) WHEN p_size % 3 = 1 THEN p_size % 5 <> 4 AND p_size % 2 = 0 ELSE p_size % 2 = 0 END AS passed FROM part""")
def metadata_assertions(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    label = s % 3 == 0
    tests = t.part.select(k.alias("test_id"), k.alias("image"), F.when(label, "label").when(s % 3 == 1, "env").otherwise("user").alias("kind"), F.when(s % 3 != 2, "K").alias("key"), F.when(label, F.concat(F.lit("^"), F.substring("p_type", 1, 2))).when(s % 2 == 0, F.when(s % 3 == 2, "").otherwise(F.col("p_brand"))).otherwise("other").alias("want"), label.alias("regex"))
    config = t.part.where("p_size % 5 <> 4").select(k.alias("image"), F.when(label, "label").otherwise("env").alias("kind"), F.lit("K").alias("key"), F.when(label, F.col("p_type")).otherwise(F.col("p_brand")).alias("value"))
    return asserts.check_metadata(tests, config)


@query("""
    SELECT conv_id, list(role ORDER BY turn) = CASE WHEN conv_id % 2 = 0 THEN list(role ORDER BY turn) ELSE [] END AS same, conv_id % 3 = 0 AS member, TRUE AS empty_equal FROM conversations GROUP BY conv_id""")
def list_assertions(t):
    c = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    none = F.lit(None).cast("array<string>")
    port = F.when(F.col("conv_id") % 3 == 0, "8080").otherwise("9090")
    return c.select("conv_id", asserts.lists_equal(F.when(F.col("conv_id") % 2 == 0, F.col("r")), F.col("r")).alias("same"), asserts.member(F.array(F.lit("8080/tcp")), asserts.port_aliases(port)).alias("member"), asserts.lists_equal(none, F.array().cast("array<string>")).alias("empty_equal"))


RULES = policy.compile_rules([
    {"allow": False, "host": "*.example.net", "repository": "en/**", "operations": ["blob.write", "manifest.write"]},
    {"allow": True, "host": "*.example.com", "repository": "**/1*", "operations": ["blob.read", "manifest.read"]},
    {"allow": True, "host": "*", "repository": "??/*", "operations": ["blob.write"]},
])


def _requests(t):
    k = F.col("page_id") % 4
    need = F.element_at(F.array(*map(F.lit, ("blob.read", "blob.write", "manifest.write", "blob.read_or_write"))), (k + 1).cast("int"))
    return t.pages.select("page_id", F.regexp_extract("url", URL, 1).alias("host"), F.btrim(F.regexp_extract("url", URL, 2), F.lit("/")).alias("repo"), need.alias("requirement"))


_REQUESTS = r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, trim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/') AS repo, page_id % 4 AS k FROM pages"
_FLAGS = f"""
    r AS ({_REQUESTS}), f AS (SELECT *, ends_with(host, '.example.net') AND len(host) > 12 AND regexp_matches('/' || repo, '^/en(/[^/]*)*$') AS net, ends_with(host, '.example.com') AND len(host) > 12 AND regexp_matches('/' || repo, '^(/[^/]*)*/1[^/]*$') AS com, regexp_matches('/' || repo, '^/[^/][^/]/[^/]*$') AS two FROM r)"""


@query(f"""
    WITH {_FLAGS} SELECT page_id, CASE k WHEN 0 THEN com WHEN 1 THEN NOT net AND two WHEN 2 THEN FALSE ELSE com OR (NOT net AND two) END AS allow,
           CAST(CASE k WHEN 0 THEN CASE WHEN com THEN 1 ELSE -1 END WHEN 1 THEN CASE WHEN net THEN 0 WHEN two THEN 2 ELSE -1 END WHEN 2 THEN CASE WHEN net THEN 0 ELSE -1 END ELSE CASE WHEN com THEN 1 WHEN net THEN 0 WHEN two THEN 2 ELSE -1 END END AS INTEGER) AS rule FROM f""")
def policy_decisions(t):
    return policy.decide(_requests(t), RULES).select("page_id", "allow", "rule")


@query(f"""
    WITH {_FLAGS} SELECT page_id, CASE WHEN net THEN FALSE ELSE two END AS allow, CAST(CASE WHEN net THEN 0 WHEN two THEN 2 ELSE -1 END AS INTEGER) AS rule FROM f""")
def policy_table(t):
    rules = t.spark.createDataFrame([(r["idx"], r["allow"], r["host_rx"], r["repo_rx"], r["ops"]) for r in RULES], "idx int, allow boolean, host_rx string, repo_rx string, ops int")
    req = _requests(t).select(F.col("page_id").alias("id"), "host", "repo", F.lit(policy.OPERATIONS["blob.write"]).alias("op"))
    return policy.decide_joined(req, rules).select(F.col("id").alias("page_id"), "allow", "rule")


@query(f"WITH {_FLAGS} SELECT DISTINCT host, ends_with(host, '.example.net') OR ends_with(host, '.example.com') AS reachable FROM f")
def reachable_hosts(t):
    return policy.reachable(_requests(t).select("host").distinct(), RULES[:2])


@query("""
    SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, TRUE AS any_host, ends_with(regexp_extract(url, '^https?://([^/?#]+)', 1), '.example.org') AS suffix FROM pages""")
def host_patterns(t):
    host = F.regexp_extract("url", URL, 1)
    return t.pages.select("page_id", F.lower(host).alias("host"), host.rlike(policy.host_regex("*")).alias("any_host"), F.upper(host).rlike(policy.host_regex("*.example.org")).alias("suffix"))


@query("SELECT n_nationkey, n_nationkey % 4 = 0 AS unsupported FROM nation")
def unsupported_specs(t):
    spec = F.when(F.col("n_nationkey") % 4 == 0, F.lit('{"commandTests":[{"name":"x"}]}')).otherwise('{"commandTests":[],"fileExistenceTests":[{}]}')
    some = lambda c: F.coalesce(F.get_json_object(spec, f"$.{c}[0]").isNotNull(), F.lit(False))
    found = F.lit(False)
    for c in asserts.UNSUPPORTED:
        found = found | some(c)
    return t.nation.select("n_nationkey", found.alias("unsupported"))
