"""Access policies: ordered rules over operation, host pattern and repository glob; the first that matches decides."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the operations that a rule can name.
OPERATIONS = {"blob.read": 1, "blob.write": 2, "manifest.read": 4, "manifest.write": 8}
REQUIREMENTS = {"blob.read": [1], "blob.write": [2], "manifest.read": [4], "manifest.write": [8], "blob.read_or_write": [1, 2], "manifest.read_or_write": [4, 8]}


def host_regex(pattern: str) -> str:
    """'*' is any host, '*.suffix' one with at least one label more, anything else itself; case doesn't count."""
    if pattern == "*":
        return "(?s)^.*$"
    if pattern.startswith("*.") and pattern != "*." and "*" not in pattern[2:]:
        return f"(?is)^.+{re.escape(pattern[1:])}$"
    if "*" in pattern:
        raise ValueError(f"invalid host pattern {pattern!r}")
    return f"(?i)^{re.escape(pattern)}$"


def repo_regex(pattern: str) -> str:
    """'**' is any number of segments, '*' any run and '?' one character within a segment."""
    one = lambda seg: "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in seg)
    segs = pattern.split("/")
    # each segment takes the slash before it; the name gets one more in front
    return "^" + "".join("(?:/[^/]*)*" if s == "**" else "/" + one(s) for s in segs) + "$"


def compile_rules(rules: list[dict]) -> list[dict]:
    """Rules with host, repo and operations as (idx, allow, host_rx, repo_rx, ops)."""
    out = []
    for i, r in enumerate(rules):
        if not r["operations"]:
            raise ValueError(f"rule {i} names no operation")
        ops = 0
        for o in r["operations"]:
            ops |= 15 if o == "*" else OPERATIONS[o]
        out.append({"idx": i, "allow": bool(r["allow"]), "host_rx": host_regex(r.get("host", "*")), "repo_rx": repo_regex(r.get("repository", "**")), "ops": ops})
    return out


def _decide(rules: list[dict], host: Column, repo: Column, bit: int, default: bool) -> Column:
    """(allow, rule) for one operation: a CASE over the rules in order, which Catalyst keeps in generated code, so the requests aren't joined or shuffled."""
    out = F.struct(F.lit(default).alias("allow"), F.lit(-1).alias("rule"))
    for r in reversed(rules):
        if r["ops"] & bit:
            hit = host.rlike(r["host_rx"]) & F.concat(F.lit("/"), repo).rlike(r["repo_rx"])
            out = F.when(hit, F.struct(F.lit(r["allow"]).alias("allow"), F.lit(r["idx"]).alias("rule"))).otherwise(out)
    return out


def decide(requests: DataFrame, rules: list[dict], default: bool = False, host: str = "host", repo: str = "repo", requirement: str = "requirement") -> DataFrame:
    """requests with allow and rule (-1: the default). Where either of two operations will do, the first that is allowed decides, else the second."""
    h, p, need = F.col(host), F.col(repo), F.col(requirement)
    out = F.struct(F.lit(False).alias("allow"), F.lit(-1).alias("rule"))
    for name, bits in REQUIREMENTS.items():
        d = [_decide(rules, h, p, b, default) for b in bits]
        one = d[0] if len(d) == 1 else F.when(d[0]["allow"], d[0]).otherwise(d[1])
        out = F.when(need == name, one).otherwise(out)
    return requests.withColumn("_d", out).withColumns({"allow": F.col("_d.allow"), "rule": F.col("_d.rule")}).drop("_d")


def decide_joined(requests: DataFrame, rules: DataFrame, default: bool = False, block: int = 5_000) -> DataFrame:
    """requests(id, host, repo, op) with allow and rule against a table of rules(idx, allow, host_rx, repo_rx, ops): for policies too long for an expression.

    Rules are broadcast in blocks of at most block rows by their number; a request's matches are reduced to the first.
    """
    hit = (F.col("ops").bitwiseAND(F.col("op")) != 0) & F.expr("host rlike host_rx") & F.expr("concat('/', repo) rlike repo_rx")
    top, found = rules.agg(F.max("idx")).first()[0], None
    for low in range(0, (-1 if top is None else top) + 1, block):
        some = rules.where((F.col("idx") >= low) & (F.col("idx") < low + block))
        got = requests.join(F.broadcast(some), hit).select("id", F.struct("idx", "allow").alias("f"))
        found = got if found is None else found.unionByName(got)
    if found is None:
        return requests.withColumn("allow", F.lit(default)).withColumn("rule", F.lit(-1))
    first = found.groupBy("id").agg(F.min("f").alias("f"))
    return requests.join(first, "id", "left").withColumn("allow", F.coalesce("f.allow", F.lit(default))).withColumn("rule", F.coalesce("f.idx", F.lit(-1))).drop("f")


def reachable(hosts: DataFrame, rules: list[dict], default: bool = False, host: str = "host") -> DataFrame:
    """hosts with reachable: whether the default allows all or any rule names the host."""
    named = F.lit(default)
    for rx in dict.fromkeys(r["host_rx"] for r in rules):
        named = named | F.col(host).rlike(rx)
    return hosts.withColumn("reachable", named)
