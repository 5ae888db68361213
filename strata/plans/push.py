"""The deduplicated push: where each missing blob is uploaded once and mounted from elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kv import override_or
from ..functions.scalars import normalize_registry


def working_set(operations: DataFrame, override_registry: str = "", override_repository: str = "") -> DataFrame:
    """One row for each destination of operations(op_idx, registry, repository, manifest, layers, home, artificial, lenient, enabled): layers in order, flags joined by or, the smallest of disagreeing homes."""
    o = operations.where("enabled").withColumns({
        "registry": normalize_registry(override_or("registry", F.lit(override_registry))), "repository": override_or("repository", F.lit(override_repository)), "home": F.nullif("home", F.lit(""))})
    in_order = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("op_idx", "layers"))), lambda x: x["layers"]))
    return o.groupBy("registry", "repository", "manifest").agg(in_order.alias("layers"), F.coalesce(F.min("home"), F.lit("")).alias("home"), (F.count_distinct("home") > 1).alias("conflict"), F.bool_or("artificial").alias("artificial"), F.bool_or("lenient").alias("lenient"))


def staging(operations: DataFrame) -> DataFrame:
    """Operations that didn't opt in: they keep the ordinary push."""
    return operations.where("not enabled")


def mount_kind(pin: Column, confirmed: Column, upstream: Column, staged: str) -> Column:
    return F.when(pin.isNotNull(), "pinned").when(confirmed.isNotNull(), "confirmed").when(upstream.isNotNull(), "upstream").otherwise("staging" if staged else "upload")


def plan(needs: DataFrame, staged: str = "", incremental: bool = False) -> DataFrame:
    """A row for each (registry, blob) that a missing manifest needs.

    needs(registry, blob, repository, present, upstream, home, artificial, lenient): a row for each layer of each destination; empty strings are unset. Repositories whose manifest is present
    confirm the blob. The home is the pinned repository, else the smallest confirmed, else the upstream that all needing rows agree on, else the staging repository, else the smallest that needs it.
    A blob that would be mounted nowhere is skipped unless incremental.

    Everything is one aggregate by (registry, blob) over a pre-aggregate by repository, so that a blob in every image is added up in map tasks and no task holds its rows.
    """
    by_repo = needs.groupBy("registry", "blob", "repository").agg(
        F.bool_or("present").alias("confirms"), F.bool_or(~F.col("present")).alias("wants"), F.min(F.when(~F.col("present"), F.nullif("home", F.lit("")))).alias("pin"),
        F.min(F.when(~F.col("present"), F.col("upstream"))).alias("up_min"), F.max(F.when(~F.col("present"), F.col("upstream"))).alias("up_max"),
        F.bool_or(~F.col("present") & F.col("artificial")).alias("artificial"), F.bool_or(~F.col("present") & F.col("lenient")).alias("lenient"))
    wants, confirms = F.when(F.col("wants"), F.col("repository")), F.when(F.col("confirms"), F.col("repository"))
    blob = by_repo.groupBy("registry", "blob").agg(
        F.count(wants).alias("n_needing"), F.min(wants).alias("smallest"), F.min(confirms).alias("confirmed"), F.min("pin").alias("pin"), F.min("up_min").alias("up_min"), F.max("up_max").alias("up_max"),
        F.bool_or("artificial").alias("artificial"), F.bool_or("lenient").alias("lenient")).where("n_needing > 0")
    upstream = F.nullif(F.when(F.col("up_min") == F.col("up_max"), F.col("up_min")), F.lit(""))
    home = F.coalesce("pin", "confirmed", upstream, F.lit(staged or None).cast("string"), F.col("smallest"))
    homed = blob.withColumn("kind", mount_kind(F.col("pin"), F.col("confirmed"), upstream, staged)).withColumn("home", home)
    # whether the home itself is among the needing: a second look at the pre-aggregate, by key
    at_home = by_repo.where("wants").select("registry", "blob", F.col("repository").alias("home"), F.lit(1).alias("own"))
    out = homed.join(at_home, ["registry", "blob", "home"], "left").withColumn("mounted", F.col("n_needing") - F.coalesce("own", F.lit(0)))
    out = out.withColumn("skipped", F.lit(False) if incremental else F.col("mounted") == 0)
    uploads = F.col("kind").isin("pinned", "staging", "upload") & ~F.col("skipped")
    return out.select("registry", "blob", "n_needing", "kind", "home", "mounted", "skipped", uploads.alias("upload"), (uploads & (F.col("mounted") > 0) & ~F.col("lenient")).alias("mount_only"), "artificial", "lenient")


def report(p: DataFrame) -> DataFrame:
    """One row of counters over a plan."""
    n = lambda c: F.count(F.when(c & ~F.col("skipped"), 1))
    return p.agg(
        n(F.col("upload")).alias("uploaded"), n(F.col("kind") == "pinned").alias("pinned"), n(F.col("kind") == "confirmed").alias("confirmed"), n(F.col("kind") == "upstream").alias("upstream"),
        F.coalesce(F.sum(F.when(~F.col("skipped"), F.col("mounted"))), F.lit(0)).cast("long").alias("mounted"), n(F.col("upload") & F.col("artificial")).alias("artificial"), F.count(F.when(F.col("skipped"), 1)).alias("skipped"))


def uploads(p: DataFrame) -> DataFrame:
    """(target, blobs): what goes where, sorted."""
    return p.where("upload").groupBy(F.concat("registry", F.lit("/"), "home").alias("target")).agg(F.array_sort(F.collect_set("blob")).alias("blobs"))


def upload_repositories(p: DataFrame) -> DataFrame:
    return p.where("upload").select(F.concat("registry", F.lit("/"), "home").alias("target")).distinct()


def seed_confirmed(confirmed: DataFrame, known: DataFrame) -> DataFrame:
    """(registry, blob, home) to add to the known homes: the smallest confirming repository of keys that are not known."""
    return confirmed.join(known.select("registry", "blob"), ["registry", "blob"], "left_anti").groupBy("registry", "blob").agg(F.min("repository").alias("home"))


def resolve_locations(p: DataFrame, known: DataFrame) -> DataFrame:
    """A plan's homes with those that known(registry, blob, home, state) has already: present before in flight before the plan's own, and under a pin only the pinned home itself."""
    best = known.groupBy("registry", "blob", F.col("home").alias("k_home")).agg(F.min(F.when(F.col("state") == "present", 0).otherwise(1)).alias("k_rank"))
    j = p.join(best, ["registry", "blob"], "left").withColumn("usable", F.col("k_home").isNotNull() & ((F.col("kind") != "pinned") | (F.col("k_home") == F.col("home"))))
    pick = j.groupBy("registry", "blob", "kind", "home").agg(F.min(F.when(F.col("usable"), F.struct("k_rank", "k_home"))).alias("k"))
    return pick.select("registry", "blob", F.coalesce("k.k_home", "home").alias("home"), F.col("k").isNotNull().alias("cached"), F.coalesce(F.col("k.k_rank") == 1, F.lit(False)).alias("joined"))


def keep_operations(operations: DataFrame, kinds: list[str]) -> DataFrame:
    """Operations of the kinds: push also keeps registry_tag, unknown commands always stay; no kinds keep all."""
    if not kinds:
        return operations
    c = F.col("command")
    return operations.where(F.when(c == "load", F.lit("load" in kinds)).when(c.isin("push", "registry_tag"), F.lit("push" in kinds)).otherwise(F.lit(True)))


def merge_settings(settings: DataFrame) -> DataFrame:
    """One row of settings(blob_repository, forbid_layer_push, sign_setting): set values must agree, the guard is joined by or."""
    def agreed(c: str) -> Column:
        v = F.nullif(F.col(c), F.lit(""))
        return F.when(F.count_distinct(v) > 1, F.raise_error(F.lit(f"conflicting {c}"))).otherwise(F.coalesce(F.min(v), F.lit(""))).alias(c)

    return settings.agg(agreed("blob_repository"), F.coalesce(F.bool_or("forbid_layer_push"), F.lit(False)).alias("forbid_layer_push"), agreed("sign_setting"))
