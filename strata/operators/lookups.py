"""Lookups: missing blobs, required layers, sources, referrers, tags, reachable digests. Equi-joins and anti-joins that Catalyst plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(wanted: DataFrame, *stores: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys of wanted that none of the stores has; each store takes out what it has before the next is asked."""
    out = wanted.select(*on).distinct()
    for s in stores:
        out = out.join(s.select(*on), on, "left_anti")
    return out


def required_layers(required: DataFrame, layers: DataFrame) -> DataFrame:
    """required(image, layer_idx, digest) with status: correct if layers(image, layer_idx, digest) has the digest at or before that layer, misordered if later, missing if nowhere."""
    first = layers.groupBy("image", "digest").agg(F.min("layer_idx").alias("provided"))
    status = F.when(F.col("provided") <= F.col("layer_idx"), "correct").when(F.col("provided").isNotNull(), "misordered").otherwise("missing")
    return required.join(first, ["image", "digest"], "left").withColumn("status", status).drop("provided")


def unknown_subjects(referrers: DataFrame, known: DataFrame) -> DataFrame:
    """Referrers whose subject is none of the known digests."""
    return referrers.join(known.select(F.col("digest").alias("subject")), "subject", "left_anti")


def known_digests(*tables: DataFrame) -> DataFrame:
    """Distinct digests of roots, manifests, configs and layers."""
    out = tables[0].select("digest")
    for t in tables[1:]:
        out = out.unionByName(t.select("digest"))
    return out.distinct()


def first_source(needs: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """needs with repository: that of the first of sources(keys, pos, repository) with the same keys, null if there is none."""
    first = sources.where("repository <> ''").groupBy(*keys).agg(F.min_by("repository", "pos").alias("repository"))
    return needs.join(first, keys, "left")


def referrers(manifests: DataFrame) -> DataFrame:
    """(repo, subject, digest, artifact_type) of manifests(repo, digest, subject, artifact_type, config_type) that refer to another."""
    return manifests.where("subject is not null").select("repo", "subject", "digest", F.coalesce(F.nullif("artifact_type", F.lit("")), "config_type").alias("artifact_type"))


def tags_of(tags: DataFrame, digests: DataFrame) -> DataFrame:
    """(repo, digest, tags): the sorted tags that resolve to each digest."""
    return tags.join(digests.select("repo", "digest"), ["repo", "digest"], "left_semi").groupBy("repo", "digest").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def resolve(targets: DataFrame, tags: DataFrame, manifests: DataFrame) -> DataFrame:
    """targets(repo, target) with digest: the target's own if a manifest has it, else its tag's."""
    by_digest = manifests.select("repo", F.col("digest").alias("target"), F.col("digest").alias("own"))
    by_tag = tags.select("repo", F.col("tag").alias("target"), F.col("digest").alias("tagged"))
    return targets.join(by_digest, ["repo", "target"], "left").join(by_tag, ["repo", "target"], "left").select("repo", "target", F.coalesce("own", "tagged").alias("digest"))


def enrich_blobs(descriptors: DataFrame, tracked: DataFrame) -> DataFrame:
    """descriptors(repo, digest, size) with what tracked(digest, repo, size, last_used) knows better: a positive size, a repo, the last use."""
    t = tracked.select("digest", F.nullif("repo", F.lit("")).alias("_repo"), F.when(F.col("size") > 0, F.col("size")).alias("_size"), "last_used")
    return descriptors.join(t, "digest", "left").select("digest", F.coalesce("_repo", "repo").alias("repo"), F.coalesce("_size", "size").alias("size"), "last_used")


def unused(overrides: DataFrame, entries: DataFrame, path: str) -> DataFrame:
    """Overrides whose path no entry has: an error for the caller to report."""
    return overrides.join(entries.select(path), path, "left_anti")


def apply_overrides(entries: DataFrame, overrides: DataFrame, path: str, defaults: dict) -> DataFrame:
    """entries with, for each column of defaults, the override of the entry's path, else the layer's default, else the entry's own."""
    o = overrides.select(F.col(path).alias("_p"), *[F.col(c).alias(f"_o_{c}") for c in defaults])
    joined = entries.join(o, F.col(path) == F.col("_p"), "left")
    own = {c: F.coalesce(F.col(f"_o_{c}"), F.lit(d), F.col(c)) if d is not None else F.coalesce(F.col(f"_o_{c}"), F.col(c)) for c, d in defaults.items()}
    return joined.withColumns(own).drop("_p", *[f"_o_{c}" for c in defaults])


def diff_ids(manifests: DataFrame) -> DataFrame:
    """(layer, diff_id) of manifests(layers, diff_ids), by place."""
    return manifests.select(F.explode(F.arrays_zip("layers", "diff_ids")).alias("z")).select(F.col("z.layers").alias("layer"), F.col("z.diff_ids").alias("diff_id")).distinct()


def first_store(blobs: DataFrame, stores: DataFrame) -> DataFrame:
    """blobs(digest) with the outcome of asking stores(digest, priority, status, size) in order: the first answer that isn't 'not_found'; an error stops the search."""
    answer = stores.where("status <> 'not_found'").groupBy("digest").agg(F.min_by(F.struct("status", "size", "priority"), "priority").alias("a"))
    return blobs.join(answer, "digest", "left").select("digest", F.coalesce("a.status", F.lit("not_found")).alias("status"), F.when(F.col("a.status") == "found", F.col("a.size")).alias("size"), F.col("a.priority").alias("priority"))


def cross_mount_source(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """targets(registry) with the repository of the first of candidates(registry, pos, repository) in the same registry."""
    return first_source(targets, candidates, ["registry"])
