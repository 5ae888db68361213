"""The reference graph of a registry: tags, manifests, blobs, and referrers that point back at their subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import INDEX_TYPES, MANIFEST_TYPES
from ..session import reliable_checkpoint

_DESCRIPTOR = "struct<mediaType:string,digest:string,size:long>"
_BODY = f"mediaType string, manifests array<{_DESCRIPTOR}>, config {_DESCRIPTOR}, layers array<{_DESCRIPTOR}>, subject {_DESCRIPTOR}"


def references(manifests: DataFrame) -> DataFrame:
    """(repo, src, dst, kind, size) of manifests(repo, digest, kind, body): child manifests, blobs and the subject. A body that can't be parsed has none."""
    m = manifests.withColumn("b", F.from_json("body", _BODY))
    children = m.where("kind = 'index'").select("repo", F.col("digest").alias("src"), F.explode("b.manifests").alias("d"))
    is_manifest = F.col("d.mediaType").isin(*INDEX_TYPES, *MANIFEST_TYPES)
    child = children.select("repo", "src", F.col("d.digest").alias("dst"), F.when(is_manifest, "manifest").otherwise("blob").alias("kind"), F.col("d.size").alias("size"))
    blobs = F.concat(F.filter(F.array("b.config"), lambda d: d["digest"].isNotNull()), F.coalesce("b.layers", F.array().cast(f"array<{_DESCRIPTOR}>")))
    blob = m.where("kind <> 'index'").select("repo", F.col("digest").alias("src"), F.explode(blobs).alias("d")).select("repo", "src", F.col("d.digest").alias("dst"), F.lit("blob").alias("kind"), F.col("d.size").alias("size"))
    subject = m.where("b.subject.digest is not null").select("repo", F.col("digest").alias("src"), F.col("b.subject.digest").alias("dst"), F.lit("subject").alias("kind"), F.col("b.subject.size").alias("size"))
    return child.unionByName(blob).unionByName(subject)


def reach(roots: DataFrame, edges: DataFrame, held: DataFrame, checkpoint_every: int = 4) -> DataFrame:
    """Nodes (repo, digest) of held that roots lead to over edges(repo, src, dst).

    Breadth first: each round joins the new nodes alone with the edges and leaves out those seen, so cycles end, and the work is that of the edges once.
    Lineage is cut by reliable checkpoints.
    """
    held = held.select("repo", "digest").distinct()
    seen = reliable_checkpoint(roots.select("repo", "digest").distinct().join(held, ["repo", "digest"], "left_semi"))
    front, rounds = seen, 0
    while not front.isEmpty():
        step = front.withColumnRenamed("digest", "src").join(edges.select("repo", "src", "dst"), ["repo", "src"]).select("repo", F.col("dst").alias("digest")).distinct()
        front = reliable_checkpoint(step.join(held, ["repo", "digest"], "left_semi").join(seen, ["repo", "digest"], "left_anti"))
        rounds += 1
        seen = seen.unionByName(front)
        if rounds % checkpoint_every == 0:
            seen = reliable_checkpoint(seen)
    return seen


def fresh(last_used, now, ttl):
    """Whether something was used less than ttl ago; a ttl of 0 or less never ends."""
    return F.lit(True) if ttl <= 0 else (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(last_used.cast("timestamp"))) < ttl * 1_000_000


def mark(manifests: DataFrame, tags: DataFrame, edges: DataFrame, now, ttl: int, tag_ttl: int) -> DataFrame:
    """Live manifests (repo, digest): what untracked or fresh manifests(repo, digest, last_used) and untracked or fresh tags(repo, tag, digest, last_used) lead to, referrers of live manifests included."""
    alive = lambda t: F.col("last_used").isNull() | fresh(F.col("last_used"), now, t)
    roots = manifests.where(alive(ttl)).select("repo", "digest").unionByName(tags.where(alive(tag_ttl)).select("repo", "digest"))
    walk = edges.where("kind = 'manifest'").select("repo", "src", "dst")
    back = edges.where("kind = 'subject'").select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(roots, walk.unionByName(back), manifests)


def live_blobs(live: DataFrame, edges: DataFrame, blobs: DataFrame, now, ttl: int) -> DataFrame:
    """Live digests: blobs of live manifests, and blobs(digest, last_used) fresh on their own."""
    named = edges.where("kind = 'blob'").join(live.select("repo", F.col("digest").alias("src")), ["repo", "src"], "left_semi").select(F.col("dst").alias("digest"))
    return named.unionByName(blobs.where(fresh(F.col("last_used"), now, ttl)).select("digest")).distinct()


def sweep(manifests: DataFrame, tags: DataFrame, blobs: DataFrame, live: DataFrame, live_digests: DataFrame, now, tag_ttl: int) -> dict[str, DataFrame]:
    """What a collection removes: manifests not reached, stale tags and tags that dangle once those are gone, blobs not reached."""
    gone = manifests.select("repo", "digest").join(live, ["repo", "digest"], "left_anti")
    stale = F.col("last_used").isNotNull() & ~fresh(F.col("last_used"), now, tag_ttl)
    dangling = tags.where(~stale).join(live, ["repo", "digest"], "left_anti")
    return {
        "manifests": gone,
        "tags": tags.where(stale).unionByName(dangling).select("repo", "tag", "digest"),
        "blobs": blobs.join(live_digests, "digest", "left_anti"),
    }


def closure(roots: DataFrame, entries: DataFrame) -> DataFrame:
    """(root, blob, part) of entries(digest, kind, config, layers, manifests): an index leads to its manifests, a manifest to its config and layers. Repeats stay."""
    e = roots.join(entries.withColumnRenamed("digest", "root"), "root")
    child = e.where("kind = 'index'").select("root", F.explode("manifests").alias("digest"))
    images = e.where("kind = 'manifest'").select("root", F.col("root").alias("digest")).unionByName(child)
    own = e.select("root", F.col("root").alias("blob"), F.lit("manifest").alias("part"))
    kids = child.select("root", F.col("digest").alias("blob"), F.lit("manifest").alias("part"))
    found = images.join(entries.where("kind = 'manifest'"), "digest")
    config = found.where("coalesce(config, '') <> ''").select("root", F.col("config").alias("blob"), F.lit("config").alias("part"))
    layers = found.select("root", F.explode("layers").alias("blob"), F.lit("layer").alias("part"))
    return own.unionByName(kids).unionByName(config).unionByName(layers)


def layer_handling(manifests: DataFrame, images: DataFrame, entries: DataFrame) -> DataFrame:
    """manifests(digest) with handling: that of the first of images(digest, ord, handling) that is it or an index of it, else shallow."""
    direct = images.select("digest", "ord", "handling")
    via = images.join(entries.where("kind = 'index'").select("digest", "manifests"), "digest").select(F.explode("manifests").alias("digest"), "ord", "handling")
    first = direct.unionByName(via).groupBy("digest").agg(F.min_by("handling", "ord").alias("handling"))
    return manifests.select("digest").join(first, "digest", "left").select("digest", F.coalesce("handling", F.lit("shallow")).alias("handling"))


def blobs_to_create(entries: DataFrame, images: DataFrame) -> DataFrame:
    """Distinct (blob, kind): manifests; configs and layers of eager manifests as files; layers of lazy ones as lazy files; shallow ones give none."""
    man = entries.where("kind = 'manifest'")
    handled = man.join(layer_handling(man, images, entries), "digest")
    out = entries.select(F.col("digest").alias("blob"), F.lit("manifest").alias("kind"))
    out = out.unionByName(man.where("coalesce(config, '') <> ''").select(F.col("config").alias("blob"), F.lit("file").alias("kind")))
    layers = handled.where("handling in ('eager', 'lazy')").select(F.explode("layers").alias("blob"), F.when(F.col("handling") == "eager", "file").otherwise("lazy_file").alias("kind"))
    return out.unionByName(layers).distinct()


def images_of_blobs(images: DataFrame, entries: DataFrame) -> DataFrame:
    """(blob, images) over the closures of images: a list, with repeats where several children share a blob."""
    c = closure(images.select(F.col("digest").alias("root")), entries)
    return c.groupBy("blob").agg(F.array_sort(F.collect_list("root")).alias("images"))


def image_files(images: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct (root, blob, label) of the files of images(digest, handling); layers of shallow images have none, those of lazy ones are in repositories of their own."""
    c = closure(images.select(F.col("digest").alias("root")), entries).join(images.select(F.col("digest").alias("root"), "handling"), "root")
    c = c.where("part <> 'layer' or handling in ('eager', 'lazy')")
    prefix = F.when((F.col("part") == "layer") & (F.col("handling") == "lazy"), "lazy_").otherwise("blob_")
    name = F.concat(F.lit("@"), prefix, F.replace(F.regexp_replace("blob", "^sha256:", ""), F.lit(":"), F.lit("_")), F.when(F.col("part") == "manifest", "//:manifest.json").otherwise("//:blob"))
    return c.select("root", "blob", name.alias("label")).distinct()


def reachable_facts(images: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts(digest, kind, manifests) of images and of their direct children; what has none is left out."""
    own = facts.join(images.select("digest"), "digest", "left_semi")
    kids = own.where("kind = 'index'").select(F.explode("manifests").alias("digest")).distinct()
    return own.unionByName(facts.join(kids, "digest", "left_semi")).dropDuplicates(["digest"])


def blob_sources(images: DataFrame) -> DataFrame:
    """(blob, repository, registries) of images(blob, repository, registry): every registry of every image that has the blob."""
    return images.groupBy("blob", "repository").agg(F.array_sort(F.collect_set("registry")).alias("registries"))


def merge_pulls(pulls: DataFrame) -> DataFrame:
    """One declaration of each digest of pulls(digest, ord, is_root, repository, registries, handling).

    Not shallow beats shallow; among those the last of the root module wins; without one eager beats lazy. The repository is the last root's, else the first's, with
    the registries of all that name it.
    """
    rank = F.when(F.col("handling") == "shallow", 0).when(F.col("is_root"), F.lit(10) + F.col("ord")).when(F.col("handling") == "eager", 2).otherwise(1)
    repo = F.when(F.col("is_root"), F.col("ord")).otherwise(-F.col("ord") - 1)
    best = pulls.withColumn("_rank", rank).withColumn("_repo", repo).groupBy("digest").agg(F.max_by("handling", F.struct("_rank", -F.col("ord"))).alias("handling"), F.max_by("repository", "_repo").alias("repository"))
    regs = pulls.select("digest", "repository", F.explode("registries").alias("r")).groupBy("digest", "repository").agg(F.array_sort(F.collect_set("r")).alias("registries"))
    return best.join(regs, ["digest", "repository"], "left")
