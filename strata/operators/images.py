"""Images: history of layers, config overlays, platforms and base selection, descriptors, listings and pages of a registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kv import merge_maps

# Fixed value: the list item or scalar that stands for the base image's value.
INHERIT = "<inherit from base>"


def split_history(history: DataFrame, layers: DataFrame) -> DataFrame:
    """history(image, ord, empty_layer) with layer_idx among layers(image, n_layers): empty entries go with the next layer, trailing ones with the last, all with the first where no entry makes a layer. Entries of images without layers have none; entries for layers beyond the last are dropped."""
    made = F.sum((~F.col("empty_layer")).cast("int"))
    before = made.over(Window.partitionBy("image").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    total = made.over(Window.partitionBy("image"))
    h = history.withColumn("_b", F.coalesce(before, F.lit(0))).withColumn("_t", total).join(layers, "image").where("n_layers > 0")
    last = F.least("_t", "n_layers")
    # entries after the last one that makes a layer
    trailing = F.col("empty_layer") & (F.col("_b") == F.col("_t"))
    at = F.when(trailing, F.greatest(last - 1, F.lit(0))).otherwise(F.col("_b"))
    return h.withColumn("layer_idx", at.cast("int")).where(F.col("layer_idx") < F.col("n_layers")).drop("_b", "_t", "n_layers")


def expand_inherit(items: Column, base: Column) -> Column:
    """items with each sentinel replaced by the base's items."""
    return F.flatten(F.transform(items, lambda x: F.when(x == INHERIT, F.coalesce(base, F.array().cast("array<string>"))).otherwise(F.array(x))))


def overlay_scalar(base: Column, value: Column) -> Column:
    """The base's value for the sentinel, else the value; an empty one unsets."""
    return F.when(value == INHERIT, base).otherwise(F.nullif(value, F.lit("")))


def _pure(items: Column) -> Column:
    return (F.size(items) == 1) & (F.try_element_at(items, F.lit(1)) == INHERIT)


def overlay_command(base_entry: Column, base_cmd: Column, entry: Column, cmd: Column) -> Column:
    """(entrypoint, cmd): inherited, unset by an empty list, or set with sentinels expanded; setting the entrypoint clears an inherited cmd."""
    none = F.lit(None).cast("array<string>")
    new_entry = F.when(_pure(entry), base_entry).when(F.size(entry) == 0, none).otherwise(expand_inherit(entry, base_entry))
    kept = F.when(_pure(entry) | (F.size(entry) == 0), base_cmd).otherwise(none)
    new_cmd = F.when(_pure(cmd), kept).when(F.size(cmd) == 0, none).otherwise(expand_inherit(cmd, base_cmd))
    return F.struct(new_entry.alias("entrypoint"), new_cmd.alias("cmd"))


def overlay_env(base: Column, env: Column) -> Column:
    """base 'K=V' entries with the values that env, a map, has for them, then env's other keys, sorted."""
    key = lambda e: F.substring_index(e, "=", 1)
    replaced = F.transform(base, lambda e: F.when(F.map_contains_key(env, key(e)), F.concat(key(e), F.lit("="), F.element_at(env, key(e)))).otherwise(e))
    keys = F.transform(base, key)
    added = F.filter(F.array_sort(F.map_keys(env)), lambda k: ~F.array_contains(keys, k))
    return F.concat(replaced, F.transform(added, lambda k: F.concat(k, F.lit("="), F.element_at(env, k))))


def overlay_fragment(base: DataFrame, fragment: DataFrame, key: str = "image") -> DataFrame:
    """base configs under fragments: os and architecture must agree; user, workdir and stop signal are replaced when set, ports, volumes, entrypoint and cmd when not null; labels and env are merged."""
    f = fragment.select(key, *[F.col(c).alias(f"_f_{c}") for c in fragment.columns if c != key])
    j = base.join(f, key, "left")
    set_ = lambda c: F.nullif(F.col(f"_f_{c}"), F.lit(""))
    agreed = lambda c: F.when((set_(c) != F.nullif(F.col(c), F.lit(""))), F.raise_error(F.lit(f"{c} mismatch"))).otherwise(F.coalesce(set_(c), F.col(c)))
    new = {c: agreed(c) for c in ("os", "architecture")}
    new |= {c: F.coalesce(set_(c), F.col(c)) for c in ("user", "workdir", "stop_signal")}
    new |= {c: F.coalesce(F.col(f"_f_{c}"), F.col(c)) for c in ("ports", "volumes", "entrypoint", "cmd")}
    new["labels"] = merge_maps("labels", "_f_labels")
    return j.select(key, *[new[c].alias(c) if c in new else F.col(c) for c in base.columns if c != key])


def platform_vector(os: Column, arch: Column, variant: Column) -> Column:
    """Platforms (os, architecture, variant) that will do, best first: the wanted one, then lower variants."""
    number = F.regexp_extract(variant, r"^v(\d+)$", 1).try_cast("int")
    down = lambda high, low, prefix: F.when(high >= low, F.transform(F.sequence(high, F.lit(low), F.lit(-1)), lambda n: F.concat(F.lit(prefix), n.cast("string")))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    wanted = F.array(variant)
    x86 = F.concat(wanted, F.when(number > 1, down(number - 1, 1, "v")).otherwise(none), F.array(F.lit("")))
    arm = F.concat(wanted, F.when(number > 5, down(number - 1, 5, "v")).otherwise(none))
    eight, nine = (F.regexp_extract(variant, rf"^v{m}\.(\d+)$", 1).try_cast("int") for m in (8, 9))
    minor = lambda n, m: F.when(n > 0, F.concat(down(n - 1, 1, f"v{m}."), F.array(F.lit(f"v{m}")))).otherwise(none)
    arm64 = F.when(eight.isNotNull(), F.concat(wanted, minor(eight, 8))).when((variant == "v9") | variant.startswith("v9."), F.concat(wanted, F.coalesce(minor(nine, 9), none), F.array(F.lit("v8")))).otherwise(wanted)
    variants = F.when((arch == "amd64") & (variant != ""), x86).when((arch == "arm") & (variant != ""), arm).when(arch == "arm64", arm64).otherwise(wanted)
    return F.transform(variants, lambda v: F.struct(os.alias("os"), arch.alias("architecture"), v.alias("variant")))


def select_base(wanted: DataFrame, manifests: DataFrame) -> DataFrame:
    """wanted(id, os, architecture, variant) with manifest: the first of manifests(pos, manifest, os, architecture, variant) of the best platform that any has; null if none will do."""
    p = wanted.select("id", F.posexplode(platform_vector(F.col("os"), F.col("architecture"), F.col("variant"))).alias("rank", "p")).select("id", "rank", "p.*")
    hit = p.join(manifests, ["os", "architecture", "variant"]).groupBy("id").agg(F.min_by("manifest", F.struct("rank", "pos")).alias("manifest"))
    return wanted.join(hit, "id", "left")


def index_children(children: DataFrame, keep: Column) -> DataFrame:
    """Children(index, pos, ..) that a predicate keeps, with default: the first of them; an index with none left ends the job."""
    kept = children.withColumn("_k", F.coalesce(keep, F.lit(False)))
    w = Window.partitionBy("index")
    some = F.max(F.col("_k")).over(w)
    checked = kept.withColumn("_k", F.when(some, F.col("_k")).otherwise(F.raise_error(F.lit("no child of the index is left")).cast("boolean")))
    return checked.where("_k").withColumn("default", F.col("pos") == F.min("pos").over(w)).drop("_k")


def descriptors(images: DataFrame) -> DataFrame:
    """A descriptor for each tag of images(digest, tags, annotations), with the tag among its annotations; one without for images without tags."""
    tag = F.explode_outer(F.when(F.size("tags") > 0, F.col("tags")))
    named = F.create_map(F.lit("org.opencontainers.image.ref.name"), F.col("tag"))
    return images.withColumn("tag", tag).withColumn("annotations", F.when(F.col("tag").isNull(), F.col("annotations")).otherwise(merge_maps("annotations", named))).drop("tags")


def index_entries(entries: DataFrame) -> DataFrame:
    """Entries(index, ord, digest, ref) of indexes, each (digest, ref) once, where it first came."""
    return entries.groupBy("index", "digest", "ref").agg(F.min("ord").alias("ord"))


def layer_descriptors(layers: DataFrame, min_size: int = 0) -> DataFrame:
    """(image, layers): descriptors of at least min_size bytes in order; one without media type, digest or diff id ends the job."""
    whole = F.col("media_type").isNotNull() & F.col("digest").isNotNull() & F.col("diff_id").isNotNull()
    d = F.when(whole, F.struct("layer_idx", "media_type", "digest", "diff_id", "size")).otherwise(F.raise_error(F.lit("incomplete layer descriptor")))
    return layers.where(F.col("size") >= min_size).groupBy("image").agg(F.array_sort(F.collect_list(d)).alias("layers"))


def tag_page(tags: DataFrame, last: str = "", n: int | None = None) -> DataFrame:
    """Sorted tags after last, n of them. Where none is after last, the list starts at its beginning."""
    t = tags.select("tag").distinct()
    if last:
        after = t.where(F.col("tag") > last)
        t = t if after.isEmpty() else after
    t = t.orderBy("tag")
    return t if n is None else t.limit(n)


def catalog(repos: DataFrame, n: int = 10_000) -> DataFrame:
    """The first n repositories by name."""
    return repos.select("repo").distinct().orderBy("repo").limit(n)


def merge_accounts(accounts: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """accounts(name, id, ..) by id with defaults for empty fields. A name or an id that is there twice ends the job."""
    def once(c: str) -> Column:
        return F.when(F.count("*").over(Window.partitionBy(c)) > 1, F.raise_error(F.concat(F.lit(f"duplicate {c} "), F.col(c).cast("string")))).otherwise(F.col(c))

    filled = accounts.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) for c, v in defaults.items()})
    kind = dict(accounts.dtypes)["id"]
    return filled.withColumn("name", once("name")).withColumn("id", once("id").cast(kind)).orderBy("id")


def account_conflicts(accounts: DataFrame) -> DataFrame:
    """(field, value, n) of names and ids that several accounts have."""
    dup = lambda c: accounts.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(c).alias("field"), "value", "n")
    return dup("name").unionByName(dup("id"))


def numbered_by_hash(items: DataFrame, group: str, order: str) -> DataFrame:
    """items with suffix: 0, 1, .. among those of the same group."""
    return items.withColumn("suffix", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)


def intern_strings(strings: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, text, offset): each distinct text of a group once, where it first comes, at the byte that the texts before it and their end bytes reach."""
    first = strings.groupBy(group, text).agg(F.min(order).alias("_o"))
    w = Window.partitionBy(group).orderBy("_o", text).rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("offset", F.coalesce(F.sum(F.octet_length(text) + 1).over(w), F.lit(0))).drop("_o")


def group_layers(files: DataFrame, order: list[str]) -> DataFrame:
    """(group_idx, files): one layer for each group of files(group, path), groups in the order given, the rest after them in one."""
    groups = F.array(*[F.lit(g) for g in order])
    at = F.coalesce(F.nullif(F.array_position(groups, F.col("group")), F.lit(0)) - 1, F.lit(len(order)))
    return files.groupBy(at.cast("int").alias("group_idx")).agg(F.array_sort(F.collect_set("path")).alias("files"))


def layer_sources(images: DataFrame) -> DataFrame:
    """(image, manifest_idx, layer_idx, source) of images(image, sources), arrays of layers' arrays of sources; images whose sources are all empty have none."""
    m = images.select("image", F.posexplode("sources").alias("manifest_idx", "s"))
    layer = m.select("image", "manifest_idx", F.posexplode("s").alias("layer_idx", "s"))
    return layer.select("image", "manifest_idx", "layer_idx", F.explode("s").alias("source"))
