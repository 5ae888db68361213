"""Assembling layers and documents: header fields, rewritten manifests, indexes, accounts' files, targets, templates, hashes of files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kv import functions as template_functions
from ..functions.kv import merge_maps
from ..functions.paths import ancestors

# Bits of entry types that a callback can ask for, types of base entries, targets of signatures.
TYPE_BITS = {"file": 1, "dir": 2, "hardlink": 4, "symlink": 8}
ENTRY_FLAGS = {"file": "0", "hardlink": "1", "symlink": "2", "char": "3", "block": "4", "dir": "5", "fifo": "6"}
TARGETS = ("roots", "child_manifests", "referrers")
LOCKED = ":!*:::::::"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def apply_fields(entries: DataFrame, fields: DataFrame, path: str = "path") -> DataFrame:
    """entries under fields(path, mode, uid, gid, uname, gname, mtime, pax): what is given replaces, modes are octal, times RFC 3339, PAX records are merged. A bad mode or time ends the job."""
    f = fields.select(F.col(path).alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("mode", "uid", "gid", "uname", "gname", "mtime", "pax")])
    j = entries.join(f, F.col(path) == F.col("_p"), "left")
    mode = F.when(F.col("_mode").rlike("^[0-7]+$"), F.conv("_mode", 8, 10).cast("long")).when(F.col("_mode").isNotNull(), F.raise_error(F.concat(F.lit("invalid mode "), F.col("_mode"))).cast("long"))
    new = {"mode": F.coalesce(mode, F.col("mode")), "mtime": F.coalesce(F.to_timestamp("_mtime"), F.col("mtime")), "pax": merge_maps("pax", "_pax")}
    new |= {c: F.coalesce(f"_{c}", c) for c in ("uid", "gid", "uname", "gname")}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in entries.columns])


def to_headers(entries: DataFrame) -> DataFrame:
    """(typeflag, name, pax, mtime_ns, ..) of base entries(path, entry_type, pax, xattrs, ..): folders end in a slash, extended attributes win over records of the same name. An unknown type or an empty path ends the job."""
    name = F.btrim("path", F.lit("/"))
    flag = F.lit(None).cast("string")
    for kind, f in ENTRY_FLAGS.items():
        flag = F.when(F.col("entry_type") == kind, f).otherwise(flag)
    checked = F.when(name == "", F.raise_error(F.lit("entry has an empty path"))).otherwise(F.concat(name, F.when(F.col("entry_type") == "dir", "/").otherwise("")))
    attributes = F.transform_keys(F.coalesce("xattrs", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: F.concat(F.lit("SCHILY.xattr."), k))
    rest = [c for c in entries.columns if c not in ("path", "entry_type", "pax", "xattrs")]
    return entries.select(F.coalesce(flag, F.raise_error(F.concat(F.lit("unknown type of "), F.col("path")))).alias("typeflag"), checked.alias("name"), merge_maps("pax", attributes).alias("pax"), *rest)


def of_types(entries: DataFrame, mask: int, kind: str = "entry_type") -> DataFrame:
    """Entries whose type's bit is in the mask; types without a bit never are."""
    bit = F.lit(0)
    for k, b in TYPE_BITS.items():
        bit = F.when(F.col(kind) == k, b).otherwise(bit)
    return entries.where(bit.bitwiseAND(F.lit(mask)) != 0)


def with_prefixes(entries: DataFrame, prefixes: list[str], path: str = "path") -> DataFrame:
    """Entries at or beneath any of the prefixes."""
    hit = F.lit(False)
    for p in prefixes:
        p = p.strip("/")
        hit = hit | (F.col(path) == p) | F.col(path).startswith(p + "/")
    return entries.where(hit)


def signing_targets(asked, override=None) -> Column:
    """Sorted targets: an override as it is, else those asked for, with all standing for each and roots always among them."""
    asked = _c(asked)
    every = F.array(*map(F.lit, TARGETS))
    own = F.when(F.coalesce(F.size(asked), F.lit(0)) <= 0, F.array(F.lit(TARGETS[0]))).otherwise(
        F.array_union(F.array(F.lit(TARGETS[0])), F.flatten(F.transform(asked, lambda t: F.when(t == "all", every).otherwise(F.array(t))))))
    return F.array_sort(own if override is None else F.coalesce(_c(override), own))


def rewrite_manifests(manifests: DataFrame, layers: DataFrame) -> DataFrame:
    """manifests(image, head, tail) with body, the JSON of head fields, the image's layers(image, layer_idx, descriptor) in order, and tail fields; and its digest and size. Other fields stay as they are, being text."""
    own = layers.groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer_idx", "descriptor"))), lambda x: x["descriptor"]), ",").alias("_l"))
    body = F.concat(F.lit("{"), "head", F.lit(',"layers":['), F.coalesce("_l", F.lit("")), F.lit("]"), F.when(F.col("tail") != "", F.concat(F.lit(","), "tail")).otherwise(""), F.lit("}"))
    return manifests.join(own, "image", "left").withColumn("body", body).withColumn("digest", F.concat(F.lit("sha256:"), F.sha2("body", 256))).withColumn("size", F.octet_length("body")).drop("_l", "head", "tail")


def assemble_index(children: DataFrame) -> DataFrame:
    """(index, digests): children(index, kind, pos, digest) with the manifests first, then the rest, each in order."""
    order = F.struct((F.col("kind") != "manifest").alias("later"), "pos", "digest")
    return children.groupBy("index").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["digest"]).alias("digests"))


def rewrite_indexes(indexes: DataFrame, changed: DataFrame) -> DataFrame:
    """indexes(index, pos, digest) with the digests that changed(old, new) says."""
    return indexes.join(changed.select(F.col("old").alias("digest"), "new"), "digest", "left").select("index", "pos", F.coalesce("new", "digest").alias("digest"))


def shadow_lines(accounts: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, line): the line that existing(name, line) has, else a locked one."""
    return accounts.select("name").join(existing.select("name", "line"), "name", "left").select("name", F.coalesce("line", F.concat("name", F.lit(LOCKED))).alias("line"))


def home_folders(accounts: DataFrame, mode: int = 0o755) -> DataFrame:
    """(path, uid, gid, uname, mode) of each distinct home that isn't the root, of the account with the smallest id; private for id 0."""
    a = accounts.withColumn("path", F.btrim("home", F.lit("/"))).where("path <> ''")
    first = a.groupBy("path").agg(F.min(F.struct("id", "gid", "name")).alias("f"))
    return first.select("path", F.col("f.id").alias("uid"), F.col("f.gid").alias("gid"), F.col("f.name").alias("uname"), F.when(F.col("f.id") == 0, 0o700).otherwise(mode).alias("mode"))


def rebase(short_path) -> Column:
    """A file's path in the tree of runfiles: the repository's name first for files of others, _main for own ones."""
    p = _c(short_path)
    return F.when(p.startswith("../"), F.substring(p, F.lit(4), F.char_length(p))).otherwise(F.concat(F.lit("_main/"), p))


def group_index(groups, name) -> Column:
    """Place of the first group of that name, -1 if there is none."""
    return F.array_position(_c(groups), _c(name)) - 1


def merge_files(files: DataFrame, templates: DataFrame) -> DataFrame:
    """(key, map, list) of templates(key, map, list) under files(key, ord, kind, pairs, items): pairs win over the map's, items go to the list's end; empty files change nothing. Both kinds for one key end the job."""
    kinds = F.collect_set(F.when(F.col("kind") != "empty", F.col("kind")))
    f = files.groupBy("key").agg(kinds.alias("_k"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "pairs"))), lambda x: F.coalesce(x["pairs"], F.array().cast("array<struct<key:string,value:string>>")))).alias("_p"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "items"))), lambda x: F.coalesce(x["items"], F.array().cast("array<string>")))).alias("_i"))
    from ..functions.kv import flatten

    j = templates.join(f, "key", "full")
    one_kind = F.when(F.size("_k") > 1, F.raise_error(F.concat(F.lit("files mix pairs and plain entries for "), F.col("key"))).cast("array<string>")).otherwise(F.coalesce("_k", F.array().cast("array<string>")))
    has = lambda k: F.array_contains(one_kind, k)
    return j.select("key", F.when(has("kv"), merge_maps("map", flatten("_p"))).otherwise(F.col("map")).alias("map"), F.when(has("list"), F.concat(F.coalesce("list", F.array().cast("array<string>")), F.col("_i"))).otherwise(F.col("list")).alias("list"))


def transfer_stats(transfers: DataFrame, sources: list[str]) -> DataFrame:
    """One row: the number and bytes of transfers(source, size) from each source."""
    return transfers.agg(*[x for s in sources for x in (F.count(F.when(F.col("source") == s, 1)).alias(s), F.coalesce(F.sum(F.when(F.col("source") == s, F.col("size"))), F.lit(0)).cast("long").alias(f"{s}_bytes"))])


def summary(layers: DataFrame) -> DataFrame:
    """(layer, outer, inner, outer_size, inner_size) of layers(layer, raw, content): hashes of the stored bytes and of the content."""
    return layers.select("layer", F.sha2("raw", 256).alias("outer"), F.sha2("content", 256).alias("inner"), F.octet_length("raw").cast("long").alias("outer_size"), F.octet_length("content").cast("long").alias("inner_size"))


def shard(keys: list, shards: int) -> Column:
    """Shard of a key by a 64-bit hash; which one is no part of any result."""
    return F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")


def digest_with(df: DataFrame, column: str, name: str, digester: Callable[[bytes], str] | None = None) -> DataFrame:
    """df with a digest of a binary column: SHA-256 in the engine, or any digester in Python, batch by batch."""
    if digester is None:
        return df.withColumn(name, F.sha2(F.col(column), 256))
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(**{name: [digester(bytes(v)) for v in p[column]]})

    return df.mapInPandas(run, schema)


def sha512(raw: bytes) -> str:
    return hashlib.sha512(raw).hexdigest()


def parents_with(entries: DataFrame, image: str, path: str, mode: Callable[[Column, Column], Column]) -> DataFrame:
    """(image, path, mode) of folders that no entry describes, with a mode from their path and the number of entries beneath."""
    above = entries.select(image, F.explode(ancestors(F.col(path))).alias("_a")).groupBy(image, "_a").agg(F.count("*").alias("_n"))
    have = entries.select(F.col(image).alias("_i"), F.col(path).alias("_p")).distinct()
    return above.join(have, (F.col(image) == F.col("_i")) & (F.col("_a") == F.col("_p")), "left_anti").select(image, F.col("_a").alias(path), mode(F.col("_a"), F.col("_n")).alias("mode"))


_PART = r"\{\{\s*(.*?)\s*\}\}"


def compile_template(template: str, columns: dict[str, Column]) -> Column:
    """A template of text, {{.name}} and {{function arguments}} as one expression over columns, so that it is planned like any other. Arguments are "texts" and .names; unknown names and functions are errors here."""
    import re

    own = template_functions()

    def argument(a: str) -> Column:
        if a.startswith('"'):
            return F.lit(a[1:-1])
        if a.startswith(".") and a[1:] in columns:
            return columns[a[1:]]
        raise ValueError(f"unknown name {a}")

    parts = []
    for i, p in enumerate(re.split(_PART, template)):
        if i % 2 == 0:
            if p:
                parts.append(F.lit(p))
            continue
        head, *rest = re.findall(r'"[^"]*"|[^\s"]+', p)
        if head.startswith("."):
            parts.append(argument(head).cast("string"))
        elif head in own:
            args = [argument(a) for a in rest]
            if head == "join":  # the separator of a join is a plain text
                args[1] = rest[1][1:-1]
            parts.append(own[head](*args).cast("string"))
        else:
            raise ValueError(f"unknown function {head}")
    return F.concat(*parts) if parts else F.lit("")
