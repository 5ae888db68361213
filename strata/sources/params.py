"""Line-oriented parameter files, as tables with a value column (spark.read.text). Fields are separated by NUL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import place

NUL = "\0"


def _fields(n: int) -> Column:
    return F.split("value", NUL, n)


def _whole(n: int, what: str) -> Column:
    """The line's fields; a line with fewer ends the job."""
    f = _fields(n)
    return F.when(F.size(f) == n, f).otherwise(F.raise_error(F.concat(F.lit(f"malformed {what} line: "), F.col("value"))).cast("array<string>"))


def read(spark, path: str) -> DataFrame:
    """Lines of a file in their order: one file is one scan, and ord is its row number."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ord"))


def add_files(lines: DataFrame) -> DataFrame:
    """path NUL type-letter source: (path, file_type, source)."""
    f = lines.where("value <> ''").withColumn("f", _whole(2, "file"))
    kind = F.substring(F.element_at("f", 2), 1, 1)
    known = F.when(kind == "f", "regular").when(kind == "d", "directory").when(kind == "l", "symlink").otherwise(F.raise_error(F.concat(F.lit("unknown file type "), kind)))
    return f.select(*[c for c in lines.columns if c != "value"], F.element_at("f", 1).alias("path"), known.alias("file_type"), F.expr("substring(element_at(f, 2), 2)").alias("source"))


def symlinks(lines: DataFrame) -> DataFrame:
    """link NUL target: (link, target)."""
    f = lines.where("value <> ''").withColumn("f", _whole(2, "symlink"))
    return f.select(*[c for c in lines.columns if c != "value"], F.element_at("f", 1).alias("link"), F.element_at("f", 2).alias("target"))


def paths(lines: DataFrame) -> DataFrame:
    """One path a line; empty lines don't count."""
    return lines.where("value <> ''").withColumnRenamed("value", "path")


def placement(lines: DataFrame) -> DataFrame:
    """(path, file_type, source) of a placement file, whose first line is mode NUL dest NUL anchor NUL skip. A file equal to skip is left out, and the number of the others settles where a single one goes."""
    header = lines.orderBy("ord").limit(1).select(F.split("value", NUL, 4).alias("h"), F.col("ord").alias("h_ord"))
    rows = add_files(lines.join(F.broadcast(header), F.col("ord") > F.col("h_ord")).withColumn("h", F.col("h"))).withColumnRenamed("path", "short")
    at = lambda i: F.element_at("h", i)
    kept = rows.where((at(4) == "") | (F.col("short") != at(4)))
    n = kept.agg(F.count("*").alias("n"))
    return kept.join(F.broadcast(n)).select("ord", place(F.col("short"), at(1), at(2), at(3), F.col("n")).alias("path"), "file_type", "source")


def required_layers(lines: DataFrame) -> DataFrame:
    """index NUL path: (layer_idx, path)."""
    f = lines.where("value <> ''").withColumn("f", _whole(2, "required layer"))
    return f.select(F.element_at("f", 1).cast("int").alias("layer_idx"), F.element_at("f", 2).alias("path"))


def layer_hints(lines: DataFrame) -> DataFrame:
    """blob NUL metadata path: (path, metadata)."""
    f = lines.where("value <> ''").withColumn("f", _whole(2, "hint"))
    return f.select(F.element_at("f", 1).alias("path"), F.element_at("f", 2).alias("metadata"))


def hints_by_digest(hints: DataFrame) -> DataFrame:
    """(digest, paths): the sorted distinct paths of each digest of hints(digest, path)."""
    return hints.groupBy("digest").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def render_hints(grouped: DataFrame) -> DataFrame:
    return grouped.select(F.concat_ws(NUL, "digest", F.array_join("paths", NUL)).alias("value"))


def reread_hints(lines: DataFrame) -> DataFrame:
    """digest NUL path NUL path ..: (digest, path)."""
    f = F.split("value", NUL)
    return lines.where("value <> ''").select(F.element_at(f, 1).alias("digest"), F.explode(F.slice(f, F.lit(2), F.size(f))).alias("path"))


def stamps(lines: DataFrame, order: str = "ord") -> DataFrame:
    """(key, value) of 'KEY VALUE' lines: the last of each key; blank lines, comments and lines without a blank don't count."""
    t = lines.where((F.btrim("value") != "") & ~F.col("value").startswith("#") & F.col("value").contains(" "))
    kv = t.select(F.substring_index("value", " ", 1).alias("key"), F.regexp_extract("value", "^[^ ]* (.*)$", 1).alias("value"), order)
    return kv.groupBy("key").agg(F.max_by("value", order).alias("value"))


def env_file(lines: DataFrame) -> DataFrame:
    """(key, value) of an environment file, quotes taken off."""
    from ..functions.kv import unquote

    t = lines.where((F.btrim("value") != "") & ~F.btrim("value").startswith("#"))
    return t.select(F.btrim(F.substring_index("value", "=", 1)).alias("key"), unquote(F.btrim(F.regexp_extract("value", "^[^=]*=(.*)$", 1))).alias("value"))


def accounts(lines: DataFrame) -> DataFrame:
    """(name, password, id, gid, gecos, home, shell) of passwd lines."""
    f = F.split("value", ":")
    g = lambda i: F.coalesce(F.try_element_at(f, F.lit(i)), F.lit(""))
    return lines.where((F.col("value") != "") & ~F.col("value").startswith("#")).select(g(1).alias("name"), g(2).alias("password"), g(3).cast("long").alias("id"), g(4).cast("long").alias("gid"), g(5).alias("gecos"), g(6).alias("home"), g(7).alias("shell"))
