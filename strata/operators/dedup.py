"""Content deduplication inside a layer, and what it needs: node keys, ordered distinct values, offsets and Merkle hashes.

Order is data: every input has an ord column. A digest that many entries share would land in one task, so the first entry of a digest comes from an
aggregate, which adds up in map tasks first, and a join that deals frequent digests over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, base_name
from ..session import reliable_checkpoint
from .skew import join_spread


def first_by(df: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """keys, first_<value> of the row with the smallest order, and rows_of_key."""
    first = F.min(F.struct(order, *[v for v in values if v != order])).alias("f")
    return df.groupBy(*keys).agg(first, F.count("*").alias("rows_of_key")).select(*keys, *[F.col(f"f.{v}").alias(f"first_{v}") for v in values], "rows_of_key")


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest order of each key."""
    rest = [c for c in df.columns if c not in keys and c != order]
    last = F.max_by(F.struct(order, *rest), order).alias("l")
    return df.groupBy(*keys).agg(last).select(*keys, "l.*")


def link_repeats(entries: DataFrame, keys: list[str], order: str = "ord", path: str = "path") -> DataFrame:
    """entries with link: the path of the first entry with the same keys, null for that entry itself."""
    first = reliable_checkpoint(first_by(entries, keys, order, order, path).select(*[F.col(k).alias(f"_{k}") for k in keys], f"first_{order}", f"first_{path}", "rows_of_key").where("rows_of_key > 1"))
    joined = join_spread(entries, first, keys, [f"_{k}" for k in keys], "rows_of_key", [order], "left")
    return joined.select(*entries.columns, F.when(F.col(order) != F.col(f"first_{order}"), F.col(f"first_{path}")).alias("link"))


def is_blob(entry_type, mode, uid, gid, uname, gname, mtime, pax) -> Column:
    """Whether an entry has default metadata, so that its content alone identifies it."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (c(entry_type) == "file") & (c(mode) == 0o755) & (c(uid) == 0) & (c(gid) == 0) & (c(uname) == "") & (c(gname) == "") & c(mtime).isNull() & c(pax).isNull()


def node_key(*columns) -> Column:
    """Equality key of the metadata of an entry; maps count as sorted entries."""
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in columns])


def dedup_layer(entries: DataFrame, meta: list[str], order: str = "ord") -> DataFrame:
    """entries with link. Entries with default metadata (is_blob) share by digest, all others by metadata and digest, each among their own."""
    keyed = entries.withColumn("_node", F.when(F.col("is_blob"), F.lit(None)).otherwise(F.struct(*meta)))
    return link_repeats(keyed, ["is_blob", "_node", "digest"], order).drop("_node")


def normalize_header(entries: DataFrame) -> DataFrame:
    """Header fields as they are hashed: seconds rounded to the nearest, no link name but for links, no device numbers but for devices, a folder for a file whose name ends in a slash."""
    kind = F.when((F.col("entry_type") == "file") & F.col("path").endswith("/"), "dir").otherwise(F.col("entry_type"))
    rounded = F.date_trunc("second", F.col("mtime") + F.expr("interval 500 milliseconds"))
    device = F.col("entry_type").isin("char", "block")
    return entries.withColumns({
        "entry_type": kind, "mtime": rounded.cast("timestamp_ntz"), "linkname": F.when(F.col("entry_type").isin("hardlink", "symlink"), F.col("linkname")).otherwise(""),
        "devmajor": F.when(device, F.col("devmajor")).otherwise(0), "devminor": F.when(device, F.col("devminor")).otherwise(0)})


def header_hash(kind, path, link, size, mode, uid, gid, uname, gname, mtime) -> Column:
    """SHA-256 over length-prefixed big-endian header fields."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    number = lambda n: F.unhex(F.lpad(F.hex(c(n).cast("long")), 16, "0"))
    text = lambda s: F.concat(number(F.octet_length(F.encode(c(s), "UTF-8"))), F.encode(c(s), "UTF-8"))
    return F.sha2(F.concat(F.encode(c(kind), "UTF-8"), text(path), text(link), *map(number, (size, mode, uid, gid)), text(uname), text(gname), number(mtime)), 256)


def rewrite_repeated_paths(entries: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """A path that several entries ask for becomes a folder of theirs, each under its source's base name. Done once: what collides then stays."""
    counts = reliable_checkpoint(entries.groupBy(F.col(path).alias("_p")).agg(F.count("*").alias("_n")).where("_n > 1"))
    new = F.when(F.col("_n") > 1, F.concat(F.col(path), F.lit("/"), base_name(F.col(source)))).otherwise(F.col(path))
    return join_spread(entries, counts, [path], ["_p"], "_n", [source], "left").withColumn(path, new).drop("_p", "_n")


def export_state(entries: DataFrame, digest: str = "digest", order: str = "ord") -> DataFrame:
    """Distinct digests with the place of their first entry."""
    return entries.groupBy(digest).agg(F.min(order).alias("first_ord"))


def link_repeated_trees(files: DataFrame, tree: str, path: str, digest: str, order: str) -> DataFrame:
    """(tree, tree_hash, link): a tree whose files are those of an earlier tree links to it."""
    trees = files.groupBy(tree).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\0", path, digest))), "\n"), 256).alias("tree_hash"), F.min(order).alias("_ord"))
    return link_repeats(trees.withColumnRenamed(tree, "path").withColumnRenamed("_ord", "ord"), ["tree_hash"]).select(F.col("path").alias(tree), "tree_hash", "link")


def running_offsets(df: DataFrame, order: list[str], length: Column, group: list[str] = (), align: int = 1) -> DataFrame:
    """df with offset: the sum of the lengths, each rounded up to align, of the rows before in its group.

    Without a group the order is global. Then rows are ranged over partitions by order, sums are made within each, and what goes before a partition
    is one number, so that no task sees all rows.
    """
    rows = df.withColumn("_len", ((length + (align - 1)) / align).cast("long") * align if align > 1 else length)
    if group:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("offset", F.coalesce(F.sum("_len").over(w), F.lit(0)).cast("long")).drop("_len")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stored, so that both uses see the rows in the same partitions, and so does a retried task
    ranged = reliable_checkpoint(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum("_len").alias("_total"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("_part").alias("_p"), "_before")
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_within", F.coalesce(F.sum("_len").over(w), F.lit(0)))
    return summed.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn("offset", (F.col("_before") + F.col("_within")).cast("long")).drop("_len", "_part", "_p", "_before", "_within")


def gaps(refs: DataFrame, group: list[str], offset: str = "offset", size: str = "size") -> DataFrame:
    """refs with gap, the inline bytes before each reference, and overlaps, whether it begins before its predecessor ends."""
    end = F.lag(F.col(offset) + F.col(size), 1, 0).over(Window.partitionBy(*group).orderBy(offset, size))
    return refs.withColumn("gap", F.col(offset) - end).withColumn("overlaps", F.col(offset) < end)


def merkle(files: DataFrame, tree: str, path: str = "path", digest: str = "digest", size: str = "size") -> DataFrame:
    """(tree, root_hash, n_dirs) of trees of files(tree, path, digest, size), folder by folder from the deepest level: one aggregate a level, and a level holds folders of all trees."""
    rows = files.select(F.col(tree).alias("_t"), F.col(path).alias("_path"), F.concat_ws(":", F.lit("f"), base_name(F.col(path)), F.col(size), F.col(digest)).alias("_node"))
    parent = F.when(F.col("_path").contains("/"), F.regexp_replace("_path", "/[^/]*$", "")).otherwise("")
    rows = rows.withColumn("_level", F.size(ancestors(F.col("_path")))).withColumn("_parent", parent)
    depth = rows.agg(F.max("_level")).first()[0] or 0
    level_files = lambda n: rows.where(F.col("_level") == n).select("_t", "_parent", "_node")
    below, dirs = None, None
    for n in range(depth, -1, -1):
        here = level_files(n) if below is None else level_files(n).union(below)
        hashed = here.groupBy("_t", "_parent").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_node")), "\n"), 256).alias("_hash"))
        count = hashed.select("_t", F.lit(1).alias("_one"))
        dirs = count if dirs is None else dirs.union(count)
        if n == 0:
            roots = hashed
            break
        up = F.when(F.col("_parent").contains("/"), F.regexp_replace("_parent", "/[^/]*$", "")).otherwise("")
        below = hashed.select("_t", up.alias("_up"), F.concat_ws(":", F.lit("d"), base_name(F.col("_parent")), F.col("_hash")).alias("_node")).withColumnRenamed("_up", "_parent")
    n_dirs = dirs.groupBy(F.col("_t").alias("_tt")).agg(F.sum("_one").cast("long").alias("n_dirs"))
    return roots.join(n_dirs, F.col("_t") == F.col("_tt")).select(F.col("_t").alias(tree), F.col("_hash").alias("root_hash"), "n_dirs")
