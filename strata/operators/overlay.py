"""Changeset semantics: layers applied in order, with deletion markers.

The relational plan turns every event into touches of a path and its ancestors and removes those that a later marker
deletes: an equi-join on exploded ancestors. It is exact where a path keeps its type, markers come first in their layer
and a layer has at most one opaque marker; other images, found by safe_images, go through a fold of one image at a
time, which is exact for all. So do small images, where a join costs more than the fold.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, base_name, dir_name

OPAQUE, WHITEOUT = ".wh..wh..opq", ".wh."
SCHEMA = "image long, path string, entry_type string, attrs string"


def events(entries: DataFrame) -> DataFrame:
    """entries(image, layer, ord, path, entry_type, attrs) with op (upsert, whiteout, opaque) and target, the path that the event is about."""
    name, folder = base_name(F.col("path")), dir_name(F.col("path"))
    op = F.when(name == OPAQUE, "opaque").when(name.startswith(WHITEOUT), "whiteout").otherwise("upsert")
    hidden = F.substring(name, F.lit(len(WHITEOUT) + 1), F.char_length(name))
    target = F.when(op == "opaque", folder).when((op == "whiteout") & (folder == "."), hidden).when(op == "whiteout", F.concat(folder, F.lit("/"), hidden)).otherwise(F.col("path"))
    return entries.withColumn("op", op).withColumn("target", target).where("target <> '.'  or op = 'opaque'")


def safe_images(e: DataFrame) -> DataFrame:
    """(image, safe): whether the relational plan is exact for an image's events."""
    per_path = e.where("op = 'upsert'").groupBy("image", "target").agg((F.count_distinct("entry_type") > 1).alias("changes"))
    changed = per_path.groupBy("image").agg(F.max("changes").alias("changes"))
    # a file with something beneath it is a type change of its own
    files = e.where("op = 'upsert' and entry_type <> 'dir'").select("image", F.col("target").alias("f")).distinct()
    above = e.select("image", F.explode(ancestors(F.col("target"))).alias("f")).distinct()
    beneath = files.join(above, ["image", "f"], "left_semi").select("image").distinct().withColumn("beneath", F.lit(True))
    order = e.groupBy("image", "layer").agg(F.max(F.when(F.col("op") != "upsert", F.col("ord"))).alias("last_marker"), F.min(F.when(F.col("op") == "upsert", F.col("ord"))).alias("first_upsert"), F.sum((F.col("op") == "opaque").cast("int")).alias("opaques"))
    late = order.groupBy("image").agg(F.max(F.coalesce(F.col("last_marker") > F.col("first_upsert"), F.lit(False))).alias("late"), F.max("opaques").alias("opaques"))
    return late.join(changed, "image", "left").join(beneath, "image", "left").select("image", (~F.col("late") & (F.col("opaques") <= 1) & ~F.coalesce("changes", F.lit(False)) & F.col("beneath").isNull()).alias("safe"))


def apply_plan(e: DataFrame) -> DataFrame:
    """The merged tree (image, path, entry_type, attrs) of events by joins alone."""
    explicit = e.where("op = 'upsert'").select("image", F.col("target").alias("path"), "ord", "layer", F.lit(True).alias("explicit"), "entry_type", "attrs")
    implied = F.when(F.col("op") == "opaque", F.concat(ancestors(F.col("target")), F.filter(F.array("target"), lambda x: x != "."))).otherwise(ancestors(F.col("target")))
    nothing = F.lit(None).cast("string")
    implicit = e.select("image", F.explode(implied).alias("path"), "ord", "layer", F.lit(False).alias("explicit"), nothing.alias("entry_type"), nothing.alias("attrs"))
    touches = explicit.unionByName(implicit)
    up = touches.withColumn("a", F.explode(F.concat(F.array(F.lit(".")), ancestors(F.col("path")), F.array("path"))))
    wiped = e.where("op = 'whiteout'").groupBy("image", F.col("target").alias("a")).agg(F.max("ord").alias("gone"))
    opaque = e.where("op = 'opaque'").groupBy("image", F.col("target").alias("a")).agg(F.array_sort(F.collect_set(F.struct("layer", "ord"))).alias("marks"))
    dead = F.coalesce(F.col("gone") > F.col("ord"), F.lit(False)) | (
        (F.col("a") != F.col("path")) & F.coalesce(F.exists("marks", lambda m: (m["ord"] > F.col("ord")) & (m["layer"] > F.col("layer"))), F.lit(False))
    )
    alive = up.join(wiped, ["image", "a"], "left").join(opaque, ["image", "a"], "left").groupBy("image", "path", "ord", "layer", "explicit", "entry_type", "attrs").agg(F.max(dead).alias("dead")).where("not dead")
    last = F.max_by(F.struct("entry_type", "attrs"), F.when(F.col("explicit"), F.col("ord")))
    return alive.groupBy("image", "path").agg(last.alias("l")).select("image", "path", F.coalesce("l.entry_type", F.lit("dir")).alias("entry_type"), F.coalesce("l.attrs", F.lit("")).alias("attrs"))


class Tree:
    """One image's tree as the fold of its events."""

    def __init__(self):
        self.root = {"kids": {}, "layer": -1, "type": "dir", "attrs": ""}

    def folder(self, names: list[str], layer: int) -> dict:
        at = self.root
        for n in names:
            kid = at["kids"].get(n)
            if kid is None:
                kid = at["kids"][n] = {"kids": {}, "layer": layer, "type": "dir", "attrs": ""}
            elif kid["type"] != "dir":
                kid |= {"kids": {}, "layer": layer, "type": "dir", "attrs": ""}
            at = kid
        return at

    def prune(self, node: dict, layer: int) -> bool:
        """Takes away what lower layers put beneath node; whether anything is left."""
        for n in list(node["kids"]):
            kid = node["kids"][n]
            if not self.prune(kid, layer) and kid["layer"] < layer:
                del node["kids"][n]
        return bool(node["kids"])

    def event(self, op: str, target: str, layer: int, kind: str, attrs: str, all_before: bool = False):
        names = [] if target == "." else target.split("/")
        if op == "opaque":
            node = self.folder(names, layer)
            if all_before:
                node["kids"].clear()
            else:
                self.prune(node, layer)
            return
        parent = self.folder(names[:-1], layer)
        if op == "whiteout":
            parent["kids"].pop(names[-1], None)
            return
        node = parent["kids"].setdefault(names[-1], {"kids": {}})
        node |= {"layer": layer, "type": kind, "attrs": attrs}

    def rows(self):
        todo = [(n, k) for n, k in self.root["kids"].items()]
        while todo:
            path, node = todo.pop()
            yield path, node["type"], node["attrs"]
            if node["type"] == "dir":
                todo += [(f"{path}/{n}", k) for n, k in node["kids"].items()]


def _fold(all_before: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree()
        for r in pdf.sort_values("ord").itertuples():
            tree.event(r.op, r.target, r.layer, r.entry_type, r.attrs, all_before)
        return pd.DataFrame([(key[0], *r) for r in tree.rows()], columns=["image", "path", "entry_type", "attrs"])

    return run


def apply_fold(e: DataFrame, all_before: bool = False) -> DataFrame:
    """The merged tree by one pass over each image's events. all_before: an opaque marker removes all children before it, whatever layer they are of."""
    cols = ["image", "layer", "ord", "op", "target", "entry_type", "attrs"]
    return e.select(*cols).groupBy("image").applyInPandas(_fold(all_before), SCHEMA)


def merge_layers(entries: DataFrame, fold_limit: int = 200_000) -> DataFrame:
    """The merged trees of images of entries(image, layer, ord, path, entry_type, attrs).

    Images of up to fold_limit events are folded, each by one task. Larger ones go through the joins where those are exact, so that one image is the work of many tasks, and else through the fold as well.
    """
    e = events(entries)
    large = e.groupBy("image").agg(F.count("*").alias("n")).where(F.col("n") > fold_limit).select("image")
    if large.isEmpty():
        return apply_fold(e)
    some = e.join(large, "image", "left_semi")
    safe = safe_images(some).where("safe").select("image")
    return apply_plan(some.join(safe, "image", "left_semi")).unionByName(apply_fold(e.join(safe, "image", "left_anti")))


def missing_parents(entries: DataFrame, image: str, path: str) -> DataFrame:
    """(image, path) of folders that paths imply and no entry describes."""
    have = entries.select(image, path).distinct()
    implied = entries.select(image, F.explode(ancestors(F.col(path))).alias(path)).distinct()
    return implied.join(have, [image, path], "left_anti")


def hardlinks(entries: DataFrame) -> DataFrame:
    """Link rows with the metadata of the last regular file that any layer puts at their target, and its number of names; links without one keep their own."""
    files = entries.where("entry_type = 'file'").groupBy("image", F.col("path").alias("t")).agg(F.max_by(F.struct("attrs", "size"), F.struct("layer", "ord")).alias("f"))
    links = entries.where("entry_type = 'hardlink'")
    names = links.groupBy("image", F.col("linkname").alias("t")).agg(F.count("*").alias("n"))
    inodes = files.join(names, ["image", "t"], "left").select("image", "t", "f", (F.coalesce("n", F.lit(0)) + 1).alias("nlink"))
    at = F.when(F.col("entry_type") == "hardlink", F.col("linkname")).when(F.col("entry_type") == "file", F.col("path"))
    joined = entries.withColumn("t", at).join(inodes, ["image", "t"], "left")
    link = F.col("entry_type") == "hardlink"
    return joined.select("image", "layer", "ord", "path", F.when(link & F.col("f").isNotNull(), F.col("f.attrs")).otherwise(F.col("attrs")).alias("attrs"), F.when(link & F.col("f").isNotNull(), F.col("f.size")).otherwise(F.col("size")).alias("size"), F.coalesce("nlink", F.lit(1)).alias("nlink"))


def merge_streams(entries: DataFrame) -> DataFrame:
    """The last entry of each path of ordered streams(ord, path, entry_type, attrs). A path whose neighbouring entries differ in type ends the job."""
    w = Window.partitionBy("path").orderBy("ord")
    before = F.lag("entry_type").over(w)
    rows = entries.withColumn("path", F.btrim("path", F.lit("/"))).withColumn("_before", before).withColumn("_last", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("ord"))) == 1)
    clash = F.col("_before").isNotNull() & (F.col("_before") != F.col("entry_type"))
    checked = rows.withColumn("entry_type", F.when(clash, F.raise_error(F.concat(F.lit("conflicting entries for "), F.col("path")))).otherwise(F.col("entry_type")))
    return checked.groupBy("path").agg(F.max_by(F.struct("entry_type", "attrs", "ord"), "ord").alias("l")).select("path", "l.*")


def type_conflicts(entries: DataFrame) -> DataFrame:
    """(path, before, after): neighbouring entries of one path whose types differ."""
    before = F.lag("entry_type").over(Window.partitionBy("path").orderBy("ord"))
    return entries.withColumn("before", before).where("before <> entry_type").select("path", "before", F.col("entry_type").alias("after"))


def beneath_files(entries: DataFrame) -> DataFrame:
    """(path, ancestor, ancestor_type) of entries beneath something that is no folder."""
    others = entries.where("entry_type <> 'dir'").select(F.col("path").alias("ancestor"), F.col("entry_type").alias("ancestor_type"))
    return entries.select("path", F.explode(ancestors(F.col("path"))).alias("ancestor")).join(others, "ancestor").select("path", "ancestor", "ancestor_type")
