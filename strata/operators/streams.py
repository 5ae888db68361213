"""Compact streams: inline bytes and references into a store, and checkpoints of a compressed stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inspect(refs: DataFrame, inline: DataFrame) -> DataFrame:
    """(stream, refs, referenced_bytes, inline_bytes, reconstructed_size) of refs(stream, offset, digest, size) and inline(stream, size)."""
    r = refs.groupBy("stream").agg(F.count("*").alias("refs"), F.sum("size").alias("referenced_bytes"))
    i = inline.groupBy("stream").agg(F.sum("size").alias("inline_bytes"))
    j = r.join(i, "stream", "full")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return j.select("stream", n("refs"), n("referenced_bytes"), n("inline_bytes"), (F.coalesce("referenced_bytes", F.lit(0)) + F.coalesce("inline_bytes", F.lit(0))).cast("long").alias("reconstructed_size"))


def check_refs(refs: DataFrame) -> DataFrame:
    """refs in table order; one that isn't after its predecessor's end ends the job."""
    w = Window.partitionBy("stream").orderBy("ord")
    end = F.lag(F.col("offset") + F.col("size"), 1, 0).over(w)
    return refs.withColumn("_e", end).withColumn("offset", F.when(F.col("offset") < F.col("_e"), F.raise_error(F.lit("references overlap or aren't sorted")).cast("long")).otherwise(F.col("offset"))).drop("_e")


def reconstruct(pieces: DataFrame) -> DataFrame:
    """(stream, content, digest): pieces(stream, offset, content) of both kinds in the order of their offsets."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "content"))), lambda p: p["content"]), "")
    return pieces.groupBy("stream").agg(joined.alias("content")).withColumn("digest", F.sha2("content", 256))


def checkpoints(blocks: DataFrame, span: int, group: str = "stream", order: str = "ord", at: str = "pos") -> DataFrame:
    """blocks with checkpoint: the first, and each more than span after the last checkpoint. It depends on the last one kept, so it is a fold, as an aggregate over a stream's sorted positions."""
    def step(acc, x):
        far = (x["pos"] - acc["last"]) > span
        first = F.size(acc["kept"]) == 0
        return F.struct(F.when(far | first, x["pos"]).otherwise(acc["last"]).alias("last"), F.when(far | first, F.concat(acc["kept"], F.array(x["ord"]))).otherwise(acc["kept"]).alias("kept"))

    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("ord"), F.col(at).cast("long").alias("pos"))))
    zero = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<long>").alias("kept"))
    kept = blocks.groupBy(F.col(group).alias("_g")).agg(F.aggregate(sorted_, zero, step)["kept"].alias("_k"))
    marks = kept.select("_g", F.explode("_k").alias("_o"), F.lit(True).alias("checkpoint"))
    return blocks.join(marks, (F.col(group) == F.col("_g")) & (F.col(order) == F.col("_o")), "left").withColumn("checkpoint", F.coalesce("checkpoint", F.lit(False))).drop("_g", "_o")


def spans(marks: DataFrame, group: str, at: str, total: str) -> DataFrame:
    """marks with until: where the next begins, or the stream's total."""
    return marks.withColumn("until", F.coalesce(F.lead(at).over(Window.partitionBy(group).orderBy(at)), F.col(total)))


def flush_order(entries: DataFrame) -> DataFrame:
    """entries(layer, ord, entry_type) with place: a layer's files first, the rest after them, each in order."""
    w = Window.partitionBy("layer").orderBy((F.col("entry_type") != "file"), "ord")
    return entries.withColumn("place", F.row_number().over(w) - 1)
