"""A training corpus from raw documents: quality, repeated lines, near duplicates, benchmark leaks, token ids.

Each stage takes what its predecessor kept and returns the columns of documents; the last returns token ids in
place of the text. Stages are written and read again between one another, so that each is planned on what there is and
a lost executor costs no more than a part of one stage.

Cases. Columns other than the five of documents are left behind. Empty tables pass through. Rows without doc_id are judged like others where a stage looks at texts alone; near-duplicate removal leaves
them alone, having no name for them. Rows that share a doc_id pass or go together, except that near-duplicate removal keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import common, decontam, linededup, minhash, quality, sentencepiece_scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.classify(docs.select(COLUMNS), common.table(spark, sf_dir, "labels")).where("predicted = 1").select(COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share; n_chars follows the text."""
    kept = linededup.dedup_lines(docs.select(COLUMNS)).withColumnRenamed("_kept_text", "text").withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (op6's ball hashing and MinHash on word shingles of five words, verified: Jaccard similarity 0.8 or more) the document with the smallest doc_id."""
    docs = docs.select(COLUMNS)
    groups = common.materialise(minhash.near_copies(docs.select("doc_id", "text")), "groups")
    go = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    kept = common.without_ids(docs, go, "doc_id")
    repeated = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs.select(COLUMNS), common.table(spark, sf_dir, "benchmark"), keep_text=True).where("not contaminated").select(COLUMNS)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids, each checked by decoding."""
    return sentencepiece_scan.encode(docs.select(COLUMNS))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", to_token_ids),
]

#: XXH64, the learned model and the merge encoding are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
