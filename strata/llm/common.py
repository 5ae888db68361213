"""What the operators of this subpackage share: scratch tables in the shared folder, and column checks."""

from __future__ import annotations

import ctypes
import os
import uuid
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    return path


def write_table(df: DataFrame, name: str) -> str:
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: this cuts the lineage and outlives lost executors."""
    path = write_table(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df and more fields."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def bound_batches(df: DataFrame, limit: str = "4m") -> DataFrame:
    """df, with batches that go to Python held to limit bytes for the rest of the session: 10,000 long texts in one batch would take more than a worker has."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)
    return df


def released(run):
    """run, for mapInArrow, with a worker that gives back what it has freed when run ends: workers stay for later tasks, several at a time."""

    def go(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # glibc alone has it
            ctypes.CDLL(None).malloc_trim(0)

    return go


def in_ids(df: DataFrame, ids: DataFrame, column: str, slots: int = 1 << 24) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose column isn't among ids(_id), rows where it may be), by a broadcast bitmap of the ids' hashes, of slots bits whatever their number."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(slots))
    bits = ids.select(place("_id").alias("_s")).groupBy(F.floor(F.col("_s") / 64).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_s % 64 as int))")).alias("_bits"))
    bits = materialise(bits, "bitmap")  # at most slots / 64 rows
    at = place(column)
    marked = df.withColumn("_at", F.floor(at / 64)).withColumn("_bit", (at % 64).cast("int")).join(F.broadcast(bits), F.col("_at") == F.col("_w"), "left")
    maybe = F.col(column).isNotNull() & F.coalesce(F.expr("getbit(_bits, _bit) = 1"), F.lit(False))
    return marked.where(~maybe).select(df.columns), marked.where(maybe).select(df.columns)


def without_ids(df: DataFrame, ids: DataFrame, column: str, slots: int = 1 << 24) -> DataFrame:
    """df without the rows whose column is among ids(_id). Rows without a value stay.

    Rows that the bitmap clears stay where they are, and only the rest, the rows that go and a few others, are shuffled to meet the ids. With many more ids than slots all rows are.
    """
    clear, rest = in_ids(df, ids, column, slots)
    return clear.unionByName(rest.join(ids, F.col(column) == F.col("_id"), "left_anti"))
