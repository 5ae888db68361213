"""Session settings that the operators rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: For clusters: runtime re-planning with skewed joins split, Go-like overwriting of map keys, UTC.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(master: str | None = None, shuffle_partitions: int | None = None):
    """A session builder with these settings. Without a master the one of spark-submit counts; shuffle partitions should hold some 100 MB each."""
    b = SparkSession.builder.config(map=SETTINGS)
    if master:
        b = b.master(master)
    return b.config("spark.sql.shuffle.partitions", shuffle_partitions) if shuffle_partitions else b


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the folder of spark.checkpoint.dir, which all executors share; one in the warehouse where that is unset."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(base)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path
