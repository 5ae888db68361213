"""Joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_spread(df: DataFrame, keyed: DataFrame, on: list[str], keys: list[str], count: str, by: list[str], how: str = "inner", least: int = 100) -> DataFrame:
    """df joined with keyed, which has a row for each value of keys and says in count how many rows of df have it. Null keys meet.

    Keys with over a thousandth of all rows (and over least) are dealt over as many tasks as there are shuffle partitions, by the columns by of df, and keyed's
    rows of these keys are repeated as often. There are at most a thousand such keys, so their list is broadcast; without any the join is a plain one. keyed is read
    more than once and should be stored.
    """
    same = lambda names: reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(on, names)))
    floor = max(least, (keyed.agg(F.sum(count)).first()[0] or 0) // 1000)
    hot = keyed.where(F.col(count) > floor)
    if hot.isEmpty():
        return df.join(keyed, same(keys), how)
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marks = [f"_hot{i}" for i in range(len(on))]
    listed = F.broadcast(hot.select(*[F.col(k).alias(m) for k, m in zip(keys, marks)], F.lit(True).alias("_hot")))
    salted = df.join(listed, same(marks), "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")).otherwise(0)).drop(*marks, "_hot")
    copies = F.when(F.col(count) > floor, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(keyed.withColumn("_copy", F.explode(copies)), same(keys) & (F.col("_salt") == F.col("_copy")), how).drop("_salt", "_copy")
