"""Set operations over tables and arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, repeats kept."""
    return reduce(DataFrame.unionByName, tables)


def marked(df: DataFrame, members: DataFrame, on: list[str], name: str) -> DataFrame:
    """df with a flag: whether members has the key."""
    m = members.select(*[F.col(c).alias(f"_{c}") for c in on]).distinct().withColumn("_in", F.lit(True))
    return df.join(m, [F.col(c) == F.col(f"_{c}") for c in on], "left").select(*df.columns, F.coalesce("_in", F.lit(False)).alias(name))


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that comes first."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_f")).select(*keys, "_f.*")


def sorted_distinct(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def ordered_distinct(items: Column) -> Column:
    """Distinct non-empty items in the order they first come."""
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))
