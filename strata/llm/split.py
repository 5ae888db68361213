"""The split of documents into those that models learn from and those held out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of doc_id as text, modulo parts, is part. Rows without a doc_id are held out: nothing is learned from them."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % parts == part, F.lit(True))
