"""A table with everything that operators have to cope with."""

from pyspark.sql import SparkSession

LONG = "lorem " * 40_000
RUN = "abcdefgh" * 12_000
SHARED = "A line of text that several of the documents share"
ROWS = [
    (1, "Hello world, this is the first document.\n" + SHARED + "\nAnd its last line is here.", "en", "a", 10),
    (1, "Hello world, this is the first document.\n" + SHARED + "\nAnd its last line is here.", "en", "a", 10),
    (2, None, "en", "a", 0),
    (3, "", None, None, None),
    (4, " \t\n\r\n ", "de", "b", 5),
    (None, "A row without an id\n" + SHARED, "en", "a", 3),
    (None, None, None, None, None),
    (5, LONG, "en", "a", 240_000),
    (6, RUN, "fr", "c", 96_000),
    (7, "Ünïcödé 漢字 😀 text\x00 with ﻿ odd characters\n  " + SHARED.upper() + " \t", "fr", "c", 30),
    (8, "12345 67.8 !!! ...", "de", "c", 18),
    (9, SHARED, "en", "c", 50),
    (-3, "negative id\n" + SHARED, "en", "c", 50),
    (2**62, "a", "de", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "held_out string, score string, predicted string, key string, component_id string, fp string, n_tokens string, id string, _of string, _gone string, record string, text_key string, k string, m string, y string, x string"


def documents(spark: SparkSession, rows=ROWS, clashing: bool = True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *[f"cast('other' as {c.split()[1]}) as {c.split()[0]}" for c in CLASHING.split(", ")]) if clashing else df


def empty(spark: SparkSession, clashing: bool = True):
    return documents(spark, [], clashing)
