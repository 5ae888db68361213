"""Structure tests: expectations of an image's config and files, each with a verdict and why it failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import executable_by, mode_string, parse_mode

UNSUPPORTED = ("commandTests", "fileContentTests", "licenseTests")


def unsupported(spec: dict) -> list[str]:
    """Categories of a spec that have entries and can't be checked."""
    return [c for c in UNSUPPORTED if spec.get(c)]


def value_matches(want: Column, actual: Column, regex: Column) -> Column:
    """Equality, or an unanchored regular expression."""
    return F.when(regex, F.regexp_like(actual, want)).otherwise(actual == want)


def lists_equal(want: Column, actual: Column) -> Column:
    """Equal lists; a null list is an empty one."""
    none = F.array().cast("array<string>")
    return F.coalesce(want, none) == F.coalesce(actual, none)


def member(have: Column, aliases: Column) -> Column:
    """Whether any spelling is among the values."""
    return F.arrays_overlap(have, aliases)


def port_aliases(port: Column) -> Column:
    """A port without protocol is its TCP one, and the other way round."""
    return F.when(port.contains("/"), F.array(port, F.regexp_replace(port, "/tcp$", ""))).otherwise(F.array(port, F.concat(port, F.lit("/tcp"))))


def check_files(tests: DataFrame, entries: DataFrame) -> DataFrame:
    """tests(test_id, path, should_exist, permissions, uid, gid, executable_by) against entries(path, type, mode, uid, gid), as (test_id, passed, message): the first check that fails gives the message."""
    e = entries.select(F.col("path").alias("e_path"), F.col("type").alias("e_type"), parse_mode("mode").alias("e_mode"), F.col("uid").alias("e_uid"), F.col("gid").alias("e_gid"))
    j = tests.join(e, F.col("path") == F.col("e_path"), "left")
    there, shown = F.col("e_path").isNotNull(), mode_string(F.col("e_type"), F.col("e_mode"))
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    text = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    number = lambda c: c.cast("string")
    attributes = F.coalesce(
        F.when(F.col("permissions") != "", F.when(F.col("e_mode").isNull(), "no mode; cannot check permissions").when(shown != F.col("permissions"), text("permissions ", quote(shown), ", want ", quote(F.col("permissions"))))),
        F.when(F.col("uid").isNotNull(), F.when(F.col("e_uid").isNull(), "no uid").when(F.col("e_uid") != F.col("uid"), text("uid ", number(F.col("e_uid")), ", want ", number(F.col("uid"))))),
        F.when(F.col("gid").isNotNull(), F.when(F.col("e_gid").isNull(), "no gid").when(F.col("e_gid") != F.col("gid"), text("gid ", number(F.col("e_gid")), ", want ", number(F.col("gid"))))),
        F.when(F.col("executable_by") != "", F.when(F.col("e_mode").isNull(), "no mode; cannot check executable").when(~executable_by(F.col("e_mode"), F.col("executable_by")), text("not executable by ", quote(F.col("executable_by"))))),
        F.lit(""),
    )
    message = (
        F.when(~F.col("should_exist") & there, text(quote(F.col("path")), " exists"))
        .when(~F.col("should_exist"), "")
        .when(~there, text(quote(F.col("path")), " does not exist"))
        .otherwise(attributes)
    )
    return j.select("test_id", (message == "").alias("passed"), message.alias("message"))


def check_metadata(tests: DataFrame, config: DataFrame) -> DataFrame:
    """tests(test_id, image, kind, key, want, regex) against config(image, kind, key, value): env and label values; user and workdir as values without key."""
    c = config.select("image", "kind", F.col("key").alias("c_key"), "value")
    j = tests.join(c, (tests["image"] == c["image"]) & (tests["kind"] == c["kind"]) & F.col("key").eqNullSafe(F.col("c_key")), "left").select(tests["*"], "value")
    passed = F.coalesce(value_matches(F.col("want"), F.coalesce("value", F.when(F.col("key").isNull(), F.lit(""))), F.col("regex")), F.lit(False))
    return j.select("test_id", passed.alias("passed"))
