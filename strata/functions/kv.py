"""Key/value lists: OCI-style arrays of 'KEY=VALUE', files of them in three notations, and their template functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import _col


def _strip(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\r\n\x0b\x0c"))


def items(text) -> Column:
    """Entries of a text or of a JSON array of strings, trimmed, without empty ones; in a text, without comments."""
    t = _strip(F.regexp_replace(_col(text), "^﻿", ""))
    array = F.filter(F.transform(F.from_json(t, "array<string>"), _strip), lambda x: x != "")
    lines = F.filter(F.transform(F.split(t, "\n"), _strip), lambda x: (x != "") & ~x.startswith("#"))
    return F.when(t.startswith("["), array).otherwise(lines)


def kind(entries) -> Column:
    """'empty', 'kv', 'list', or 'mixed', which is an error."""
    e = _col(entries)
    has = lambda x: x.contains("=")
    return F.when(F.size(e) == 0, "empty").when(F.forall(e, has), "kv").when(F.exists(e, has), "mixed").otherwise("list")


def pairs(entries) -> Column:
    """Entries as (key, value) in order; an entry without a key is an error."""
    split = lambda x: F.struct(_strip(F.substring_index(x, "=", 1)).alias("key"), _strip(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("value"))
    e = F.transform(_col(entries), split)
    return F.when(F.exists(e, lambda x: x["key"] == ""), F.raise_error(F.lit("empty key"))).otherwise(e)


def object_pairs(text) -> Column:
    """(key, value) pairs of a JSON object whose values are strings or arrays of strings, by key."""
    t = _strip(F.regexp_replace(_col(text), "^﻿", ""))
    raw = F.map_entries(F.from_json(t, "map<string,string>"))
    as_list = lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v))
    return F.flatten(F.transform(F.array_sort(raw), lambda e: F.transform(as_list(e["value"]), lambda v: F.struct(e["key"].alias("key"), v.alias("value")))))


def flatten(key_values) -> Column:
    """Map of the last value of each key. Keys with no value have no pair and so no entry."""
    p = _col(key_values)
    keys = F.array_distinct(F.transform(p, lambda x: x["key"]))
    last = lambda k: F.element_at(F.filter(p, lambda x: x["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def to_env(key_values) -> Column:
    """Sorted 'KEY=VALUE' entries, the last value of each key."""
    return F.transform(F.array_sort(F.map_entries(flatten(key_values))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))


def getkv(entries, key) -> Column:
    """Value of the first entry that starts with 'key=', '' if there is none."""
    prefix = F.concat(_col(key), F.lit("="))
    first = F.try_element_at(F.filter(_col(entries), lambda x: x.startswith(prefix)), F.lit(1))
    return F.coalesce(F.substring(first, F.char_length(prefix) + 1, F.char_length(first)), F.lit(""))


def appendkv(entries, key, suffix) -> Column:
    return F.concat(getkv(entries, key), _col(suffix))


def prependkv(entries, key, prefix) -> Column:
    return F.concat(_col(prefix), getkv(entries, key))


def trim_prefix(value, prefix) -> Column:
    v, p = _col(value), _col(prefix)
    return F.when(v.startswith(p), F.substring(v, F.char_length(p) + 1, F.char_length(v))).otherwise(v)


def trim_suffix(value, suffix) -> Column:
    v, s = _col(value), _col(suffix)
    return F.when(v.endswith(s), F.substring(v, F.lit(1), F.char_length(v) - F.char_length(s))).otherwise(v)


def _time(seconds: Column) -> Column:
    """Years beyond 9999 are written without the sign that date_format puts before them."""
    return F.ltrim(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("+"))


def rfc3339(seconds) -> Column:
    """UTC time of Unix seconds (a number or its text), '' for blank or null; other text is an error."""
    t = F.btrim(_col(seconds).cast("string"))
    return F.when(t.isNull() | (t == ""), "").otherwise(_time(t.cast("long")))


def lenient_rfc3339(seconds) -> Column:
    """As rfc3339, with '' for text that is no number."""
    n = F.btrim(_col(seconds).cast("string")).try_cast("long")
    return F.coalesce(_time(n), F.lit(""))


def override_or(value, override) -> Column:
    return F.coalesce(F.nullif(_col(override), F.lit("")), _col(value))


def merge_maps(lower, upper) -> Column:
    """Both maps' entries, upper's value where both have a key; null maps are empty."""
    low, up = _col(lower), _col(upper)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    low, up = F.coalesce(low, none), F.coalesce(up, none)
    return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(up, k)), up)


def unquote(value) -> Column:
    """Value without one pair of equal quotes around it."""
    v = _col(value)
    return F.when((F.char_length(v) >= 2) & v.rlike("(?s)^(\".*\"|'.*')$"), F.substring(v, F.lit(2), F.char_length(v) - 2)).otherwise(v)


def functions() -> dict:
    """The template functions by name, for expressions built from templates."""
    return {
        "getkv": getkv, "appendkv": appendkv, "prependkv": prependkv, "split": lambda v, sep: F.split_part(_col(v), _col(sep), F.lit(1)), "join": lambda v, sep: F.array_join(_col(v), sep),
        "hasprefix": lambda v, p: _col(v).startswith(_col(p)), "hassuffix": lambda v, s: _col(v).endswith(_col(s)), "trimprefix": trim_prefix, "trimsuffix": trim_suffix, "rfc3339": rfc3339,
    }
