"""Slash-separated paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _none() -> Column:
    return F.array().cast("array<string>")


def segments(path) -> Column:
    """The path's names, without empty ones and single dots, with each '..' taking the name before it away."""
    path = _col(path)
    rooted = path.startswith("/")

    def step(done: Column, name: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        return (
            F.when((name == "..") & (F.size(done) > 0) & (last != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when((name == "..") & rooted, done)
            .otherwise(F.concat(done, F.array(name)))
        )

    return F.aggregate(F.filter(F.split(path, "/"), lambda x: (x != "") & (x != ".")), _none(), step)


def clean(path) -> Column:
    """Lexically shortest equal path; '.' for an empty one, '/' for the root."""
    path = _col(path)
    body = F.array_join(segments(path), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), body)).when(body == "", ".").otherwise(body)


def entry_path(path) -> Column:
    """Canonical path of an archive entry: no trailing slash, no leading './'."""
    return clean(F.regexp_replace(_col(path), "/$", ""))


def base_path(path) -> Column:
    """Path without slashes at either end."""
    return F.btrim(_col(path), F.lit("/"))


def test_path(path) -> Column:
    """Canonical path of an assertion: absolute and './' forms mean the same entry, the root is '.'."""
    p = F.regexp_replace(F.regexp_replace(_col(path), r"^\./", ""), "^/", "")
    p = clean(F.regexp_replace(p, "/$", ""))
    return F.when(p == "/", ".").otherwise(p)


def base_name(path) -> Column:
    p = F.regexp_replace(_col(path), "/+$", "")
    return F.when(_col(path) == "", ".").when(p == "", "/").otherwise(F.element_at(F.split(p, "/"), -1))


def dir_name(path) -> Column:
    return clean(F.regexp_extract(_col(path), "^(.*/)?[^/]*$", 1))


def join(*parts) -> Column:
    """Non-empty parts with slashes between them, cleaned; '' if all are empty."""
    body = F.array_join(F.filter(F.array(*[_col(p) for p in parts]), lambda x: x != ""), "/")
    return F.when(body == "", "").otherwise(clean(body))


def ancestors(path) -> Column:
    """Strict ancestors of a canonical relative path, outermost first."""
    names = F.split(_col(path), "/")
    return F.when(F.size(names) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(names) - 1, F.lit(1))), lambda n: F.array_join(F.slice(names, F.lit(1), n), "/"))).otherwise(_none())


def relative(target, base) -> Column:
    """target as seen from base, both relative paths of one namespace."""
    t, b = (F.filter(F.split(_col(p), "/"), lambda x: (x != "") & (x != ".")) for p in (target, base))
    longest = F.least(F.size(t), F.size(b))
    same = F.aggregate(
        F.when(longest > 0, F.sequence(F.lit(1), F.greatest(longest, F.lit(1)))).otherwise(F.array().cast("array<int>")),
        F.lit(0),
        lambda n, i: F.when((n == i - 1) & (F.try_element_at(t, i) == F.try_element_at(b, i)), i).otherwise(n),
    )
    out = F.concat(F.array_repeat(F.lit(".."), F.size(b) - same), F.slice(t, same + 1, F.greatest(F.size(t) - same, F.lit(0))))
    return F.when(F.size(out) == 0, ".").otherwise(F.array_join(out, "/"))


def symlink_target(target, link) -> Column:
    """Target of a symlink relative to the link's folder. A link in the root keeps its target; so, too, where one path is a beginning of the other, nothing common is removed."""
    target, link = _col(target), _col(link)
    folder = dir_name(link)
    s, t = F.split(folder, "/"), F.split(clean(target), "/")
    longest = F.least(F.size(s), F.size(t))
    differs = F.try_element_at(F.filter(F.sequence(F.lit(1), longest), lambda i: F.try_element_at(s, i) != F.try_element_at(t, i)), F.lit(1))
    cut = F.coalesce(differs - 1, F.lit(0))
    up, down = F.array_repeat(F.lit(".."), F.size(s) - cut), F.slice(t, cut + 1, F.greatest(F.size(t) - cut, F.lit(0)))
    return F.when(folder == ".", target).otherwise(F.array_join(F.concat(up, down), "/"))


def place(short_path, mode, dest, anchor, count) -> Column:
    """Path in the image of a file of a placement: one file of a collapsing mode goes to dest itself, or into it if dest ends in a slash."""
    short_path, mode, count = _col(short_path), _col(mode), _col(count)
    dest = F.regexp_replace(_col(dest), "^/", "")
    rel = join(dest, relative(short_path, anchor))
    collapse = (count == 1) & mode.isin("package_relative", "flatten")
    climbs = (rel == "..") | rel.startswith("../")
    return (
        F.when(collapse & dest.endswith("/"), join(dest, base_name(short_path)))
        .when(collapse, dest)
        .when(mode == "flatten", join(dest, base_name(short_path)))
        .when(climbs, F.raise_error(F.concat(F.lit("placed above the image root: "), rel)))
        .otherwise(rel)
    )
