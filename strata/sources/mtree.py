"""mtree specs: parsed to rows of path and keywords, and rendered from entries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import entry_path

KEYWORDS = ("type", "size", "mode", "uid", "gid", "uname", "gname", "sha256", "time", "link", "nlink", "xattr")
_ESCAPED = " \t\n\r\\#*?["


# What a letter after a backslash stands for.
_LETTERS = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, "s": 32, "E": 27, "0": 0}


def unvis(c: Column) -> Column:
    """Escapes back to what they stand for: octal bytes, letters, control (\\^x) and meta (\\M-x, \\M^x) characters, nothing (\\$); bytes together are UTF-8."""
    tokens = F.regexp_extract_all(c, F.lit(r"\\[0-3][0-7][0-7]|\\M-.|\\M\^.|\\\^.|\\.|[^\\]+|\\"), F.lit(0))
    byte = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0"))
    code = lambda t, at: F.ascii(F.substring(t, at, 1))
    control = lambda x: F.when(x == ord("?"), F.lit(127)).otherwise(x.bitwiseAND(31))
    letter = F.create_map(*[F.lit(x) for kv in _LETTERS.items() for x in kv])

    def one(t):
        rest = F.substring(t, 2, 9)
        return (
            F.when(~t.startswith("\\"), F.encode(t, "UTF-8"))
            .when(t.rlike(r"^\\[0-3][0-7][0-7]$"), byte(F.conv(rest, 8, 10)))
            .when(t.rlike(r"^\\M-"), byte(code(t, 4).bitwiseOR(128)))
            .when(t.rlike(r"^\\M\^"), byte(control(code(t, 4)).bitwiseOR(128)))
            .when(t.rlike(r"^\\\^."), byte(control(code(t, 3))))
            .when(rest == "$", F.lit(b""))
            .when(F.map_contains_key(letter, rest), byte(letter[rest]))
            .otherwise(F.encode(F.when(rest == "", t).otherwise(rest), "UTF-8"))
        )

    joined = F.aggregate(tokens, F.lit(b""), lambda x, t: F.concat(x, one(t)))
    return F.when(F.contains(c, F.lit("\\")), joined.cast("string")).otherwise(c)


def vis(c: Column) -> Column:
    """Blanks, backslashes and the characters of patterns as octal escapes."""
    out = F.replace(c, F.lit("\\"), F.lit("\\134"))
    for x in _ESCAPED.replace("\\", ""):
        out = F.replace(out, F.lit(x), F.lit(f"\\{ord(x):03o}"))
    return out


def _keywords(words: Column) -> Column:
    pair = lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.regexp_extract(w, "^[^=]*=?(.*)$", 1).alias("v"))
    return F.map_from_entries(F.transform(words, pair))


def parse(lines: DataFrame) -> DataFrame:
    """(path, keywords) of the lines of specs in which every line stands for itself, as render makes them: comments, blank lines and the root don't count.

    Settings, '..' and names without a slash depend on the lines before them; these end the job, and parse_specs reads them.
    """
    t = lines.where((F.btrim("value") != "") & ~F.col("value").rlike("^\\s*#"))
    words = F.split(F.btrim("value"), r"\s+")
    name = F.element_at(words, 1)
    own = F.contains(name, F.lit("/")) & ~name.rlike("^/(un)?set$") | (name == ".")
    name = F.when(own, name).otherwise(F.raise_error(F.concat(F.lit("depends on the lines before it: "), F.col("value"))))
    return t.select(*[c for c in lines.columns if c != "value"], entry_path(unvis(name)).alias("path"), _keywords(F.slice(words, F.lit(2), F.size(words))).alias("keywords")).where("path <> '.'")


def _entries(text: str):
    """(full name, keywords) of a spec's entries, in order. A name without a slash is in the current folder, and a folder of such a name becomes it; '..' leaves it."""
    lines, defaults, here, joined = text.split("\n"), {}, [], ""
    for line in lines:
        line = joined + line.rstrip("\r")
        if line.endswith("\\") and not line.lstrip().startswith("#"):
            joined = line[:-1] + " "
            continue
        joined, words = "", line.split()
        if not words or words[0].startswith("#"):
            continue
        given = {k: v for k, _, v in (w.partition("=") for w in words[1:])}
        if words[0] == "/set":
            defaults |= given
        elif words[0] == "/unset":
            defaults = {} if "all" in given else {k: v for k, v in defaults.items() if k not in given}
        elif words[0] == "..":
            here = here[:-1]
        else:
            keywords, full = defaults | given, "/" in words[0]
            yield words[0] if full else "/".join([*here, words[0]]), keywords
            if not full and keywords.get("type") == "dir":
                here = [*here, words[0]]


def parse_specs(specs: DataFrame) -> DataFrame:
    """(spec, ord, path, keywords) of specs(spec, content), each a whole spec: lines depend on those before them, so a spec is read by one task."""
    kind = specs.schema["spec"].dataType

    def run(batches):
        for b in batches:
            for spec, text in zip(b.column(0), b.column(1).to_pylist()):
                rows = list(_entries(text or ""))
                yield pa.record_batch([pa.array([spec.as_py()] * len(rows), b.column(0).type), pa.array(range(len(rows)), pa.int64()), pa.array([p for p, _ in rows], pa.string()), pa.array([list(k.items()) for _, k in rows], pa.map_(pa.string(), pa.string()))], names=["spec", "ord", "name", "keywords"])

    rows = specs.select("spec", F.col("content").cast("string").alias("content")).mapInArrow(run, f"spec {kind.simpleString()}, ord long, name string, keywords map<string,string>")
    return rows.select("spec", "ord", entry_path(unvis(F.col("name"))).alias("path"), "keywords").where("path <> '.'")


def keep(keywords: Column, options: list[str]) -> Column:
    """'k=v' items of the keywords asked for, in the order asked; xattr stands for all attributes, by name."""
    one = lambda o: F.when(F.map_contains_key(keywords, o), F.array(F.concat(F.lit(f"{o}="), F.element_at(keywords, o)))).otherwise(F.array().cast("array<string>"))
    attributes = F.transform(F.array_sort(F.map_entries(F.map_filter(keywords, lambda k, _: k.startswith("xattr.")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(*[attributes if o == "xattr" else one("sha256digest" if o == "sha256" else o) for o in options])


def entry_type(flag: Column) -> Column:
    """Type keyword of a tar type flag."""
    return F.when(flag == "5", "dir").when(flag == "2", "link").when(flag == "3", "char").when(flag == "4", "block").when(flag == "6", "fifo").otherwise("file")


def xattrs(pax: Column) -> Column:
    """Sorted 'xattr.name=base64' items of extended attributes among PAX records."""
    prefix = "SCHILY.xattr."
    own = F.array_sort(F.map_entries(F.map_filter(pax, lambda k, _: k.startswith(prefix))))
    return F.transform(own, lambda e: F.concat(F.lit("xattr."), F.replace(e["key"], F.lit(prefix), F.lit("")), F.lit("="), F.base64(e["value"].cast("binary"))))


def items(e: DataFrame, options: list[str]) -> DataFrame:
    """entries(type, size, mode, uid, gid, uname, gname, digest, mtime, linkname, nlink) with items, the keywords asked for: no size for folders, no names that are empty, a link for links only."""
    none = F.lit(None).cast("string")
    text = lambda k, c: F.concat(F.lit(f"{k}="), F.col(c).cast("string"))
    made = {
        "type": text("type", "type"), "size": F.when(F.col("type") == "link", F.concat(F.lit("size="), F.octet_length("linkname").cast("string"))).when(F.col("type") != "dir", text("size", "size")),
        "mode": F.concat(F.lit("mode=0"), F.conv(F.col("mode").cast("string"), 10, 8)), "uid": text("uid", "uid"), "gid": text("gid", "gid"), "uname": F.when(F.col("uname") != "", text("uname", "uname")), "gname": F.when(F.col("gname") != "", text("gname", "gname")),
        "sha256": F.when(F.col("digest") != "", text("sha256digest", "digest")), "time": text("time", "mtime"), "link": F.when((F.col("type") == "link") & (F.col("linkname") != ""), F.concat(F.lit("link="), vis(F.col("linkname")))), "nlink": text("nlink", "nlink"), "xattr": none,
    }
    return e.withColumn("items", F.filter(F.array(*[made[o] for o in options]), lambda x: x.isNotNull()))


def render(e: DataFrame, options: list[str]) -> DataFrame:
    """Spec lines of entries, sorted by path: './path/' for folders, './path' for others, and their keywords."""
    path = F.concat(F.lit("./"), vis(F.col("path")), F.when(F.col("type") == "dir", "/").otherwise(""))
    return items(e, options).orderBy("path").select(F.concat_ws(" ", path, F.array_join("items", " ")).alias("value"))


def write(e: DataFrame, options: list[str], path: str) -> None:
    """The spec as text files whose names are in path order; the header line says what it is."""
    head = e.sparkSession.createDataFrame([("#mtree v2.0",)], "value string")
    head.coalesce(1).write.mode("append").text(f"{path}/0-head")
    render(e, options).write.mode("append").text(f"{path}/1-entries")
