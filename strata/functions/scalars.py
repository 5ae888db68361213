"""Modes, sizes, image names, and what a registry request is about, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import _col

# Repository grammar, digest grammar, media types and status classes of the distribution protocol.
NAME = r"[a-z0-9]+(?:(?:\.|_|__|-+)[a-z0-9]+)*(?:/[a-z0-9]+(?:(?:\.|_|__|-+)[a-z0-9]+)*)*"
DIGEST = r"^[a-z0-9]+(?:[+._-][a-z0-9]+)*:[a-zA-Z0-9=_-]{32,128}$"
METHODS = ("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "CONNECT", "TRACE")
INDEX_TYPES = ("application/vnd.oci.image.index.v1+json", "application/vnd.docker.distribution.manifest.list.v2+json")
MANIFEST_TYPES = ("application/vnd.oci.image.manifest.v1+json", "application/vnd.docker.distribution.manifest.v2+json")
CONFIG_TYPES = ("", "application/vnd.oci.image.config.v1+json", "application/vnd.docker.container.image.v1+json")


def parse_mode(text) -> Column:
    """Octal mode, with or without 0o; null where there is none; anything else is an error."""
    t = F.regexp_replace(_col(text), "^0o", "")
    return F.when(t.isNull() | (t == ""), F.lit(None).cast("long")).when(t.rlike("^[0-7]+$"), F.conv(t, 8, 10).cast("long")).otherwise(F.raise_error(F.concat(F.lit("bad mode "), t)).cast("long"))


def _bit(mode: Column, bit: int) -> Column:
    return mode.bitwiseAND(F.lit(bit)) != 0


def mode_string(kind, mode) -> Column:
    """Mode as text, with a letter for each special kind: d L D p u g c t."""
    kind, mode = _col(kind), _col(mode).cast("long")
    on = lambda cond, letter: F.when(cond, letter).otherwise("")
    special = F.concat(
        on(kind == "dir", "d"), on(kind == "link", "L"), on(kind.isin("char", "block"), "D"), on(kind == "fifo", "p"), on(_bit(mode, 0o4000), "u"), on(_bit(mode, 0o2000), "g"), on(kind == "char", "c"), on(_bit(mode, 0o1000), "t")
    )
    rwx = F.concat(*[F.when(_bit(mode, 1 << (8 - i)), "rwx"[i % 3]).otherwise("-") for i in range(9)])
    return F.concat(F.when(special == "", "-").otherwise(special), rwx)


def executable_by(mode, who) -> Column:
    mode, who = _col(mode).cast("long"), F.lower(_col(who))
    return F.when(who == "owner", _bit(mode, 0o100)).when(who == "group", _bit(mode, 0o010)).when(who == "other", _bit(mode, 0o001)).when(who == "any", _bit(mode, 0o111)).otherwise(F.lit(False))


def humanize_bytes(n, largest: str = "PiB") -> Column:
    """'512 B', '1.5 KiB' and so on; ties round to the even digit. Sizes beyond the largest unit are shown in it."""
    n = _col(n).cast("long")
    units = ("KiB", "MiB", "GiB", "TiB", "PiB")
    top = units.index(largest) + 1
    shown = lambda power: F.format_string(f"%.1f {units[power - 1]}", F.bround(n / F.lit(float(1 << 10 * power)), 1))
    out = shown(top)
    for power in range(top - 1, 0, -1):
        out = F.when(n < 1 << 10 * (power + 1), shown(power)).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n)).otherwise(out)


def parse_byte_size(text) -> Column:
    """Bytes of '10 MiB', '1.5g', '200'; an unknown unit or a negative size is an error."""
    t = _col(text)
    digits = F.regexp_extract(t, r"^(.*?)[kKmMgGtTiIbB \t]*$", 1)
    unit = F.lower(F.btrim(F.substring(t, F.char_length(digits) + 1, F.char_length(t)), F.lit(" \t")))
    factor = F.when(unit.isin("", "b"), 1)
    for power, letter in enumerate("kmgt", 1):
        factor = factor.when(unit.isin(letter, f"{letter}b", f"{letter}ib"), 1 << 10 * power)
    factor = factor.otherwise(F.raise_error(F.concat(F.lit("unknown unit "), unit)).cast("long"))
    value = F.btrim(digits).cast("double")
    return F.when(value < 0, F.raise_error(F.lit("negative size")).cast("long")).otherwise((value * factor.cast("long")).cast("long"))


def timestamp_or_null(text) -> Column:
    """RFC 3339 time of trimmed text; blank is null, anything else an error."""
    t = F.btrim(_col(text))
    return F.when(t != "", t.cast("timestamp"))


def retry_after(value, now) -> Column:
    """Seconds to wait: a number of seconds, or an HTTP date after now; null for neither."""
    v = F.btrim(_col(value))
    secs = F.when(v.rlike("^[0-9]+$"), v.try_cast("long"))
    at = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(v, "^[A-Za-z]{3}, ", ""), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.unix_timestamp(at) - F.unix_timestamp(_col(now))
    return F.coalesce(secs, F.when(wait >= 0, wait))


# ---- names -----------------------------------------------------------------------------------------------------


def normalize_registry(registry) -> Column:
    """One name for a registry that has several; an omitted one means the same; what is no registry name stays."""
    r = _col(registry)
    return F.when(r.isin("", "docker.io", "index.docker.io"), "index.docker.io").otherwise(r)


def qualify_tags(registry, repository, tags) -> Column:
    """registry/repository:tag for each tag when both are given, else the tags as they are."""
    g, p, t = _col(registry), _col(repository), _col(tags)
    return F.when((g == "") | (p == ""), t).otherwise(F.transform(t, lambda x: F.concat(g, F.lit("/"), p, F.lit(":"), x)))


def normalize_reference(ref) -> Column:
    """Reference with ':latest' where it has neither tag nor digest; an unusable one is an error."""
    r = _col(ref)
    last = F.substring_index(r, "/", -1)
    good = r.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/:-]*(@[a-z0-9+._-]+:[A-Za-z0-9=_-]{32,})?$") & ~r.endswith("/") & ~r.endswith(":")
    return F.when(~good, F.raise_error(F.concat(F.lit("invalid image reference "), r))).when(r.contains("@") | last.contains(":"), r).otherwise(F.concat(r, F.lit(":latest")))


def is_config_type(media_type) -> Column:
    return _col(media_type).isin(*CONFIG_TYPES)


def type_kind(media_type) -> Column:
    m = _col(media_type)
    return F.when(m.isin(*INDEX_TYPES), "index").when(m.isin(*MANIFEST_TYPES), "manifest").otherwise("other")


def manifest_kind(content_type, body) -> Column:
    """Kind of a manifest: what its own media type says, else its shape, else the header."""
    b = _col(body)
    own = type_kind(F.coalesce(F.get_json_object(b, "$.mediaType"), F.lit("")))
    has = lambda k: F.coalesce(F.get_json_object(b, f"$.{k}"), F.lit("null")) != "null"
    return F.when(own != "other", own).when(has("manifests"), "index").when(has("config") | has("layers"), "manifest").otherwise(type_kind(content_type))


# ---- requests --------------------------------------------------------------------------------------------------


def existence_result(status) -> Column:
    s = _col(status)
    return F.when((s >= 200) & (s < 300), "hit").when(s == 404, "miss").otherwise("error")


def status_error(status) -> Column:
    """Class of a failed response; '' for success and for 404, which is an answer."""
    s = _col(status)
    return F.when((s < 400) | (s == 404), "").when(s == 401, "upstream_unauthorized").when(s == 403, "upstream_forbidden").when(s == 429, "upstream_rate_limited").when(s >= 500, "upstream_server_error").otherwise("upstream_client_error")


def normalize_method(method) -> Column:
    return F.when(_col(method).isin(*METHODS), _col(method)).otherwise("_OTHER")


def protocol_version(proto) -> Column:
    v = F.regexp_replace(_col(proto), "^HTTP/", "")
    return F.when(v == "2.0", "2").when(v == "", "unknown").otherwise(v)


def absent(status) -> Column:
    """Whether a manifest counts as absent, by the status of its probe: true, false, or null for a failure of the probe itself."""
    s = _col(status)
    return F.when(s.isin(401, 403, 404), True).when((s >= 200) & (s < 300), False)


def _query(query: Column, key: str) -> Column:
    """All values of a key of a query string."""
    return F.transform(F.filter(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1) == key), lambda p: F.regexp_extract(p, "^[^=]*=?(.*)$", 1))


def classify_request(method, path, query) -> Column:
    """(kind, op, requirement, repo, digest, write) of a request; null fields but op = 'unknown' for a path of no known form."""
    m, p, q = _col(method), _col(path), F.coalesce(_col(query), F.lit(""))
    none = F.lit("")

    def made(kind: str, op, need, repo: Column, write, digest: Column = none) -> Column:
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), lit(op).alias("op"), lit(need).alias("requirement"), repo.alias("repo"), digest.alias("digest"), lit(write).alias("write"))

    form = lambda tail: f"^/v2/({NAME}){tail}$"
    tags, refs, up, blob, man = form("/tags/list"), form("/referrers/(.+)"), form("/blobs/uploads/?(.*)"), form("/blobs/([^/]+)"), form("/manifests/(.+)")
    repo = lambda rx: F.regexp_extract(p, rx, 1)
    ref = F.regexp_extract(p, blob, 2)
    own = F.when(ref.rlike(DIGEST), ref).otherwise("")
    mount, source, digest = _query(q, "mount"), _query(q, "from"), _query(q, "digest")
    torn = q.contains(";") | ((m == "POST") & ((F.size(mount) > 1) | (F.size(source) > 1)))
    named = F.when((m == "POST") & (F.size(mount) == 1) & (F.size(source) == 1) & (F.size(digest) == 0), F.try_element_at(mount, F.lit(1))).when((F.size(digest) == 1) & (F.size(mount) == 0), F.try_element_at(digest, F.lit(1)))
    done = F.when(m.isin("POST", "PUT") & ~torn & named.rlike(DIGEST), named).otherwise("")
    by = lambda get, head, delete, rest: F.when(m == "GET", get).when(m == "HEAD", head).when(m == "DELETE", delete).otherwise(rest)
    return (
        F.when(p.rlike(tags), made("tag listing", "tags.list", "manifest.read", repo(tags), False))
        .when(p.rlike(refs), made("referrers query", "referrers.read", "manifest.read", repo(refs), False))
        .when(p.rlike(up), made("blob upload", "blob.upload", "blob.write", repo(up), True, done))
        .when(p.rlike(blob), made(by("blob read", "blob existence check", "blob write", "blob write"), by("blob.read", "blob.head", "blob.write", "blob.write"), by("blob.read", "blob.read_or_write", "blob.write", "blob.write"), repo(blob), ~m.isin("GET", "HEAD"), F.when(m.isin("GET", "HEAD", "DELETE"), own).otherwise("")))
        .when(p.rlike(man), made(by("manifest read", "manifest existence check", "manifest write", "manifest write"), by("manifest.read", "manifest.head", "manifest.write", "manifest.write"), by("manifest.read", "manifest.read_or_write", "manifest.write", "manifest.write"), repo(man), ~m.isin("GET", "HEAD")))
        .otherwise(made("", "unknown", "", none, False))
    )


def cache_admits(op, status, request_digest, response_digest) -> Column:
    """Whether a response proves that a blob exists: a HEAD with 200, a read with 200 that names the asked digest, an upload with 201 that names it or none."""
    op, status, asked, got = (_col(c) for c in (op, status, request_digest, response_digest))
    upload = (op == "blob.upload") & (status == 201) & ((got == asked) | (got == ""))
    return (asked != "") & (((op == "blob.head") & (status == 200)) | ((op == "blob.read") & (status == 200) & (got == asked)) | upload)


def cache_removes(op, status, request_digest) -> Column:
    """(forgotten here, told to others) of a request: any blob delete is forgotten, a successful one is told."""
    gone = (_col(op) == "blob.write") & (_col(request_digest) != "")
    return F.struct(gone.alias("forget"), (gone & F.coalesce(_col(status).isin(200, 202, 204), F.lit(False))).alias("tell"))


def uploaded_length(method, mount_from, content_length) -> Column:
    """Size of an uploaded blob where one request carries all of it, else -1."""
    whole = (_col(method) == "POST") & (_col(mount_from) == "") & (_col(content_length) >= 0)
    return F.when(whole, _col(content_length).cast("long")).otherwise(F.lit(-1).cast("long"))
