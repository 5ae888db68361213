"""Operators against plain versions on small tables, and what they refuse."""

import io
import posixpath
import random
import re
import tarfile

import pytest
from pyspark.sql import functions as F

from strata.functions import kv, paths, scalars
from strata.operators import asserts, cache, dedup, graph, images, lookups, metrics, overlay, policy, streams
from strata.plans import push
from strata.sources import archives, layouts, mtree, params


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# ---- functions -------------------------------------------------------------------------------------------------


def test_clean_like_the_library(spark):
    rng = random.Random(1)
    samples = ["", "/", ".", "..", "/..", "a/../..", "../a", "//a//b/", "./.", "a/./b"] + ["/".join(rng.choices(["a", "b", "..", ".", ""], k=rng.randint(1, 7))) for _ in range(200)]
    df = spark.createDataFrame([(s,) for s in samples], "p string")
    for r in df.select("p", paths.clean("p").alias("c")).collect():
        want = posixpath.normpath(r["p"]) if r["p"] else "."
        assert r["c"] == (want[1:] if want.startswith("//") else want), r["p"]


def test_relative_paths(spark):
    cases = [("a/b", "a", "b"), ("a/b", "a/c", "../b"), ("x", "a/b", "../../x"), ("a", "a", "."), ("", "a", "..")]
    for t, b, want in cases:
        assert one(spark, paths.relative(F.lit(t), F.lit(b)))[0] == want
    links = [("usr/lib/x", "usr/bin/y", "../lib/x"), ("a/b", "link", "a/b"), ("x/y", "a/b/l", "../../x/y"), ("a/b/c", "a/b/l", "../../a/b/c")]
    for t, link, want in links:
        assert one(spark, paths.symlink_target(F.lit(t), F.lit(link)))[0] == want, (t, link)


def test_placement(spark):
    place = lambda *a: one(spark, paths.place(*[F.lit(x) for x in a]))[0]
    assert place("pkg/a/b", "relative", "/opt", "pkg", 3) == "opt/a/b"
    assert place("pkg/a/b", "flatten", "/opt", "pkg", 3) == "opt/b"
    assert place("pkg/a/b", "package_relative", "/opt/f", "pkg", 1) == "opt/f" and place("pkg/a/b", "package_relative", "/opt/", "pkg", 1) == "opt/b"
    assert place("lib/x", "relative", "/opt", "pkg", 2) == "lib/x"
    with pytest.raises(Exception, match="image root"):
        place("lib/x", "relative", "", "pkg", 2)


def test_modes_and_sizes(spark):
    s = lambda kind, m: one(spark, scalars.mode_string(F.lit(kind), F.lit(m)))[0]
    assert [s("file", 0o755), s("dir", 0o1777), s("link", 0o777), s("file", 0o4711), s("char", 0o600)] == ["-rwxr-xr-x", "dtrwxrwxrwx", "Lrwxrwxrwx", "urwx--x--x", "Dcrw-------"]
    h = lambda n: one(spark, scalars.humanize_bytes(F.lit(n)))[0]
    assert [h(0), h(1023), h(1536), h(5 << 30), h(3 << 50), h(435456)] == ["0 B", "1023 B", "1.5 KiB", "5.0 GiB", "3.0 PiB", "425.2 KiB"]
    p = lambda x: one(spark, scalars.parse_byte_size(F.lit(x)))[0]
    assert [p("10"), p("1.5 KiB"), p("2m"), p("3 GB"), p("7B")] == [10, 1536, 2 << 20, 3 << 30, 7]
    for bad in ("0o9", "x"):
        with pytest.raises(Exception, match="bad mode"):
            one(spark, scalars.parse_mode(F.lit(bad)))
    with pytest.raises(Exception, match="negative"):
        p("-1k")


def test_references(spark):
    n = lambda x: one(spark, scalars.normalize_reference(F.lit(x)))[0]
    digest = "@sha256:" + "a" * 64
    assert [n("app"), n("app:v1"), n("host:5000/app"), n("host:5000/a/b:x"), n("app" + digest)] == ["app:latest", "app:v1", "host:5000/app:latest", "host:5000/a/b:x", "app" + digest]
    for bad in ("", "a b", "app:"):
        with pytest.raises(Exception, match="invalid image reference"):
            n(bad)


def test_requests(spark):
    d = "sha256:" + "0" * 64
    c = lambda m, p, q="": one(spark, scalars.classify_request(F.lit(m), F.lit(p), F.lit(q)))[0]
    assert c("HEAD", f"/v2/a/b/blobs/{d}")[:6] == ("blob existence check", "blob.head", "blob.read_or_write", "a/b", d, False)
    assert c("POST", "/v2/a/blobs/uploads/", f"mount={d}&from=b").digest == d and c("POST", "/v2/a/blobs/uploads/", f"mount={d}&mount={d}&from=b").digest == ""
    assert c("PUT", "/v2/a/blobs/uploads/u", f"digest={d};x=1").digest == "" and c("PUT", "/v2/a/manifests/latest").write
    assert c("GET", "/v2/A/tags/list").op == "unknown" and c("GET", "/v2/a%2Fb/manifests/x").op == "unknown"
    assert c("DELETE", f"/v2/a/blobs/{d}").digest == d and c("GET", "/v2/a/blobs/nodigest").digest == ""


def test_key_values(spark):
    kinds = lambda t: one(spark, kv.kind(kv.items(F.lit(t))))[0]
    assert [kinds(""), kinds("a=1\nb = 2"), kinds("x\ny"), kinds("a=1\ny"), kinds('["a=1"]'), kinds("﻿# c\na=1")] == ["empty", "kv", "list", "mixed", "kv", "kv"]
    assert one(spark, kv.to_env(kv.pairs(kv.items(F.lit("b=1\na = x=y\nb=2")))))[0] == ["a=x=y", "b=2"]
    with pytest.raises(Exception, match="empty key"):
        one(spark, kv.pairs(kv.items(F.lit("=1"))))
    assert one(spark, kv.getkv(F.array(F.lit("AB=1"), F.lit("A=2")), F.lit("A")))[0] == "2"
    assert one(spark, kv.rfc3339(F.lit("0")))[0] == "1970-01-01T00:00:00Z"


# ---- overlays --------------------------------------------------------------------------------------------------


def random_images(rng, n, safe):
    rows = []
    for image in range(n):
        kinds = {}
        order = 0
        for layer in range(rng.randint(1, 4)):
            events = []
            for _ in range(rng.randint(1, 6)):
                p = "/".join(rng.choices("abc", k=rng.randint(1, 3)))
                what = rng.random()
                if what < 0.15:
                    events.append((0, posixpath.join(p, ".wh..wh..opq"), "file"))
                elif what < 0.35:
                    events.append((0, posixpath.join(posixpath.dirname(p), ".wh." + posixpath.basename(p)), "file"))
                else:
                    kind = kinds.setdefault(p, rng.choice(("file", "dir"))) if safe else rng.choice(("file", "dir"))
                    events.append((1, p, kind))
            if safe:
                events.sort(key=lambda e: e[0])
            for _, p, kind in events:
                rows.append((image, layer, order, p, kind, f"{layer}.{order}"))
                order += 1
    return rows


@pytest.mark.parametrize("safe", [True, False])
def test_overlay_plan_equals_fold(spark, safe):
    rows = random_images(random.Random(11 + safe), 250, safe)
    e = spark.createDataFrame(rows, "image long, layer int, ord long, path string, entry_type string, attrs string")
    got, want = ({tuple(r) for r in x.select("image", "path", "entry_type", "attrs").collect()} for x in (overlay.merge_layers(e, fold_limit=0), overlay.apply_fold(overlay.events(e))))
    assert got == want
    if safe:
        assert overlay.safe_images(overlay.events(e)).where("safe").count() > 20


def test_overlay_cases(spark):
    rows = [(0, 0, 0, "usr/bin/a", "file", "0"), (0, 0, 1, "etc/conf", "file", "0"), (0, 1, 2, "usr/.wh..wh..opq", "file", ""), (0, 1, 3, "usr/lib/b", "file", "1"), (0, 2, 4, ".wh.etc", "file", "")]
    e = spark.createDataFrame(rows, "image long, layer int, ord long, path string, entry_type string, attrs string")
    got = {(r["path"], r["entry_type"], r["attrs"]) for r in overlay.merge_layers(e, fold_limit=0).collect()}
    assert got == {("usr", "dir", ""), ("usr/lib", "dir", ""), ("usr/lib/b", "file", "1")}


def test_stream_merge_conflict(spark):
    e = spark.createDataFrame([("/a", 1, "file", "x"), ("a/", 2, "dir", "y")], "path string, ord long, entry_type string, attrs string")
    with pytest.raises(Exception, match="conflicting"):
        overlay.merge_streams(e).collect()
    assert overlay.beneath_files(spark.createDataFrame([("l", "symlink"), ("l/x", "file")], "path string, entry_type string")).collect()[0]["ancestor"] == "l"


# ---- dedup, streams --------------------------------------------------------------------------------------------


def test_offsets_with_and_without_groups(spark):
    rng = random.Random(2)
    rows = [(i % 3, i, rng.randint(0, 2000)) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, ord long, size long").repartition(4)
    at, want = 0, {}
    for _, i, n in rows:
        want[i] = at
        at += -(-n // 512) * 512
    assert {r["ord"]: r["offset"] for r in dedup.running_offsets(df, ["ord"], F.col("size"), align=512).collect()} == want


def test_checkpoints(spark):
    pos = [0, 5, 11, 12, 22, 23, 40]
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate(pos)], "stream int, ord long, pos long")
    assert [r["pos"] for r in streams.checkpoints(df, 10).where("checkpoint").orderBy("ord").collect()] == [0, 11, 22, 40]


def test_overlapping_references_are_refused(spark):
    df = spark.createDataFrame([(0, 0, 0, "a", 10), (0, 1, 5, "b", 10)], "stream long, ord long, offset long, digest string, size long")
    with pytest.raises(Exception, match="overlap"):
        streams.check_refs(df).collect()


def test_header_hash_tells_fields_apart(spark):
    row = lambda **k: [F.lit(k.get(c, d)) for c, d in (("kind", "0"), ("path", "a"), ("link", ""), ("size", 1), ("mode", 420), ("uid", 0), ("gid", 0), ("uname", ""), ("gname", ""), ("mtime", 0))]
    h = lambda **k: one(spark, dedup.header_hash(*row(**k)))[0]
    assert len({h(), h(path="ab"), h(uname="a"), h(gname="a"), h(mode=421), h(uid=1), h(gid=1)}) == 7 and h() == h()


# ---- graph -----------------------------------------------------------------------------------------------------


def test_reach_with_cycles(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(60), rng.randrange(80)) for _ in range(90)} | {(70, 71), (71, 70), (5, 5)}
    seen, todo = set(), [0, 70, 99]
    while todo:
        x = todo.pop()
        if x not in seen and x < 75:
            seen.add(x)
            todo += [b for a, b in edges if a == x]
    e = spark.createDataFrame([(0, a, b) for a, b in edges], "repo int, src long, dst long")
    held = spark.createDataFrame([(0, i) for i in range(75)], "repo int, digest long")
    roots = spark.createDataFrame([(0, 0), (0, 70), (0, 99)], "repo int, digest long")
    assert {r["digest"] for r in graph.reach(roots, e, held).collect()} == seen


def test_collection_keeps_referrers(spark):
    now = "2024-01-10 00:00:00"
    m = spark.createDataFrame([("r", "image", "2024-01-09 12:00:00"), ("r", "sig", "2023-01-01 00:00:00"), ("r", "old", "2023-01-01 00:00:00"), ("r", "new", None)], "repo string, digest string, last_used string").selectExpr("repo", "digest", "cast(last_used as timestamp_ntz) as last_used")
    tags = spark.createDataFrame([("r", "gone", "old", "2023-01-01 00:00:00"), ("r", "dangling", "nowhere", "2024-01-09 23:00:00")], "repo string, tag string, digest string, last_used string").selectExpr("repo", "tag", "digest", "cast(last_used as timestamp_ntz) as last_used")
    edges = spark.createDataFrame([("r", "sig", "image", "subject"), ("r", "image", "blob1", "blob"), ("r", "old", "blob2", "blob")], "repo string, src string, dst string, kind string")
    blobs = spark.createDataFrame([("blob1", "2023-01-01 00:00:00"), ("blob2", "2023-01-01 00:00:00"), ("blob3", "2024-01-09 23:59:59")], "digest string, last_used string").selectExpr("digest", "cast(last_used as timestamp_ntz) as last_used")
    live = graph.mark(m, tags, edges, now, 86_400, 86_400)
    assert {r["digest"] for r in live.collect()} == {"image", "sig", "new"}
    s = graph.sweep(m, tags, blobs, live, graph.live_blobs(live, edges, blobs, now, 86_400), now, 86_400)
    assert [{r[c] for r in s[k].collect()} for k, c in (("manifests", "digest"), ("tags", "tag"), ("blobs", "digest"))] == [{"old"}, {"gone", "dangling"}, {"blob2"}]


# ---- push ------------------------------------------------------------------------------------------------------


def brute_plan(rows, staged, incremental):
    out = {}
    for key in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == key]
        needing, confirmed = {r[2] for r in own if not r[3]}, {r[2] for r in own if r[3]}
        if not needing:
            continue
        ups, pins = {r[4] for r in own if not r[3]}, {r[5] for r in own if not r[3]} - {""}
        up = ups.pop() if len(ups) == 1 else ""
        home, kind = (min(pins), "pinned") if pins else (min(confirmed), "confirmed") if confirmed else (up, "upstream") if up else (staged, "staging") if staged else (min(needing), "upload")
        mounted = len(needing - {home})
        skipped = not incremental and not mounted
        upload = kind in ("pinned", "staging", "upload") and not skipped
        out[key] = (kind, home, mounted, skipped, upload, upload and mounted > 0 and not any(r[7] for r in own if not r[3]))
    return out


@pytest.mark.parametrize("staged, incremental", [("", False), ("stage", False), ("", True)])
def test_push_plan(spark, staged, incremental):
    rng = random.Random(4)
    rows = [("g" + rng.choice("ab"), "l" + str(rng.randrange(25)), "r" + str(rng.randrange(4)), rng.random() < 0.2, rng.choice(("", "", "base", "other")), rng.choice(("",) * 9 + ("pin1", "pin0")), rng.random() < 0.1, rng.random() < 0.05) for _ in range(150)]
    df = spark.createDataFrame(rows, "registry string, blob string, repository string, present boolean, upstream string, home string, artificial boolean, lenient boolean")
    got = {(r["registry"], r["blob"]): (r["kind"], r["home"], r["mounted"], r["skipped"], r["upload"], r["mount_only"]) for r in push.plan(df, staged, incremental).collect()}
    assert got == brute_plan(rows, staged, incremental)


def test_settings_must_agree(spark):
    s = spark.createDataFrame([("a", False, ""), ("b", True, "")], "blob_repository string, forbid_layer_push boolean, sign_setting string")
    with pytest.raises(Exception, match="conflicting blob_repository"):
        push.merge_settings(s).collect()
    assert push.merge_settings(s.where("blob_repository = 'b'")).first().asDict() == {"blob_repository": "b", "forbid_layer_push": True, "sign_setting": ""}


# ---- policies and assertions -----------------------------------------------------------------------------------


def glob(pattern, name):
    p, n = pattern.split("/"), name.split("/")

    def seg(a, b):
        return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in a), b) is not None

    def match(i, j):
        if i == len(p):
            return j == len(n)
        if p[i] == "**":
            return any(match(i + 1, k) for k in range(j, len(n) + 1))
        return j < len(n) and seg(p[i], n[j]) and match(i + 1, j + 1)

    return match(0, 0)


def test_globs():
    rng = random.Random(5)
    for _ in range(3000):
        pattern = "/".join(rng.choice(["**", "*", "a", "?", "a*", "*b", "ab"]) for _ in range(rng.randint(1, 4)))
        name = "/".join(rng.choice(["a", "b", "ab", "abc", ""]) for _ in range(rng.randint(1, 4)))
        assert bool(re.search(policy.repo_regex(pattern), "/" + name)) == glob(pattern, name), (pattern, name)


def test_hosts():
    m = lambda p, h: bool(re.search(policy.host_regex(p), h))
    assert m("*", "x") and m("*.docker.io", "index.Docker.io") and not m("*.docker.io", "docker.io") and m("Ghcr.io", "ghcr.IO") and not m("ghcr.io", "xghcr.io")
    with pytest.raises(ValueError):
        policy.host_regex("a*b")


def test_file_checks(spark):
    tests = spark.createDataFrame([(1, "a", True, "-rwxr-xr-x", None, None, ""), (2, "a", True, "", 5, None, ""), (3, "a", False, "", None, None, ""), (4, "b", True, "", None, None, ""), (5, "a", True, "", None, None, "other"), (6, "c", True, "", None, None, "owner"), (7, "b", False, "", None, None, "")], "test_id int, path string, should_exist boolean, permissions string, uid long, gid long, executable_by string")
    entries = spark.createDataFrame([("a", "file", "0755", 0, 0), ("c", "file", None, 0, 0)], "path string, type string, mode string, uid long, gid long")
    got = {r["test_id"]: r["message"] for r in asserts.check_files(tests, entries).collect()}
    assert got == {1: "", 2: "uid 0, want 5", 3: '"a" exists', 4: '"b" does not exist', 5: "", 6: "no mode; cannot check executable", 7: ""}
    assert asserts.unsupported({"commandTests": [1], "licenseTests": [], "fileExistenceTests": [1]}) == ["commandTests"]


# ---- images ----------------------------------------------------------------------------------------------------


def test_history_cases(spark):
    def split(empties, n):
        h = spark.createDataFrame([(0, i, bool(e)) for i, e in enumerate(empties)], "image int, ord int, empty_layer boolean")
        rows = images.split_history(h, spark.createDataFrame([(0, n)], "image int, n_layers int")).orderBy("ord").collect()
        return [(r["ord"], r["layer_idx"]) for r in rows]

    assert split([1, 0, 1, 0, 1], 2) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 1)]
    assert split([1, 1], 2) == [(0, 0), (1, 0)] and split([0, 0, 0], 2) == [(0, 0), (1, 1)] and split([0], 0) == []


def test_platforms(spark):
    v = lambda a, x: [p["variant"] for p in one(spark, images.platform_vector(F.lit("linux"), F.lit(a), F.lit(x)))[0]]
    assert [v("amd64", "v3"), v("amd64", ""), v("arm", "v7"), v("arm64", "v8.2"), v("arm64", "v9.1"), v("arm64", ""), v("s390x", "z")] == [["v3", "v2", "v1", ""], [""], ["v7", "v6", "v5"], ["v8.2", "v8.1", "v8"], ["v9.1", "v9", "v8"], [""], ["z"]]


def test_refusals(spark):
    acc = spark.createDataFrame([("a", 1, ""), ("a", 2, "")], "name string, id long, shell string")
    with pytest.raises(Exception, match="duplicate name"):
        images.merge_accounts(acc, {"shell": "x"}).collect()
    layers = spark.createDataFrame([(0, 0, "t", None, "d", 1)], "image int, layer_idx int, media_type string, digest string, diff_id string, size long")
    with pytest.raises(Exception, match="incomplete"):
        images.layer_descriptors(layers).collect()
    with pytest.raises(Exception, match="no child"):
        images.index_children(spark.createDataFrame([(0, 1)], "index int, pos int"), F.col("pos") > 5).collect()


# ---- caches ----------------------------------------------------------------------------------------------------


def test_ttl_variants(spark):
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate([0, 6, 12, 18, 30])], "k int, ord long, t long")
    hits = lambda x: [r["hit"] for r in x.orderBy("ord").collect()]
    assert hits(cache.hits_if_all_store(df, ["k"], F.col("t"), 10, "ord")) == [False, True, True, True, False]
    assert hits(cache.hits_if_misses_store(df, ["k"], "t", 10, "ord")) == [False, True, False, True, False]


def test_eviction_passes_over_entries_in_use(spark):
    df = spark.createDataFrame([(0, "a", 1, 5, True), (0, "b", 2, 5, False), (0, "c", 3, 5, False), (0, "d", 4, 5, False)], "g int, key string, last_used long, size long, pinned boolean")
    assert {r["key"] for r in cache.evict(df, 11, ["g"]).collect()} == {"b", "c"} and cache.evict(df, 20, ["g"]).count() == 0


def test_unknown_length_keeps_the_known_one(spark):
    d = "sha256:" + "a" * 64
    e = spark.createDataFrame([("r", "p", d, 0, 0, False, 7), ("r", "p", d, 1, 5, False, -1), ("r", "q", d, 2, 0, False, 3), ("r", "q", d, 3, 1, True, -1), ("r", "x", "bad", 4, 1, False, 1)], "registry string, repository string, digest string, ord long, ts long, deleted boolean, length long")
    rows = cache.cache_state(cache.valid_events(e), F.lit(6), 10).collect()
    assert [(r["repository"], r["length"], r["expires"]) for r in rows] == [("p", 7, 15)]


def test_bounded_labels_and_histograms(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, ""), (3, None), (4, "c"), (5, "b")], "ord long, host string")
    assert [r["bounded"] for r in metrics.bounded_labels(df, "host", "ord", 2).orderBy("ord").collect()] == ["b", "a", "unknown", "unknown", "_other", "b"]
    h = metrics.histogram(spark.createDataFrame([(0.005,), (0.006,), (1000.0,)], "v double"), F.col("v"), metrics.SECONDS).orderBy("bucket").collect()
    assert [(r["bucket"], r["n"], r["cumulative"]) for r in h] == [(0, 1, 1), (1, 1, 2), (18, 1, 3)] and h[-1]["upper"] is None


def test_combined_store_stops_at_errors(spark):
    s = spark.createDataFrame([("a", 0, "error", 1), ("a", 1, "found", 2), ("b", 0, "not_found", 0), ("b", 1, "found", 3)], "digest string, priority int, status string, size long")
    rows = lookups.first_store(spark.createDataFrame([("a",), ("b",), ("c",)], "digest string"), s).orderBy("digest").collect()
    assert [(r["status"], r["size"]) for r in rows] == [("error", None), ("found", 3), ("not_found", None)]


# ---- sources ---------------------------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz", format=tarfile.PAX_FORMAT) as tar:
        d = tarfile.TarInfo("usr")
        d.type = tarfile.DIRTYPE
        tar.addfile(d)
        f = tarfile.TarInfo("usr/a")
        f.size, f.pax_headers = 5, {"SCHILY.xattr.user.x": "1"}
        tar.addfile(f, io.BytesIO(b"hello"))
        s = tarfile.TarInfo("usr/l")
        s.type, s.linkname = tarfile.SYMTYPE, "a"
        tar.addfile(s)
    (tmp_path / "x.tar.gz").write_bytes(raw.getvalue())
    rows = archives.scan(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["path"], r["typeflag"], r["size"], r["linkname"]) for r in rows] == [("usr/", "5", 0, ""), ("usr/a", "0", 5, ""), ("usr/l", "2", 0, "a")]
    assert rows[1]["digest"].startswith("2cf24dba") and rows[1]["pax"]["SCHILY.xattr.user.x"] == "1"


def test_mtree_names(spark, tmp_path):
    e = spark.createDataFrame([("a b#c", "file", 3, 0o644, 0, 0, "u", "", "ff", 7, "", 1), ("d", "dir", 0, 0o755, 0, 0, "", "", "", 7, "", 1), ("l", "link", 0, 0o777, 0, 0, "", "", "", 7, "to x", 1)], "path string, type string, size long, mode long, uid long, gid long, uname string, gname string, digest string, mtime long, linkname string, nlink int")
    lines = [r["value"] for r in mtree.render(e, ["type", "size", "mode", "uname", "sha256", "time", "link"]).collect()]
    assert lines == ["./a\\040b\\043c type=file size=3 mode=0644 uname=u sha256digest=ff time=7", "./d/ type=dir mode=0755 time=7", "./l type=link size=4 mode=0777 time=7 link=to\\040x"]
    back = mtree.parse(spark.createDataFrame([(x,) for x in ["#mtree v2.0", "", ". type=dir", *lines]], "value string")).collect()
    assert sorted(r["path"] for r in back) == ["a b#c", "d", "l"]


def test_malformed_lines_are_refused(spark):
    bad = spark.createDataFrame([("no separator", 1)], "value string, ord long")
    for scan in (params.add_files, params.symlinks):
        with pytest.raises(Exception, match="malformed"):
            scan(bad).collect()
    m = spark.createDataFrame([(0, '{"operations":[{"command":"push","registry":"r","surprise":1}]}')], "manifest int, body string")
    with pytest.raises(Exception, match="unknown field"):
        layouts.push_operations(m).collect()


def test_specs(spark, tmp_path):
    (tmp_path / "spec.json").write_text('{"metadataTest": {"user": "root"}}')
    assert layouts.read_spec(spark, str(tmp_path / "spec.json")) == {"metadataTest": {"user": "root"}}


def test_rules_in_blocks(spark):
    rows = [(i, i % 3 == 0, policy.host_regex("*"), policy.repo_regex(f"r{i % 7}/**"), 1 << (i % 4)) for i in range(40)]
    rules = spark.createDataFrame(rows, "idx int, allow boolean, host_rx string, repo_rx string, ops int")
    requests = spark.createDataFrame([(i, "h", f"r{i % 9}/x", 1 << (i % 4)) for i in range(60)], "id int, host string, repo string, op int")
    want = {}
    for i in range(60):
        first = next(((r[0], r[1]) for r in rows if r[0] % 7 == i % 9 and r[4] == 1 << (i % 4)), (-1, False))
        want[i] = first
    for block in (3, 1000):
        assert {r["id"]: (r["rule"], r["allow"]) for r in policy.decide_joined(requests, rules, block=block).collect()} == want
    assert {r["rule"] for r in policy.decide_joined(requests, rules.limit(0)).collect()} == {-1}


def test_hot_keys_are_spread(spark):
    """A digest that a third of all entries share: the join deals its rows over many tasks, and results stay."""
    from strata.operators.skew import join_spread

    n = 3000
    rows = [(i, f"p{i}", "hot" if i % 3 == 0 else None if i % 50 == 1 else f"d{i % 700}") for i in range(n)]
    entries = spark.createDataFrame(rows, "ord long, path string, digest string").repartition(5)
    first = {}
    for i, p, d in rows:
        first.setdefault(d, (i, p))
    got = {r["ord"]: r["link"] for r in dedup.link_repeats(entries, ["digest"]).collect()}
    assert got == {i: None if first[d][0] == i else first[d][1] for i, p, d in rows}
    keyed = entries.groupBy(F.col("digest").alias("k")).agg(F.count("*").alias("n"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = [r["c"] for r in join_spread(entries, keyed, ["digest"], ["k"], "n", ["ord"]).groupBy(F.spark_partition_id()).agg(F.count("*").alias("c")).collect()]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sum(sizes) == n and max(sizes) < 2.5 * n / int(spark.conf.get("spark.sql.shuffle.partitions"))
