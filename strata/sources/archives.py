"""Tar archives: scanned to rows in file order, and written one layer at a time."""

from __future__ import annotations

import gzip
import hashlib
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "archive string, ord long, path string, typeflag string, mode long, uid long, gid long, uname string, gname string, size long, mtime long, linkname string, digest string, pax map<string,string>"


def decompressed(raw: bytes) -> bytes:
    """gzip and zstd by their first bytes, else as it is."""
    if raw[:2] == b"\x1f\x8b":
        return gzip.decompress(raw)
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
    return raw


def _rows(name: str, raw: bytes) -> Iterator[tuple]:
    with tarfile.open(fileobj=io.BytesIO(decompressed(raw))) as tar:
        for n, m in enumerate(tar):
            digest = hashlib.sha256(tar.extractfile(m).read()).hexdigest() if m.isreg() else None
            yield name, n, m.name + ("/" if m.isdir() else ""), m.type.decode("latin1").replace("\0", "0"), m.mode, m.uid, m.gid, m.uname, m.gname, m.size, int(m.mtime), m.linkname, digest, dict(m.pax_headers)


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A row for each entry of each archive under path; an archive is read by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, raw in zip(p["path"], p["content"]):
                yield pd.DataFrame(list(_rows(name, raw)), columns=[c.split()[0] for c in ENTRY.split(", ")])

    return files.mapInPandas(run, ENTRY)


def _tar(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for r in pdf.sort_values("ord").itertuples():
            info = tarfile.TarInfo(r.path)
            info.mode, info.mtime = int(r.mode), 0
            if r.link is not None:
                info.type, info.linkname = tarfile.LNKTYPE, r.link
                tar.addfile(info)
                continue
            content = r.content or b""
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    raw = out.getvalue()
    return pd.DataFrame([(key[0], raw, hashlib.sha256(raw).hexdigest(), len(raw))], columns=["layer", "tar", "digest", "size"])


def write_layers(entries: DataFrame) -> DataFrame:
    """(layer, tar, digest, size) of entries(layer, ord, path, mode, content, link): files, and hard links where link is set. A layer is one task's work, as an archive is one stream."""
    cols = entries.select("layer", "ord", "path", "mode", "content", "link")
    return cols.groupBy("layer").applyInPandas(_tar, "layer long, tar binary, digest string, size long")


def import_entries(entries: DataFrame, imported: DataFrame, order: str = "ord") -> DataFrame:
    """imported rows after all of entries, in their order."""
    last = entries.agg(F.coalesce(F.max(order), F.lit(-1)).alias("_last"))
    moved = imported.join(F.broadcast(last)).withColumn(order, F.col(order) + F.col("_last") + 1).drop("_last")
    return entries.unionByName(moved)
