"""JSON documents: deploy manifests, layer metadata, specs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUSH_KEYS = ("command", "registry", "repository", "tags", "manifests", "root", "deduplicated_push")
LOAD_KEYS = ("command", "tags", "daemon", "root", "manifests", "registry", "repository")


def operations(manifests: DataFrame, command: str, keys: tuple[str, ...]) -> DataFrame:
    """(manifest, op_idx, op) of the operations of manifests(manifest, body) with a command. Unknown fields end the job."""
    ops = manifests.select("manifest", F.posexplode(F.from_json(F.get_json_object("body", "$.operations"), "array<string>")).alias("op_idx", "op"))
    own = ops.where(F.get_json_object("op", "$.command") == command)
    extra = F.array_except(F.json_object_keys("op"), F.array(*map(F.lit, keys)))
    return own.withColumn("op", F.when(F.size(extra) == 0, F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown field "), F.array_join(extra, ", ")))))


def push_operations(manifests: DataFrame) -> DataFrame:
    o = operations(manifests, "push", PUSH_KEYS)
    return o.select("manifest", "op_idx", F.get_json_object("op", "$.registry").alias("registry"), F.get_json_object("op", "$.repository").alias("repository"), F.from_json(F.get_json_object("op", "$.tags"), "array<string>").alias("tags"))


def tag_operations(manifests: DataFrame) -> DataFrame:
    o = operations(manifests, "registry_tag", PUSH_KEYS)
    return o.select("manifest", "op_idx", F.get_json_object("op", "$.registry").alias("registry"), F.get_json_object("op", "$.repository").alias("repository"), F.from_json(F.get_json_object("op", "$.tags"), "array<string>").alias("tags"))


def load_operations(manifests: DataFrame) -> DataFrame:
    o = operations(manifests, "load", LOAD_KEYS)
    return o.select("manifest", "op_idx", F.from_json(F.get_json_object("op", "$.tags"), "array<string>").alias("tags"), F.get_json_object("op", "$.daemon").alias("daemon"))


def write_merged(ops: DataFrame, settings: DataFrame) -> DataFrame:
    """One JSON document of operations(ord, op) and settings."""
    merged = ops.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "op"))), lambda x: x["op"]).alias("operations"))
    body = F.concat(F.lit('{"operations":['), F.array_join("operations", ","), F.lit('],"settings":'), F.to_json(F.struct(*settings.columns)), F.lit("}"))
    return merged.join(F.broadcast(settings)).select(body.alias("body"))


def layer_metadata(layers: DataFrame) -> DataFrame:
    """Descriptor JSON of layers, with an empty history where there is none."""
    body = F.to_json(F.struct(F.col("diff_id"), F.col("media_type").alias("mediaType"), F.col("digest"), F.col("size"), F.coalesce("history", F.array().cast("array<string>")).alias("history")))
    return layers.withColumn("metadata", body)


def read_descriptors(lines: DataFrame) -> DataFrame:
    """(media_type, digest, diff_id, size) of descriptor JSON; one without media type, digest or diff id ends the job."""
    d = lines.withColumn("_d", F.from_json("metadata", "mediaType string, digest string, diff_id string, size long"))
    need = lambda c: F.when(F.coalesce(F.col(f"_d.{c}"), F.lit("")) != "", F.col(f"_d.{c}")).otherwise(F.raise_error(F.lit(f"descriptor without {c}")))
    return d.select(*[c for c in lines.columns if c != "metadata"], need("mediaType").alias("media_type"), need("digest").alias("digest"), need("diff_id").alias("diff_id"), F.col("_d.size").alias("size"))


def inject(documents: DataFrame, path: str) -> DataFrame:
    """documents(value) with the JSON at a dotted path as the root; one without it ends the job."""
    at = F.get_json_object("value", "$." + path)
    return documents.withColumn("value", F.coalesce(at, F.raise_error(F.lit(f"no value at {path}"))))


def _lower(value):
    if isinstance(value, dict):
        return {k.lower(): _lower(v) for k, v in value.items()}
    return [_lower(v) for v in value] if isinstance(value, list) else value


def lower_keys(documents: DataFrame, column: str = "value") -> DataFrame:
    """documents with the keys of their JSON in lower case, all the way down."""
    schema = documents.schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(**{column: [None if v is None else json.dumps(_lower(json.loads(v)), separators=(",", ":"), ensure_ascii=False) for v in p[column]]})

    return documents.mapInPandas(run, schema)


def read_spec(spark: SparkSession, path: str) -> dict:
    """A structure test or policy file in JSON, or in YAML where a YAML reader is installed: small, read on the driver."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()[0].decode()
    if raw.lstrip()[:1] in "{[":
        return json.loads(raw)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("the file isn't JSON, and no YAML reader is installed") from e
    return yaml.safe_load(raw)


def write_distribution(images: DataFrame, path: str) -> None:
    """images(registry, repository, digest, body) in folders by registry and repository."""
    images.write.mode("append").partitionBy("registry", "repository").parquet(path)
