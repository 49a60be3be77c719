"""The index job, graph files, settings, and what a scan leaves out."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contract_matches
from ..operators import embedding
from . import chunking, files, stores, tables


def index(spark: SparkSession, root: str, store: str, force: bool = False, patterns: list[str] | None = None, now: Column | None = None) -> dict[str, int]:
    """Brings a store folder up to date with the files below ``root``: files
    whose hash has changed (all with ``force``) are chunked, marked and embedded
    again, chunks of files that are gone go. Returns the numbers of files by
    what was done. Tables are replaced by whole versions, so a run that dies
    leaves the store as it was or at a table's next version, and the next run
    does the rest: the files table comes last."""
    now = F.current_timestamp() if now is None else now
    present = files.scan(spark, root, patterns)
    known = tables.read(spark, store, "files")
    status = files.staleness(known.select(F.col("file_path").alias("path"), F.col("content_hash").alias("hash")), present.select(F.col("file_path").alias("path"), F.col("content_hash").alias("hash")))
    counts = {r.status: r["count"] for r in status.groupBy("status").count().collect()}  # four rows at most
    wanted = status.where("status <> 'deleted'" if force else "status IN ('new', 'stale')").select(F.col("path").alias("file_path"))
    touched = status.where("status = 'deleted'").select(F.col("path").alias("file_path")).unionByName(wanted)
    changed = present.join(wanted, "file_path", "left_semi")
    fresh = chunking.chunks(changed).join(changed.select("file_path", "content_hash"), "file_path")
    mark = F.size(contract_matches(F.col("content"), F.col("language"))) > 0
    fresh = fresh.withColumns({"is_contract": mark, "is_pinned": F.lit(False), "updated_at": now, "extra": F.create_map().cast("map<string,string>")})
    old = tables.read(spark, store, "chunks")
    kept = old.join(touched, "file_path", "left_anti")
    tables.write(kept.unionByName(fresh.select(*old.columns)), store, "chunks")
    chunks = tables.read(spark, store, "chunks")
    vectors = tables.read(spark, store, "vectors")
    new = chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "content")
    made = embedding.embedded(new, "content").select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"))
    tables.write(vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi").unionByName(made), store, "vectors")
    records = stores.contract_records(chunks)
    tables.write(records, store, "contracts")
    tables.write(records.select("contract_id", F.explode("dependencies").alias("name")), store, "contract_dependencies")
    listed = present.select("file_path", "content_hash", "language", "size", "modified").withColumn("indexed_at", now)
    tables.write(known.join(touched, "file_path", "left_anti").unionByName(listed.join(wanted, "file_path", "left_semi")), store, "files")
    return {s: counts.get(s, 0) for s in ("new", "stale", "fresh", "deleted")}


def freshness(indexed_at: Column, now: Column, changed: Column, reindexed: Column, days: int = 7) -> Column:
    """How fresh an index is: missing, reindexed, stale (older than ``days`` or
    with changed files) or fresh."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(indexed_at.cast("timestamp"))) / 86_400e6
    return F.when(indexed_at.isNull(), "missing").when((changed > 0) & (reindexed > 0), "reindexed").when((age > days) | (changed > 0), "stale").otherwise("fresh")


# ---- graph files ------------------------------------------------------------------

NODE = "struct<node_id:string,node_type:string,name:string,file_path:string,start_line:int,end_line:int,chunk_id:string>"
EDGE = "struct<src:string,dst:string,edge_type:string,weight:double>"


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, version: int = 1) -> None:
    """A graph as JSON lines: one element each, a node or an edge, with the version."""
    rows = nodes.select(F.lit(version).alias("version"), F.struct(*nodes.columns).alias("node"))
    rows.unionByName(edges.select(F.lit(version).alias("version"), F.struct(*edges.columns).alias("edge")), allowMissingColumns=True).write.mode("overwrite").json(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph file; what a file does not state is null."""
    rows = spark.read.schema(f"version int, node {NODE}, edge {EDGE}").json(path)
    return rows.where("node is not null").select("node.*"), rows.where("edge is not null").select("edge.*")


def simple_edges(edges: DataFrame) -> DataFrame:
    """Edges for tools that know one edge between two nodes: the last type by name."""
    return edges.groupBy("src", "dst").agg(F.max("edge_type").alias("edge_type"))


# ---- settings ----------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """What changes results. Files may hold these in a table ``retrieval``, ``pack`` or at the top."""

    pool: int = 100
    limit: int = 20
    trade: float = 0.7
    tau_days: float = 30.0
    temperature: float = 1.0
    budget_tokens: int = 8000
    max_file_bytes: int = files.MOST_BYTES
    ignore: tuple[str, ...] = ()


#: Where settings are looked for below a project, in order.
SETTINGS_FILES = ["config.toml", "config.json", ".config/config.toml", ".config/config.json"]


def settings(spark: SparkSession, root: str, names: list[str] | None = None) -> Settings:
    """The settings of the first file that is there; defaults without one. A
    file that does not parse, or holds a value of another type, raises."""
    for name in names or SETTINGS_FILES:
        fs, at = tables._fs(spark, f"{root.rstrip('/')}/{name}")
        if fs.exists(at):
            text = spark.read.text(f"{root.rstrip('/')}/{name}", wholetext=True).first()[0]
            return parsed_settings(json.loads(text) if name.endswith(".json") else tomllib.loads(text))
    return Settings()


def parsed_settings(found: dict) -> Settings:
    flat = {k: v for section in [found, *(found.get(s, {}) for s in ("retrieval", "pack"))] for k, v in section.items()}
    out = {}
    for f in fields(Settings):
        if f.name in flat:
            value, default = flat[f.name], f.default
            value = tuple(value) if isinstance(value, list) else float(value) if isinstance(default, float) and isinstance(value, int) else value
            if type(value) is not type(default):
                raise ValueError(f"{f.name} must be of type {type(default).__name__}")
            out[f.name] = value
    return Settings(**out)
