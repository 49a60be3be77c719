"""Schemas of the engine's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "chunks": "chunk_id string, file_path string, content string, start_line int, end_line int, symbol_name string, symbol_type string, language string, token_count int, is_contract boolean, is_pinned boolean, content_hash string, updated_at timestamp, extra map<string,string>",
    "files": "file_path string, content_hash string, language string, size long, modified timestamp, indexed_at timestamp",
    "vectors": "chunk_id string, embedding array<float>",
    "contracts": "contract_id string, chunk_id string, name string, contract_type string, file_path string, start_line int, end_line int, language string, signature string",
    "contract_dependencies": "contract_id string, name string",
    "contract_implementors": "contract_id string, chunk_id string",
    "nodes": "node_id string, node_type string, name string, file_path string, start_line int, end_line int, chunk_id string",
    "edges": "src string, dst string, edge_type string, weight double",
    "pins": "source_id string, path string, label string, priority int, pinned_at timestamp, expires_at timestamp",
    "ledger": "entry_id string, session_id string, category string, content string, confidence double, created_at timestamp, resolved boolean",
    "sessions": "session_id string, queries array<string>, chunks array<string>, focus string, updated_at timestamp",
    "metrics": "metric_type string, name string, value double, ts timestamp, tags map<string,string>",
    "retrieval_events": "event_id long, session_id string, query string, query_intent string, retrieved array<string>, selected array<string>, outcome string, ts timestamp",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


_VERSION = re.compile(r"^v=(\d+)(?:\.(.*))?$")


def versions(spark: SparkSession, path: str, complete: bool = True) -> list[tuple[int, str]]:
    """Numbers and folder names of a table's versions, in order; of those whose
    writer has finished, or of all."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    out = []
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        found = _VERSION.match(name)
        if found and (not complete or fs.exists(_fs(spark, f"{path}/{name}/_SUCCESS")[1])):
            out.append((int(found[1]), name))
    return sorted(out)


def commit(df: DataFrame, path: str, mark: str = "", keep: int = 2) -> str:
    """Writes ``df`` as the next version of a table folder. A reader takes the
    last version whose writer has finished, so a crash loses nothing and a table
    may be read while it is replaced; the ``keep`` last ones stay. ``mark``: a
    version so marked that is there already is not written again."""
    spark, path = df.sparkSession, path.rstrip("/")
    done = versions(spark, path)
    if mark and any(name.endswith(f".{mark}") for _, name in done):
        return next(name for _, name in done if name.endswith(f".{mark}"))
    number = max((n for n, _ in versions(spark, path, complete=False)), default=-1) + 1
    name = f"v={number:08d}" + (f".{mark}" if mark else "")
    df.write.parquet(f"{path}/{name}")
    for _, old in done[: max(0, len(done) + 1 - keep)]:
        fs, at = _fs(spark, f"{path}/{old}")
        fs.delete(at, True)
    return name


def current(spark: SparkSession, path: str, schema) -> DataFrame:
    """The last complete version of a table folder; empty before the first.
    Anything else that goes wrong raises."""
    done = versions(spark, path.rstrip("/"))
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{done[-1][1]}") if done else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of a store folder; one that was never written is empty."""
    return current(spark, f"{root.rstrip('/')}/{name}", SCHEMAS[name])


def write(df: DataFrame, root: str, name: str) -> None:
    """Writes a table of a store folder, as its next version."""
    commit(df.select(*[c.split()[0] for c in _columns(name)]), f"{root.rstrip('/')}/{name}")


def _columns(name: str) -> list[str]:
    return re.split(r",\s+(?=\w+ )", SCHEMAS[name])
