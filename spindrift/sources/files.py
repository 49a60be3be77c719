"""Files, logs and tables: scans, ignore rules, upserts and exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import language

# Size limit of a file and patterns that are never indexed.
MOST_BYTES = 500 * 1024
IGNORED = ["**/.git/**", "**/node_modules/**", "**/__pycache__/**", "**/dist/**", "**/build/**", "**/.venv/**", "**/venv/**", "*.pyc", "*.lock", "*.min.js"]


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression; ``*`` crosses folders."""
    out = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", pattern))
    return f"^{out}$"


def ignore_patterns(text: str) -> list[str]:
    """Patterns of an ignore file: no comments, no negations, folders with all below."""
    lines = [x.strip() for x in text.splitlines()]
    return [x.strip("/") for x in lines if x and not x.startswith(("#", "!"))]


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path, its name or a folder above it fits one of the patterns."""
    if not patterns:
        return F.lit(False)
    one = "|".join(f"(?:{glob_regex(p)})" for p in patterns)
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return path.rlike(one) | F.concat(F.lit("/"), path).rlike(one) | F.exists(parts, lambda x: x.rlike(one)) | F.exists(above, lambda x: x.rlike(one))


def listed(spark: SparkSession, root: str, patterns: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Every file below a folder: ``file_path`` (relative), ``size``,
    ``modified``, ``content`` (bytes; of files that are not left out by rule or
    size) and ``skipped``: ignored, too large, not text, or null."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = raw.select(F.regexp_replace("path", "^file:/+", "/").alias("full"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    clean = re.sub("^file:/+", "/", root).rstrip("/")
    rel = F.when(F.startswith("full", F.lit(clean + "/")), F.substring("full", len(clean) + 2, 1 << 30)).otherwise(F.col("full"))
    rows = base.withColumn("file_path", rel)
    rule = F.when(ignored(F.col("file_path"), [*IGNORED, *(patterns or [])]), "ignored").when(F.col("size") > most_bytes, "too large")
    text = F.is_valid_utf8(F.col("content").cast("string"))
    return rows.select("file_path", "size", "modified", F.when(rule.isNull(), F.col("content")).alias("content"), F.when(rule.isNotNull(), rule).when(~text, "not text").alias("skipped"))


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Text files below a folder: ``file_path`` (relative), ``content``,
    ``language``, ``content_hash``, ``size``, ``modified``. What is left out and
    why is in ``skipped``."""
    found = listed(spark, root, patterns, most_bytes).where("skipped is null")
    return found.select("file_path", F.col("content").cast("string").alias("content"), language(F.col("file_path"), "text").alias("language"), F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"), "size", "modified")


def skipped(spark: SparkSession, root: str, patterns: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The files that a scan leaves out: ``file_path``, ``size``, ``skipped``."""
    return listed(spark, root, patterns, most_bytes).where("skipped is not null").select("file_path", "size", "skipped")


def first_files(found: DataFrame, limit: int, extensions: list[str], focus: list[str] | None = None) -> DataFrame:
    """The first files of a scan by path, of some extensions and below focus
    folders: three times ``limit``, for a search without an index."""
    rows = found.where(F.lower(F.regexp_extract("file_path", "\\.([A-Za-z0-9]+)$", 1)).isin(*extensions))
    for n, prefix in enumerate(focus or []):
        hit = F.startswith(F.col("file_path"), F.lit(prefix))
        near = hit if n == 0 else near | hit
    return (rows.where(near) if focus else rows).orderBy("file_path").limit(3 * limit)


def upsert(current: DataFrame, batch: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """``current`` with the rows of ``batch`` in place of theirs (one per key)."""
    if order:
        batch = batch.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    else:
        batch = batch.dropDuplicates(key)
    return current.join(batch.select(*key), key, "left_anti").unionByName(batch, allowMissingColumns=True)


def removed(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def staleness(indexed: DataFrame, present: DataFrame, key: str = "path", hash_col: str = "hash") -> DataFrame:
    """``status`` of each path: fresh, stale, new or deleted."""
    a = indexed.select(F.col(key), F.col(hash_col).alias("_old"))
    b = present.select(F.col(key), F.col(hash_col).alias("_new"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "stale").otherwise("fresh")
    return a.join(b, key, "full").select(key, status.alias("status"))


def reindex(indexed: DataFrame, present: DataFrame, most: int = 50, key: str = "path") -> DataFrame:
    """The paths that a bounded incremental run takes: stale, then new."""
    s = staleness(indexed, present, key)
    order = F.when(F.col("status") == "stale", 0).otherwise(1)
    return s.where(F.col("status").isin("stale", "new")).orderBy(order, key).limit(most)


def read_jsonl(spark: SparkSession, path: str, schema: str, order: str | None = None, last: int | None = None) -> DataFrame:
    """A log of JSON lines; lines that do not parse are left out. With ``last``
    the last so many in an ``order``."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if last is None or order is None else rows.orderBy(F.desc(order)).limit(last)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines, as files of their own."""
    rows.write.mode("append").json(path)


def export(points: DataFrame, path: str, kind: str = "json", tags: str = "tags") -> None:
    """Metric points as JSON lines or CSV, tags as ``k=v;k=v``."""
    if kind == "csv":
        flat = F.concat_ws(";", F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
        points.withColumn(tags, flat).write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        points.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format: {kind}")


def lines(files: DataFrame, start: int, end: int, most: int = 200) -> DataFrame:
    """Numbered lines of files, 1-based and inclusive; ``truncated`` if cut at ``most``."""
    stop = min(end, start + most - 1)
    rows = files.select("file_path", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    return rows.where(F.col("pos").between(start - 1, stop - 1)).select("file_path", (F.col("pos") + 1).alias("line"), F.concat(F.lpad((F.col("pos") + 1).cast("string"), 6, " "), F.lit("  "), "text").alias("numbered"), F.lit(stop < end).alias("truncated"))


def matching(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Files that fit one of the globs of ``include`` (all without any) and none of ``exclude``."""
    out = files.where(ignored(F.col("file_path"), include)) if include else files
    return out.where(~ignored(F.col("file_path"), exclude)) if exclude else out


def tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """Folders and files to a depth: ``path``, ``parent``, ``depth``, ``files``, ``bytes``."""
    parts = F.split("file_path", "/")
    each = files.select("size", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda i: F.slice(parts, F.lit(1), i))).alias("p"))
    path = F.array_join("p", "/")
    parent = F.array_join(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))), "/")
    return each.groupBy(path.alias("path"), parent.alias("parent"), F.size("p").alias("depth")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
