"""The engine as one object: tables in, named tools over them.

Each tool checks its parameters' ranges and gives a DataFrame (or, for
``admin_ping``, a dict). ``call`` runs a tool by name.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates, graph, lexical, packing, statistics
from ..sources import files as file_sources
from ..sources import stores
from ..streaming import jobs
from . import hybrid, planner


def within(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return value


# Command files and the patterns of their commands (name as the group).
COMMANDS = {"Makefile": "(?m)^([A-Za-z][\\w-]*):", "package.json": '"([\\w:-]+)"\\s*:\\s*"[^"]*"', "pyproject.toml": '(?m)^([\\w-]+)\\s*=\\s*"[\\w.]+:\\w+"'}

# Commands that a file of this name stands for.
USUAL = {"Cargo.toml": ["cargo build", "cargo test", "cargo fmt", "cargo run"], "go.mod": ["go build", "go test", "go fmt", "go run"]}


@dataclass
class Engine:
    """``files``: file_path, content, language, size; ``chunks``: chunk_id,
    file_path, content, start_line, end_line, symbol_name, language, is_contract
    and if known updated_at; ``vectors``: chunk_id, embedding (by the built-in
    embedding if not given)."""

    spark: SparkSession
    files: DataFrame
    chunks: DataFrame
    edges: DataFrame | None = None
    pins: DataFrame | None = None
    vectors: DataFrame | None = None
    ledger: DataFrame | None = None
    started: float = field(default_factory=time.time)

    def retrieve(self, queries: DataFrame, k: int = 20, focus: list[str] | None = None, now: Column | None = None) -> DataFrame:
        """Hybrid hits: words, vectors, recency, contracts, focus and pins, with
        weights that follow each query's intent."""
        within("k", k, 1, 1000)
        chunks = self.chunks.drop("is_pinned")
        if self.pins is not None:
            pinned = self.pins.select(F.col("source_id").alias("chunk_id")).distinct().withColumn("is_pinned", F.lit(True))
            chunks = chunks.join(pinned, "chunk_id", "left")
        return hybrid.retrieve(chunks, queries, self.vectors, now=now, pool=max(100, k), limit=k, focus=focus)

    def memory_pack(self, queries: DataFrame, budget_tokens: int = 4000, k: int = 20, focus_paths: list[str] | None = None, mode: str = "auto", pinned_only: bool = False) -> DataFrame:
        """``query_id``, ``pack_markdown``, ``mode`` (as asked for, or by the
        gate), ``rlm_score``, ``entropy``, ``used_tokens``, ``top_sources``."""
        within("budget_tokens", budget_tokens, 512, 12000)
        if mode not in ("auto", "pack", "rlm"):
            raise ValueError(f"unknown mode: {mode}")
        hits = self.retrieve(queries, within("k", k, 5, 50), focus_paths)
        hits = hits.where("pinned_score = 1") if pinned_only else hits
        marks = [F.col("contract_score").cast("boolean").alias("is_contract"), F.col("pinned_score").cast("boolean").alias("is_pinned")]
        items = hits.select("query_id", "chunk_id", F.col("final").alias("score"), T.token_estimate(F.col("content")).alias("tokens"), *marks)
        chosen = packing.knapsack(packing.with_utility(items), budget_tokens)
        full = chosen.select("query_id", "chunk_id", "tokens").join(hits.select("query_id", "chunk_id", "content", "file_path", "start_line", "end_line", "symbol_name", *marks), ["query_id", "chunk_id"])
        stats = statistics.score_statistics(hits.select("query_id", F.col("final").alias("score")), "query_id")
        density = hits.groupBy("query_id").agg(F.avg("contract_score").alias("contract_density"))
        gate = statistics.mode_gate(stats, queries, density)
        if mode != "auto":
            gate = gate.withColumn("mode", F.lit(mode))
        used = full.groupBy("query_id").agg(F.sum("tokens").alias("used_tokens"), F.slice(F.array_sort(F.collect_set("file_path")), 1, 5).alias("top_sources"))
        return packing.markdown(full).join(gate, "query_id").join(stats.select("query_id", F.col("norm_entropy").alias("entropy")), "query_id").join(used, "query_id")

    def memory_pin(self, pins: DataFrame, ttl_seconds: int | None = None, now: Column | None = None) -> DataFrame:
        """Adds or replaces pins (``source_id``, ``path``, ``label`` and other
        columns); with a time to live they expire."""
        if "source_id" not in pins.columns:
            raise ValueError("pins need the column source_id")
        now = F.current_timestamp() if now is None else now
        if ttl_seconds is not None:
            within("ttl_seconds", ttl_seconds, 60, 86_400)
            pins = pins.withColumns({"pinned_at": now, "expires_at": now + F.make_dt_interval(secs=F.lit(float(ttl_seconds)))})
        self.pins = pins if self.pins is None else file_sources.upsert(self.pins, pins, ["source_id"])
        return self.pins

    def memory_unpin(self, sources: DataFrame) -> DataFrame:
        if self.pins is not None:
            self.pins = file_sources.removed(self.pins, sources, "source_id")
        return self.pins

    def pinned(self, least_priority: int | None = None, now: Column | None = None) -> DataFrame:
        """Pins that live, the most important first."""
        if self.pins is None:
            raise ValueError("no pins are kept")
        out = jobs.live(self.pins, F.current_timestamp() if now is None else now) if "expires_at" in self.pins.columns else self.pins
        if "priority" not in out.columns:
            return out.orderBy("source_id")
        out = out if least_priority is None else out.where(F.col("priority") >= least_priority)
        return out.orderBy(F.desc("priority"), "source_id")

    def memory_list(self, filter: str = "all", limit: int = 50, offset: int = 0, stale_days: int = 30, now: Column | None = None) -> DataFrame:  # noqa: A002
        """Chunks as memory items: all, the pinned, those changed in the last
        ``stale_days`` (recent) or before (stale), a page at a time."""
        within("limit", limit, 1, 200)
        now = F.current_timestamp() if now is None else now
        rows = self.chunks.select("chunk_id", "file_path", "symbol_name", *(["updated_at"] if "updated_at" in self.chunks.columns else []))
        if filter == "pinned":
            rows = rows.join(self.pinned(now=now).select(F.col("source_id").alias("chunk_id")), "chunk_id", "left_semi")
        elif filter in ("recent", "stale"):
            if "updated_at" not in rows.columns:
                raise ValueError("chunks have no times")
            limit_time = now.cast("timestamp") - F.make_dt_interval(F.lit(stale_days))
            rows = rows.where(F.col("updated_at") >= limit_time if filter == "recent" else F.col("updated_at") < limit_time)
        elif filter != "all":
            raise ValueError(f"unknown filter: {filter}")
        return aggregates.page(rows, [F.col("chunk_id")], offset, limit)

    def memory_get(self, sources: DataFrame, include_content: bool = True) -> DataFrame:
        """The chunks of some ids (``source_id``), and whether they are pinned."""
        rows = self.chunks.join(sources.select(F.col("source_id").alias("chunk_id")).distinct(), "chunk_id", "left_semi")
        mark = F.lit(False)
        if self.pins is not None:
            rows = rows.join(self.pins.select(F.col("source_id").alias("chunk_id"), F.lit(True).alias("_pin")).distinct(), "chunk_id", "left")
            mark = F.coalesce("_pin", F.lit(False))
        rows = rows.withColumn("is_pinned", mark).drop("_pin")
        return rows if include_content else rows.drop("content")

    def memory_stats(self) -> DataFrame:
        return self.chunks.groupBy("language").agg(
            F.count(F.lit(1)).alias("chunks"), F.sum(T.token_estimate(F.col("content"))).alias("tokens"), F.sum(F.octet_length("content")).alias("bytes"),
            F.count_if(F.coalesce(F.col("is_contract"), F.lit(False))).alias("contracts"),
        )

    def service_stats(self) -> DataFrame:
        """``metric``, ``value`` over all that the engine holds."""
        one = lambda df, name: df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
        out = one(self.files, "files").unionByName(one(self.chunks, "chunks"))
        for name, df in (("edges", self.edges), ("pins", self.pins), ("vectors", self.vectors), ("ledger", self.ledger)):
            out = out if df is None else out.unionByName(one(df, name))
        langs = self.memory_stats()
        return out.unionByName(langs.select(F.concat(F.lit("language_"), "language").alias("metric"), F.col("chunks").cast("double").alias("value")))

    def ledger_add(self, entries: DataFrame) -> DataFrame:
        self.ledger = entries if self.ledger is None else stores.add_entries(self.ledger, entries)
        return self.ledger

    def ledger_search(self, queries: DataFrame, categories: list[str] | None = None, k: int = 10) -> DataFrame:
        if self.ledger is None:
            raise ValueError("no ledger is kept")
        return stores.search_entries(self.ledger, queries, categories, within("k", k, 1, 100))

    def ledger_resolve(self, done: DataFrame) -> DataFrame:
        if self.ledger is not None:
            self.ledger = stores.resolve_entries(self.ledger, done)
        return self.ledger

    def ledger_remove(self, gone: DataFrame) -> DataFrame:
        if self.ledger is not None:
            self.ledger = stores.remove_entries(self.ledger, gone)
        return self.ledger

    def env_search(self, query: str, limit: int = 20, offset: int = 0, path_prefix: str | None = None, language: str | None = None, scope: str = "repo", regex: bool = False) -> DataFrame:
        """Text search in the chunks (repo), the contracts among them, the ledger
        (transcript), or all."""
        if not query or len(query) > 2000:
            raise ValueError("query must have 1 to 2000 characters")
        columns = [F.col(c).cast("string").alias(c) for c in ("chunk_id", "file_path", "content", "language")]
        scopes = {"repo": lambda: self.chunks.select(*columns), "contracts": lambda: self.chunks.where("is_contract").select(*columns)}
        if self.ledger is not None:
            scopes["transcript"] = lambda: self.ledger.select(F.col("entry_id").cast("string").alias("chunk_id"), F.concat_ws("/", "session_id", "category").alias("file_path"), "content", F.lit("text").alias("language"))
            scopes["all"] = lambda: scopes["repo"]().unionByName(scopes["transcript"]())
        else:
            scopes["all"] = scopes["repo"]
        if scope not in scopes:
            raise ValueError(f"unknown or empty scope: {scope}")
        return lexical.text_search(scopes[scope](), query, within("limit", limit, 1, 50), offset, path_prefix, language, regex)

    def env_peek(self, path: str, start_line: int, end_line: int, max_lines: int = 200) -> DataFrame:
        if end_line < start_line:
            raise ValueError("end_line must not be before start_line")
        return file_sources.lines(self.files.where(F.col("file_path") == path), start_line, end_line, within("max_lines", max_lines, 1, 400))

    def env_slice(self, path: str, symbol: str | None = None, context: int = 3, start_line: int | None = None, end_line: int | None = None) -> DataFrame:
        """Lines of a symbol's chunk or of a range, and around them; ``inside`` marks their own."""
        within("context", context, 0, 20)
        if symbol is not None:
            span = self.chunks.where((F.col("file_path") == path) & (F.col("symbol_name") == symbol)).select("file_path", "start_line", "end_line").orderBy("start_line").limit(1)
        elif start_line is not None and end_line is not None and start_line <= end_line:
            span = self.spark.range(1).select(F.lit(path).alias("file_path"), F.lit(start_line).alias("start_line"), F.lit(end_line).alias("end_line"))
        else:
            raise ValueError("a symbol or a range of lines is needed")
        rows = self.files.where(F.col("file_path") == path).select("file_path", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
        line = F.col("pos") + 1
        near = rows.join(span, "file_path").where(line.between(F.col("start_line") - context, F.col("end_line") + context))
        return near.select("file_path", line.alias("line"), "text", line.between(F.col("start_line"), F.col("end_line")).alias("inside")).orderBy("line")

    def env_aggregate(self, op: str, inputs: list[str], limit: int = 100, **params) -> DataFrame:
        within("inputs", len(inputs), 1, 200)
        table = self.spark.createDataFrame(list(enumerate(inputs)), "pos long, value string")
        if op == "diff_sets":
            params = {k: self.spark.createDataFrame([(i,) for i in v], "pos long") for k, v in params.items()}
            return aggregates.aggregate(op, table, **params)
        return aggregates.aggregate(op, table, limit=within("limit", limit, 1, 200), **params)

    def project_map(self, depth: int = 3, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
        """Folders and files to a depth, of the files that fit a glob of
        ``include`` (if any) and none of ``exclude``."""
        return file_sources.tree(file_sources.matching(self.files, include, exclude), within("depth", depth, 1, 10)).orderBy("path")

    def project_languages(self) -> DataFrame:
        """Files and bytes by language."""
        return self.files.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).orderBy(F.desc("files"), "language")

    def project_symbol_search(self, query: str, limit: int = 30) -> DataFrame:
        return lexical.symbol_search(self.files, query, within("limit", limit, 1, 100))

    def project_impact(self, changed: DataFrame, max_nodes: int = 100) -> DataFrame:
        """Files that the changed ones (``file_path``) import, with their kind."""
        within("max_nodes", max_nodes, 10, 500)
        rows = self.files.join(changed.select("file_path").distinct(), "file_path", "left_semi")
        found = rows.select(F.col("file_path").alias("src"), F.explode(F.slice(T.imports(F.col("content"), F.col("language")), 1, 20)).alias("dst"))
        return found.distinct().withColumn("node_type", T.node_type(F.col("dst"))).orderBy("src", "dst").limit(max_nodes)

    def project_dependents(self, nodes: DataFrame, depth: int = 3) -> DataFrame:
        """What depends on the nodes (``node``) in the code graph."""
        if self.edges is None:
            raise ValueError("no code graph is kept")
        return graph.impact(self.edges, nodes, depth)

    def project_commands(self, command_type: str | None = None) -> DataFrame:
        """Commands of build files: ``file_path``, ``name``, ``command_type``."""
        name = F.element_at(F.split("file_path", "/"), -1)
        found = F
        for file, pattern in COMMANDS.items():
            body = F.regexp_extract("content", '(?s)"scripts"\\s*:\\s*\\{(.*?)\\}', 1) if file == "package.json" else F.col("content")
            found = found.when(name == file, F.regexp_extract_all(body, F.lit(pattern), F.lit(1)))
        rows = self.files.where(name.isin(*COMMANDS)).select("file_path", F.explode(found).alias("name"))
        usual = F.create_map(*[x for f, names in USUAL.items() for x in (F.lit(f), F.array(*map(F.lit, names)))])
        known = self.files.where(name.isin(*USUAL)).select("file_path", F.explode(F.element_at(usual, name)).alias("name"))
        out = rows.unionByName(known).distinct().withColumn("command_type", T.command_type(F.col("name")))
        return out if command_type is None else out.where(F.col("command_type") == command_type)

    def rlm_plan(self, queries: list[tuple[int, str]]) -> DataFrame:
        return planner.plan_table(self.spark, queries)

    def rlm_map_reduce(self, sources: DataFrame, group: str, first: int = 10) -> DataFrame:
        """Per group of sources: how many, their tokens, and the first summaries."""
        line = F.regexp_extract("content", "^\\s*([^\\n]{0,200})", 1)
        rows = sources.select(group, "chunk_id", T.token_estimate(F.col("content")).alias("tokens"), line.alias("summary"))
        ordered = F.slice(F.array_sort(F.collect_list(F.struct("chunk_id", "summary"))), 1, first)
        return rows.groupBy(group).agg(F.count(F.lit(1)).alias("sources"), F.sum("tokens").alias("tokens"), F.transform(ordered, lambda x: x["summary"]).alias("summaries"))

    def admin_ping(self, echo: str | None = None) -> dict:
        return {"echo": echo, "uptime": time.time() - self.started, "spark": self.spark.version}

    def tools(self) -> dict[str, Callable]:
        names = ("memory_", "env_", "project_", "rlm_", "admin_", "ledger_", "service_")
        return {n: getattr(self, n) for n in dir(self) if n.startswith(names) and callable(getattr(self, n))}

    def call(self, name: str, **params):
        if name not in self.tools():
            raise ValueError(f"unknown tool: {name}")
        return self.tools()[name](**params)
