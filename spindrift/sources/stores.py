"""Stores as tables: chunks, contracts, memory entries, telemetry, retrieval logs.

Lookups take tables of keys, so any number of them is one job; writers give the
table's next state, to be kept by ``tables.commit``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import code
from ..functions import text as T
from ..operators import lexical

# ---- chunks and files ---------------------------------------------------------


def chunks_by_file(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """The chunks of some files (``file_path``), by line."""
    return chunks.join(files.select("file_path").distinct(), "file_path", "left_semi").orderBy("file_path", "start_line", "chunk_id")


def chunk_ids(chunks: DataFrame, languages: list[str] | None = None, kinds: list[str] | None = None, contracts: bool | None = None, pinned: bool | None = None, path_prefix: str | None = None) -> DataFrame:
    """Ids of the chunks that fit all filters given; all ids without any."""
    conditions: list[Column] = []
    if languages:
        conditions.append(F.col("language").isin(*languages))
    if kinds:
        conditions.append(F.col("symbol_type").isin(*kinds))
    if contracts is not None:
        conditions.append(F.coalesce(F.col("is_contract"), F.lit(False)) == contracts)
    if pinned is not None:
        conditions.append(F.coalesce(F.col("is_pinned"), F.lit(False)) == pinned)
    if path_prefix is not None:
        conditions.append(F.startswith(F.col("file_path"), F.lit(path_prefix)))
    return chunks.where(reduce(lambda a, b: a & b, conditions, F.lit(True))).select("chunk_id")


def by_ids(chunks: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks in the order of a list of ids (``pos``); unknown ids give none."""
    return chunks.join(lexical.small(ids.select("pos", key)), key).orderBy("pos")


def file_records(files: DataFrame, paths: DataFrame) -> DataFrame:
    return files.join(paths.select("file_path").distinct(), "file_path", "left_semi")


# ---- contracts ----------------------------------------------------------------


def contract_records(chunks: DataFrame) -> DataFrame:
    """A contract of each chunk that is marked as one and shows one
    (``file_path``, ``content``, ``language``, ``symbol_name``, ``start_line``, ...)."""
    best = code.best_contract(F.col("content"), F.col("language"))
    ident = code.contract_id(F.col("file_path"), F.col("symbol_name"), F.col("start_line"))
    rows = chunks.where("is_contract").withColumn("_best", best).where("_best is not null").withColumn("contract_id", ident)
    return rows.select(
        "contract_id", "chunk_id",
        F.coalesce("symbol_name", F.concat(F.lit("contract_"), F.substring("contract_id", 1, 8))).alias("name"),
        F.col("_best.contract_type").alias("contract_type"), F.col("_best.confidence").alias("confidence"),
        "file_path", "start_line", "end_line", "language",
        code.signature(F.col("content"), F.col("language")).alias("signature"),
        T.contract_dependencies(F.col("content"), F.col("language")).alias("dependencies"),
    )


def contracts(records: DataFrame, dependencies: DataFrame, implementors: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Contracts with the names they depend on and the chunks that implement
    them, as sorted arrays; those of ``ids`` (``contract_id``), or all."""
    if ids is not None:
        records, dependencies, implementors = (x.join(lexical.small(ids.select("contract_id").distinct()), "contract_id", "left_semi") for x in (records, dependencies, implementors))
    listed = lambda df, c, name: df.groupBy("contract_id").agg(F.array_sort(F.collect_set(c)).alias(name))
    none = lambda name: F.coalesce(F.col(name), F.array().cast("array<string>"))
    out = records.drop("dependencies").join(listed(dependencies, F.col("name").cast("string"), "dependencies"), "contract_id", "left").join(listed(implementors, F.col("chunk_id").cast("string"), "implementors"), "contract_id", "left")
    return out.withColumns({n: none(n) for n in ("dependencies", "implementors")})


def contracts_named(records: DataFrame, name: str, fuzzy: bool = False) -> DataFrame:
    """Contracts of a name, or with ``fuzzy`` those whose names hold it in any case."""
    return records.where(F.contains(F.lower("name"), F.lit(name.lower())) if fuzzy else F.col("name") == name)


def contract_chunk_ids(records: DataFrame) -> DataFrame:
    return records.select("chunk_id").distinct()


def contract_statistics(records: DataFrame, dependencies: DataFrame, implementors: DataFrame) -> DataFrame:
    """``metric``, ``value``: contracts in all and by type, dependencies, implementors."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
    kinds = records.groupBy("contract_type").agg(F.count(F.lit(1)).alias("value")).select(F.concat(F.lit("type_"), "contract_type").alias("metric"), "value")
    return n(records, "contracts").unionByName(kinds).unionByName(n(dependencies, "dependencies")).unionByName(n(implementors, "implementors"))


# ---- memory entries -----------------------------------------------------------


def add_entries(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """The ledger with new entries; an entry of a known id takes its place."""
    return ledger.join(entries.select("entry_id"), "entry_id", "left_anti").unionByName(entries.dropDuplicates(["entry_id"]), allowMissingColumns=True)


def resolve_entries(ledger: DataFrame, done: DataFrame) -> DataFrame:
    """The ledger with some entries (``entry_id``) marked as resolved."""
    hit = done.select("entry_id").distinct().withColumn("_hit", F.lit(True))
    return ledger.join(hit, "entry_id", "left").withColumn("resolved", F.coalesce("_hit", "resolved", F.lit(False))).drop("_hit").select(*ledger.columns)


def remove_entries(ledger: DataFrame, gone: DataFrame) -> DataFrame:
    return ledger.join(gone.select("entry_id").distinct(), "entry_id", "left_anti")


def entries(ledger: DataFrame, session: str | None = None, categories: list[str] | None = None, open_only: bool = False, limit: int = 50) -> DataFrame:
    """The latest entries that fit the filters."""
    out = ledger
    if session is not None:
        out = out.where(F.col("session_id") == session)
    if categories:
        out = out.where(F.col("category").isin(*categories))
    if open_only:
        out = out.where(~F.coalesce(F.col("resolved"), F.lit(False)))
    return out.orderBy(F.desc("created_at"), "entry_id").limit(limit)


def search_entries(ledger: DataFrame, queries: DataFrame, categories: list[str] | None = None, k: int = 10) -> DataFrame:
    """``query_id``, ``entry_id``, ``score``, ``rank``: entries by BM25."""
    rows = ledger if not categories else ledger.where(F.col("category").isin(*categories))
    found = lexical.bm25(rows.select(F.col("entry_id").alias("chunk_id"), "content"), queries, k=k)
    return found.select("query_id", F.col("chunk_id").alias("entry_id"), "score", "rank")


# ---- telemetry ----------------------------------------------------------------

# Names and types of the points that the engine records of itself.
RECORDERS = {
    "retrieval_latency_ms": "retrieval", "retrieval_entropy": "retrieval", "indexing_rate_cps": "indexing", "embedding_latency_ms": "embedding",
    "pack_tokens": "pack", "pack_chunks": "pack", "pack_latency_ms": "pack", "error_count": "error",
}


def points(rows: DataFrame, ts: str = "ts", value: str = "value", name: str = "name", tags: Column | None = None) -> DataFrame:
    """Metric points: the type follows from the name (others are ``custom``);
    rows without a value or a finite one are no points."""
    known = F.create_map(*[F.lit(x) for pair in RECORDERS.items() for x in pair])
    fine = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    return rows.where(fine).select(
        F.coalesce(F.element_at(known, F.col(name)), F.lit("custom")).alias("metric_type"), F.col(name).alias("name"), F.col(value).cast("double").alias("value"), F.col(ts).cast("timestamp").alias("ts"),
        (F.create_map().cast("map<string,string>") if tags is None else tags).alias("tags"),
    )


def flushes(recorded: DataFrame, size: int = 100, by: str = "source", order: str = "ts", tie: str = "event_id") -> DataFrame:
    """The number of the flush (``flush``) in which each point of a recorder's
    buffer of ``size`` points is written."""
    n = F.row_number().over(W.partitionBy(by).orderBy(order, tie))
    return recorded.withColumn("flush", F.floor((n - 1) / size).cast("long"))


def pruned(raw: DataFrame, now: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Points of the last ``days``, and the roll-up by day of the older ones."""
    old = F.col("ts") < now.cast("timestamp") - F.make_dt_interval(F.lit(days))
    rolled = raw.where(old).groupBy("metric_type", "name", F.to_date("ts").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.avg("value").alias("mean")
    )
    return raw.where(~old), rolled


def metric_names(raw: DataFrame) -> DataFrame:
    return raw.select("name").distinct()


# ---- retrieval log --------------------------------------------------------------


def logged(hits: DataFrame, queries: DataFrame, intents: DataFrame, session: Column, now: Column, most: int = 20) -> DataFrame:
    """An event of each retrieval: its query, intent, and retrieved chunks with
    their scores, in order."""
    listed = hits.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("_h"))
    rows = queries.join(listed, "query_id", "left").join(intents.select("query_id", "intent"), "query_id", "left")
    return rows.select(
        F.col("query_id").alias("event_id"), session.alias("session_id"), F.col("text").alias("query"), F.coalesce("intent", F.lit("general")).alias("query_intent"),
        F.coalesce(F.transform("_h", lambda x: x["chunk_id"].cast("string")), F.array().cast("array<string>")).alias("retrieved"),
        F.coalesce(F.transform("_h", lambda x: x["score"]), F.array().cast("array<double>")).alias("scores"),
        F.lit(None).cast("string").alias("outcome"), now.alias("ts"),
    )


def labelled(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Events with the outcome that their session was given (``session_id``,
    ``outcome``); those of other sessions keep theirs."""
    given = outcomes.groupBy("session_id").agg(F.max("outcome").alias("_given"))
    return events.join(given, "session_id", "left").withColumn("outcome", F.coalesce("_given", "outcome")).drop("_given").select(*events.columns)


def compactions(log: DataFrame, by: str = "session_id") -> DataFrame:
    """How often each session was compacted, from an append-only log."""
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("compactions"), F.max("ts").alias("last"))
