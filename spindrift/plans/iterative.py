"""Retrieval in several steps, for a whole table of questions at a time:
over the graph, by plan, by program, with a judge after each round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import any_of
from ..operators import graph, ranking, statistics
from ..operators.lexical import among
from ..operators.lineage import cut
from . import intent

Retrieve = Callable[[DataFrame], DataFrame]
#: Seeds of a multi-hop retrieval at most.
SEEDS = 10
#: Entropy below which results are sure.
SURE = 0.3


# ---- chunks and nodes ----------------------------------------------------------


def nodes_for_chunks(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``chunk_id`` and ``node``: the node of a chunk's id, else one of its file
    and symbol; of several the smallest. Chunks without a node are left out."""
    own = nodes.where("chunk_id is not null").groupBy("chunk_id").agg(F.min("node_id").alias("_own"))
    named = nodes.groupBy("file_path", F.col("name").alias("symbol_name")).agg(F.min("node_id").alias("_named"))
    joined = chunks.select("chunk_id", "file_path", "symbol_name").join(own, "chunk_id", "left").join(named, ["file_path", "symbol_name"], "left")
    return joined.withColumn("node", F.coalesce("_own", "_named")).where("node is not null").select("chunk_id", "node")


def chunks_for_nodes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The chunks of nodes (``query_id``, ``node``, ``score``), each once with its best score."""
    known = nodes.where("chunk_id is not null").select(F.col("node_id").alias("node"), "chunk_id")
    return found.join(known, "node").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def related_interfaces(edges: DataFrame, starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and the interfaces and types that it implements or uses."""
    steps = edges.where(F.col("edge_type").isin("IMPLEMENTS", "USES_TYPE")).select(F.col("src").alias("node"), F.col("dst").alias("node_id"))
    return starts.select("node").distinct().join(steps, "node").distinct().join(nodes.select("node_id", "node_type", "name"), "node_id").select("node", F.col("node_id").alias("interface"), "node_type", "name")


# ---- multi-hop and enhanced ------------------------------------------------------


def multi_hop_retrieve(hits: DataFrame, intents: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """``query_id``, ``chunk_id``, ``score``, ``rank``: the first hits as seeds,
    what lies around them by the strategy of each question's intent, seeds first
    on equal chunks. ``hits``: query_id, chunk_id, score, rank."""
    seeds = hits.where(F.col("rank") <= min(limit, SEEDS)).select("query_id", "chunk_id", "score")
    placed = seeds.join(nodes_for_chunks(chunks, nodes), "chunk_id").join(intents.select("query_id", "intent"), "query_id", "left")
    strategy = F.when(F.col("intent").isin(*graph.STRATEGIES), F.col("intent")).otherwise("default")
    placed = cut(placed.withColumn("strategy", strategy))
    around = None
    for name, hops in graph.STRATEGIES.items():
        part = graph.multi_hop(edges, placed.where(F.col("strategy") == name).groupBy("query_id", "node").agg(F.max("score").alias("score")), hops)
        around = part if around is None else around.unionByName(part)
    return ranking.merged(seeds, chunks_for_nodes(around, nodes), limit)


def enhanced(queries: DataFrame, hits: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 20, threshold: float | None = None) -> DataFrame:
    """Routed retrieval: questions whose intent asks for it are expanded over the
    graph, the others keep their hits. Adds ``intent``, ``expanded``, the list's
    ``entropy`` and whether it passes a calibrated ``threshold``."""
    routes = intent.multipliers(intent.classified(queries)).select("query_id", "intent", "expand")
    wide = routes.where("expand")
    far = multi_hop_retrieve(hits.join(wide.select("query_id"), "query_id", "left_semi"), wide, chunks, nodes, edges, limit)
    near = hits.where(F.col("rank") <= limit).join(wide.select("query_id"), "query_id", "left_anti").select(*far.columns)
    both = far.unionByName(near)
    stats = statistics.score_statistics(both, "query_id").select("query_id", F.col("norm_entropy").alias("entropy"))
    out = both.join(routes, "query_id").join(stats, "query_id").withColumnRenamed("expand", "expanded")
    return out if threshold is None else out.withColumn("unsure", F.col("entropy") >= threshold)


def prefer_types(hits: DataFrame, kinds: list[str], boost: float = 1.5) -> DataFrame:
    """Hits with chunks of the preferred symbol types in front, their scores raised."""
    preferred = F.coalesce(F.col("symbol_type").isin(*kinds), F.lit(False))
    raised = hits.withColumn("_p", preferred).withColumn("score", F.when(F.col("_p"), F.col("score") * boost).otherwise(F.col("score")))
    order = W.partitionBy("query_id").orderBy(F.desc("_p"), F.desc("score"), "chunk_id")
    return raised.withColumn("rank", F.row_number().over(order)).drop("_p")


def focus_folders(hits: DataFrame, chunks: DataFrame, first: int = 10, most: int = 3) -> DataFrame:
    """The commonest folders of each question's first hits: ``query_id``, ``folder``, ``n``, ``rank``."""
    folder = F.regexp_extract("file_path", "^(.+)/[^/]*$", 1)
    n = hits.where(F.col("rank") <= first).join(chunks.select("chunk_id", "file_path"), "chunk_id").withColumn("folder", folder).where("folder <> ''").groupBy("query_id", "folder").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("query_id").orderBy(F.desc("n"), "folder")
    return n.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


# ---- filters on fused results -----------------------------------------------------


def scoring(fused: DataFrame, least: float) -> DataFrame:
    return fused.where(F.col("score") >= least)


def from_sources(fused: DataFrame, least: int) -> DataFrame:
    """Items that ``least`` scores or more were fused into (repeats of a source count)."""
    return fused.where(F.col("n_scores") >= least)


def contracts_only(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    return fused.join(chunks.where("is_contract").select("chunk_id").distinct(), "chunk_id", "left_semi")


def named_like(hits: DataFrame, names: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits whose symbol holds the name that was looked up (``query_id``, ``name``; case counts)."""
    joined = hits.join(chunks.select("chunk_id", "symbol_name"), "chunk_id").join(names, "query_id")
    return joined.where(F.contains("symbol_name", F.col("name"))).drop("name")


# ---- rounds ----------------------------------------------------------------------


def iterate(queries: DataFrame, first: DataFrame, plan: DataFrame, retrieve: Retrieve, rounds: int = 3, per: int = 20, most: int = 50) -> DataFrame:
    """``query_id``, ``chunk_id``, ``score``, ``rank`` and ``rounds``: the first
    hits, then one sub-query a round in the plan's order, fused in; a question is
    done once its results are sure (entropy below ``SURE``) or its plan is. Each
    round is one retrieval for all questions that go on."""
    order = W.partitionBy("of").orderBy("query_id")
    plan = cut(plan.withColumn("turn", F.row_number().over(order)))
    fused = cut(first.select("query_id", "chunk_id", F.col("score").cast("double").alias("score"), F.array(F.lit("first")).alias("sources")))
    spent = queries.select("query_id", F.lit(0).alias("rounds"))
    for turn in range(1, rounds + 1):
        unsure = statistics.score_statistics(fused, "query_id").where(F.col("norm_entropy") >= SURE).select(F.col("query_id").alias("of"))
        live = cut(plan.where(F.col("turn") == turn).join(unsure, "of", "left_semi"))
        if live.isEmpty():
            break
        hits = retrieve(live.select("query_id", "text")).where(F.col("rank") <= per).join(live.select("query_id", "of", "query_type"), "query_id")
        batch = hits.select(F.col("of").alias("query_id"), "chunk_id", "score", F.col("query_type").alias("source"))
        fused = cut(ranking.fuse_incremental(fused, batch, most, by=("query_id",)))
        spent = spent.join(live.select(F.col("of").alias("query_id"), F.lit(turn).alias("_t")), "query_id", "left").select("query_id", F.coalesce("_t", "rounds").alias("rounds"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return fused.drop("sources").withColumn("rank", F.row_number().over(w)).join(spent, "query_id", "left")


def follow_ups(plan: DataFrame, hits: DataFrame, chunks: DataFrame, first: int = 5, new: int = 2, most: int = 10) -> DataFrame:
    """Further sub-queries (``of``, ``text``) for symbols among the first results
    that no sub-query has named, while a plan has fewer than ``most``."""
    names = hits.where(F.col("rank") <= first).join(chunks.select("chunk_id", "symbol_name"), "chunk_id").where("symbol_name is not null").select(F.col("query_id").alias("of"), "symbol_name").distinct()
    have = plan.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.collect_set("text").alias("texts"))
    fresh = names.join(have, "of").where(~F.exists("texts", lambda t: F.contains(t, F.col("symbol_name"))))
    n = F.row_number().over(W.partitionBy("of").orderBy("symbol_name"))
    return fresh.withColumn("_n", n).where((F.col("_n") <= new) & (F.col("_n") + F.col("n") <= most)).select("of", F.concat(F.lit("related to "), "symbol_name").alias("text"))


# Forms of symbols in a question, words that are none, and what asks for context.
SYMBOL = "\\b([A-Z][a-zA-Z0-9]+|[a-z]+_[a-z_]+)\\b"
NO_SYMBOLS = ["How", "What", "Where", "When", "Why"]
TRACES = ["how does", "trace", "flow"]


def programs(questions: DataFrame, with_graph: bool = True) -> DataFrame:
    """A program of operations for each question: ``query_id``, ``op_id``,
    ``op_type``, ``query``, ``depends_on``."""
    text = F.col("text")
    found = F.filter(F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(1)), lambda s: ~s.isin(*NO_SYMBOLS))
    op = lambda i, kind, q, *needs: F.struct(i.alias("op_id"), F.lit(kind).alias("op_type"), q.alias("query"), F.array(*map(F.lit, needs)).cast("array<string>").alias("depends_on"))
    if_ = lambda holds, x: F.when(holds, F.array(x)).otherwise(F.slice(F.array(x), 1, 0))
    some = F.size(found) > 0
    steps = F.concat(
        F.array(op(F.lit("op1"), "semantic_search", text)),
        F.transform(F.slice(found, 1, 2), lambda s, i: op(F.concat(F.lit("op_symbol_"), i.cast("string")), "symbol_lookup", s)),
        if_(some & F.lit(with_graph), op(F.lit("op_graph"), "graph_traverse", F.coalesce(F.get(found, F.lit(0)), F.lit("")), "op_symbol_0")),
        if_(any_of(F.lower(text), TRACES), op(F.lit("op_expand"), "expand_context", text, "op1")),
    )
    return questions.where("text is not null").select("query_id", F.explode(steps).alias("s")).select("query_id", "s.*")


def judged(queries: DataFrame, hits: DataFrame, chunks: DataFrame, first: int = 10) -> DataFrame:
    """``relevance`` (mean share of a question's words in its first results) and
    the ``decision``: continue, refine or retry."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "\\s+"), lambda w: w != ""))
    hits = hits.where(F.col("rank") <= first)
    rows = hits.join(among(chunks, hits, "content").select("chunk_id", words(F.col("content")).alias("have")), "chunk_id").join(queries.select("query_id", words(F.col("text")).alias("want")), "query_id")
    # divided once, from whole numbers: a mean at a threshold does not hang on the order of its hits
    found = F.size(F.array_intersect("want", "have"))
    mean = rows.groupBy("query_id").agg(F.try_divide(F.sum(found), F.count(found) * F.max(F.greatest(F.size("want"), F.lit(1)))).alias("m"))
    m = F.coalesce("m", F.lit(0.0))
    decision = F.when(m >= 0.6, "continue").when(m >= 0.3, "refine").otherwise("retry")
    return queries.select("query_id").join(mean, "query_id", "left").select("query_id", ranking.rounded(m, 6).alias("relevance"), decision.alias("decision"), F.col("m").isNull().alias("empty"))


def refinements(queries: DataFrame, verdicts: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """What to ask in the next round (``of``, ``text``): symbols of the first
    five results where the results are to be refined, the first five words where
    there were none, and the question again without its case else."""
    names = hits.where("rank <= 5").join(chunks.select("chunk_id", "symbol_name"), "chunk_id").where("symbol_name is not null").groupBy("query_id").agg(F.array_sort(F.collect_set("symbol_name")).alias("names"))
    rows = queries.join(verdicts.where("decision <> 'continue'"), "query_id").join(names, "query_id", "left")
    broad = F.array_join(F.slice(F.split(F.trim("text"), "\\s+"), 1, 5), " ")
    related = F.transform(F.slice(F.coalesce("names", F.array().cast("array<string>")), 1, 2), lambda s: F.concat(F.lit("related to "), s))
    asks = F.when(F.col("empty"), F.array(broad)).when(F.col("decision") == "refine", related).otherwise(F.array(F.lower("text")))
    return rows.select(F.col("query_id").alias("of"), F.explode(asks).alias("text"))


def quality_loop(queries: DataFrame, first: DataFrame, chunks: DataFrame, retrieve: Retrieve, rounds: int = 2, limit: int = 20) -> DataFrame:
    """Retrieves again what a round's judge is not content with; new chunks come
    behind those already found, in the order of their finding, and a chunk's
    final score is one over its place."""
    found = cut(first.select("query_id", "chunk_id", F.lit(0).alias("round"), F.col("rank").cast("long").alias("at")))
    for r in range(1, rounds + 1):
        place = F.row_number().over(W.partitionBy("query_id").orderBy("round", "at", "chunk_id"))
        now = found.withColumn("rank", place)
        verdicts = cut(judged(queries, now, chunks))
        asks = refinements(queries, verdicts, now, chunks)
        asks = cut(asks.withColumn("query_id", F.col("of") * 100 + F.row_number().over(W.partitionBy("of").orderBy("text"))))
        if asks.isEmpty():
            break
        hits = retrieve(asks.select("query_id", "text")).join(asks.select("query_id", "of"), "query_id")
        new = hits.groupBy(F.col("of").alias("query_id"), "chunk_id").agg(F.min(F.struct(F.col("query_id"), F.col("rank"))).alias("_m"))
        new = new.select("query_id", "chunk_id", F.lit(r).alias("round"), (F.col("_m.query_id") * 1000 + F.col("_m.rank")).alias("at")).join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        found = cut(found.unionByName(new))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("round", "at", "chunk_id"))
    return by_place(found.withColumn("rank", place).where(F.col("rank") <= limit).drop("at"))


def by_place(ranked: DataFrame) -> DataFrame:
    """Scores by place: one over the rank."""
    return ranked.withColumn("score", 1 / F.col("rank"))


def decomposed(questions: DataFrame, decompose: Callable[[DataFrame], DataFrame] | None = None, plan: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Sub-queries by a given decomposer (a function of the questions' table to
    ``of``, ``text``, ``query_type``, ``priority``: a model, a service, rules);
    questions it does not answer get the rules' plan."""
    from .planner import planned

    rules = (plan or planned)(questions)
    if decompose is None:
        return rules
    own = decompose(questions).select("of", "text", "query_type", F.col("priority").cast("int").alias("priority"))
    n = F.row_number().over(W.partitionBy("of").orderBy(F.desc("priority"), "text"))
    numbered = own.withColumn("_n", n).where("_n <= 10").withColumn("query_id", F.col("of") * 10 + F.col("_n") - 1)
    return numbered.select(*rules.columns).unionByName(rules.join(own.select("of").distinct(), "of", "left_anti").select(*rules.columns))

