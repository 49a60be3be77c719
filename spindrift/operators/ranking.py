"""Hybrid scores, fusion of ranked lists, merges and diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ancestors

# Default weights and time constant of the hybrid score.
WEIGHTS = {"embedding": 0.4, "bm25": 0.3, "recency": 0.1, "contract": 0.1, "focus": 0.05, "pinned": 0.05}
TAU_DAYS = 30.0


def rounded(value: Column, digits: int) -> Column:
    """Rounds doubles as the SQL twins do: scaled, then to the nearest whole
    number, halves away from zero; ``F.round`` goes by the printed digits and
    differs where the scaled value lies at a half. Values are rounded once: to 9
    digits and then to 6 lifts what lies just below a half."""
    return F.round(value * 10.0**digits) / 10.0**digits


def recency(updated: Column, now: Column, tau_days: float = TAU_DAYS) -> Column:
    """exp(-age in days / tau)."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(updated.cast("timestamp"))) / 86_400e6
    return F.exp(-age / tau_days)


def focus(path: Column, paths: list[str]) -> Column:
    """1 where the path holds one of the focus paths."""
    return F.greatest(*[F.contains(path, F.lit(p)).cast("double") for p in paths], F.lit(0.0), F.lit(0.0))


def hybrid_score(candidates: DataFrame, weights: dict[str, float] | None = None, multipliers: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """``final`` (to ``digits``) and ``rank`` of candidates with the columns
    ``embedding_score``, ``bm25_score`` (by the query's best), ``recency_score``,
    ``contract_score``, ``focus_score`` and ``pinned_score``; missing scores count as 0.
    ``multipliers`` (``query_id``, ``embedding``, ``bm25``, ``contract``,
    ``recency``) change the weights of a query, without renormalising."""
    w = {**WEIGHTS, **(weights or {})}
    weight = {k: F.lit(v) for k, v in w.items()}
    if multipliers is not None:
        names = ["embedding", "bm25", "contract", "recency"]
        candidates = candidates.join(multipliers.select("query_id", *[F.col(n).alias(f"_m_{n}") for n in names]), "query_id", "left")
        weight |= {n: F.lit(w[n]) * F.coalesce(F.col(f"_m_{n}"), F.lit(1.0)) for n in names}
    final = sum((weight[k] * F.coalesce(F.col(f"{k}_score"), F.lit(0.0)) for k in w), F.lit(0.0))
    order = W.partitionBy("query_id").orderBy(F.desc("final"), F.asc("chunk_id"))
    out = candidates.withColumn("final", rounded(final, digits)).withColumn("rank", F.row_number().over(order))
    return out.drop(*[c for c in out.columns if c.startswith("_m_")])


def min_max(scored: DataFrame, by: str = "query_id", score: str = "score", out: str = "norm") -> DataFrame:
    """Scores from 0 to 1 per group; equal scores are 0."""
    w = W.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return scored.withColumn(out, (F.col(score) - low) / F.when(high == low, 1.0).otherwise(high - low))


def fuse(lists: DataFrame, how: str = "boosted", k: int = 60, weights: dict[str, float] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One score per item (and per ``by``) from several lists (``chunk_id``, ``list``, ``rank``,
    ``score``): ``boosted`` (the best, 0.2 * log2 of the number of scores, 0.1
    for each further source), ``max``, ``mean``, ``rrf`` (by rank),
    ``weighted`` (by list) or ``geometric`` (of positive scores)."""
    score = F.col("score")
    if how == "weighted":
        table = F.create_map(*[F.lit(x) for pair in (weights or {}).items() for x in pair]) if weights else None
        weight = F.coalesce(F.element_at(table, F.col("list")), F.lit(0.0)) if table is not None else F.lit(1.0)
        total = F.sum(weight)
        fused = F.when(total == 0, 0.0).otherwise(F.sum(score * weight) / total)
    else:
        n, sources = F.count("score"), F.count_distinct("list")
        positive = F.when(score > 0, F.ln(score))
        fused = {
            "boosted": F.max("score") + F.when(n > 1, 0.2 * F.log2(n)).otherwise(0.0) + 0.1 * (sources - 1),
            "max": F.max("score"),
            "mean": F.avg("score"),
            "rrf": F.sum(1.0 / (k + F.col("rank"))),
            "geometric": F.coalesce(F.exp(F.avg(positive)), F.lit(0.0)),
        }[how]
    return lists.groupBy(*by, "chunk_id").agg(rounded(fused, 6).alias("score"), F.count("score").alias("n_scores"))


def fuse_incremental(current: DataFrame, batch: DataFrame, most: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds a batch (``chunk_id``, ``score``, ``source``) to fused scores
    (``chunk_id``, ``score``, ``sources``): known items get the larger score
    and 0.2, with 0.1 more from a new source; the ``most`` best (of each
    ``by``) stay."""
    key = [*by, "chunk_id"]
    new = batch.groupBy(*key).agg(F.max("score").alias("new_score"), F.min("source").alias("source"))
    joined = current.join(new, key, "full")
    known, hit = F.col("score").isNotNull(), F.col("new_score").isNotNull()
    extra = F.when(F.array_contains("sources", F.col("source")), 0.2).otherwise(0.3)
    score = F.when(known & hit, F.greatest("score", "new_score") + extra).when(known, F.col("score")).otherwise(F.col("new_score"))
    sources = F.when(known & hit, F.array_append("sources", F.col("source"))).when(known, F.col("sources")).otherwise(F.array("source"))
    out = joined.select(*key, F.round(score, 9).alias("score"), sources.alias("sources"))
    if not by:
        return out.orderBy(F.desc("score"), "chunk_id").limit(most)
    n = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "chunk_id"))
    return out.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def coverage(planned: DataFrame, answered: DataFrame) -> DataFrame:
    """``query_type`` and the share of its sub-queries (``sub_query``) with a hit."""
    hit = answered.select("sub_query").distinct().withColumn("hit", F.lit(1))
    joined = planned.join(hit, "sub_query", "left")
    return joined.groupBy("query_type").agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("coverage"))


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def merged(first: DataFrame, second: DataFrame, limit: int, second_score: float | None = None) -> DataFrame:
    """Two result lists per query (``query_id``, ``chunk_id``, ``score``) as
    one: rows of the first win, the best ``limit`` stay. ``second_score``
    replaces the scores of the second list (graph expansion: 0.5)."""
    other = second.withColumn("score", F.lit(second_score)) if second_score is not None else second
    both = first.withColumn("_o", F.lit(0)).unionByName(other.withColumn("_o", F.lit(1)))
    one = keep_first(both, ["query_id", "chunk_id"], [F.col("_o"), F.desc("score")]).drop("_o")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def rerank(scored: DataFrame, cross: Column, share: float = 0.7) -> DataFrame:
    """Mixes a second scorer's value, clipped to 0..1 or squashed, with the score."""
    squashed = F.when((cross >= 0) & (cross <= 1), cross).otherwise(1 / (1 + F.exp(-cross)))
    return scored.withColumn("score", F.round(share * squashed + (1 - share) * F.col("score"), 9))


def mmr(candidates: DataFrame, limit: int, trade: float = 0.7) -> DataFrame:
    """Maximal marginal relevance per query (``query_id``, ``chunk_id``,
    ``score``, ``vector``): greedily the item of the best trade * relevance -
    (1 - trade) * similarity to those chosen. Candidate lists are bounded by
    the retrieval before; lists within the limit stay in their order."""

    def choose(pdf):
        import numpy as np

        pdf = pdf.sort_values(["score", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
        if len(pdf) <= limit:
            return pdf.assign(rank=np.arange(1, len(pdf) + 1))[["query_id", "chunk_id", "score", "rank"]]
        v = np.stack(pdf["vector"].to_numpy()).astype(float)
        size = np.linalg.norm(v, axis=1)
        v = v / np.where(size == 0, 1, size)[:, None]
        s = pdf["score"].to_numpy(float)
        span = s.max() - s.min()
        relevance = (s - s.min()) / (span if span else 1)
        nearest, left, picked = np.zeros(len(pdf)), np.ones(len(pdf), bool), []
        for _ in range(limit):
            value = np.where(left, trade * relevance - (1 - trade) * nearest, -np.inf)
            best = np.flatnonzero(value == value.max())
            at = best[np.argmin(pdf["chunk_id"].to_numpy()[best])]
            picked.append(at)
            left[at] = False
            nearest = np.maximum(nearest, np.maximum(0, v @ v[at]))
        return pdf.iloc[picked].assign(rank=np.arange(1, limit + 1))[["query_id", "chunk_id", "score", "rank"]]

    kinds = dict(candidates.dtypes)
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double, rank long"
    return candidates.select("query_id", "chunk_id", F.col("score").cast("double").alias("score"), "vector").groupBy("query_id").applyInPandas(choose, schema)


def type_diversity(items: DataFrame, by: str, kind: str) -> DataFrame:
    """Entropy of the kinds in a group over its greatest value; one kind: 0."""
    counts = items.groupBy(by, F.coalesce(F.col(kind).cast("string"), F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy(by))
    parts = counts.withColumn("h", -share * F.log2(share)).groupBy(by).agg(F.sum("h").alias("h"), F.count(F.lit(1)).alias("kinds"))
    return parts.select(by, F.round(F.when(F.col("kinds") > 1, F.col("h") / F.log2(F.col("kinds"))).otherwise(0.0), 6).alias("diversity"))


def folder_coverage(results: DataFrame, everything: DataFrame, path: str = "path") -> DataFrame:
    """Share of all folders that the results touch."""
    folders = lambda df: df.select(F.explode(ancestors(F.col(path))).alias("folder")).where("folder <> ''").distinct()
    n = folders(results).agg(F.count(F.lit(1)).alias("touched"))
    return n.crossJoin(folders(everything).agg(F.count(F.lit(1)).alias("total"))).select("touched", "total", F.round(F.when(F.col("total") == 0, 0.0).otherwise(F.col("touched") / F.col("total")), 6).alias("coverage"))


def adjacent(chosen: DataFrame, chunks: DataFrame, gap: int = 5) -> DataFrame:
    """Chunks of the same file at most ``gap`` lines from a chosen one. Lines
    are binned by a width above any chunk's reach, so the join is on file and
    bin; of all pairs only neighbours are compared."""
    width = 256
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    a = chosen.select(F.col("chunk_id").alias("of"), "file_path", F.col("start_line").alias("s"), F.col("end_line").alias("e")).withColumn("bin", bins(F.col("s") - gap, F.col("e") + gap))
    b = chunks.select("chunk_id", "file_path", "start_line", "end_line").withColumn("bin", bins(F.col("start_line"), F.col("end_line")))
    near = (F.abs(F.col("start_line") - F.col("e")) <= gap) | (F.abs(F.col("s") - F.col("end_line")) <= gap)
    pairs = a.join(b, ["file_path", "bin"]).where(near & (F.col("chunk_id") != F.col("of")))
    return pairs.select("of", "chunk_id").distinct().join(chosen.select("chunk_id"), "chunk_id", "left_anti").select("of", "chunk_id")


def overlapping(chunks: DataFrame, nodes: DataFrame, width: int = 256) -> DataFrame:
    """The chunk of each node: same file, overlapping lines, the same name
    first, then the smallest chunk. Joined on file and line bins."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    c = chunks.select("file_path", "chunk_id", "start_line", "end_line", "symbol_name").withColumn("bin", bins(F.col("start_line"), F.col("end_line")))
    n = nodes.select("file_path", "node_id", F.col("start_line").alias("s"), F.col("end_line").alias("e"), "name").withColumn("bin", bins(F.col("s"), F.col("e")))
    hits = c.join(n, ["file_path", "bin"]).where((F.col("start_line") <= F.col("e")) & (F.col("end_line") >= F.col("s")))
    same = F.coalesce(F.col("symbol_name") == F.col("name"), F.lit(False))
    return keep_first(hits.select("node_id", "chunk_id", same.alias("same_name")).distinct(), ["node_id"], [F.desc("same_name"), F.asc("chunk_id")])
