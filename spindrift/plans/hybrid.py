"""Hybrid retrieval: both legs, their union, all score parts, in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import embedding, lexical, ranking, vectors
from . import intent


def semantic_hits(stored: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``chunk_id``, ``embedding_score`` of the k nearest vectors.
    ``stored``: chunk_id, embedding; ``asked``: query_id, embedding."""
    a = asked.select(F.col("query_id").alias("vec_id"), "embedding")
    found = vectors.knn(stored.select(F.col("chunk_id").alias("vec_id"), "embedding"), a, k=k, own=True)
    return found.select(F.col("query_vec").alias("query_id"), F.col("vec_id").alias("chunk_id"), F.col("score").alias("embedding_score"))


def pooled(lexical_hits: DataFrame, near: DataFrame, queries: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """The candidates of each query: hits of either leg, and all pinned chunks
    (``chunk_id``; a list that people keep, broadcast once counted)."""
    words = lexical_hits.select("query_id", "chunk_id", F.col("norm_score").alias("bm25_score"))
    both = words.join(near, ["query_id", "chunk_id"], "full")
    if pins is not None:
        always = queries.select("query_id").crossJoin(lexical.small(pins.select("chunk_id").distinct()))
        both = both.join(always, ["query_id", "chunk_id"], "full")
    return both


def scored(pool: DataFrame, chunks: DataFrame, now: Column, focus: list[str] | None = None) -> DataFrame:
    """Candidates with all parts of the hybrid score. ``chunks``: chunk_id,
    file_path, and as far as known ``updated_at``, ``is_contract``,
    ``is_pinned``; what is unknown counts 0. Candidates without a chunk go."""
    have = set(chunks.columns)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double") if c in have else F.lit(0.0)
    age = F.coalesce(ranking.recency(F.col("updated_at"), now), F.lit(0.0)) if "updated_at" in have else F.lit(0.0)
    return pool.join(chunks, "chunk_id").withColumns(
        {
            "bm25_score": F.coalesce("bm25_score", F.lit(0.0)),
            "embedding_score": F.coalesce("embedding_score", F.lit(0.0)),
            "recency_score": age,
            "contract_score": flag("is_contract"),
            "focus_score": ranking.focus(F.col("file_path"), focus or []),
            "pinned_score": flag("is_pinned"),
        }
    )


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    stored: DataFrame | None = None,
    asked: DataFrame | None = None,
    now: Column | None = None,
    pool: int = 100,
    limit: int | None = 20,
    focus: list[str] | None = None,
    weights: dict[str, float] | None = None,
    route: bool = True,
    second: Column | None = None,
    trade: float | None = None,
) -> DataFrame:
    """The hybrid retrieve of a table of queries (``query_id``, ``text``):
    ``pool`` hits of each leg, pinned chunks, six score parts weighted by the
    query's intent if ``route``, a second scorer's column mixed in, diversity at
    ``trade``, and the ``limit`` best.

    ``chunks``: chunk_id, content, file_path and further columns of ``scored``.
    Vectors that are not given come from the built-in embedding.
    """
    stored = embedding.embedded(chunks.select("chunk_id", "content"), "content").drop("content") if stored is None else stored
    asked = embedding.embedded(queries.select("query_id", "text"), "text").drop("text") if asked is None else asked
    pins = chunks.where("is_pinned").select("chunk_id") if "is_pinned" in chunks.columns else None
    found = pooled(lexical.bm25(chunks, queries, k=pool), semantic_hits(stored, asked, pool), queries, pins)
    parts = scored(found, chunks, F.current_timestamp() if now is None else now, focus)
    multipliers = intent.multipliers(intent.classified(queries)) if route else None
    out = ranking.hybrid_score(parts, weights, multipliers)
    if second is not None:
        out = ranking.rerank(out.join(queries.select("query_id", "text"), "query_id").withColumn("score", F.col("final")), second).withColumn("final", F.col("score")).drop("score", "text")
        out = lexical.ranked(out.drop("rank").withColumn("score", F.col("final")), 1 << 30).drop("score", "norm_score")
    if trade is not None and limit is not None:
        lists = out.where(F.col("rank") <= 5 * limit).join(stored.select("chunk_id", F.col("embedding").alias("vector")), "chunk_id")
        chosen = ranking.mmr(lists.select("query_id", "chunk_id", F.col("final").alias("score"), "vector"), limit, trade)
        return out.drop("rank").join(chosen.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"])
    return out if limit is None else out.where(F.col("rank") <= limit)
