"""Corrective retrieval: how relevant are the results, and what else to ask."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import any_of
from ..operators.ranking import merged

CORRECT, INCORRECT = 0.5, 0.15
# Words too general to search for alone.
GENERAL_WORDS = {"class", "function", "method", "implementation", "definition", "code", "file", "module", "the", "how", "what", "where", "when", "does", "is", "are", "work", "works", "type", "interface"}


def relevance(hits: DataFrame) -> DataFrame:
    """Adds ``relevance`` (0 to 1) to hits with ``text`` (the query's),
    ``content``, ``file_path`` and optionally ``symbol_name``, ``symbol_type``,
    ``is_contract``."""
    have = set(hits.columns)
    col = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)))
    asked, low = words(F.col("text")), F.lower("text")
    n = F.greatest(F.size(asked), F.lit(1))
    name, kind = F.lower(col("symbol_name", "string")), col("symbol_type", "string")
    in_name = F.coalesce(F.exists(asked, lambda w: (F.length(w) > 2) & F.contains(name, w)), F.lit(False))
    how = any_of(low, ["how", "implement"]) & kind.isin("function_definition", "method_definition")
    what = any_of(low, ["what", "type"]) & (F.coalesce(col("is_contract", "boolean"), F.lit(False)) | kind.isin("interface_declaration", "type_alias_declaration", "class_definition"))
    size = F.length("content")
    score = (
        0.3 * F.size(F.array_intersect(asked, words(F.col("content")))) / n
        + F.when(in_name, 0.2).otherwise(0.0)
        + F.when(how, 0.15).otherwise(0.0)
        + F.when(what, 0.15).otherwise(0.0)
        + 0.15 * F.size(F.array_intersect(asked, words(F.col("file_path")))) / n
        + F.when((size > 50) & (size < 2000), 0.1).otherwise(0.0)
        + F.when(any_of(F.col("content"), ['"""', "'''", "/**"]), 0.1).otherwise(0.0)
    )
    return hits.withColumn("relevance", F.round(F.least(score, F.lit(1.0)), 6))


def verdict(evaluated: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """``query_id``, ``avg_relevance``, ``quality`` and ``confidence`` from the
    ``top`` first hits; no hits at all are incorrect, with confidence 0."""
    # added in the order of ranks, as the SQL does: a mean may lie at a threshold
    values = F.transform(F.array_sort(F.collect_list(F.when(F.col("relevance").isNotNull(), F.struct("rank", "relevance")))), lambda x: x["relevance"])
    mean = evaluated.where(F.col("rank") <= top).groupBy("query_id").agg(F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values)).alias("m"))
    j = queries.select("query_id").join(mean, "query_id", "left")
    quality = F.when(F.col("m") >= CORRECT, "correct").when(F.col("m").isNull() | (F.col("m") <= INCORRECT), "incorrect").otherwise("ambiguous")
    sure = F.when(F.col("m").isNull(), 0.0).when(F.col("m") >= CORRECT, F.col("m")).when(F.col("m") <= INCORRECT, 1 - F.col("m")).otherwise(0.5)
    return j.select("query_id", F.round(F.col("m") + 1e-9, 6).alias("avg_relevance"), quality.alias("quality"), F.round(sure + 1e-9, 6).alias("confidence"))


# Forms of names in a query, and the question that gives way to its keywords.
NAME = "[A-Z][a-z]+(?:[A-Z][a-z]+)+", "[a-z]+(?:_[a-z]+)+"
QUESTION = "^(?:how|what|where|when)\\s+(?:does|do|is|are)\\s+"
#: Names that are asked for, and rewrites of a query at most.
NAMES, MOST = 2, 3


def rewrites(query: Column) -> Column:
    """Other ways to ask, at most ``MOST``: each name with "implementation" and
    alone, a question's keywords, tests of the names. Equal ones (but for case)
    count once."""
    general = F.array(*map(F.lit, sorted(GENERAL_WORDS)))
    found = F.concat(*[F.regexp_extract_all(query, F.lit(p), F.lit(0)) for p in NAME])
    names = F.slice(F.filter(found, lambda w: ~F.array_contains(general, F.lower(w))), 1, NAMES)
    low = F.lower(query)
    keywords = F.trim(F.regexp_replace(F.regexp_replace(low, QUESTION, ""), "^[?]+|[?]+$", ""))
    asks = low.rlike("^(?:how|what|where|when)") & ~F.array_contains(general, keywords)
    none = F.array().cast("array<string>")
    options = F.concat(
        F.flatten(F.transform(names, lambda w: F.array(F.concat(w, F.lit(" implementation")), w))),
        F.when(asks, F.array(keywords)).otherwise(none),
        F.when(F.contains(low, F.lit("test")) & (F.size(names) > 0), F.array(F.concat(F.lit("test "), F.array_join(names, " ")))).otherwise(none),
    )
    lower = F.transform(options, lambda x: F.lower(x))
    return F.slice(F.filter(options, lambda x, i: (x != "") & (F.array_position(lower, F.lower(x)) == i + 1)), 1, MOST)


def corrected(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], evaluate: Callable[[DataFrame, DataFrame], DataFrame], limit: int = 20) -> DataFrame:
    """Results of all queries, corrected: correct ones stay, incorrect ones give
    way to the rewrite of greatest confidence, ambiguous ones are merged with
    it. All rewrites of all queries run as one retrieval.

    ``retrieve(queries)`` gives query_id, chunk_id, score, rank;
    ``evaluate(hits, queries)`` gives a ``verdict``.
    """
    first = retrieve(queries)
    judged = evaluate(first, queries)
    asked = queries.join(judged.where("quality <> 'correct'"), "query_id").select("query_id", F.posexplode(rewrites(F.col("text"))).alias("n", "text"))
    asked = asked.select(F.concat_ws("#", "query_id", "n").alias("query_id"), F.col("query_id").alias("of"), "text")
    second = retrieve(asked.select("query_id", "text"))
    scores = evaluate(second, asked.select("query_id", "text")).join(asked.select("query_id", "of"), "query_id")
    best = scores.withColumn("_n", F.row_number().over(W.partitionBy("of").orderBy(F.desc("confidence"), "query_id"))).where((F.col("_n") == 1) & (F.col("confidence") > INCORRECT))
    other = second.join(best.select("query_id", "of"), "query_id").select(F.col("of").cast(dict(queries.dtypes)["query_id"]).alias("query_id"), "chunk_id", "score")
    redone = other.select("query_id").distinct()
    kept = first.select("query_id", "chunk_id", "score").join(judged.select("query_id", "quality"), "query_id")
    keep = kept.join(redone.withColumn("redone", F.lit(True)), "query_id", "left").where("quality <> 'incorrect' OR redone IS NULL")
    return merged(keep.select("query_id", "chunk_id", "score"), other, limit)
