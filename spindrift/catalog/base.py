"""Registry of queries and the tables in the engine's own columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = partial(_ranks_as_long, f)
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _ranks_as_long(f: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank numbers in the type that they have in SQL."""
    df = f(spark, sf_dir)
    return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind == "int" and c == "rank"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("lang").alias("language"), F.col("source").alias("file_path"), T.token_estimate(F.col("text")).alias("tokens"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity labels stand in for selected and contract or pinned chunks."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), (F.col("quality") == 1).alias("selected"), (F.col("toxic") == 1).alias("is_contract"), (F.pmod("doc_id", F.lit(7)) == 0).alias("is_pinned"))


#: SQL of the common parts.
TERMS = f"regexp_extract_all(translate(lower({{}}), '{T.ACCENTED}', '{T.FOLDED}'), '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"


def bm25_sql(k: int, docs: str = "(SELECT doc_id AS chunk_id, text FROM documents)", asks: str = "(SELECT item_id AS query_id, text FROM benchmark)") -> str:
    return f"""
tok AS (SELECT chunk_id, {TERMS.format('text')} AS words FROM {docs}),
stat AS (SELECT count(*) AS n_docs, avg(coalesce(len(words), 0)) AS avgdl FROM tok),
post AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(words) AS dl, unnest(words) AS term FROM tok) GROUP BY chunk_id, term),
ask AS (SELECT DISTINCT query_id, unnest({TERMS.format('text')}) AS term FROM {asks}),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
part AS (SELECT a.query_id, p.chunk_id, greatest(1e-6, ln((n_docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s
  FROM ask a JOIN post p USING (term) JOIN dfs USING (term), stat),
scored AS (SELECT query_id, chunk_id, round(sum(s), 9) AS score, count(*) AS matched FROM part GROUP BY query_id, chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored),
hits AS (SELECT query_id, chunk_id, score, rank, round(CASE WHEN max(score) OVER (PARTITION BY query_id) = 0 THEN score ELSE score / max(score) OVER (PARTITION BY query_id) END, 9) AS norm_score
  FROM ranked WHERE rank <= {k})"""


BM25 = bm25_sql(10)
