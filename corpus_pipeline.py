"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``, in their order, whatever other
columns there are and however they are named. ``run`` writes each stage's
result to the shared folder as Parquet and reads it again for the next one; the
copy before is removed then. An empty table passes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import byte_bpe, mixing, nbsvm, ngram_join, repeats
from spindrift.llm.shared import release, unused, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.5 or more). It
    is fitted on labelled documents outside the held-out fold; without labels
    all stay. Null and empty texts are scored by the classifier's intercept;
    rows without an id are scored, not learned; equal rows fare alike; a long
    text is scored whole."""
    model = nbsvm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs.columns, "score")
    return nbsvm.score(docs, model, score_col=score).where(F.col(score) >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles,
    similarity 0.8 or more): that of the smallest id, and of rows that repeat
    an id the one of the smallest text hash. Rows without an id or without
    words link with nothing and stay (the latter once for each id)."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes and more that occur elsewhere
    as well, each judged on the stage's input. All occurrences go, the first
    too: whole copies are gone before, so what repeats here is boilerplate, and
    a passage worth keeping costs its one copy. A document that consists of
    such passages stays, empty; a null text stays null; ``n_chars`` follows the
    text."""
    out = repeats.without_repeats(docs, length=200)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: documents repeated or left out. A null
    source is a source; documents without words count nothing and follow their
    source's rate; rows that agree in id and text are taken alike."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, ``n_tokens``, ``ids`` and whether these decode
    to the text's bytes. Null and empty texts have no ids."""
    import public_tokenizers

    return byte_bpe.encoded_rows(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("encoded", encoded),
]

#: A fitted classifier and byte-level merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
