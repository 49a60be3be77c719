"""Words counted and scores added in Arrow batches, against plain loops, SQL and the joined form."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import counting, lexical

ODD = [None, "", "  ", "Éclair éclair ECLAIR eclair", "İstanbul ΑΣ ΑΣ'Α ß", "áb x²y Ⅷ 数字 snake_case", "a\x0bb\tc d", "😀 face", "the the the"]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["Été", "ÉTÉ", "naïve"]
    texts = [*ODD, *(" ".join(rng.choices(words, k=rng.randrange(1, 25))) for _ in range(300)), *["w1 w2 w3"] * 40]
    asks = [(q, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for q in range(12)] + [(12, ""), (13, None), (14, "nowhere"), (15, "eclair the istanbul")]
    return table(spark, list(enumerate(texts)), "chunk_id long, content string").repartition(3), table(spark, asks, "query_id long, text string")


def test_words_are_those_of_terms(spark, corpus):
    chunks, _ = corpus
    want = {r.chunk_id: Counter(r.words or []) for r in chunks.select("chunk_id", T.terms(F.col("content")).alias("words")).collect()}
    words = sorted({w for c in want.values() for w in c})
    got = {r.chunk_id: (r.dl, {words[c]: n for c, n in zip(r.codes, r.tfs, strict=True)}) for r in counting.counted(chunks.select("chunk_id", F.col("content").alias("text")), words).collect()}
    assert got == {k: (sum(c.values()), dict(c)) for k, c in want.items()}
    df = Counter(w for c in want.values() for w in c)
    assert {r.term: r.df for r in lexical.corpus_frequencies(chunks).collect()} == df


@pytest.mark.parametrize("match", ["any", "all"])
@pytest.mark.parametrize("scores", [1, 1 << 21])  # a block of 64 rows, and of all
def test_counted_scores_equal_joined_ones(spark, corpus, monkeypatch, match, scores):
    chunks, asks = corpus
    rows = lambda: sorted(tuple(r) for r in lexical.bm25(chunks, asks, k=7, match=match).select("query_id", "chunk_id", F.round("score", 8), "rank").collect())
    monkeypatch.setattr(counting, "SCORES", scores)
    got = rows()
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    assert got and got == rows()


def test_results_of_bm25_do_not_read_the_corpus_again(spark, corpus):
    found = lexical.bm25(*corpus, k=5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and "LogicalRDD" in plan and "Aggregate" not in plan


@pytest.mark.parametrize("k", [3, 500])
def test_word_overlap_equals_a_loop(spark, corpus, monkeypatch, k):
    chunks, asks = corpus
    c = chunks.select("chunk_id", F.coalesce("content", F.lit("")).alias("content"), F.concat(F.lit("src/w"), (F.col("chunk_id") % 5).cast("string")).alias("file_path"), (F.col("chunk_id") * 7 % 400).alias("age"), (F.col("chunk_id") % 11 == 0).alias("pin"))
    split = lambda x: [w for w in re.split(r"[ \t\n\f\r]+", x) if w]
    docs = [(r.chunk_id, set(split(r.low)[:1000]), set(split(re.sub("[/_-]", " ", r.file_path))), 0.1 * max(0.0, 1 - r.age / 168) + (0.2 if r.pin else 0.0)) for r in c.withColumn("low", F.lower("content")).collect()]
    want = set()
    for q, text in ((r.query_id, r.text) for r in asks.collect()):
        wanted = set(split((text or "").lower()))
        n = max(1, len(wanted))
        score = {i: min(1.0, 0.3 * len(wanted & p) / n + 0.5 * len(wanted & w) / n + b) for i, w, p, b in docs if wanted & p or wanted & w or b > 0}
        best = sorted(((math.floor(s * 1e6 + 0.5) / 1e6, i) for i, s in score.items()), key=lambda x: (-x[0], x[1]))[:k]
        want |= {(q, i, s, rank) for rank, (s, i) in enumerate(best, 1)}
    got = lambda: {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in lexical.word_overlap(c, asks, k=k, hours="age", pinned="pin").collect()}
    assert got() == want
    monkeypatch.setattr(counting, "SCORES", 1)
    assert got() == want


def test_verdicts_add_in_the_order_of_ranks(spark):
    from spindrift.plans import correction

    rng = random.Random(4)
    rows = [(q, rank, rng.randrange(30) / 100) for q in range(300) for rank in range(1, 11)]
    rng.shuffle(rows)
    by = {}
    for q, rank, x in sorted(rows):
        by[q] = by.get(q, 0.0) + x
    got = correction.verdict(table(spark, rows, "query_id long, rank int, relevance double").repartition(4), spark.range(301).withColumnRenamed("id", "query_id")).collect()
    want = {q: "correct" if t / 10 >= 0.5 else "incorrect" if t / 10 <= 0.15 else "ambiguous" for q, t in by.items()} | {300: "incorrect"}
    assert {r.query_id: r.quality for r in got} == want
