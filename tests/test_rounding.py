"""Scores at and just below a half of the last digit, as the queries' SQL rounds them."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift import catalog
from spindrift.catalog import analytics, retrieval
from spindrift.plans import iterative


def near_a_half(spark, folder, weight):
    """Pinned chunks 7 and 14 score 0.05 and ``weight`` of their recency:
    0.1234562 and 0.1234564996, of which 9 digits are 0.1234565."""
    now = datetime(2024, 1, 1)
    age = lambda final: timedelta(microseconds=round(-math.log((final - 0.05) / weight) * 30 * 86400e6))
    tables = {
        "documents": ([(7, "word", "en", "s"), (14, "word", "en", "s")], "doc_id long, text string, lang string, source string"),
        "benchmark": ([(1, "alpha")], "item_id long, text string"),
        "labels": ([(7, 0, 0), (14, 0, 0)], "doc_id long, quality int, toxic int"),
        "events": ([(7, now - age(0.1234562)), (14, now - age(0.1234564996)), (1000, now)], "event_id long, ts timestamp_ntz"),
        "embeddings": ([(99, [1.0, 0.0])], "vec_id long, embedding array<float>"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["hybrid_score", "hybrid_retrieve"])
def test_hybrid_scores_are_rounded_once(spark, tmp_path, name):
    sf, con = near_a_half(spark, tmp_path, 0.1)
    got = [(r.chunk_id, r.final, r["rank"]) for r in catalog.QUERIES[name](spark, sf).orderBy("rank").collect()]
    assert got == [(7, 0.123456, 1), (14, 0.123456, 2)]
    assert got == con.execute(f"SELECT chunk_id, final, rank FROM ({catalog.ORACLE_SQL[name]}) ORDER BY rank").fetchall()


def test_routed_scores_are_rounded_once(spark, tmp_path):
    sf, con = near_a_half(spark, tmp_path, 0.1 * 0.8)  # question 1 asks how: implementation
    got = [(r.chunk_id, r.intent, r.final, r["rank"]) for r in catalog.QUERIES["hybrid_routed"](spark, sf).orderBy("rank").collect()]
    assert got == [(7, "implementation", 0.123456, 1), (14, "implementation", 0.123456, 2)]
    assert got == con.execute(f"SELECT chunk_id, intent, final, rank FROM ({catalog.ORACLE_SQL['hybrid_routed']}) ORDER BY rank").fetchall()


@pytest.mark.parametrize("how", ["mean", "weighted"])
def test_fused_halves_are_rounded_as_in_sql(spark, monkeypatch, how):
    rng = random.Random(1)
    legs = {"hits": "norm_score", "near": "embedding_score"}
    # every other score ends at a half of the sixth digit, and so do means of two
    tables = {name: pd.DataFrame([(1, c, rng.randrange(2 * 10**6) * 5 / 10**7) for c in range(3000)], columns=["query_id", "chunk_id", score]) for name, score in legs.items()}
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    monkeypatch.setattr(retrieval, "hits", lambda spark, sf_dir, k=10: spark.createDataFrame(tables["hits"]))
    monkeypatch.setattr(retrieval, "near_hits", lambda spark, sf_dir, k=100: spark.createDataFrame(tables["near"]))
    got = sorted((r.chunk_id, r.score) for r in catalog.QUERIES[f"fuse_{how}"](spark, "").collect())
    lists = retrieval.LISTS.split(retrieval.NEAR + ",")[1]  # over the two tables in place of the searches
    assert got == con.execute(f"WITH {lists} SELECT chunk_id, round({retrieval.FUSIONS[how]}, 6) FROM l GROUP BY chunk_id ORDER BY chunk_id").fetchall()


def test_utilities_are_rounded_once(spark, monkeypatch):
    # 0.6 of these scores ends just below a half of the sixth digit, or at it
    scores = [x + 5000 * i for x in (4166, 2500) for i in range(0, 199_000, 97)]
    rows = [(1, c, s / 1e9, 0, "f", c % 2, c // 2 % 2) for c, s in enumerate([10**9, *scores])]
    cand = pd.DataFrame(rows, columns=["query_id", "chunk_id", "bm25_score", "tokens", "file_path", "contract_score", "pinned_score"])
    monkeypatch.setattr(analytics, "candidates", lambda spark, sf_dir: spark.createDataFrame(cand))
    got = sorted((r.chunk_id, r.utility) for r in catalog.QUERIES["pack_utility"](spark, "").collect())
    con = duckdb.connect()
    con.register("cand", cand)
    assert got == con.execute(f"WITH {analytics.UTILITY.split(retrieval.CANDIDATES + ',')[1]} SELECT chunk_id, utility FROM ut ORDER BY chunk_id").fetchall()
    assert got[1][1] == 0.200002


def test_digits_are_printed_as_in_sql(spark):
    halves = sorted({s * i / 10**6 for i in range(50, 10**6, 900) for s in (-1, 1)} | {i / 2**k for k in range(5, 14) for i in range(-40, 41)})
    got = {r.x: r.digits for r in spark.createDataFrame([(x,) for x in halves], "x double").select("x", retrieval.four_digits(F.col("x")).alias("digits")).collect()}
    con = duckdb.connect()
    con.register("t", pd.DataFrame({"x": halves}))
    assert got == dict(con.execute("SELECT x, printf('%.4f', x) FROM t").fetchall())


def test_hashed_digests_equal_the_sql(spark, tmp_path):
    # 13 words apart have components of 0.277350
    texts = [" ".join(f"w{n}x{i}" for i in range(n)) for n in range(1, 60)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    got = {r.query_id: r.digest for r in catalog.QUERIES["hashed_embeddings"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(f"SELECT query_id, digest FROM ({catalog.ORACLE_SQL['hashed_embeddings']})").fetchall())


def test_sizes_of_large_ids(spark, tmp_path):
    ids = [0, 11, 4095, 99_999, 2_097_151, 2_097_152, 5_999_999, 10**12 + 7, 9 * 10**18, -3_000_000]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()  # the SQL's own product needs more than 64 bits as well
    con.execute(f"CREATE VIEW events AS SELECT CAST(event_id AS HUGEINT) AS event_id FROM '{tmp_path}/events.parquet/*.parquet' WHERE abs(event_id) < 10000000")
    got = {r.event_id: (r["size"], r.duration) for r in catalog.QUERIES["readable_sizes"](spark, str(tmp_path)).collect()}
    want = {r[0]: r[1:] for r in con.execute(catalog.ORACLE_SQL["readable_sizes"]).fetchall()}
    assert len(got) == len(ids) and {k: got[k] for k in want} == want
    rest = (10**12 + 7) ** 3 % (5 * 10**12)
    assert rest == 343 + 147 * 10**12 % (5 * 10**12) and got[10**12 + 7][0] == f"{rest / 2**40:.1f} TB"


def test_means_at_a_threshold_do_not_hang_on_their_order(spark):
    rng, n = random.Random(5), 7
    asked, found, texts = [], [], []
    for q in range(200):
        shared = [rng.randrange(n + 1) for _ in range(10)]
        while sum(shared) != n * (3 if q % 2 else 6):  # ten hits of mean 0.3 or 0.6
            shared = [rng.randrange(n + 1) for _ in range(10)]
        asked.append((q, " ".join(f"w{i}" for i in range(n))))
        for rank, k in enumerate(shared, 1):
            texts.append((q * 100 + rank, " ".join(f"w{i}" for i in range(k))))
            found.append((q, q * 100 + rank, rank))
    queries, hits, chunks = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(found, "query_id long, chunk_id long, rank int"), spark.createDataFrame(texts, "chunk_id long, content string")
    got = {r.query_id: (r.relevance, r.decision) for r in iterative.judged(queries, hits, chunks).collect()}
    assert all(v == ((0.3, "refine") if q % 2 else (0.6, "continue")) for q, v in got.items())
