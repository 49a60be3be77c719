"""Small cases with numbers worked out by hand, and invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spindrift.functions import stemming
from spindrift.functions import text as T
from spindrift.operators import aggregates, graph, lexical, metrics, packing, ranking, statistics, vectors
from spindrift.plans import correction, intent, planner
from spindrift.sources import chunking, files, tables
from spindrift.streaming import jobs


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, "dog"), (4, "cat"), (5, "cow")], "chunk_id long, content string")
    q = spark.createDataFrame([(1, "red hen")], "query_id long, text string")
    got = {r.chunk_id: r.score for r in lexical.bm25(docs, q).collect()}
    avg = 8 / 5
    idf = lambda n: max(1e-6, math.log((5 - n + 0.5) / (n + 0.5)))
    part = lambda n, tf, dl: idf(n) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got[1] == pytest.approx(part(2, 1, 2), abs=1e-8)
    assert got[2] == pytest.approx(part(2, 2, 3) + part(1, 1, 3), abs=1e-8)
    assert {r.chunk_id for r in lexical.bm25(docs, q, match="all").collect()} == {2}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "chunk_id long, content string")
    q = spark.createDataFrame([(1, "x")], "query_id long, text string")
    assert lexical.bm25(docs, q).count() == 0
    assert intent.classified(q.limit(0)).count() == 0
    assert statistics.score_statistics(spark.createDataFrame([], "g int, score double"), "g").count() == 0


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    pairs = v.alias("a").crossJoin(v.alias("b")).select("a.vec_id", F.col("b.vec_id").alias("o"), vectors.cosine(F.col("a.embedding"), F.col("b.embedding")).alias("c"))
    got = {(r[0], r[1]): r.c for r in pairs.collect()}
    assert got[1, 2] == pytest.approx(1) and got[1, 3] == 0 and got[1, 4] == 0
    assert [r.vec_id for r in vectors.knn(v, v.where("vec_id = 1"), 1).collect()] == [2]


def test_entropy_properties(spark):
    rows = [("even", s) for s in [1.0] * 5] + [("peak", s) for s in [10.0, 0.1, 0.1, 0.1, 0.1]] + [("one", 3.0)]
    got = {r.g: r for r in statistics.score_statistics(spark.createDataFrame(rows, "g string, score double"), "g").collect()}
    assert got["even"].norm_entropy == 1 and got["peak"].norm_entropy < 0.3
    assert got["one"].norm_entropy == 0 and got["one"].score_gap == 1
    assert got["peak"].difficulty < 0.5 < got["even"].difficulty


def test_mmr_without_diversity_is_top_k(spark):
    rows = [(1, i, 1 - 0.1 * i, [float(i % 2), 1.0]) for i in range(6)]
    c = spark.createDataFrame(rows, "query_id long, chunk_id long, score double, vector array<double>")
    assert [r.chunk_id for r in ranking.mmr(c, 3, trade=1.0).orderBy("rank").collect()] == [0, 1, 2]
    assert ranking.mmr(c, 10).count() == 6


def test_knapsack_beats_greedy(spark):
    rows = [(1, "a", 10.0, 60), (1, "b", 9.0, 50), (1, "c", 9.0, 50), (1, "d", 1.0, 5)]
    items = spark.createDataFrame(rows, "query_id long, chunk_id string, utility double, tokens long")
    got = packing.knapsack(items, 100).collect()
    assert {r.chunk_id for r in got} == {"b", "c"} and sum(r.tokens for r in got) <= 100
    one = packing.incremental(items.withColumn("t", F.col("chunk_id")), "t", 100).collect()
    assert sum(r.tokens for r in one) <= 100


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("d", "d2", "IMPORTS")], "src string, dst string, edge_type string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r.path) for r in graph.paths(e, start, 3).collect()} == {("a", "b"), ("a", "b", "c")}
    assert {r.node: r.depth for r in graph.impact(e, start).collect()} == {"c": 1, "b": 2}
    assert sum(r["rank"] for r in graph.pagerank(e).collect()) == pytest.approx(1, abs=1e-6)
    assert {r.node: r.component for r in graph.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "d2": "d"}


def test_list_operators(spark):
    i = spark.createDataFrame(list(enumerate(["a/x", "b", "a/y", "a/x"])), "pos long, value string")
    assert {r.key: r["values"] for r in aggregates.group_by(i, "^([^/]+)/").collect()} == {"a": ["a/x", "a/y", "a/x"], "_other": ["b"]}
    assert [(r.value, r["count"]) for r in aggregates.aggregate("count", i).collect()] == [("a/x", 2), ("b", 1), ("a/y", 1)]
    assert aggregates.join_on(i, "+").first().value == "a/x+b+a/y+a/x"
    with pytest.raises(ValueError):
        aggregates.aggregate("median", i)


def test_outcomes_at_the_limits(spark):
    rows = [(i, 1, t) for i, t in enumerate(["2024-01-01 00:00:00", "2024-01-01 00:00:29", "2024-01-01 00:00:59", "2024-01-01 00:05:58", "2024-01-01 00:10:58"])]
    e = spark.createDataFrame(rows, "event_id long, session long, t string").withColumn("ts", F.to_timestamp("t"))
    got = [r.outcome for r in metrics.outcomes(e, F.lit("2024-01-01 00:20:00").cast("timestamp")).orderBy("event_id").collect()]
    assert got == ["failure", "unknown", "unknown", "success", "success"]


def test_ledger(spark):
    text = "Ledger:\n- Decisions: [use A, 'use B']\n- Todos: none\n\n- [ ] open item\n- [x] done\nTODO: later\n"
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(T.ledger_entries(F.col("t"))).alias("e")).select("e.*")
    assert {(r.entry_type, r.content, r.confidence) for r in df.collect()} == {("decision", "use A", 1.0), ("decision", "use B", 1.0), ("todo", "open item", 0.9), ("todo", "later", 0.95)}


def test_intents_and_plans(spark):
    q = spark.createDataFrame([(1, "what is class Foo"), (2, "zzz"), (3, "where is foo_bar used")], "query_id long, text string")
    got = {r.query_id: r for r in intent.classified(q).collect()}
    assert (got[1].intent, got[2].intent, got[3].intent) == ("definition", "general", "usage") and got[2].confidence == 0.5
    asked = ["how does RequestHandler work", "Where is the test of load_file and parse_line?", "what is interface", "plain words", None]
    ways = spark.createDataFrame([(n, t) for n, t in enumerate(asked)], "n int, t string").select("n", correction.rewrites(F.col("t")).alias("r")).collect()
    assert {r.n: r.r for r in ways} == {
        0: ["RequestHandler implementation", "RequestHandler", "requesthandler work"],
        1: ["load_file implementation", "load_file", "parse_line implementation"], 2: [], 3: [], 4: None,
    }
    plan = planner.plan_table(spark, [(7, "how is DataStore used in load_file"), (8, "AaBb CcDd EeFf GgHh IiJj KkLl usage defined tests"), (9, None)]).orderBy("query_id").collect()
    assert [(r.text, r.query_type, r.priority) for r in plan if r.of == 7] == [
        ("definition of DataStore", "definition", 10), ("definition of load_file", "definition", 9), ("usages of DataStore", "usage", 8), ("usages of load_file", "usage", 7),
        ("implementation is DataStore used in load_file", "implementation", 6), ("interfaces and types related to how is DataStore used in load_file", "contract", 1), ("how is DataStore used in load_file", "related", 1),
    ]
    assert [r.priority for r in plan if r.of == 8] == [10, 9, 8, 7, 6, 5, 4, 3, 2, 1] and not [r for r in plan if r.of == 9]
    known = spark.createDataFrame([(7, ["DataStore"])], "query_id long, names array<string>")
    again = planner.planned(spark.createDataFrame([(7, "how is DataStore used in load_file")], "query_id long, text string"), known).collect()
    assert [r.text for r in again][:2] == ["definition of load_file", "usages of load_file"]
    assert planner.next_allocation(1000, 0, 0, 2) == 500 and planner.next_allocation(1000, 1000, 1, 2) == 0
    done = planner.run_program([planner.Operation("a", lambda _: q), planner.Operation("b", lambda d: d["a"].where("query_id = 1"), ("a",)), planner.Operation("c", lambda _: 1 / 0), planner.Operation("d", lambda d: q, ("c",))])
    assert sorted(done) == ["a", "b"] and done["b"].count() == 1


def test_long_chains_are_one_component(spark):
    """A path of ten thousand shuffled nodes, a ring, and a node that only meets itself."""
    rnd = random.Random(2)
    order = rnd.sample(range(20_000), 10_000)
    edges = [*zip(order, order[1:], strict=False), *((30_000 + i, 30_000 + (i + 1) % 50) for i in range(50)), (5 + 40_000, 5 + 40_000)]
    got = graph.components(spark.createDataFrame(edges, "src long, dst long")).groupBy("component").count().collect()
    assert {r.component: r["count"] for r in got} == {min(order): 10_000, 30_000: 50, 40_005: 1}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_knn_ties_own_and_nulls(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [3.0]), (7, [1.0, 1e-9])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    near = lambda **how: [(r.vec_id, r.score) for r in vectors.knn(v, v.where("vec_id = 1"), shard_rows=2, block_rows=1, **how).orderBy("rank").collect()]
    assert near(k=3) == [(2, 1.0), (6, 1.0), (7, 1.0)] and near(k=2, own=True) == [(1, 1.0), (2, 1.0)]
    assert near(k=9) == [(2, 1.0), (6, 1.0), (7, 1.0), (3, 0.0), (5, 0.0)]
    plan = vectors.knn(v, v)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    names = spark.createDataFrame([("b", [1.0, 1.0]), ("a", [1.0, 1.0]), ("c", [1.0, 0.0])], "vec_id string, embedding array<double>")
    assert [r.vec_id for r in vectors.knn(names, names.where("vec_id = 'c'"), k=2).orderBy("rank").collect()] == ["a", "b"]


def test_stems_meet_in_bm25(spark):
    assert [stemming.porter(w) for w in ("relational", "hopping", "happy", "sky", "ponies", "electricity", "été", "x1")] == ["relat", "hop", "happi", "sky", "poni", "electr", "été", "x1"]
    chunks = spark.createDataFrame([(1, "The connection was connected", "a"), (2, "Éléphants connecting", "b"), (3, "nothing here", "b"), (4, None, "b")], "chunk_id long, content string, file_path string")
    asked = spark.createDataFrame([(1, "connect"), (2, "ELEPHANTS"), (3, "absent")], "query_id long, text string")
    plain = {(r.query_id, r.chunk_id) for r in lexical.bm25(chunks, asked).collect()}
    stemmed = {(r.query_id, r.chunk_id): r.score for r in lexical.bm25(chunks, asked, stem=True).collect()}
    assert plain == {(2, 2)} and stemmed.keys() == {(1, 1), (1, 2), (2, 2)}
    # a text of stems has the same scores without a stemmer
    words = {"the": "the", "connection": "connect", "was": "wa", "connected": "connect", "éléphants": "eleph", "connecting": "connect", "nothing": "noth", "here": "here"}
    by_hand = spark.createDataFrame([(r.chunk_id, " ".join(words[w] for w in (r.content or "").lower().split()), r.file_path) for r in chunks.collect()], chunks.schema)
    want = lexical.bm25(by_hand, spark.createDataFrame([(1, "connect"), (2, "eleph")], "query_id long, text string")).collect()
    assert {(r.query_id, r.chunk_id): r.score for r in want} == pytest.approx(stemmed)


def test_files_and_chunks(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules" / "x").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("class A:\n" + "\n".join(f"    def f{i}(self):\n        return '{'x' * 60}'\n" for i in range(80)))
    (tmp_path / "src" / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "node_modules" / "x" / "b.py").write_text("x = 1")
    found = files.scan(spark, str(tmp_path))
    assert [r.file_path for r in found.collect()] == ["src/a.py"]
    rows = chunking.chunks(found).orderBy("start_line").collect()
    assert len(rows) > 3 and all(r.symbol_name == "A" for r in rows) and all(r.token_count <= 1200 for r in rows)
    assert rows[0].start_line == 1 and rows[-1].end_line >= 240


def test_staleness_and_upsert(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "path string, hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "path string, hash string")
    assert {r.path: r.status for r in files.staleness(a, b).collect()} == {"x": "fresh", "y": "stale", "z": "deleted", "w": "new"}
    assert {r.path: r.hash for r in files.upsert(a, b.where("path = 'y'"), ["path"]).collect()} == {"x": "1", "y": "2", "z": "1"}
    assert [r.path for r in files.reindex(a, b).collect()] == ["y", "w"]


def test_stream_upsert_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "upsert", 1), ("b", 1, "upsert", 2), ("a", 2, "upsert", 3), ("b", 9, "delete", 4)], "k string, v int, op string, seq int").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k string, v int, op string, seq int").parquet(src)
    jobs.upserting(stream, str(tmp_path / "t"), ["k"], "seq", str(tmp_path / "c"), "k string, v int").awaitTermination()
    assert [tuple(r) for r in tables.current(spark, str(tmp_path / "t"), "k string, v int").collect()] == [("a", 2)]


def test_ignore_rules(spark):
    got = spark.createDataFrame([("a/b/c.py",), ("a/dist/x.js",), ("docs/readme.md",)], "p string").select("p", files.ignored(F.col("p"), files.ignore_patterns("# no\n!keep\ndist/\n*.md\n")).alias("i"))
    assert {r.p: r.i for r in got.collect()} == {"a/b/c.py": False, "a/dist/x.js": True, "docs/readme.md": True}
