import pytest

from spindrift.plans.service import Engine
from spindrift.sources import tables

FILES = [
    ("src/a.py", "from base import Area\n\nclass Shape(Area):\n    def area(self):\n        return 1\n", "python", 70),
    ("web/package.json", '{"scripts": {"test": "jest", "build": "tsc"}, "version": "1"}', "json", 60),
    ("Makefile", "lint:\n\truff .\n", "text", 15),
]
CHUNKS = [
    (1, "src/a.py", FILES[0][1], 3, 5, "Shape", "python", True),
    (2, "src/b.py", "def total(xs):\n    return sum(xs)\n", 1, 2, "total", "python", False),
    (3, "docs/c.md", "how the shape area is computed, and the total", 1, 1, None, "markdown", False),
]


@pytest.fixture(scope="module")
def engine(spark):
    files = spark.createDataFrame(FILES, "file_path string, content string, language string, size int")
    chunks = spark.createDataFrame(CHUNKS, "chunk_id long, file_path string, content string, start_line int, end_line int, symbol_name string, language string, is_contract boolean")
    return Engine(spark, files, chunks)


def test_tools(spark, engine):
    q = spark.createDataFrame([(1, "what is class Shape area")], "query_id long, text string")
    assert engine.retrieve(q).orderBy("rank").first().chunk_id in (1, 3)
    pack = engine.call("memory_pack", queries=q, k=5).first()
    assert "## src/a.py" in pack.pack_markdown and pack.used_tokens > 0 and pack["mode"] in ("pack", "rlm")
    assert {(r.name, r.command_type) for r in engine.project_commands().collect()} == {("test", "test"), ("build", "build"), ("lint", "lint")}
    assert [r.inside for r in engine.env_slice("src/a.py", "Shape", 1).collect()] == [False, True, True, True, False]
    assert engine.project_symbol_search("Shape").first().score == 1.0
    assert engine.project_impact(engine.files.where("file_path = 'src/a.py'")).first().dst == "base.py"
    assert engine.env_aggregate("diff_sets", ["a", "b", "a"], set_a=[0, 1], set_b=[2]).count() == 2
    assert engine.rlm_map_reduce(engine.chunks, "language").count() == 2
    assert engine.admin_ping("x")["echo"] == "x" and len(engine.tools()) >= 15
    with pytest.raises(ValueError):
        engine.memory_pack(q, budget_tokens=1)
    with pytest.raises(ValueError):
        engine.call("nothing")


def test_tables(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert tables.read(spark, root, "pins").count() == 0
    row = spark.createDataFrame([("s", "p", "l", 1, None, None)], tables.SCHEMAS["pins"])
    tables.write(row, root, "pins")
    tables.write(tables.read(spark, root, "pins").unionByName(row.selectExpr("'t' AS source_id", "path", "label", "priority", "pinned_at", "expires_at")), root, "pins")
    assert sorted(r.source_id for r in tables.read(spark, root, "pins").collect()) == ["s", "t"]


def test_memory_and_scopes(spark, engine):
    from pyspark.sql import functions as F

    q = spark.createDataFrame([(1, "what is class Shape area"), (2, "total of xs")], "query_id long, text string")
    now = F.lit("2030-01-01").cast("timestamp")
    e = Engine(spark, engine.files, engine.chunks.withColumn("updated_at", F.when(F.col("chunk_id") == 1, F.lit("2029-12-30")).otherwise(F.lit("2020-01-01")).cast("timestamp")))
    first = e.retrieve(q, k=3, now=now)
    best = {r.query_id: r.asDict() for r in first.where("rank = 1").collect()}
    assert best[1]["chunk_id"] == 1 and best[1]["embedding_score"] > 0 and best[1]["recency_score"] == pytest.approx(2.718281828 ** (-2 / 30))
    with pytest.raises(ValueError):
        e.memory_pin(spark.createDataFrame([(3,)], "source_id long"), ttl_seconds=5)
    e.memory_pin(spark.createDataFrame([(3, "p", "l", 1)], "source_id long, path string, label string, priority int"), ttl_seconds=60, now=now)
    assert [r.source_id for r in e.pinned(now=now).collect()] == [3] and e.pinned(least_priority=2, now=now).count() == 0
    assert e.pinned(now=F.lit("2030-01-02").cast("timestamp")).count() == 0
    # a pinned chunk is always among the candidates
    assert {r.chunk_id for r in e.retrieve(q, k=3, now=now).where("pinned_score = 1").collect()} == {3}
    assert [r.chunk_id for r in e.memory_list("pinned", now=now).collect()] == [3]
    assert [r.chunk_id for r in e.memory_list("recent", now=now).collect()] == [1] and e.memory_list("stale", now=now).count() == 2
    assert {(r.chunk_id, r.is_pinned) for r in e.memory_get(spark.createDataFrame([(1,), (3,)], "source_id long"), include_content=False).collect()} == {(1, False), (3, True)}
    pack = e.memory_pack(q, k=5, mode="rlm", pinned_only=True).collect()
    assert {r["mode"] for r in pack} == {"rlm"} and all(r.top_sources == ["docs/c.md"] for r in pack)
    assert {r.chunk_id for r in e.env_search("area", scope="contracts").collect()} == {"1"}
    with pytest.raises(ValueError):
        e.env_search("area", scope="transcript")
    e.ledger_add(spark.createDataFrame([(9, "s", "todo", "area again", 1, False)], "entry_id long, session_id string, category string, content string, created_at int, resolved boolean"))
    assert {r.chunk_id for r in e.env_search("area", scope="all").collect()} == {"1", "3", "9"}
    assert [r.entry_id for r in e.ledger_search(spark.createDataFrame([(1, "area")], "query_id long, text string")).collect()] == [9]
    assert e.ledger_resolve(spark.createDataFrame([(9,)], "entry_id long")).first().resolved
    assert {(r.metric, r.value) for r in e.service_stats().collect()} >= {("files", 3.0), ("chunks", 3.0), ("pins", 1.0), ("ledger", 1.0), ("language_python", 2.0)}
    assert e.ledger_remove(spark.createDataFrame([(9,)], "entry_id long")).count() == 0
    assert [(r.line, r.inside) for r in e.env_slice("src/a.py", start_line=4, end_line=4, context=1).collect()] == [(3, False), (4, True), (5, False)]
    assert [r.path for r in e.project_map(include=["*.py"]).collect()] == ["src", "src/a.py"] and e.project_languages().count() == 3
    assert [r.name for r in e.project_commands("lint").collect()] == ["lint"]
