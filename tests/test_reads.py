"""Texts are read once: what several parts of a query share is kept, not worked out again."""

import os

import pytest
from pyspark.sql import functions as F

from spindrift.catalog import graphs, stores
from spindrift.functions import code
from spindrift.functions import text as T
from spindrift.sources import chunking

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@needs_tables
def test_a_file_is_parsed_once_for_nodes_and_edges(spark, monkeypatch):
    files = graphs.code_files(spark, SF).cache()
    nodes, edges = chunking.graph(files)
    assert "MapIn" not in plan(nodes) and "MapIn" not in plan(edges)
    monkeypatch.setattr(chunking, "ROWS", 1)
    again = chunking.graph(files)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(nodes) == rows(again[0]) and rows(edges) == rows(again[1])


@needs_tables
def test_contracts_are_found_once(spark):
    assert all("rlike" not in plan(df).lower() for df in stores.contract_tables(spark, SF)[:2])


def test_best_contract_is_the_first_of_the_surest(spark):
    texts = ["", None, "class A(ABC):\n  pass", "@dataclass\nclass B(Protocol):", "an interface", "a SCHEMA of\n@schema", "x: TypeAlias = int", "class C(Enum): pass", "type T = int", "type X struct {", "pub trait R", "public enum E"]
    langs = ["python", "typescript", "go", "rust", "java", "text", None]
    df = spark.createDataFrame([(t, lang) for t in texts for lang in langs], "content string, language string")
    found = T.contract_matches(F.col("content"), F.col("language"))
    top = F.array_max(F.transform(found, lambda x: x["confidence"]))
    want = F.get(F.filter(found, lambda x: x["confidence"] == top), F.lit(0))
    best = code.best_contract(F.col("content"), F.col("language"))
    rows = df.select(want.alias("want"), best.alias("best")).collect()
    assert [r.best for r in rows] == [r.want for r in rows]
    # each mark is looked for once, and not for each field that is read
    marks = sum(len(p) for kinds in T.CONTRACTS.values() for p in kinds.values())
    assert plan(df.select(best["contract_type"].alias("t"), best["confidence"].alias("c"))).lower().count("rlike") <= 2 * marks


def test_signatures_begin_behind_long_comments(spark):
    texts = ["\n".join(["# c"] * 20 + ["", "def f(", "  a,", "):", "  pass"]), "# c\n// d", "", "class A:\n  x", "\n".join(f"l{i}" for i in range(12)), None, "  {\nb", "\n".join(["//"] * 7 + ["func f() {", "}"])]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    got = [r[0] for r in df.select(code.signature(F.col("content"), F.lit("python"))).collect()]
    assert got == ["def f(\n  a,\n):", None, None, "class A:", "\n".join(f"l{i}" for i in range(6)), None, "{", "func f() {"]
    assert plan(df.select(code.signature(F.col("content"), F.lit("python")).alias("s"))).count("split(") == 1
