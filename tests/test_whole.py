"""Queries on planted rows that a cut of their input would lose."""

import os

import pytest

from spindrift import catalog

SF = "/root/testdata/sf0.001"


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize(("name", "column", "expected"), [("contract_detect", "contract_type", {4: "schema", 11: None}), ("contract_deps", "deps", {4: "BaseModel", 11: ""})])
def test_contracts_after_a_long_text(spark, tmp_path, name, column, expected):
    long = "word " * 2000
    sf = written(spark, tmp_path, documents=([(4, long + "\nclass Late(BaseModel):\n"), (11, long)], "doc_id long, text string"))
    assert {r.chunk_id: r[column] for r in catalog.QUERIES[name](spark, sf).collect()} == expected


def test_all_questions_are_planned(spark, tmp_path):
    texts = [(i, f"word{i} of a question") for i in range(120)]
    docs = [(i, f"word{i} and more words", "en", "s") for i in range(120)]
    sf = written(spark, tmp_path, benchmark=(texts, "item_id long, text string"), documents=(docs, "doc_id long, text string, lang string, source string"))
    plan = catalog.QUERIES["subquery_plan"](spark, sf).collect()
    asked = catalog.analytics.named(spark, sf).collect()
    assert {r.of for r in plan} == {r.query_id for r in asked} and {r.text for r in plan if r.query_type == "related"} == {r.text for r in asked}
    assert len({r.query_id for r in plan}) == len(plan)
    assert {r.query_id for r in catalog.QUERIES["planned_retrieval"](spark, sf).collect()} == set(range(120))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize(("name", "column"), [("lsh_knn", "query_vec"), ("mmr_select", "query_id")])
def test_every_twentieth_vector_is_searched(spark, name, column):
    due = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").collect()}
    assert due and {r[column] for r in catalog.QUERIES[name](spark, SF).collect()} == due
