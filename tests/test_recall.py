"""Recall of the approximate vector search against brute force on whole tables."""

import os

import pytest

from spindrift.operators import vectors

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_lsh_recall(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = v.where("vec_id % 20 = 0")
    found, exact = ({(r.query_vec, r.vec_id): r.score for r in f(v, asked, k=5).collect()} for f in (vectors.lsh_knn, vectors.knn))
    shared = found.keys() & exact.keys()
    assert len(exact) == 5 * asked.count() and len(shared) / len(exact) >= 0.9
    assert all(abs(found[x] - exact[x]) < 1e-8 for x in shared)
