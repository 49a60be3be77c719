"""Packs over many candidates: the same as plain loops, by steps that grow with the input."""

import random

from pyspark.sql import functions as F

from spindrift.catalog import analytics
from spindrift.operators import packing


def test_incremental_packs_of_many_items_are_quick(spark):
    rng = random.Random(8)
    items = [(1, i, u / 1e6, 1) for i, u in enumerate(rng.sample(range(10**6), 40_000))]
    df = spark.createDataFrame(items, "query_id long, chunk_id long, utility double, tokens long")
    got = {r.chunk_id for r in packing.incremental(df, "chunk_id", 15_000).collect()}  # a search through all kept for each item takes an hour
    assert got == {i for _, i, _, _ in sorted(items, key=lambda x: -x[2])[:15_000]}


def test_neighbours_meet_by_bins(spark):
    rng = random.Random(9)
    rows = sorted({(rng.randrange(-300, 3000), f"f{rng.randrange(3)}") for _ in range(700)})
    df = spark.createDataFrame(rows, "chunk_id long, file_path string")
    near = analytics.neighbours(df, 40)
    want = sorted((a, b) for a, f in rows for b, g in rows if f == g and 0 < a - b <= 40)
    assert sorted((r.chunk_id, r.needs) for r in near.collect()) == want
    assert "bin" in near._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].split("\n")[0]


def test_packs_of_chunks_cut_before_are_the_same(spark):
    texts = ["", "one", "\n".join(map(str, range(250))), "a\n\nb\n"]
    lines = F.split("content", "\n")
    rows = [(q, c, f"f{c % 2}", 1, None, c == 1, c == 2, t) for q in (1, 2) for c, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, file_path string, start_line int, symbol_name string, is_contract boolean, is_pinned boolean, content string").withColumn("end_line", F.size(lines))
    short = df.withColumn("content", F.array_join(F.slice(lines, 1, 100), "\n"))
    packs = lambda d, most: sorted(tuple(r) for r in packing.markdown(d, most_lines=most).collect())
    assert packs(df, 100) == packs(short, None) and "99" in packs(df, 100)[0][1] and "\n100\n" not in packs(df, 100)[0][1]
