import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import byte_bpe, nbsvm
from spindrift.llm.shared import written

from test_duplicates import brute_repeats, family, links_of, shingles
from test_selection import brute_targets, naive_score

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    P = pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs

    sizes = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == before.columns
        sizes[name] = docs.count()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert 0 < sizes["near_duplicates"] < sizes["quality"] < before.count() and sizes["repeated_passages"] == sizes["near_duplicates"]
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    rows = final.collect()
    codec = byte_bpe.RankCodec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == sizes["mixture"]
    for r in rows:
        assert r.decodes and list(r.ids) == codec.encode(texts[r.doc_id]).tolist()
        assert r.doc_id not in labels or labels[r.doc_id].quality == 1


def raw_documents() -> list[tuple]:
    """Good and bad texts, near copies, shared passages, repeated rows and ids,
    nulls, empty and long texts, and columns named like the operators' own."""
    rnd = random.Random(31)
    prose = lambda n: " ".join(rnd.choice(["River", "stone,", "house", "walks", "under", "the", "a", "old", f"w{rnd.randint(0, 400)}"]) for _ in range(n)) + "."
    junk = lambda n: " ".join(rnd.choice(["BUY", "NOW!!", "$$$", "click", "WIN|", "0x9"]) for _ in range(n))
    passage = prose(70)
    texts = [prose(rnd.randint(5, 120)) for _ in range(50)] + [junk(rnd.randint(5, 80)) for _ in range(40)]
    texts += [prose(20) + " " + passage + " " + prose(20) for _ in range(6)]
    texts += [f"River stone. {x}" for x in family(rnd, 120, 12, 5)] + [None, "", " ", prose(6000), junk(3000)]
    out = [(i, t, "en", rnd.choice(["b", "a", None, "é"]), len(t or ""), 5, "x") for i, t in enumerate(texts)]
    return out + [out[3], (3, prose(30), "en", "a", 1, 5, "x"), (None, prose(30), "en", "b", 1, 5, "x"), (None, texts[96], "fr", "b", 1, 5, "x")]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, kept string"


def brute_stages(spark, rows: list[tuple], labels: list[tuple], codec) -> dict[str, list]:
    """The rows after each stage, computed one by one."""
    docs = spark.createDataFrame(rows, SCHEMA)
    model = nbsvm.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    out = {}
    now = out["quality"] = [r for r in rows if naive_score(model, r[1]) >= 0.5]
    # an id is one node: its rows' links join
    nodes = {n: (r[0], shingles(r[1], 5)) for n, r in enumerate(now)}
    group = links_of({n: s for n, (_, s) in nodes.items()}, 80)
    up = {i: i for i, _ in nodes.values() if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, g in group.items():
        a, b = nodes[n][0], nodes[g][0]
        if a is not None and b is not None:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    hashed = spark.createDataFrame([(n, r[1]) for n, r in enumerate(now)], "n int, text string").select("n", F.xxhash64("text").alias("h")).collect()
    h = {r.n: r.h for r in hashed}
    first: dict = {}
    for n, r in enumerate(now):
        if r[0] is not None and root(r[0]) == r[0]:
            first[r[0]] = min(first.get(r[0], n), n, key=lambda x: (h[x], now[x][1] or ""))
    now = out["near_duplicates"] = [r for n, r in enumerate(now) if r[0] is None or first.get(r[0]) == n]
    cut = brute_repeats([r[1] for r in now], 200, as_text=True)
    now = out["repeated_passages"] = [(r[0], None if r[1] is None else t, *r[2:4], None if r[1] is None else len(t), *r[5:]) for r, t in zip(now, cut, strict=True)]
    sizes: dict = {}
    for r in now:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    target, mixed = brute_targets(sizes), []
    for r in now:
        rate = target[r[3]] / sizes[r[3]] if sizes[r[3]] else 0.0
        digest = hashlib.md5((r[1] or "").encode()).hexdigest()
        draw = int(hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}:{digest}".encode()).hexdigest()[:13], 16) / 2**52
        mixed += [r] * (int(rate) + (draw < rate - int(rate)))
    out["mixture"] = mixed
    out["encoded"] = [(r[0], *r[2:], len(x), x, True) for r in mixed for x in [codec.encoding.encode_ordinary(r[1] or "")]]
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    rows = raw_documents()
    labels = [(i, int(i < 50 or i >= 90)) for i in range(100)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    codec = byte_bpe.RankCodec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = brute_stages(spark, rows, labels, codec)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: repr(tuple(list(x) if isinstance(x, list) else x for x in r))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "encoded" or out.columns == docs.columns
        got = sorted(map(key, out.collect()))
        assert got == sorted(map(key, want[name])), name
        docs = written(out, name)
    assert len(want["quality"]) > len(want["near_duplicates"]) > 0 and 0 < len(want["encoded"]) != len(want["repeated_passages"])
    assert sorted(map(key, corpus_pipeline.run(spark, str(tmp_path)).collect())) == got


def test_pipeline_of_nothing(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
