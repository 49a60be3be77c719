import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import maxscore, mixing, nbsvm, warc

SF = "/root/testdata/sf0.01"


def test_maxscore_equals_brute_force():
    rng = np.random.default_rng(0)
    for it in range(200):
        n, m, scale = int(rng.integers(1, 200)), int(rng.integers(1, 20)), int(rng.choice([1, 3, 256, 10**7]))
        v = (rng.normal(size=(n, m)) * scale).round().astype(np.int64)
        if it % 3 == 0:
            v[rng.random(v.shape) < 0.7] = 0
        if it % 5 == 0:
            v = -np.abs(v)
        ids = rng.permutation(2 * n)[:n].astype(np.int64)
        shard = maxscore.Shard(ids, v)
        for q in (v[rng.integers(n)], (rng.normal(size=m) * scale).round().astype(np.int64)):
            own = int(ids[rng.integers(n)])
            got, score = shard.top_k(own, q, 5)
            full, keep = v @ q, ids != own
            best = np.lexsort((ids[keep], -full[keep]))[:5]
            assert got.tolist() == ids[keep][best].tolist() and score.tolist() == full[keep][best].tolist()


def test_scores_beyond_64_bits(spark):
    big = (1 << 63) - 1
    rows = np.array([[big, big], [big, -big - 1], [5, 7], [-big - 1, -big - 1]], np.int64)
    shard = maxscore.Shard(np.arange(4), rows)
    for q in ([1, 1], [big, 1], [-3, big]):
        exact = [sum(a * b for a, b in zip(q, r, strict=True)) for r in rows.tolist()]
        best = sorted(range(4), key=lambda i: (-exact[i], i))
        ids, score = shard.top_k(9, np.array(q, np.int64), 4)
        assert ids.tolist() == best and score.tolist() == [min(max(exact[i], -big - 1), big) for i in best]
    v = maxscore.quantised(spark.createDataFrame([(1, [1e300, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>"))
    assert {r.vec_id: r.v for r in v.collect()} == {1: [big, 256], 2: [256, 256]}


def test_null_and_repeated_page_ids(spark):
    """Each row is a capture of its own; the response of equal payloads is the row of the smallest id, null first."""
    body = "x" * 150
    p = spark.createDataFrame([(7, "u", body, 1), (7, "u", body, 1), (None, "v", body, 1), (3, "w", "y" * 150, 1)], "page_id long, url string, html string, kind int").repartition(2)
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in warc.digests(warc.write_archives(p)).collect()), key=repr)
    assert got == [(0, "response", None), (3, "response", None), (7, "revisit", None), (7, "revisit", None)]


@pytest.mark.parametrize("shard_rows", [1 << 18, 7])
def test_maxscore_query(spark, shard_rows):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-1.0, 0.25, 0.5, 1.0]) for _ in range(4)], 1, "v") for i in range(60)] + [(60, None, 1, "v"), (61, [1.0, None, 0.0, 0.0], 1, "v"), (62, [float("nan")] * 4, 1, "v"), (63, [float("inf"), 0.0, 0.0, 0.0], 1, "v"), (64, [], 1, "v")]
    v = maxscore.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, v string"))
    got = maxscore.top_k(v, v.where("vec_id % 10 = 0"), 5, shard_rows=shard_rows, block_rows=3, least_shards=2).collect()
    q = {i: [int(np.floor(256 * x)) for x in e] for i, e, *_ in rows[:60]} | {64: []}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i in [i for i in q if i % 10 == 0]:
        best = sorted((-dot(q[i], e), j) for j, e in q.items() if j != i)[:5]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == [(j, -s) for s, j in best]
    assert maxscore.top_k(v.limit(0), v.limit(0)).count() == 0


def brute_targets(sizes: dict, weights=(5, 2, 1), cap=3) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        free = sum(w[s] for s in names if s not in capped)
        over = {s: cap * sizes[s] for s in names if s not in capped and w[s] * left > cap * sizes[s] * free}
        if not over:
            return {s: float(capped[s]) if s in capped else w[s] * left / free for s in names}
        capped |= over


def test_mixture(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["b", "a", "Z", "é", None, "rare"] if i % 40 == 0 else ["b", "a", "Z", None]), " ".join("w" * rnd.randint(1, 4) for _ in range(rnd.randint(0, 40))), 3, "t") for i in range(1500)]
    rows += [(None, "no ids", " ".join("x" * rnd.randint(1, 9) for _ in range(30)), 3, "t") for _ in range(400)]
    rows += [(1500, "a", None, 3, "t"), (1501, "empty", " \t ", 3, "t"), (None, "b", "x y", 3, "t"), (None, "b", "x y", 3, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int, target string")
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, s, t, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    taken: dict = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in ("a", "b", "Z", "no ids"):
        assert taken[s] == pytest.approx(want[s], rel=0.15)
    again = {(r.doc_id, r.taken) for r in mixing.mix_plan(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    clash = docs.withColumn("mix_source", F.lit("x")).withColumn("MIX_COPY", F.lit(1))
    assert mixing.mix(clash).columns == clash.columns and mixing.mix(clash).count() == sum(r.copies for r in got)
    copies = mixing.mix(docs)
    assert "Exchange" not in copies._jdf.queryExecution().sparkPlan().toString() and "SortMergeJoin" not in copies._jdf.queryExecution().executedPlan().toString()
    assert copies.columns == docs.columns and copies.count() == sum(r.copies for r in got)
    assert mixing.mix_plan(docs.limit(0)).count() == 0


def test_words(spark):
    texts = [None, "", "  ", "a", " a\tb\n\x0b\x0cc\rd ", "é x y", "x" * 9000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", mixing.words(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 4, 5: 2, 6: 1}


def pages(spark):
    big = "<p>" + "é" * 80 + "</p>"
    rows = [(5, "http://a/", big, 1), (3, None, big, 1), (9, "http://b/\r\nX: y", big, 1), (4, "http://c/", "x", 1), (6, "http://c/", "x", 1), (7, "u", None, 1), (8, "u", "", 1), (10, "u", "WARC/1.1\r\n\r\n" * 50, 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int")


def test_warc(spark):
    p = pages(spark).repartition(2)
    files = warc.write_archives(p, file_bytes=300)
    got = {r.page_id: r for r in warc.digests(files).collect()}
    assert len(got) == 8
    for r in p.collect():
        body = (r.html or "").encode()
        assert (got[r.page_id].payload_bytes, got[r.page_id].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.record_type == "revisit"} == {5: ("revisit", 3), 9: ("revisit", 3)}
    full = {r.page_id: r for r in warc.captures(files).collect()}
    assert bytes(full[3].response.payload) == ("<p>" + "é" * 80 + "</p>").encode() and full[3].url is None
    assert full[9].url == "http://b/%0D%0AX:%20y" and full[9].request.concurrent_to == full[9].capture == full[9].metadata.concurrent_to
    assert warc.digests(warc.write_archives(p.limit(0))).count() == 0


def test_warc_damage():
    import io

    record = warc.capture_records(1, 1, "u", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), None, "d")
    assert [h["WARC-Type"] for h, _ in warc.parse(io.BytesIO(record))] == ["response", "request", "metadata"]
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(record[:-30])))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in nbsvm.quality(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [r for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.97
    good = [r for r in held if r.quality == 1]
    assert np.mean([got[r.doc_id].predicted for r in good]) > 0.98
    # labels of the held-out fold are never learned
    flipped = labels.withColumn("quality", F.when(nbsvm.in_training("doc_id"), F.col("quality")).otherwise(1 - F.col("quality")))
    assert {r.doc_id: r.score for r in nbsvm.quality(docs, flipped).collect()} == {i: r.score for i, r in got.items()}


def test_hinge_fit_is_optimal():
    rng = np.random.default_rng(3)
    for c in (0.01, 0.3, 5.0):
        x = rng.normal(size=(60, 8))
        y = np.where(x @ rng.normal(size=8) + rng.normal(size=60) > 0, 1.0, -1.0)
        cap = np.where(y > 0, 0.7, 1.3) * c
        rows = [np.arange(8)] * 60
        w, bias, alpha = nbsvm.hinge(rows, list(x), y, cap, 8, tolerance=1e-6, most_passes=5000)
        f = x @ w + bias
        assert np.allclose(w, (alpha * y) @ x) and bias == pytest.approx((alpha * y).sum())
        assert (alpha >= 0).all() and (alpha <= cap).all()
        # no gap between the primal and the dual: this is the linear hinge loss, not its square
        primal = (w @ w + bias**2) / 2 + (cap * np.maximum(0, 1 - y * f)).sum()
        dual = alpha.sum() - (w @ w + bias**2) / 2
        assert primal - dual == pytest.approx(0, abs=1e-4 * (1 + primal))
        assert (y * f >= 1 - 1e-4)[alpha == 0].all() and (y * f <= 1 + 1e-4)[alpha == cap].all()


def test_scores_follow_the_class_counts():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 50, 6)) + i % 2 for i in range(200)]
    labels = np.arange(200) % 2
    even, rare = nbsvm.fit(rows, labels, (1000, 1000)), nbsvm.fit(rows, labels, (100, 1900))
    assert (even.weights == rare.weights).all()
    mean = lambda m: m.scores(np.concatenate(rows), np.repeat(np.arange(200), [len(r) for r in rows]), 200).mean()
    assert mean(rare) < mean(even) - 0.05


def naive_score(model, text):
    """A score without batches: word pairs and words as they stand."""
    ids, of = nbsvm.indicators(pa.array([text], pa.string()))
    z = sum(float(model.weights[i]) for i in ids) / max(len(ids), 1) ** 0.5 + model.bias
    return 1 / (1 + np.exp(-np.clip(model.slope * z + model.offset, -30, 30)))


def test_batches_do_not_change_scores(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["one", "Two", "THREE!", "4", "five,"]) for _ in range(rnd.randint(0, 60))) for _ in range(80)] + [None, "", "x " * 50_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    model = nbsvm.train(docs, labels)
    for r in nbsvm.score(docs, model).collect():
        assert r.score == pytest.approx(naive_score(model, texts[r.doc_id]), abs=1e-5)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 2), (None, "text here", 2), (4, "x " * 3000, 2), (4, "again", 2)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in nbsvm.quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1), (4, None), (9, 1), (None, 0)], "doc_id long, quality int")
    got = nbsvm.quality(docs, one).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert nbsvm.quality(docs.limit(0), one).count() == 0
