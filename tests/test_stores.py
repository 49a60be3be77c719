"""Stores, the index job, streams and retrieval in steps, against plain code."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import metrics, packing, ranking, snapshots, vectors
from spindrift.operators import graph as graph_operators
from spindrift.plans import iterative, planner
from spindrift.sources import chunking, files, indexing, stores, tables
from spindrift.streaming import jobs


def test_versions_survive_a_crash(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.current(spark, path, "a int").count() == 0
    tables.commit(spark.createDataFrame([(1,)], "a int"), path)
    tables.commit(tables.current(spark, path, "a int").unionByName(spark.createDataFrame([(2,)], "a int")), path)
    # a writer that died: files, no mark of its end
    (tmp_path / "t" / "v=00000002").mkdir()
    (tmp_path / "t" / "v=00000002" / "part-0.parquet").write_bytes(b"cut")
    assert sorted(r.a for r in tables.current(spark, path, "a int").collect()) == [1, 2]
    assert tables.commit(spark.createDataFrame([(9,)], "a int"), path, mark="m") == "v=00000003.m" == tables.commit(spark.createDataFrame([(8,)], "a int"), path, mark="m")
    assert [r.a for r in tables.current(spark, path, "a int").collect()] == [9]
    assert [n for n, _ in tables.versions(spark, path)] == [1, 3]
    (tmp_path / "t" / "v=00000003.m" / "_SUCCESS").unlink()
    assert sorted(r.a for r in tables.current(spark, path, "a int").collect()) == [1, 2]


def test_stream_upsert_goes_on_and_raises(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "k string, v int, op string, seq int"
    stream = lambda: jobs.upserting(spark.readStream.schema(schema).parquet(src), out, ["k"], "seq", check, "k string, v int")
    spark.createDataFrame([("a", 1, "upsert", 1), ("b", 1, "upsert", 2)], schema).coalesce(1).write.parquet(src)
    stream().awaitTermination()
    spark.createDataFrame([("a", 5, "upsert", 3), ("b", 0, "delete", 4), ("c", 7, "upsert", 5)], schema).coalesce(1).write.mode("append").parquet(src)
    stream().awaitTermination()
    stream().awaitTermination()
    assert {tuple(r) for r in tables.current(spark, out, "k string, v int").collect()} == {("a", 5), ("c", 7)}
    # a table that cannot be read stops the stream instead of starting anew
    (number, name) = tables.versions(spark, out)[-1]
    for f in (tmp_path / "out" / name).glob("part-*"):
        f.write_bytes(b"not parquet")
    spark.createDataFrame([("d", 1, "upsert", 6)], schema).coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(Exception):  # noqa: B017
        stream().awaitTermination()
    assert tables.versions(spark, out)[-1] == (number, name)


def test_watch_and_appending(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(src)
    watch = jobs.Watch(lambda: jobs.appending(spark.readStream.schema("id long").parquet(src), out, str(tmp_path / "c")))
    watch.start().awaitTermination()
    assert not watch.running
    watch.start().awaitTermination()
    watch.stop()
    assert spark.read.parquet(out).count() == 5


def project(folder):
    (folder / "src").mkdir()
    body = "\n".join(f"    x{i} = '{'y' * 60}'" for i in range(40))
    (folder / "src" / "a.py").write_text(f"from abc import ABC\n\nclass Alpha(ABC):\n{body}\n\ndef beta():\n{body}\n")
    (folder / "src" / "b.py").write_text(f"def gamma():\n{body}\n")
    (folder / "big.txt").write_text("z" * 600_000)
    (folder / "odd.txt").write_bytes(b"\xff\xfe\x00")
    (folder / "x.lock").write_text("no")
    return str(folder)


def test_index_job(spark, tmp_path):
    (tmp_path / "p").mkdir()
    root, store = project(tmp_path / "p"), str(tmp_path / "store")
    assert {(r.file_path, r.skipped) for r in files.skipped(spark, root).collect()} == {("big.txt", "too large"), ("odd.txt", "not text"), ("x.lock", "ignored")}
    assert indexing.index(spark, root, store) == {"new": 2, "stale": 0, "fresh": 0, "deleted": 0}
    first = tables.read(spark, store, "chunks").collect()
    assert {r.symbol_name for r in first} == {"Alpha", "beta", "gamma"}
    assert {r.chunk_id for r in tables.read(spark, store, "vectors").collect()} == {r.chunk_id for r in first}
    contract = tables.read(spark, store, "contracts").collect()
    assert [(r.name, r.contract_type, r.signature) for r in contract] == [("Alpha", "abstract_class", "class Alpha(ABC):")]
    assert [r.name for r in tables.read(spark, store, "contract_dependencies").collect()] == ["ABC"]
    assert indexing.index(spark, root, store) == {"new": 0, "stale": 0, "fresh": 2, "deleted": 0}
    (tmp_path / "p" / "src" / "b.py").unlink()
    text = (tmp_path / "p" / "src" / "a.py").read_text()
    (tmp_path / "p" / "src" / "a.py").write_text(text.replace("beta", "delta"))
    assert indexing.index(spark, root, store) == {"new": 0, "stale": 1, "fresh": 0, "deleted": 1}
    assert {r.symbol_name for r in tables.read(spark, store, "chunks").collect()} == {"Alpha", "delta"}
    assert {r.chunk_id for r in tables.read(spark, store, "vectors").collect()} == {r.chunk_id for r in tables.read(spark, store, "chunks").collect()}
    indexing.index(spark, root, store, force=True)
    assert tables.read(spark, store, "files").count() == 1
    assert [r.file_path for r in files.first_files(files.scan(spark, root), 1, ["py"], ["src"]).collect()] == ["src/a.py"]


def test_graph_files_and_settings(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "class", "A", "f", 1, 2, None), ("b", "file", "f", "f", 1, 9, "c1")], "node_id string, node_type string, name string, file_path string, start_line int, end_line int, chunk_id string")
    edges = spark.createDataFrame([("b", "a", "CONTAINS", 1.0), ("b", "a", "CALLS", None)], "src string, dst string, edge_type string, weight double")
    indexing.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = indexing.read_graph(spark, str(tmp_path / "g"))
    assert {tuple(r) for r in n.collect()} == {tuple(r) for r in nodes.collect()} and {tuple(r) for r in e.collect()} == {tuple(r) for r in edges.collect()}
    assert indexing.settings(spark, str(tmp_path)) == indexing.Settings()
    (tmp_path / "config.json").write_text('{"pack": {"budget_tokens": 900}, "trade": 1, "ignore": ["*.x"]}')
    assert indexing.settings(spark, str(tmp_path)) == indexing.Settings(budget_tokens=900, trade=1.0, ignore=("*.x",))
    (tmp_path / "config.toml").write_text('[retrieval]\nlimit = "many"\n')
    with pytest.raises(ValueError):
        indexing.settings(spark, str(tmp_path))


def test_learning_job_equals_a_loop(spark):
    rnd = random.Random(3)
    rows, chunks = [], [(i, f"d/{'test' if i % 3 == 0 else 'config' if i % 5 == 0 else 'src'}/f{i}", ["class", None, "function"][i % 3], i % 4 == 0) for i in range(30)]
    for e in range(40):
        got = rnd.sample(range(30), 6)
        rows.append((e, e % 5, 1000 + 50 * e, got, rnd.sample(got, 2), "success" if e % 7 == 0 else None, e % 2))
    events = spark.createDataFrame(rows, "event_id long, session_id long, t long, retrieved array<long>, selected array<long>, outcome string, model long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    c = spark.createDataFrame(chunks, "chunk_id long, file_path string, symbol_type string, is_contract boolean")
    now = 1000 + 50 * 40
    got = {(r.model, r.feature): r.weight for r in metrics.learn(events, c, F.timestamp_seconds(F.lit(now))).collect()}

    def features(i):
        _, path, kind, contract = chunks[i]
        return [f"symbol_{kind or 'unknown'}", *(["file_test"] if "test" in path else []), *(["file_config"] if "config" in path else []), *(["is_contract"] if contract else [])]

    want = {}
    for model in (0, 1):
        w, pairs = {}, []
        for e, s, t, retrieved, selected, given, m in rows:
            later = [x[2] for x in rows if x[1] == s and x[2] > t]
            gap = min(later) - t if later else None
            outcome = given or ("unknown" if gap is None and now - t <= 300 else "success" if gap is None or gap >= 300 else "failure" if gap < 30 else "unknown")
            if m == model and outcome in ("success", "failure"):
                unused = sorted(set(retrieved) - set(selected))[:3]
                pairs += [(e, *((u, x) if outcome == "failure" else (x, u))) for x in selected for u in unused]
        for _, p, n in sorted(pairs):
            margin = sum(w.get(f, 0.0) for f in features(p)) - sum(w.get(f, 0.0) for f in features(n))
            step = 0.01 / (1 + math.exp(min(margin, 10)))
            for f in features(p):
                w[f] = w.get(f, 0.0) + step
            for f in features(n):
                w[f] = w.get(f, 0.0) - step
        want |= {(model, f): x for f, x in w.items()}
    assert got == pytest.approx(want, abs=1e-8) and len(want) > 4


def searcher(spark, corpus):
    """Hits by shared words, as a function of a table of questions and as plain code."""

    def plain(text, k=20):
        found = sorted((-len(set(text.lower().split()) & set(t.lower().split())), i) for i, t in corpus.items())
        return [(i, -n / 10) for n, i in found if n < 0][:k]

    def spark_side(qs):
        rows = [(r.query_id, i, s, n + 1) for r in qs.collect() for n, (i, s) in enumerate(plain(r.text))]
        return spark.createDataFrame(rows, "query_id long, chunk_id long, score double, rank int")

    return plain, spark_side


def entropy(scores):
    top = max(scores)
    p = [math.exp(s - top) for s in scores]
    p = [x / sum(p) for x in p]
    return -sum(x * math.log(x) for x in p if x > 1e-10) / math.log(len(p)) if len(p) > 1 else 0.0


def test_rounds_equal_a_loop(spark):
    rnd = random.Random(5)
    words = ["data", "store", "file", "load", "test", "work", "definition", "of", "interfaces", "types", "zeta"]
    corpus = {i: " ".join(rnd.sample(words, 4)) for i in range(40)}
    plain, retrieve = searcher(spark, corpus)
    texts = {1: "how does data work", 2: "zeta", 3: "load file test", 4: "absent"}
    q = spark.createDataFrame(list(texts.items()), "query_id long, text string")
    plan = planner.planned(q)
    got: dict = {}
    for r in iterative.iterate(q, retrieve(q), plan, retrieve, rounds=2, most=15).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = (r.score, r.rounds)
    subs: dict = {}
    for r in plan.orderBy("query_id").collect():
        subs.setdefault(r.of, []).append((r.text, r.query_type))
    for n, text in texts.items():
        fused, spent = {i: (s, ["first"]) for i, s in plain(text)}, 0
        for turn in (1, 2):
            if not fused or entropy([s for s, _ in fused.values()]) < iterative.SURE or len(subs[n]) < turn:
                break
            sub, kind = subs[n][turn - 1]
            spent = turn
            for i, s in plain(sub):
                old = fused.get(i)
                fused[i] = (max(old[0], s) + (0.2 if kind in old[1] else 0.3), [*old[1], kind]) if old else (s, [kind])
            fused = dict(sorted(fused.items(), key=lambda x: (-round(x[1][0], 9), x[0]))[:15])
        assert {i: s for i, (s, _) in got.get(n, {}).items()} == pytest.approx({i: s for i, (s, _) in fused.items()}), n
        assert all(r == spent for _, r in got.get(n, {}).values())


def test_quality_rounds_and_follow_ups(spark):
    corpus = {1: "alpha beta", 2: "gamma delta", 3: "related to alpha", 4: "nothing much", 5: "a b c d e f g h"}
    names = {1: "Alpha", 2: None, 3: "Rel", 4: None, 5: "Long"}
    plain, retrieve = searcher(spark, corpus)
    chunks = spark.createDataFrame([(i, t, names[i]) for i, t in corpus.items()], "chunk_id long, content string, symbol_name string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "alpha zz"), (3, "xx yy a"), (4, "unknown words only here f x y")], "query_id long, text string")
    verdict = {r.query_id: (r.relevance, r.decision) for r in iterative.judged(q, retrieve(q), chunks).collect()}
    assert verdict[1] == (0.75, "continue") and verdict[2] == (0.5, "refine") and verdict[3][1] == "refine" and verdict[4][1] == "retry"
    rows = iterative.quality_loop(q, retrieve(q), chunks, retrieve).orderBy("query_id", "rank").collect()
    by = {n: [(r.chunk_id, r.rank, r.score) for r in rows if r.query_id == n] for n in texts_of(q)}
    assert by[1] == [(1, 1, 1.0), (3, 2, 0.5)]
    assert [x[0] for x in by[2]][:2] == [1, 3] and all(s == 1 / r for x in by.values() for _, r, s in x)
    empty = spark.createDataFrame([(9, "one two three four five six seven")], "query_id long, text string")
    asks = iterative.refinements(empty, iterative.judged(empty, retrieve(empty), chunks), retrieve(empty).withColumn("rank", F.col("rank")), chunks).collect()
    assert [(r.of, r.text) for r in asks] == [(9, "one two three four five")]
    plan = spark.createDataFrame([(10, 1, "definition of Alpha"), (20, 2, "x")], "query_id long, of long, text string")
    more = iterative.follow_ups(plan, retrieve(q), chunks).collect()
    assert {(r.of, r.text) for r in more} == {(1, "related to Rel"), (2, "related to Alpha"), (2, "related to Rel")}
    own = iterative.decomposed(q, lambda qs: qs.where("query_id = 1").select(F.col("query_id").alias("of"), F.lit("part").alias("text"), F.lit("own").alias("query_type"), F.lit(3).alias("priority")))
    assert {r.query_type for r in own.where("of = 1").collect()} == {"own"} and own.where("of = 2").count() > 0


def texts_of(q):
    return [r.query_id for r in q.collect()]


def test_snapshots_within_a_budget(spark):
    items = [("s", k, f"{k} number {i} {'x' * 30}", 0, i, i + 1) for k, n in (("symbol", 8), ("file", 9), ("question", 5), ("decision", 8), ("todo", 9), ("activity", 6)) for i in range(n)]
    rows = spark.createDataFrame([(*x[:5], x[5]) for x in items], "session_id string, kind string, content string, weight int, seq int, place int")
    pinned = spark.createDataFrame([("s", "never drop me " + "y" * 300), ("t", "only this")], "session_id string, content string")
    size = {}
    for budget in (10_000, 480, 400, 360, 300, 250, 10):
        got = {r.session_id: r for r in snapshots.snapshots(rows, pinned, budget).collect()}
        r = got["s"]
        size[budget] = (len(r.symbols), len(r.files), len(r.questions), len(r.decisions), len(r.todos), len(r.summary) > 203)
        assert len(r.invariants) == 1 and got["t"].invariants == ["only this"] and got["t"].summary == "Session in progress."
        assert r.tokens <= budget or size[budget] == (0, 5, 3, 5, 5, False)
    assert size[10_000] == (8, 9, 5, 8, 9, True) and size[10] == (0, 5, 3, 5, 5, False)
    order = [size[b] for b in (10_000, 480, 400, 360, 300, 250, 10)]
    assert order == sorted(order, reverse=True)


def test_mmr_equals_a_loop(spark):
    rnd = random.Random(8)
    rows = [(q, i, round(rnd.random(), 2), [rnd.gauss(0, 1) for _ in range(5)]) for q in (1, 2) for i in range(14)]
    got = ranking.mmr(spark.createDataFrame(rows, "query_id long, chunk_id long, score double, vector array<double>"), 6, 0.6).collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    for q in (1, 2):
        mine = {i: (s, v) for n, i, s, v in rows if n == q}
        low, high = min(s for s, _ in mine.values()), max(s for s, _ in mine.values())
        picked = []
        while len(picked) < 6:
            value = {i: 0.6 * (s - low) / (high - low) - 0.4 * max([0, *(cos(v, mine[j][1]) for j in picked)]) for i, (s, v) in mine.items() if i not in picked}
            picked.append(min(value, key=lambda i: (-round(value[i], 12), i)))
        assert [r.chunk_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == picked


def test_knapsack_is_optimal(spark):
    rnd = random.Random(4)
    rows = [(q, i, round(rnd.random(), 3), 10 * rnd.randint(1, 12)) for q in range(12) for i in range(9)]
    got = packing.knapsack(spark.createDataFrame(rows, "query_id long, chunk_id long, utility double, tokens long"), 200).collect()
    for q in range(12):
        mine = [(u, t) for n, _, u, t in rows if n == q]
        best = max(sum(u for b, (u, _) in enumerate(mine) if m >> b & 1) for m in range(1 << 9) if sum(t for b, (_, t) in enumerate(mine) if m >> b & 1) <= 200)
        chosen = [r for r in got if r.query_id == q]
        assert sum(r.tokens for r in chosen) <= 200 and sum(r.utility for r in chosen) == pytest.approx(best)


def test_incremental_pack_and_bundles_equal_a_loop(spark):
    rnd = random.Random(6)
    rows = [(q, i, round(rnd.random(), 3), rnd.randint(5, 60)) for q in range(6) for i in range(12)]
    items = spark.createDataFrame(rows, "query_id long, chunk_id long, utility double, tokens long")
    got = {(r.query_id, r.chunk_id) for r in packing.incremental(items, "chunk_id", 120).collect()}
    for q in range(6):
        kept: list = []
        for _, i, u, t in (r for r in rows if r[0] == q):
            used = sum(x[2] for x in kept)
            if used + t <= 120:
                kept.append((i, u, t))
            elif kept:
                worst = min(kept, key=lambda x: (x[1], x[0]))
                if u > worst[1] and used - worst[2] + t <= 120:
                    kept.remove(worst)
                    kept.append((i, u, t))
        assert {x[0] for x in kept} == {i for n, i in got if n == q}
    needs = spark.createDataFrame([(i, j) for i in range(12) for j in range(12) if i != j and (i * j) % 5 == 1], "chunk_id long, needs long")
    bundles = packing.with_dependencies(items, needs, 120).collect()
    want = {i: {j for j in range(12) if i != j and (i * j) % 5 == 1} for i in range(12)}
    for q in range(6):
        mine = {i: (u, t) for n, i, u, t in rows if n == q}
        have, used = set(), 0
        for i in sorted(mine, key=lambda i: (-mine[i][0] / max(1, mine[i][1] + sum(mine[j][1] for j in want[i])), i)):
            new = [i, *(j for j in want[i] if j not in have)]
            if i not in have and used + sum(mine[j][1] for j in new) <= 120:
                used += sum(mine[j][1] for j in new)
                have |= set(new)
        assert {r.chunk_id for r in bundles if r.query_id == q} == have


def test_communities_equal_a_loop(spark):
    rnd = random.Random(9)
    edges = [(a, b, "CALLS") for a, b in ((rnd.randint(0, 25), rnd.randint(0, 25)) for _ in range(60)) if a != b]
    got = {r.node: r.label for r in graph_operators.communities(spark.createDataFrame(edges, "src long, dst long, edge_type string")).collect()}
    steps = {(a, b) for a, b, _ in edges} | {(b, a) for a, b, _ in edges}
    label = {a: a for a, _ in steps}
    for _ in range(5):
        votes = {n: [label[b] for a, b in steps if a == n] for n in label}
        label = {n: min(set(v), key=lambda x: (-v.count(x), x)) for n, v in votes.items()}
    assert got == label


def test_contracts_ledger_and_filters(spark):
    c = spark.createDataFrame([(1, "a.py", "# head\n\nclass A(Protocol,\n  B):\n    x = 1\n", "python", "A", 1, 5, True), (2, "b.ts", "export interface Foo {\n a: 1\n}", "typescript", None, 3, 5, True), (3, "c.py", "x = 1", "python", None, 1, 1, False)], "chunk_id long, file_path string, content string, language string, symbol_name string, start_line int, end_line int, is_contract boolean")
    r = {x.chunk_id: x for x in stores.contract_records(c).collect()}
    assert r[1].signature == "class A(Protocol,\n  B):" and r[1].contract_type == "protocol" and r[1].dependencies == ["Protocol", "B"]
    assert r[2].signature == "export interface Foo {" and r[2].name == f"contract_{r[2].contract_id[:8]}" and set(r) == {1, 2}
    schema = "entry_id long, session_id string, category string, content string, created_at int, resolved boolean"
    led = spark.createDataFrame([(1, "s", "todo", "fix the parser", 1, False), (2, "s", "decision", "use trees", 2, None)], schema)
    led = stores.add_entries(led, spark.createDataFrame([(2, "s", "decision", "use tries", 3, False), (3, "t", "todo", "parser tests", 4, False)], schema))
    assert [x.entry_id for x in stores.entries(led, session="s").collect()] == [2, 1]
    assert [x.content for x in stores.entries(stores.resolve_entries(led, led.where("entry_id = 1")), categories=["todo"], open_only=True).collect()] == ["parser tests"]
    q = spark.createDataFrame([(1, "parser")], "query_id long, text string")
    assert {x.entry_id for x in stores.search_entries(led, q, ["todo"]).collect()} == {1, 3}
    assert stores.remove_entries(led, led.where("entry_id = 3")).count() == 2
    assert [x.vec_id for x in vectors.similar_ids(spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>"), 1, spark.createDataFrame([(2,)], "vec_id long")).collect()] == [2]


def test_code_graph_of_other_languages(spark):
    code = [
        ("a.ts", "import { Token } from './b'\nexport class Handler extends Base implements Token {\n  run() { return check(1) }\n}\nexport type Id = string;\nfunction check(x) { return x }\n", "typescript"),
        ("b.ts", "export interface Token {\n  id: Id\n}\nexport class Base {\n}\n", "typescript"),
        ("c.go", 'package c\nimport "x/store"\ntype Box struct {\n  a int\n}\ntype Store interface {\n  Get() int\n}\nfunc Open() {\n  Close()\n}\nfunc Close() {\n}\n', "go"),
        ("d.rs", "use crate::shape::Area;\npub trait Area {\n}\npub fn area() {\n  helper()\n}\nfn helper() {\n}\n", "rust"),
        ("e.txt", "class Nothing {}", "text"),
    ]
    nodes, edges = chunking.graph(spark.createDataFrame(code, "file_path string, content string, language string"))
    assert {(r.node_type, r.name) for r in nodes.where("node_type <> 'file'").collect()} == {
        ("class", "Handler"), ("type", "Id"), ("function", "check"), ("interface", "Token"), ("class", "Base"), ("type", "Box"), ("interface", "Store"), ("function", "Open"), ("function", "Close"), ("interface", "Area"), ("function", "area"), ("function", "helper"),
    }
    short = lambda x: x.split(":")[-1]
    assert {(short(r.src), short(r.dst), r.edge_type) for r in edges.where("edge_type <> 'CONTAINS'").collect()} == {
        ("a.ts", "Token", "IMPORTS"), ("Handler", "Base", "INHERITS"), ("Handler", "Token", "IMPLEMENTS"), ("Handler", "check", "CALLS"), ("Open", "Close", "CALLS"), ("d.rs", "Area", "IMPORTS"), ("area", "helper", "CALLS"),
    }
    assert {short(r.dst) for r in edges.where("edge_type = 'CONTAINS'").collect()} == {"Handler", "check", "Base", "Open", "Close", "area", "helper"}


def test_line_chunks_cover_a_text(spark):
    """Chunks by lines: every line that is not blank is in one, ends are at rests or at twice the target, overlaps are short."""
    rnd = random.Random(11)
    lines = [" " * rnd.choice([0, 0, 4]) + "w" * rnd.randint(0, 120) for _ in range(600)]
    found = list(chunking.line_chunks(lines))
    assert {n for a, b in found for n in range(a, b + 1)} >= {n for n, x in enumerate(lines, 1) if x.strip()}
    tokens = lambda a, b: sum(chunking.tokens(x + "\n") for x in lines[a - 1 : b])
    for (a, b), (c, _) in zip(found, found[1:], strict=False):
        assert a <= b < c + 9 and c > a and chunking.TARGET <= tokens(a, b) <= 2 * chunking.TARGET + 31 + chunking.OVERLAP
        rest = not lines[b - 1].strip() or not lines[b].startswith((" ", "\t"))
        assert rest or tokens(a, b) >= 2 * chunking.TARGET
    rows = chunking.chunks(spark.createDataFrame([("f.txt", "\n".join(lines), "text")], "file_path string, content string, language string")).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line) for r in rows] == found and all(r.content == "\n".join(lines[r.start_line - 1 : r.end_line]) for r in rows)


def test_exports_logs_and_history(spark, tmp_path):
    points = spark.createDataFrame([("a", 1.5, {"k": "v", "b": "2"}), ("c", 2.0, {})], "name string, value double, tags map<string,string>")
    files.export(points, str(tmp_path / "j"))
    assert {r.name: r.value for r in spark.read.json(str(tmp_path / "j")).collect()} == {"a": 1.5, "c": 2.0}
    files.export(points, str(tmp_path / "c"), "csv")
    assert {(r.name, r.tags) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {("a", "b=2;k=v"), ("c", None)}
    with pytest.raises(ValueError):
        files.export(points, str(tmp_path / "x"), "xml")
    log = str(tmp_path / "log")
    files.append_jsonl(spark.range(3).withColumn("t", F.col("id")), log)
    files.append_jsonl(spark.range(3, 5).withColumn("t", F.col("id")), log)
    (tmp_path / "log" / "bad.json").write_text("{cut\n")
    assert files.read_jsonl(spark, log, "id long, t long").count() == 5
    assert [r.id for r in files.read_jsonl(spark, log, "id long, t long", order="t", last=2).collect()] == [4, 3]
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "k string, n int")
    assert {tuple(r) for r in jobs.history(rows, 2, "k", "n").collect()} == {("a", 3), ("a", 2), ("b", 1)}
    assert [r.n for r in jobs.history(rows, 1, None, "n").collect()] == [3]
    moves = spark.createDataFrame([("x", "change", 1), ("x", "delete", 2), ("y", "delete", 1), ("y", "change", 3)], "path string, op string, ts int")
    assert {tuple(r) for r in jobs.latest_changes(moves).collect()} == {("x", "delete"), ("y", "change")}
    points = spark.createDataFrame([(1, 30, 100), (2, 5, 0)], "words int, retrieved int, total int")
    assert [r.m for r in points.select(metrics.estimated_missed(F.col("words"), F.col("retrieved"), F.col("total")).alias("m")).collect()] == [0, 0]
