import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import components, ngram_join, repeats, spotsigs


def links_of(sets: dict, percent: int) -> dict:
    """Smallest id reachable, by comparing all pairs."""
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def shingles(text, n):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def family(rnd, words, copies, edits):
    base = [f"w{rnd.randint(0, 3000)}" for _ in range(words)]
    out = [base]
    for _ in range(copies):
        x = list(rnd.choice(out))
        for _ in range(rnd.randint(0, edits)):
            x[rnd.randrange(len(x))] = f"e{rnd.randint(0, 99999)}"
        out.append(x)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize(("n", "percent", "tile"), [(4, 85, 1 << 21), (5, 80, 1 << 21), (4, 85, 600), (3, 50, 900), (4, 100, 600)])
def test_join_equals_brute_force(spark, n, percent, tile):
    rnd = random.Random(percent + tile)
    texts = [None, "", "one", "one", "ONE", "Été two", "été two", "a b c", "A  b\tC"]
    for words, copies, edits in ((6, 6, 1), (20, 10, 2), (45, 12, 3), (120, 15, 6), (400, 12, 14), (90, 40, 3)):
        texts += family(rnd, words, copies, edits)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{' '.join(f'u{rnd.randint(0, 99999)}' for _ in range(rnd.randint(5, 80)))} {passage}" for _ in range(40)]
    ids = rnd.sample(range(10_000), len(texts))
    want_sets = {i: shingles(t, n) for i, t in zip(ids, texts, strict=True)}
    want = links_of(want_sets, percent)
    rows = [(i, t, 5, "x") for i, t in zip(ids, texts, strict=True)] + [(None, "one", 5, "x"), (ids[2], "one", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int, cell string").repartition(3)
    got = ngram_join.join(docs, n=n, percent=percent, tile_shingles=tile).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(want_sets[r.doc_id]), want[r.doc_id])


def test_every_pair_at_the_threshold_shares_a_kept_key():
    """No pair is left to chance: also with few elements to a bucket."""
    rng = np.random.default_rng(1)
    for percent in (10, 34, 50, 67, 80, 85, 97, 100):
        bands = ngram_join.Bands(percent)
        for n in (1, 5, 33, 41, 100, 700):
            for _ in range(12):
                a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
                cut = int(rng.integers(0, n - -(-n * percent // 100) + 1)) if percent < 100 else 0
                b = a[cut:]
                sets = [np.unique(a), np.unique(b), *(np.unique(rng.choice(a, n)) for _ in range(3))]
                key, owner, tag = ngram_join.keys(sets, bands)
                held = {k: int((key == k).sum()) for k in np.unique(key)}
                kept = []
                for i in (0, 1):
                    mine = set()
                    for band in np.unique(tag[owner == i] % 128):
                        at = np.flatnonzero((owner == i) & (tag % 128 == band))
                        at = at[np.lexsort((key[at].view(np.int64), [held[k] for k in key[at]]))]
                        mine |= set(key[at[: len(at) - int(tag[at[0]] // 128) + 1]].tolist())
                    kept.append(mine)
                assert kept[0] & kept[1], (percent, n, cut)


def test_bitmaps_bound_the_overlap_in_groups_of_any_size(monkeypatch):
    rng = np.random.default_rng(2)
    seen = []
    exact = ngram_join._contained
    monkeypatch.setattr(ngram_join, "_contained", lambda x, y: seen.append(1) or exact(x, y))
    for n in (2, 3, 9):
        sets = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(n)]
        forest = components.Forest()
        ngram_join._compare(sets, list(range(n)), None, 80, forest)
        assert not forest.up and not seen
    ngram_join._compare([sets[0], sets[0][:-2], sets[1]], [7, 8, 9], None, 80, forest)
    assert forest.root(8) == 7 and forest.root(9) == 9 and len(seen) == 1


def test_near_copies_do_not_meet_in_every_pair_of_tiles(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    texts = {i: " ".join([*base[:59], f"own{i}"]) for i in range(300)}
    sent = []
    monkeypatch.setattr(ngram_join, "written", lambda df, name, real=ngram_join.written: (lambda out: sent.append((name, out.count())) or out)(real(df, name)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = ngram_join.join(docs, n=4, percent=85, tile_shingles=1000).collect()
    assert len(got) == 300 and {r.component_id for r in got} == {0}
    # each text once in its own tile, then one of each tile, then nothing: far below 300 texts times 36 tiles
    assert sum(n for name, n in sent if name == "ngram-cells") < 300 + 40 * 40


def test_one_row_of_each_group_stays(spark):
    t = "a b c d e f g"
    rows = [(1, t, "x"), (1, t, "x"), (1, "other words " * 5, "y"), (2, t, "z"), (3, None, "n"), (3, None, "n"), (None, t, "k"), (None, t, "k"), (4, "", "e"), (5, "alone " * 9, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    kept = ngram_join.keep_one(docs).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 1, 3, 4, 5]
    assert kept[0].__fields__ == docs.columns
    again = {(r.doc_id, r.text) for r in ngram_join.keep_one(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.text) for r in kept}


def test_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(docs).count() == 0
    kept = ngram_join.keep_one(spark.createDataFrame([(2, "a b c d e f"), (1, "a b c d e f"), (3, None), (4, None)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_components(spark):
    rnd = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(rnd.randint(200, 300), rnd.randint(200, 300)) for _ in range(60)] + [(7, 7), (1, 2), (2, 1), (1, 2)]
    forest = components.Forest()
    for a, b in links:
        forest.union(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: forest.root(x) for a, b in links if a != b for x in (a, b)}


def brute_repeats(texts, length, as_text=False):
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        m = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                m[i : i + length] = b"\1" * length
        if as_text:
            out.append(bytes(x for x, y in zip(b, m, strict=True) if not y).decode("utf-8", "ignore"))
            continue
        spans = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        out.append((len(b), sum(m), spans, hashlib.sha256(bytes(x for x, y in zip(b, m, strict=True) if not y)).hexdigest()))
    return out


@pytest.mark.parametrize(("index_bytes", "piece"), [(2 << 20, 1 << 22), (2000, 700)])
def test_repeats_equal_brute_force(spark, monkeypatch, index_bytes, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    rnd = random.Random(index_bytes)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    a, b = text(80), text(300)
    texts = [None, "", "x", "z" * 199, "z" * 200, "z" * 900, a, a, b, text(50) + a + text(20), a[:201] + text(9), text(9) + a[-200:], text(9) + a[-199:], b[100:700] + text(30) + b[50:400]]
    texts += [text(20) + a[:260] + text(rnd.randint(1, 60)) for _ in range(40)] + [("ab" * 150) + text(5), b, text(200)]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_bytes int").repartition(3)
    want = brute_repeats(texts, 200)
    for r in repeats.removal_digests(docs, index_bytes=index_bytes).collect():
        assert tuple(r)[1:] == want[r.doc_id], r.doc_id


def test_repeats_of_repeated_ids_and_nothing(spark):
    t = "".join(random.Random(1).choice("abcdef ") for _ in range(500))
    docs = spark.createDataFrame([(1, t), (1, t), (None, "short")], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed) for r in repeats.removal_digests(docs).collect()) == [(5, 0), (500, 500), (500, 500)]
    assert repeats.removal_digests(docs.limit(0)).count() == 0
    cut = spark.createDataFrame([(1, "é" * 150, 1), (2, "x" + "é" * 150, 2)], "doc_id long, text string, n int")
    assert {r.doc_id: r.text for r in repeats.without_repeats(cut).collect()} == {1: "", 2: "x"}


def test_the_index_is_run_compressed():
    """A corpus of copies: as many runs and samples as one copy has, and no text or suffix order."""
    rnd = random.Random(9)
    one = bytes(rnd.choice(b"abcdefgh") for _ in range(500))
    few = repeats.RunLengthIndex(np.frombuffer(one * 2, np.uint8), np.array([500] * 2))
    lots = repeats.RunLengthIndex(np.frombuffer(one * 100, np.uint8), np.array([500] * 100))
    assert len(few) == 1002 and len(lots) == 50_100 and len(lots.heads) < 2 * len(few.heads)
    assert sum(len(x) for x in vars(lots).values()) <= 6 * len(lots.heads) + 100
    assert [m for b in lots.matching(block=77) for m in b.tolist()] == [500 - i for _ in range(100) for i in range(501)]


def test_bytes_decide_not_hashes():
    """Strings whose hashes agree are told apart by their bytes, before the shuffle and after it."""
    flat = np.frombuffer(b"aaaabaaaaab", np.uint8)
    a, b, n = np.array([0, 0, 3, 1]), np.array([5, 6, 8, 7]), np.array([4, 5, 3, 0])
    assert repeats._equal_bytes(flat, a, b, np.maximum(n, 1)).tolist() == [True, True, False, True]
    rows = pa.table({"h": [5] * 5, "g": [5] * 5, "key": [1, 2, 3, 4, 5], "s0": [10, 20, 30, 40, 50], "many": [False, False, False, True, False], "body": pa.array([b"xxxx", b"xxxy", b"xxxx", b"zzzz", b"yyyy"], pa.binary())})
    settled, one = repeats._collapsed(rows, 3)
    assert sorted(zip(*(settled.column(i).to_pylist() for i in (3, 4, 5)), strict=True)) == [(1, 10, 11), (3, 30, 31), (4, 40, 41)]
    assert list(zip(one["key"].to_pylist(), one["many"].to_pylist(), strict=True)) == [(1, True), (2, False), (4, True), (5, False)]


def test_run_length_index():
    rnd = random.Random(3)
    for _ in range(200):
        length = rnd.choice([3, 5, 8])
        strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(1, 12))]
        count = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [len(s) - i >= length and count[s[i : i + length]] > 1 for s in strings for i in range(len(s))]
        assert repeats.repeated_windows(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), length).tolist() == want


def spots(text):
    import re

    words, content, run = re.findall(r"[^\W_]+", text.lower()), [], []
    for w in words:
        if w in spotsigs.ANCHORS:
            run.append(w)
        else:
            content.append((run, w))
            run = []
    out = {(z, a, b) for (r, a), (_, b) in zip(content, content[1:], strict=False) for z in r}
    if out:
        return out
    tied = ["\1".join([*r, a]) for r, a in content] + (["\1".join([*run, ""])] if run else [])
    return {tuple(tied[i : i + 3]) for i in range(len(tied) - 2)} if len(tied) > 2 else {("all", *tied)}


def test_fingerprints_equal_brute_force(spark):
    rnd = random.Random(2)
    words = ["the", "of", "and", "la", "der", "house", "tree", "river", "stone", "glass", "Été", "x1"]
    texts = [None, "", "the", "the the the", "house tree river stone", "of the house, in it: a Tree!"] + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 90))) for _ in range(30)] + ["the " * 30_000 + "house tree"]
    texts += [texts[9], texts[9]]
    ids = rnd.sample(range(1000), len(texts))
    docs = spark.createDataFrame([(i, t, "next", [1]) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, next string, sigs array<int>").repartition(3)
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(docs).collect()}
    order = sorted(zip(ids, texts, strict=True), reverse=True)
    assert len(got) == len(texts)
    for n, (i, t) in enumerate(order):
        text, following = t or "", order[(n + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        r = got[i]
        a, b, c = spots(text), spots(edited), spots(following)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & c) / len(a | c))
    same = [i for i, t in zip(ids, texts, strict=True) if t == texts[9]]
    assert len({got[i].fingerprint for i in same}) == 1
    one = spark.createDataFrame([(1, "the house tree")], "doc_id long, text string")
    assert spotsigs.edited_fingerprints(one).first().near_next == 1.0
    assert spotsigs.edited_fingerprints(one.limit(0)).count() == 0


@pytest.mark.parametrize(("least", "rows"), [(0.8, 4096), (0.5, 3), (1.0, 4096)])
def test_similar_equals_brute_force(spark, least, rows):
    rnd = random.Random(4)
    words = ["the", "of", "and", "la", *(f"w{i}" for i in range(60))]
    texts = [None, "", "the", "no common words here"]
    for _ in range(8):
        base = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        for _ in range(12):
            x = list(base)
            for _ in range(rnd.randint(0, 4)):
                x[rnd.randrange(len(x))] = rnd.choice(words)
            texts.append(" ".join(x[: rnd.randint(len(x) - 6, len(x))]))
    texts += texts[10:14]
    ids = rnd.sample(range(10_000), len(texts))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)] + [(None, texts[10], "y", 2)], "doc_id long, text string, sigs string, n int").repartition(3)
    pairs, members = spotsigs.similar(docs, least, list_rows=rows)
    sets = {i: frozenset(spots(t or "")) for i, t in zip(ids, texts, strict=True)}
    first = {x: min(i for i, y in sets.items() if y == x) for x in sets.values()}
    got = members.collect()
    assert len(got) == len(texts) + 1 and all(r.class_id == (None if r.doc_id is None else first[sets[r.doc_id]]) for r in got)
    want = {frozenset((first[x], first[y])): len(x & y) / len(x | y) for x in first for y in first if first[x] < first[y] and len(x & y) / len(x | y) >= least}
    found = pairs.collect()
    assert len(found) == len(want) and (least == 1.0 or len(want) > 20)
    for r in found:
        assert want[frozenset((r.a, r.b))] == pytest.approx(r.likeness) and len(sets[r.a]) <= len(sets[r.b])
    assert spotsigs.similar(docs.limit(0))[0].count() == 0


def test_partitions_of_length_hold_all_partners(spark):
    for least in (0.8, 0.85, 0.5, 2 / 3):
        n = spark.range(1, 3000).select(F.col("id").alias("n"), spotsigs.length_partition(F.col("id"), least).alias("p"))
        p = {r.n: r.p for r in n.collect()}
        assert all(p[min(2999, int(k / least + 1e-9))] - p[k] <= 1 and p[k] <= p.get(k + 1, 1 << 30) for k in range(1, 2999))


def test_null_and_repeated_ids_have_an_order(spark):
    """Descending ids, equal ones by the text's hash, null ids last; the last one's next is the first."""
    docs = spark.createDataFrame([(5, "the a b"), (5, "of c d"), (None, "the x y"), (2, "and e f")], "doc_id long, text string")
    rows = spotsigs.with_next(docs, "doc_id", ["text"]).collect()
    h = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    five = sorted(["the a b", "of c d"], key=lambda t: h[t], reverse=True)
    order = [*five, "and e f", "the x y"]
    assert {r.text: r["next"].text for r in rows} == {t: order[(i + 1) % 4] for i, t in enumerate(order)}
