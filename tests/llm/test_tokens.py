import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from spindrift.llm import byte_bpe, simple8b, token_counts, word_bpe  # noqa: E402

TEXTS = [None, "", " ", "The cat's 12 hats, isn't it?", "x" * 5000, " " * 3000 + "end", "été 漢字 🙂 <|endoftext|> <|ENDOFTEXT|>", "a\x0bb\x1cc\x85d", "word,!! don't IT'S"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "ids", 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "ids", 7), (None, "no id", "ids", 7)]
    # extra columns named like results
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def texts_of_any_kind(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    parts = [*"ab'sT1 2!\n\t\r\x0b\x1c  éÉ́漢🙂0", "  ", "'ll", " " * 300, "<|endoftext|>", "<|", "The", "don't"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 80))) for _ in range(n)]


def test_byte_bpe_equals_the_library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.RankCodec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, piece_chars=30)
    for t in texts_of_any_kind(500, 1) + [x or "" for x in TEXTS]:
        ids = codec.encode(t)
        assert ids.tolist() == library.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_byte_bpe_long_white_space():
    codec = byte_bpe.RankCodec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for t in (" " * 1_500_000, "\n" * 1_200_000 + "x"):
        assert codec.decode(codec.encode(t)) == t.encode()
    # the pattern's own matches, as the library finds them in shorter runs
    for t in (" " * 4000, "a" + " " * 4000 + "b", "\n" * 4000 + "x", " \n" * 2000 + "!  c"):
        assert codec.encode(t).tolist() == codec.encoding.encode_ordinary(t)
    run = "\n" * 1_200_000
    assert list(codec.pieces(run + "x")) == [(run[:-1], True), ("\nx", False)] and list(codec.pieces(run)) == [(run, True)]


def test_texts_of_other_patterns_are_not_cut():
    import tiktoken

    pattern = r"\p{L}+(?: \p{L}+)*|\s+|[^\s\p{L}]+"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.RankCodec(P.path("byte_bpe_50k.tiktoken"), pattern, piece_chars=10)
    text = "some words in a row, then more of them " * 9 + " " * 300 + "end"
    assert P.PATTERN == byte_bpe.SPLITS and list(codec.pieces(text)) == [(text, False)]
    assert codec.encode(text).tolist() == library.encode_ordinary(text)


def test_null_ids_and_clashing_columns(spark, docs):
    path = P.path("byte_bpe_50k.tiktoken")
    coded = spark.createDataFrame([(1, None, "x"), (2, [], "x"), (None, [64, 65], "x")], "doc_id long, ids array<int>, bytes string")
    assert {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(coded, path, P.PATTERN).collect()} == {1: b"", 2: b"", None: byte_bpe.RankCodec(path, P.PATTERN).decode(np.array([64, 65]))}
    out = byte_bpe.encoded_rows(docs.withColumn("decodes", F.lit("old")).withColumn("lang", F.lit("en")), path, P.PATTERN)
    assert out.columns == ["doc_id", "lang", "n_tokens", "ids", "decodes"]
    assert all(r.decodes and r.lang == "en" and r.n_tokens == len(r.ids) for r in out.collect())


def test_round_trip(docs):
    codec = byte_bpe.RankCodec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = byte_bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = codec.encode(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert byte_bpe.round_trip(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_encode_then_decode(docs):
    path = P.path("byte_bpe_50k.tiktoken")
    back = byte_bpe.decode(byte_bpe.encode(docs.where("doc_id < 9"), path, P.PATTERN), path, P.PATTERN)
    assert all(bytes(r.bytes) == (TEXTS[r.doc_id] or "").encode() for r in back.collect())


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    encoder = word_bpe.WordEncoder(P.path("word_bpe_49k.json"), memo_bytes=20_000)
    assert encoder.by_words
    for seed in range(6):
        texts = texts_of_any_kind(60, seed) + TEXTS
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        column = pa.array(texts, pa.string())
        ids, sizes = encoder.ids(column.slice(0))
        assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(x) for x in want]


def test_files_that_keep_white_space_are_encoded_whole():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encoder = word_bpe.WordEncoder(P.path("byte_bpe_50k.json"))
    assert not encoder.by_words
    texts = texts_of_any_kind(60, 9) + TEXTS + ["hello world  two"]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, sizes = encoder.ids(pa.array(texts, pa.string()))
    assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(x) for x in want]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_long_texts_are_split_at_safe_boundaries(name):
    cut, whole = token_counts.Pieces(P.path(name), piece_chars=25), token_counts.Pieces(P.path(name), piece_chars=1 << 40)
    words = ["The", "the", "cat's", "12", "été", "漢字", "don't", "!", "x", "<|endoftext|>", "\u2581", "a\u0301", "", "\n", "\x85b", "\t"]
    rnd = random.Random(8)
    texts = [*texts_of_any_kind(200, 3), *TEXTS, *(" ".join(rnd.choice(words) for _ in range(300)) for _ in range(50))]
    assert sum(len(list(cut.of(t or ""))) for t in texts) > 2 * len(texts)
    column = pa.array(texts, pa.string())
    assert cut.counts(column).tolist() == whole.encode([t or "" for t in texts]) == cut.counts(pa.concat_arrays([column.slice(0, 3), column]).slice(3)).tolist()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, name):
    got = token_counts.token_counts(docs, P.path(name), limit=20).collect()
    assert len(got) == len(TEXTS) + 2
    if name.endswith("json"):
        from tokenizers import Tokenizer

        count = lambda t: len(Tokenizer.from_file(P.path(name)).encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(t))
    for r in got:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), count(text)) and r.over_limit == (r.n_tokens > 20)
    assert token_counts.token_counts(docs.limit(0), P.path(name)).count() == 0


def test_simple8b_packs_any_values():
    rng = np.random.default_rng(0)
    for i in range(60):
        n, bits = int(rng.integers(0, 5000)), int(rng.choice([1, 4, 16, 30, 60, 64]))
        v = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) >> np.uint64(64 - bits)
        if i % 3 == 0:
            v[rng.random(n) < 0.9] = 0
        words, offsets = simple8b.pack(v)
        assert (simple8b.unpack(words, offsets, n) == v).all()
        back = simple8b.file_content(simple8b.file_bytes(v, np.array([4, 5]), np.array([1, 0]), np.array([n, 0])))
        assert (back[0] == v).all() and back[2].tolist() == [True, False]
    with pytest.raises(ValueError):
        simple8b.file_content(b"S8BIDS01 cut")


def test_simple8b_blocks_decode_from_their_offsets():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 63, 9000, dtype=np.uint64) >> rng.integers(0, 63, 9000).astype(np.uint64)
    v[3000:5000] = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) + np.uint64(1 << 62)  # escapes
    words, offsets = simple8b.pack(v)
    data = simple8b.file_bytes(v, np.array([1]), np.array([1]), np.array([len(v)]))
    for lo, hi in ((0, 1), (1023, 1025), (2048, 3072), (4000, 4001), (8999, 9000), (5, 5), (100, 20_000)):
        assert (simple8b.unpack(words, offsets, len(v), start=lo, stop=hi) == v[lo:hi]).all()
        assert (simple8b.file_slice(data, lo, hi) == v[lo:hi]).all()
    # words of other blocks are not looked at
    other = words.copy()
    other[: offsets[3]] = other[offsets[4] :] if len(other) - offsets[4] == offsets[3] else np.uint64(7)
    assert (simple8b.unpack(other, offsets, len(v), start=3 * 1024, stop=4 * 1024) == v[3 * 1024 : 4 * 1024]).all()
    for bad in (np.zeros(0, np.int64), np.zeros_like(offsets), offsets + 1):
        with pytest.raises((ValueError, IndexError)):
            simple8b.unpack(words, bad, len(v))


def test_id_files(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    one = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    written = simple8b.write_ids(one, simple8b.word_encoder(P.path("word_bpe_49k.json")), end_id=2, file_ids=50)
    assert written.count() > 1
    start = 0
    got = {r.doc_id: r for r in simple8b.read_digests(written).collect()}
    arrays = {r.doc_id: r for r in simple8b.read_ids(written).collect()}
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert list(arrays[i].ids) == ids
        start += len(ids)
    empty = simple8b.write_ids(docs.limit(0), simple8b.word_encoder(P.path("word_bpe_49k.json")), end_id=2)
    assert simple8b.read_digests(empty).count() == 0
    again = simple8b.read_digests(simple8b.write_ids(docs, simple8b.word_encoder(P.path("word_bpe_49k.json")), end_id=2)).collect()
    assert len(again) == len(TEXTS) + 2 and sum(r.doc_id is None for r in again) == 1
