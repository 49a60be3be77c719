"""Byte-level BPE encoding and decoding with a local rank file.

Encoding runs tiktoken in Arrow batches. A text is first cut at safe
boundaries: in front of white space that follows another character, no match
of the pattern crosses. (That holds for ``SPLITS``; texts of any other pattern
are encoded whole.) Very long runs of white space, on which the library's
regex engine overflows, are cut by the pattern's own rule (all but the last
character match ``\\s+(?!\\S)``) and merged without the regex. Decoding joins
the raw bytes of the ranks; the bytes need not be valid UTF-8 in between.

Null and empty texts have no ids, null ids no bytes; an empty table gives no
rows; repeated rows are answered each. A text and its ids are in memory at
once, however long. ``encode``, ``decode`` and ``round_trip`` read the id and
the text (or ids) only; ``encoded_rows`` passes other columns through and
replaces those named like its results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .shared import releasing

#: White space as the pattern's regex engine sees it.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Fixed value: the pattern whose safe boundaries are known.
SPLITS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG_SPACE = re.compile(SPACE + "{256,}")
_CUT = re.compile(f"(?<!{SPACE})(?={SPACE})")


class RankCodec:
    """Encoder and decoder over one rank file. One instance per task."""

    def __init__(self, path: str, pattern: str, piece_chars: int = 1 << 18):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.piece_chars = piece_chars
        self.cuts = pattern == SPLITS
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self._sizes = np.array([len(x) for x in table], np.int64)
        self._starts = np.concatenate([[0], np.cumsum(self._sizes)])[:-1]
        self._bytes = np.frombuffer(b"".join(table), np.uint8)

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of a text that encode alone; True marks a part that is one match."""
        if not self.cuts or len(text) <= self.piece_chars and not _LONG_SPACE.search(text):
            yield text, False
            return
        at = 0
        for run in _LONG_SPACE.finditer(text):
            yield from self._cut(text, at, run.start())
            # the last character of a run in front of a word belongs to what follows
            at = run.end() if run.end() == len(text) else run.end() - 1
            yield text[run.start() : at], True
        yield from self._cut(text, at, len(text))

    def _cut(self, text: str, start: int, stop: int) -> Iterator[tuple[str, bool]]:
        while stop - start > self.piece_chars:
            # from start+1 on: a run's last character at start stays with its word
            cut = _CUT.search(text, start + self.piece_chars, stop)
            if cut is None or cut.start() >= stop:
                break
            yield text[start : cut.start()], False
            start = cut.start()
        if stop > start:
            yield text[start:stop], False

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers (null: none)."""
        parts = []
        for piece, whole in self.pieces(text or ""):
            if whole:
                parts.append(np.asarray(self.encoding._encode_single_piece(piece), "<u4"))
            else:
                parts.append(self.encoding.encode_to_numpy(piece, disallowed_special=()).astype("<u4", copy=False))
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, "<u4"), *parts])

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' raw bytes."""
        if not len(ids):
            return b""
        sizes = self._sizes[ids]
        ends = np.cumsum(sizes)
        inside = np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes)
        return self._bytes[np.repeat(self._starts[ids], sizes) + inside].tobytes()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) per row; null or empty text: no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = RankCodec(path, pattern)
        for batch in batches:
            for keys, texts in _small(batch):
                ids = [codec.encode(t) for t in texts.to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate([np.zeros(0, np.int32), *(x.astype(np.int32) for x in ids)]), pa.int32())
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(releasing(run), "doc_id long, ids array<int>").withColumnRenamed("doc_id", id_col)


def decode(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``bytes`` per row; null ids: no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = RankCodec(path, pattern)
        for batch in batches:
            out = [codec.decode(np.asarray(x if x is not None else [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    source = coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(releasing(run), "doc_id long, bytes binary").withColumnRenamed("doc_id", id_col)


def encoded_rows(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` without the text, ``n_tokens``, ``ids`` (array of
    int) and ``decodes`` (whether they decode to the text's bytes)."""
    names = [c for c in docs.columns if c not in (text_col, "n_tokens", "ids", "decodes")]
    source = docs.select(*names, F.col(text_col).cast("string").alias("_text"))
    schema = source.drop("_text").schema.add("n_tokens", "long").add("ids", ArrayType(IntegerType())).add("decodes", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .word_bpe import byte_slices

        codec = RankCodec(path, pattern)
        for batch in batches:
            for lo, hi in byte_slices(batch.column(len(names)), 2 << 20):
                part = batch.slice(lo, hi - lo)
                texts = part.column(len(names)).to_pylist()
                ids = [codec.encode(t) for t in texts]
                good = [codec.decode(x) == (t or "").encode() for x, t in zip(ids, texts, strict=True)]
                size = [len(x) for x in ids]
                flat = pa.array(np.concatenate([np.zeros(0, np.int32), *(x.astype(np.int32) for x in ids)]), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(size, pa.int64()), lists, pa.array(good, pa.bool_())], [*names, "n_tokens", "ids", "decodes"])

    return source.mapInArrow(releasing(run), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of both directions without moving ids: ``n_tokens``,
    ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers) and
    ``decoded_sha256`` (of the decoded bytes) per row. No shuffle; null and
    empty texts have no ids; repeated rows are answered each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = RankCodec(path, pattern)
        for batch in batches:
            for keys, texts in _small(batch):
                n, a, b = [], [], []
                for text in texts:
                    ids = codec.encode(text.as_py())
                    n.append(len(ids))
                    a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    out = _texts(docs, id_col, text_col).mapInArrow(releasing(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)


def _small(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    from .word_bpe import byte_slices

    for lo, hi in byte_slices(batch.column(1), 2 << 20):
        yield batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
