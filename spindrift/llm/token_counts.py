"""Token counts: batch encoding in Arrow functions, lengths out.

A task's texts are dealt into library calls of about ``batch_bytes`` each. Long
texts are split at safe boundaries first, so one long text is many entries of
such calls instead of one: no token of the vocabulary and no match of its rules
crosses such a boundary, which is read from the vocabulary file (``Pieces``); a
file that does not show it keeps its texts whole. Files that drop white space
split every text at all of it, and a call encodes the distinct pieces whose
lengths a worker does not know yet (it keeps ``MEMO_BYTES`` of short ones). No
ids leave the Python worker and there is no shuffle: a task counts the rows of
its own scan split.

Null and empty texts have 0 tokens; an empty table gives no rows; a long text
is in memory once, with one call's ids. Rows keep their order within a task,
repeated rows are counted each, a null id stays null, and columns other than
the key and the text are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import SPACE
from .shared import releasing
from .word_bpe import byte_slices, drops_white_space, open_tokenizer

#: In front of a blank or a line's end that follows no white space.
_BEFORE_SPACE = re.compile(f"(?<!{SPACE})(?=[ \\n])")
#: One space between two other characters; it belongs to neither piece.
_ONE_SPACE = re.compile(r"(?<=[^\s\u2581]) (?=[^\s\u2581])")
_WORD_MARK = "\u2581"
#: Short pieces whose lengths a worker keeps, by vocabulary file.
MEMO_BYTES, MEMO_PIECE = 16 << 20, 24
_memos: dict[str, tuple[pa.Array, np.ndarray]] = {}


def _byte_level(tokenizer) -> bool:
    """Whether a file of the tokenizers library has no step before the merges
    but the byte-level pattern, in whose matches white space only comes first."""
    c = json.loads(tokenizer.to_str())
    pre = c.get("pre_tokenizer") or {}
    plain = c.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    return bool(plain) and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in c["added_tokens"])


class Pieces:
    """Counts of a vocabulary file and the boundaries at which its texts may be
    split: in front of white space for files that drop it or whose matches
    start with it; at a single space, left out, for word-piece models whose
    pieces hold the word mark in front only and whose encoder adds it."""

    def __init__(self, path: str, piece_chars: int = 1 << 16):
        self.path, self.piece_chars = path, piece_chars
        self.cut, self.skip, self.by_words = None, 0, False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode: Callable[[list[str]], list[int]] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            inner = any(_WORD_MARK in model.id_to_piece(i).lstrip(_WORD_MARK) for i in range(model.get_piece_size()))
            if not inner and model.encode("a b") == model.encode("a") + model.encode("b"):
                self.cut, self.skip = _ONE_SPACE, 1
        else:
            tokenizer = open_tokenizer(path)
            self.encode = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.by_words = drops_white_space(tokenizer)
            if self.by_words or _byte_level(tokenizer):
                self.cut = _BEFORE_SPACE

    def of(self, text: str) -> Iterator[str]:
        start = 0
        while self.cut is not None and len(text) - start > self.piece_chars:
            found = self.cut.search(text, start + self.piece_chars)
            if found is None:
                break
            yield text[start : found.start()]
            start = found.start() + self.skip
        yield text[start:] if start else text

    def _lengths(self, pieces: pa.Array) -> np.ndarray:
        """Number of tokens of distinct pieces."""
        known, sizes = _memos.get(self.path, (pa.array([], pa.large_string()), np.zeros(0, np.int64)))
        at = pc.index_in(pieces, value_set=known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        out = np.zeros(len(pieces), np.int64)
        out[~new] = sizes[at.drop_null().to_numpy()]
        missing = pieces.filter(pa.array(new))
        out[new] = self.encode(missing.to_pylist()) if len(missing) else 0
        if known.nbytes < MEMO_BYTES:
            short = pc.less_equal(pc.binary_length(missing), MEMO_PIECE)
            _memos[self.path] = pa.concat_arrays([known, missing.filter(short)]), np.concatenate([sizes, out[new][short.to_numpy(zero_copy_only=False)]])
        return out

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of tokens of each text (null: 0)."""
        if self.by_words:
            lists = pc.ascii_split_whitespace(pc.cast(pc.fill_null(column, ""), pa.large_string()))
            coded = lists.flatten().dictionary_encode()
            size = self._lengths(coded.dictionary)
            sums = np.concatenate([[0], np.cumsum(size[coded.indices.to_numpy()])])
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            return sums[ends[1:]] - sums[ends[:-1]]
        texts = column.to_pylist()
        pieces, owner = [], []
        for i, text in enumerate(texts):
            for piece in self.of(text or ""):
                pieces.append(piece)
                owner.append(i)
        return np.bincount(owner, self.encode(pieces), len(texts)).astype(np.int64) if pieces else np.zeros(len(texts), np.int64)


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, batch_bytes: int = 4 << 20, piece_chars: int = 1 << 16
) -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` per row.

    ``path``: a ``.json`` file of the tokenizers library or a ``.model`` file
    of sentencepiece, present on every executor.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path, piece_chars)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in byte_slices(texts, batch_bytes):
                part = texts.slice(lo, hi - lo)
                n = pa.array(pieces.counts(part), pa.int64())
                size = pc.cast(pc.fill_null(pc.binary_length(part), 0), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    out = source.mapInArrow(releasing(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("doc_id", id_col)
