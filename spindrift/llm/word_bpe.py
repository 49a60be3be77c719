"""Encoding with a vocabulary file of the tokenizers library.

Where the file's own steps show that white space is dropped and never joined
(see ``drops_white_space``), a text encodes to its words' ids in order: a batch
is cut at ASCII white space, each distinct word goes through the library once,
and a memo bounded in bytes carries words from batch to batch. Words keep the
library's own treatment of special strings, Unicode and punctuation. Texts of
any other file go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def byte_slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; one long text may exceed it."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        floor = int(sizes[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, floor + limit, side="right")))
        yield start, stop
        start = stop


#: A character that vocabularies give one id, between words that are encoded together.
MARK = "0"


class _Memo:
    """Words of earlier batches and tasks of this worker, and their ids."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_list(pa.uint32()))
        self.pieces: dict[str, bytes] = {}

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.ids.nbytes


_memos: dict[str, _Memo] = {}
#: Bytes of a dictionary entry of the memo beside its ids.
_ENTRY = 200


#: Steps before the merges that drop white space: for printable ASCII without
#: "<|" they lower the case and cut by this pattern.
_STEPS = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
_PLAIN_WORD = re.compile(r"[!-~]+")
_PLAIN_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def drops_white_space(tokenizer) -> bool:
    """Whether the vocabulary file has the steps above, byte-level merges and
    no added token that holds white space or takes any."""
    c = json.loads(tokenizer.to_str())
    try:
        split, byte = c["pre_tokenizer"]["pretokenizers"]
        return (
            [n["type"] for n in c["normalizer"]["normalizers"]] == _STEPS["normalizer"]
            and split["pattern"] == {"Regex": _STEPS["pattern"]}
            and split["behavior"] == "Removed"
            and split["invert"]
            and byte["type"] == "ByteLevel"
            and not byte["use_regex"]
            and not byte["add_prefix_space"]
            and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"]) for t in c["added_tokens"])
        )
    except (KeyError, TypeError, ValueError):
        return False


def open_tokenizer(path: str):
    """The library's tokenizer of a file, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordEncoder:
    """Ids of texts. One instance per task; the tasks of a worker share a memo
    of about ``memo_bytes`` in all, for words of ``memo_word_chars`` characters
    at most."""

    def __init__(self, path: str, memo_bytes: int = 64 << 20, memo_word_chars: int = 24):
        self.tokenizer = open_tokenizer(path)
        self.memo = _memos.setdefault(path, _Memo())
        self.by_words = drops_white_space(self.tokenizer)
        self.memo_bytes, self.memo_word_chars = memo_bytes // 2, memo_word_chars
        mark = self._ids([MARK])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _library(self, words: list[str]) -> list[bytes]:
        """Each word's ids. Words are encoded as one text, with a digit between
        them that becomes an id of its own; words with that digit go alone."""
        out: list = [None] * len(words)
        merges, pieces = self.tokenizer.model.tokenize, self.memo.pieces
        for i, w in enumerate(words):
            if _PLAIN_WORD.fullmatch(w) and "<|" not in w:
                parts = []
                for p in _PLAIN_PIECE.findall(w.lower()):
                    ids = pieces.get(p)
                    if ids is None:
                        ids = b"".join([x.id.to_bytes(4, "little") for x in merges(p)])
                        if len(pieces) * _ENTRY < self.memo_bytes and len(p) <= self.memo_word_chars:
                            pieces[p] = ids
                    parts.append(ids)
                out[i] = parts[0] if len(parts) == 1 else b"".join(parts)
        joined = [i for i, w in enumerate(words) if out[i] is None and MARK not in w] if self.mark is not None else []
        for lo in range(0, len(joined), 10_000):
            part = joined[lo : lo + 10_000]
            ids = self._ids([f" {MARK} ".join([words[i] for i in part])])[0]
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(part) - 1:  # a word made the mark's id: take them one by one
                continue
            data = ids.tobytes()
            for i, x, y in zip(part, [0, *(4 * ends + 4).tolist()], [*(4 * ends).tolist(), len(data)], strict=True):
                out[i] = data[x:y]
        alone = [i for i, x in enumerate(out) if x is None]
        for lo in range(0, len(alone), 10_000):
            part = alone[lo : lo + 10_000]
            for i, x in zip(part, self._ids([words[i] for i in part]), strict=True):
                out[i] = x.tobytes()
        return out

    def _looked_up(self, words: pa.LargeStringArray) -> tuple[pa.LargeListArray, np.ndarray]:
        """Lists of ids, and which of them is each word's."""
        memo = self.memo
        known = pc.index_in(words, value_set=memo.words)
        missing = words.filter(pc.is_null(known))
        at = known.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(missing):
            return memo.ids, at
        fresh = self._library(missing.to_pylist())
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)) // 4)])
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(fresh), np.uint32)))
        both = pa.concat_arrays([memo.ids, lists])
        at[at < 0] = len(memo.ids) + np.arange(len(missing))
        if memo.nbytes < self.memo_bytes:
            short = pc.less_equal(pc.binary_length(missing), self.memo_word_chars)
            memo.words = pa.concat_arrays([memo.words, missing.filter(short)])
            memo.ids = pa.concat_arrays([memo.ids, lists.filter(short)])
        return both, at

    @staticmethod
    def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Dictionary-coded words of all texts, and each text's first word."""
        lists = pc.ascii_split_whitespace(pc.cast(pc.fill_null(texts, ""), pa.large_string()))
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        offsets = lists.offsets.to_numpy()
        words = lists.flatten()
        return words.dictionary_encode(), offsets - offsets[0]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and each text's number of ids (null: 0)."""
        if not self.by_words:
            found = self._ids([t or "" for t in texts.to_pylist()])
            return np.concatenate([np.zeros(0, "<u4"), *found]), np.array([len(x) for x in found], np.int64)
        coded, offsets = self._words(texts)
        lists, at = self._looked_up(coded.dictionary)
        at = at[coded.indices.to_numpy()]
        out = lists.take(pa.array(at)).flatten().to_numpy()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)[at]
        sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return out, sums[offsets[1:]] - sums[offsets[:-1]]
