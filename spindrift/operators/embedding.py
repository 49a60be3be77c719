"""Text vectors: backends by name, prefixes, pooling, and embedding of tables.

A backend turns Arrow batches of texts into rows of a matrix. The built-in one
hashes words; model files are plugged in by ``register``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.text import terms

# What models of this kind expect in front of stored texts and of questions.
PREFIXES = {"document": "search_document: ", "query": "search_query: "}


class Backend(Protocol):
    """Opened once a task; ``embed_batch`` gives one row per list of words."""

    dimension: int

    def embed_batch(self, words: list[list[str]]) -> np.ndarray: ...


class HashedWords:
    """Signed feature hashing: a word's cell and sign come from its digest."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension
        self._known: dict[str, tuple[int, int]] = {}

    def _cell(self, word: str) -> tuple[int, int]:
        found = self._known.get(word)
        if found is None:
            digest = hashlib.md5(word.encode()).hexdigest()
            found = int(digest[:8], 16) % self.dimension, 1 if int(digest[8], 16) % 2 == 0 else -1
            if len(self._known) < 100_000:
                self._known[word] = found
        return found

    def embed_batch(self, words: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(words), self.dimension))
        for row, found in zip(out, words, strict=True):
            for word in found:
                cell, sign = self._cell(word)
                row[cell] += sign
        return out


_BACKENDS: dict[str, Callable[..., Backend]] = {"hashed": HashedWords}


def register(name: str, make: Callable[..., Backend]) -> None:
    _BACKENDS[name] = make


def create(name: str = "hashed", **settings) -> Backend:
    if name not in _BACKENDS:
        raise ValueError(f"unknown embedding backend: {name}")
    return _BACKENDS[name](**settings)


def prefixed(text: Column, task: str) -> Column:
    """A text with the prefix of its task (document or query)."""
    return F.concat(F.lit(PREFIXES[task]), F.coalesce(text, F.lit("")))


def mean_pooled(states: Column, mask: Column) -> Column:
    """Mean of the vectors (array of arrays) whose mask is 1; the sum of masks
    counts as 1e-9 at least."""
    kept = F.filter(F.zip_with(states, mask, lambda s, m: F.when(m > 0, s)), lambda s: s.isNotNull())
    total = F.aggregate(kept, F.transform(states[0], lambda _: F.lit(0.0)), lambda a, s: F.zip_with(a, s, lambda x, y: x + y.cast("double")))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m.cast("double")), F.lit(1e-9))
    return F.transform(total, lambda x: x / n)


def embedded(texts: DataFrame, text_col: str, out: str = "embedding", backend: str = "hashed", **settings) -> DataFrame:
    """``texts`` and a vector of length one for each (zero vectors stay). A
    backend sees each distinct text of a batch once."""
    names = [c for c in texts.columns if c != out]
    schema = StructType([*(texts.schema[c] for c in names), StructField(out, ArrayType(DoubleType()))])
    source = texts.select(*names, F.coalesce(F.array_join(terms(F.col(text_col)), " "), F.lit("")).alias("_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = create(backend, **settings)
        for b in batches:
            coded = b.column(len(names)).dictionary_encode()
            rows = np.asarray(model.embed_batch([x.split() for x in coded.dictionary.to_pylist()]), float).reshape(-1, model.dimension)
            size = np.linalg.norm(rows, axis=1, keepdims=True)
            rows = (rows / np.where(size == 0, 1, size))[coded.indices.to_numpy()]
            offsets = pa.array(np.arange(len(rows) + 1) * model.dimension, pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], [*names, out])

    return source.mapInArrow(run, schema)


def fetched(vectors: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The vectors of some ids; unknown ids give none."""
    return vectors.join(ids.select(key).distinct(), key, "left_semi")


def statistics(vectors: DataFrame, column: str = "embedding", bytes_each: int = 4) -> DataFrame:
    """Number of vectors, their greatest dimension and bytes."""
    n, width = F.count(column), F.coalesce(F.max(F.size(column)), F.lit(0))
    return vectors.agg(n.alias("vectors"), width.cast("long").alias("dimension"), F.coalesce(F.sum(F.size(column).cast("long")) * bytes_each, F.lit(0)).alias("bytes"))
