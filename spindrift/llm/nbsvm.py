"""Quality classifier: naive Bayes support vectors.

Features are n-gram indicators, hashed: words and pairs of words, and 1- to
3-grams of word shapes (letter case, last mark, length, repeat of the word
before), the latter at several shares of the text, since one odd word says
little about a long text. An indicator is scaled by its log-count ratio between
the classes, and a linear model is fitted on the hinge loss by dual coordinate
descent until no row's optimality condition is off by more than a tolerance; a
logistic curve over the margins gives scores. The fit runs on a bounded sample
of labelled rows, drawn by hash (``per_class`` rows of each label), the curve
on the same rows weighted by the class counts of the whole training fold, so
the cap does not change what 0.5 stands for. Scoring reads all rows.

Nothing but the text enters a score. Null and empty texts have no features and
get the score of the intercept. Labels that are null are not used; of several
labels of one document the largest counts; of rows that repeat an id and a text
one is learned. With one class only (or no labels) every score is that class's
share (0.5 without any). An empty table gives no rows; a column named ``score``
is replaced, all others pass through. A text's words are in memory at once, its
neighbours' in a batch are not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hand_back, releasing, unused
from .word_bpe import byte_slices

BITS = 18
#: Bytes of text whose indicators are in memory at once; a longer text goes alone.
SLICE = 1 << 19
#: Shares of a text's n-grams from which an indicator of that level is on.
LEVELS = (0.0, 0.02, 0.1, 0.3, 0.6)


@dataclass
class Model:
    weights: np.ndarray  # of hashed indicators, scaled already
    bias: float
    slope: float
    offset: float

    def scores(self, ids: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
        """``ids[i]`` is an indicator of document ``docs[i]``; each once."""
        sums = np.bincount(docs, self.weights[ids], n)
        norm = np.sqrt(np.maximum(np.bincount(docs, minlength=n), 1))
        z = self.slope * (sums / norm + self.bias) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _shapes(words: pa.Array) -> np.ndarray:
    """A small number for each word: case, last mark and length."""
    upper, lower = pc.utf8_is_upper(words), pc.utf8_is_lower(words)
    title = pc.utf8_is_title(words)
    case = np.select([pc.and_(upper, pc.greater(pc.utf8_length(words), 1)).to_numpy(zero_copy_only=False), title.to_numpy(zero_copy_only=False), lower.to_numpy(zero_copy_only=False)], [1, 2, 3], 0)
    last = pc.utf8_slice_codeunits(words, -1)
    code = np.array([ord(c) if c else 0 for c in last.to_pylist()], np.int64)
    mark = np.select([code == ord("."), code == ord(","), code == ord("!"), code == ord("|"), (code >= 48) & (code < 58)], [1, 2, 3, 4, 5], 0)
    letter = np.array([chr(c).isalpha() if c else False for c in code.tolist()])
    mark = np.where((mark == 0) & ~letter, 6, mark)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    return (case * 7 + mark) * 4 + np.digitize(size, [2, 6, 14])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed indicators and the text of each, without repeats, by text."""
    lists = pc.ascii_split_whitespace(pc.cast(pc.fill_null(texts, ""), pa.large_string()))
    words = lists.flatten()
    keep = pc.greater(pc.binary_length(words), 0)
    sizes = np.diff(lists.offsets.to_numpy())
    doc = np.repeat(np.arange(len(texts)), sizes)[keep.to_numpy(zero_copy_only=False)]
    words = words.filter(keep)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = words.dictionary_encode()
    at, names = coded.indices.to_numpy(), coded.dictionary
    n = np.bincount(doc, minlength=len(texts))
    repeat = np.zeros(len(at), np.int64)
    same = doc[1:] == doc[:-1]
    repeat[1:] = same & (at[1:] == at[:-1])
    shape = _shapes(names)[at] * 2 + repeat
    found = []

    def add(kind: int, gram: np.ndarray, of: np.ndarray, levels) -> None:
        code = gram * 4 + kind
        pairs, count = np.unique(of * (1 << 40) + code, return_counts=True)
        d, g = pairs >> 40, pairs & ((1 << 40) - 1)
        share = count / n[d]
        for i, level in enumerate(levels):
            on = share > level
            found.append(d[on] * (1 << BITS) + _mix(g[on] * 8 + i).astype(np.int64))

    add(0, shape, doc, LEVELS)
    two = same
    add(1, shape[:-1][two] * 256 + shape[1:][two], doc[1:][two], LEVELS)
    three = two[1:] & two[:-1]
    add(2, (shape[:-2][three] * 256 + shape[1:-1][three]) * 256 + shape[2:][three], doc[2:][three], LEVELS[1:])
    lower = pc.utf8_lower(names)
    word = np.fromiter((_text_hash(w) for w in lower.to_pylist()), np.int64, len(names))[at]
    add(3, word, doc, LEVELS[:1])
    pair = (word[:-1] * 0x9E3779B1 + word[1:]) & ((1 << 36) - 1)
    add(3, (pair | 1 << 36)[two], doc[1:][two], LEVELS[:1])
    pairs = np.unique(np.concatenate(found))
    return pairs & ((1 << BITS) - 1), pairs >> BITS


def _text_hash(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode())


def hinge(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cap: np.ndarray, size: int, tolerance: float = 1e-3, most_passes: int = 300, seed: int = 7) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of the linear support vector machine
    with hinge loss: least |w|^2 / 2 + b^2 / 2 + sum of cap * max(0, 1 - y * f).

    Dual coordinate descent: each step solves the dual for one row within
    0..cap. A row whose projected gradient is below ``tolerance`` rests; the
    fit ends when all rows rest in one pass over all of them.
    """
    squares = np.array([np.dot(v, v) for v in values], float) + 1.0
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    live, everyone = np.arange(len(y)), True
    for _ in range(most_passes):
        moving = []
        for i in rng.permutation(live).tolist():
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            if abs(min(g, 0) if alpha[i] <= 0 else max(g, 0) if alpha[i] >= cap[i] else g) <= tolerance:
                continue
            moving.append(i)
            new = min(max(alpha[i] - g / squares[i], 0.0), cap[i])
            step = (new - alpha[i]) * y[i]
            w[rows[i]] += step * values[i]
            bias += step
            alpha[i] = new
        if moving:
            live, everyone = np.array(moving), False
        elif everyone:
            break
        else:
            live, everyone = np.arange(len(y)), True
    return w, bias, alpha


def logistic(margin: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic curve over the margins, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(weight * (p - target) * margin).sum() + 1e-2 * (a - 1), (weight * (p - target)).sum() + 1e-2 * b])
        r = weight * p * (1 - p)
        h = np.array([[(r * margin * margin).sum() + 1e-2, (r * margin).sum()], [(r * margin).sum(), r.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, totals: tuple[int, int] | None = None, smooth: float = 1.0, c: float = 1.0) -> Model:
    """Log-count ratios, then the hinge-loss fit with evenly weighted classes;
    rows are scaled to the root of their size. ``totals``: rows with and without
    the label in all, for the scores' curve (default: those given)."""
    y = np.where(labels > 0, 1.0, -1.0)
    n = (int((y > 0).sum()), int((y < 0).sum()))
    totals = totals or n
    if not n[0] or not n[1]:
        share = totals[0] / sum(totals) if sum(totals) else 0.5
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    share = n[0] / len(y)
    held = np.full((2, 1 << BITS), smooth)
    for r, positive in zip(rows, y > 0, strict=True):
        held[int(positive)][r] += 1
    ratio = np.log((held[1] / held[1].sum()) / (held[0] / held[0].sum()))
    values = [(ratio[r] / np.sqrt(max(len(r), 1))).astype(np.float32) for r in rows]
    cap = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) * c
    w, bias, _ = hinge(rows, values, y, cap, 1 << BITS)
    margin = np.array([w[r] @ v for r, v in zip(rows, values, strict=True)]) + bias
    weight = np.where(y > 0, totals[0] / n[0], totals[1] / n[1])
    a, b = logistic(margin, (y > 0).astype(float), weight * len(y) / weight.sum())
    return Model((w * ratio).astype(np.float32), bias, a, b)


def in_training(id_col: str = "doc_id", folds: int = 3, held_out: int = 1):
    """The fold rule: whether labels of this id may be learned."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) != held_out


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on at most ``per_class`` labelled rows of each class outside the
    held-out fold. The sample is smallest in the hash of its ids, so it does
    not depend on partitioning; only its indicators go to the driver."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & in_training(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    order = [F.xxhash64("_id").asc(), F.col("_id").asc()]
    counts = known.agg(F.count_if(F.col("_label") > 0), F.count_if(F.col("_label") <= 0)).first()
    sample = known.where("_label > 0").orderBy(*order).limit(per_class).unionByName(known.where("_label <= 0").orderBy(*order).limit(per_class))
    # at most 2 * per_class rows of two numbers
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch.column(1), SLICE):
                part = batch.slice(lo, hi - lo)
                ids, of = indicators(part.column(1))
                offsets = np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], ["id", "label", "ids"])

    got = texts.select("_id", "text", "_label").mapInArrow(releasing(run), "id long, label int, ids array<int>").toArrow().sort_by("id")
    # rows of one id with equal texts are one example
    seen, rows, y = set(), [], []
    for i, label, ids in zip(got["id"].to_pylist(), got["label"].to_pylist(), got["ids"], strict=True):
        ids = ids.values.to_numpy(zero_copy_only=False)
        mark = (i, hashlib.sha256(ids.tobytes()).digest())
        if mark not in seen:
            seen.add(mark)
            rows.append(ids)
            y.append(label)
    model = fit(rows, np.array(y), (int(counts[0]), int(counts[1])))
    del got, rows, seen
    hand_back()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score_col`` (0 to 1, higher: label 1 likelier)."""
    names = [c for c in docs.columns if c != score_col]
    body = unused(docs.columns, "body")
    source = docs.select(*names, F.col(text_col).cast("string").alias(body))
    at, schema = len(names), source.drop(body).schema.add(score_col, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch.column(at), SLICE):
                part = batch.slice(lo, hi - lo)
                ids, of = indicators(part.column(at))
                s = pa.array(model.scores(ids, of, part.num_rows), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], s], [*names, score_col])

    return source.mapInArrow(releasing(run), schema)


def quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(texts, train(docs, labels, **how))
    held = F.coalesce(~in_training("doc_id"), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
