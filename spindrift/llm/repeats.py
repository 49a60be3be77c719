"""Removal of long repeated byte strings.

A byte goes when a string of ``length`` bytes that covers it also starts
somewhere else in the corpus, the same document included.

1. Cells. The least hash of the k-grams inside a window of ``length`` bytes is
   its anchor, so equal windows have equal anchors. Consecutive windows with
   one anchor are a cell; its content is a few hundred bytes.
2. Cells meet by anchor: an anchor that occurs once is not repeated. Equal
   cells of one task, compared by their bytes, are counted before the shuffle
   and go on as one.
3. The bytes of all cells whose anchors meet are dealt by anchor. Equal ones
   collapse; the distinct ones get a run-length index (the run-compressed
   Burrows-Wheeler transform of their contents, with suffixes sampled at run
   ends and the match lengths at these). From the samples, matching statistics
   stream along the text, one less at each step, and positions whose match
   elsewhere has ``length`` bytes are marked.
4. Marks are united by task, joined to their documents, the rest is kept.

Hashes only bring equal strings together and set aside those that cannot be
repeated; what is repeated is decided from the bytes. No task holds more than
``index_bytes`` of distinct contents: the windows of an anchor with more are
counted by their hashes, over all tasks, and those that are counted twice get
indexes of their own, dealt by window. Long texts are cut into pieces that
share their border windows.

Null and empty texts have nothing to remove. Rows that repeat an id are
documents of their own. An empty table gives no rows. A text and the list of
its marked ranges are in memory at once. Columns pass through; those named like
results are replaced in ``kept`` and left alone in ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .ngram_join import mixed
from .shared import releasing, tasks_for, unique_ids, unused, written
from .word_bpe import byte_slices

_U = np.uint64
_RNG = np.random.default_rng(77)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_FINE = _RNG.integers(1, 1 << 63, 4, dtype=np.uint64) | _U(1)
_PLACE = (1 << 24) - 1
GRAM = 64
#: Bytes of a text handled at once; longer texts are cut here.
PIECE = 1 << 22


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_cached: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    if size not in _cached:
        _cached.clear()
        _cached[size] = (_powers(_BASE, size), _powers(_INVERSE, size))
    return _cached[size]


def substring_hashes(flat: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of ``flat[start:stop]``, equal for equal bytes wherever they stand."""
    power, inverse = _both_powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE[flat] * power[: len(flat)], out=sums[1:])
    return mixed((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64) * _FINE[0])


def cells(flat: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Cells of the texts that stand in ``flat`` one after another: anchor
    hash, content hash, text number, first and last window."""
    window = length - GRAM + 1
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    n = len(flat)
    if n < length:
        return empty
    h, reach, base = _BYTE[flat], 1, _BASE
    while reach < GRAM:
        h = h[:-reach] * _U(base) + h[reach:]
        base, reach = base * base % (1 << 64), 2 * reach
    h = mixed(h)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    least = (h & ~_U(_PLACE)) | (_U(_PLACE) - at[: len(h)].astype(np.uint64))
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    good = np.flatnonzero(at[: len(least)] + length <= sizes[doc[: len(least)]])
    if not len(good):
        return empty
    anchor = _PLACE - (least[good] & _U(_PLACE)).astype(np.int64)
    of = doc[good]
    new = np.ones(len(good), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(good)) - 1
    begin = good[first] - at[good[first]]
    start, stop = good[first], good[last] + length
    content = substring_hashes(flat, start, stop)
    content = mixed(content + (begin + anchor[first] - start).astype(np.uint64) * _FINE[1])
    return h[begin + anchor[first]], content, of[first], at[good[first]], at[good[last]]


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some strings, each closed by
    an end mark of its own: the runs' first places and symbols, and for the
    suffixes at the runs' ends (``at``) how far they agree with the suffix on
    the other side of that end (``reach``). The text, its suffix order and all
    else of the building are let go."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        total = len(flat) + len(sizes)
        self.ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(total, np.int64)
        inner = np.ones(total, bool)
        inner[self.ends] = False
        text[inner] = flat.astype(np.int64) + 1
        levels = [_first_ranks(text, self.ends)]  # ranks by the first FIRST, 2 * FIRST, ... symbols
        depth, longest = FIRST, int(sizes.max(initial=0)) + 1
        while depth < longest and int(levels[-1].max(initial=0)) + 1 < total:
            pairs = levels[-1].astype(np.int64) * (total + 1)
            pairs[:-depth] += levels[-1][depth:] + 1
            levels.append(_ranked(pairs))
            depth *= 2
        suffixes = np.empty(total, np.int64)
        suffixes[levels[-1]] = np.arange(total)
        # end marks differ from one another: a string's first suffix never goes on its neighbour's run
        text[self.ends] = -1 - np.arange(len(sizes))
        before = np.where(suffixes > 0, text[suffixes - 1], 0)
        change = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.heads = np.concatenate([[0], change])
        self.symbols = before[self.heads]
        # on both sides of each change of runs: the suffix, and its match across it
        own = np.concatenate([suffixes[change], suffixes[change - 1]])
        match = _common(levels, text, suffixes[change], suffixes[change - 1])
        order = np.argsort(own, kind="stable")
        self.at, self.reach = own[order], np.concatenate([match, match])[order]

    def __len__(self) -> int:
        return int(self.ends[-1]) + 1 if len(self.ends) else 0

    def matching(self, block: int = 1 << 16) -> Iterator[np.ndarray]:
        """Matching statistics, block by block along the text: for each position
        the longest match that starts at another one. Inside a run it is one
        less than at the position before."""
        n, reached = len(self), 0
        for lo in range(0, n, block):
            hi = min(n, lo + block)
            first, last = np.searchsorted(self.at, [lo, hi])
            end = np.zeros(hi - lo, np.int64)
            np.maximum.at(end, self.at[first:last] - lo, self.at[first:last] + self.reach[first:last])
            end[0] = max(end[0], reached)
            end = np.maximum.accumulate(end)
            reached = int(end[-1])
            here = np.arange(lo, hi)
            yield np.minimum(np.maximum(end - here, 0), self.ends[np.searchsorted(self.ends, here)] - here)


def _ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(len(key), np.int32)
    rank[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]), dtype=np.int32)
    return rank


#: Symbols that the first sort compares at once: nine bits each.
FIRST = 7


def _first_ranks(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks by the first symbols, ends lowest. Suffixes that reach their end
    differ from all others; of equal ones the earlier string's comes first."""
    n = len(text)
    key, closed = text.copy(), text == 0
    for i in range(1, FIRST):
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - i)] = text[i:]
        ahead[closed] = 0
        key = key << 9 | ahead
        closed |= ahead == 0
    order = np.argsort(key, kind="stable")
    key = key[order]
    rank = np.empty(n, np.int32)
    rank[order] = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | closed[order][1:]]), dtype=np.int32)
    return rank


def _common(levels: list[np.ndarray], text: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefixes of suffixes ``i`` and ``j``."""
    out, n = np.zeros(len(i), np.int64), len(text)
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        inside = (i < n) & (j < n)
        same = np.zeros(len(i), bool)
        same[inside] = rank[i[inside]] == rank[j[inside]]
        step = same * (FIRST << level)
        out, i, j = out + step, i + step, j + step
    going = np.ones(len(i), bool)
    for _ in range(FIRST - 1):
        going &= (i < n) & (j < n)
        going[going] = text[i[going]] == text[j[going]]
        out, i, j = out + going, i + going, j + going
    return out


def repeated_windows(flat: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """By position in ``flat``: whether the ``length`` bytes from there also
    start elsewhere in the strings."""
    index = RunLengthIndex(flat, sizes)
    long = np.concatenate([np.zeros(0, bool), *(m >= length for m in index.matching())])
    return np.delete(long, index.ends)


CELL, DUP, CHECK, WINDOW = 0, 1, 2, 3
_CELLS = ["kind", "h", "g", "key", "s0", "s1", "many"]
_CELL_SCHEMA = "kind byte, h long, g long, key long, s0 long, s1 long, many boolean"


def _cell_rows(kind, h, g, key, s0, s1, many) -> pa.RecordBatch:
    n = len(key)
    kind = np.full(n, kind, np.int8) if np.isscalar(kind) else kind.astype(np.int8)
    arrays = [kind, h.view(np.int64) if h.dtype == np.uint64 else h, g.view(np.int64) if g.dtype == np.uint64 else g, key, s0, s1, many]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], _CELLS)


def _in_parts(batch: pa.RecordBatch, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], np.diff(bounds)


def _equal_bytes(flat: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from ``a`` and from ``b`` are the same."""
    out = np.ones(len(a), bool)
    ends = np.cumsum(size)
    start = 0
    while start < len(a):
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + (1 << 19), side="right")))
        n = size[start:stop]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = flat[np.repeat(a[start:stop], n) + step] == flat[np.repeat(b[start:stop], n) + step]
        out[start:stop] = np.logical_and.reduceat(same, np.cumsum(n) - n)
        start = stop
    return out


def _scan(texts: DataFrame, length: int, flush: int) -> DataFrame:
    """Cells of all texts. Equal cells of a block of a task are one row, marked
    ``many``, and their windows are sent on as repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bodies, rows, size = [], [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held, bodies, rows, size
            if held:
                h, g, key, s0, s1, place = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((g, h))
                h, g, key, s0, s1, place = h[order], g[order], key[order], s0[order], s1[order], place[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
                # copies of the first of each group, by their bytes
                copy = np.flatnonzero(~new)
                first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
                length_of = s1 - s0 + length
                same = length_of[copy] == length_of[first[copy]]
                same[same] = _equal_bytes(np.concatenate(bodies), place[copy[same]], place[first[copy[same]]], length_of[copy[same]])
                copy = copy[same]
                many = np.zeros(len(h), bool)
                many[first[copy]] = True
                go = np.ones(len(h), bool)
                go[copy] = False
                yield from _in_parts(_cell_rows(CELL, h[go], g[go], key[go], s0[go], s1[go], many[go]))
                many[copy] = True
                yield from _in_parts(_united(key[many], s0[many], s1[many]))
            held, bodies, rows, size = [], [], 0, 0

        def add(flat: np.ndarray, sizes: np.ndarray, keys: np.ndarray, shift: int = 0) -> None:
            nonlocal rows, size
            h, g, of, s0, s1 = cells(flat, sizes, length)
            held.append((h, g, keys[of], s0 + shift, s1 + shift, size + (np.cumsum(sizes) - sizes)[of] + s0))
            bodies.append(flat)
            rows += len(h)
            size += len(flat)

        for batch in batches:
            for lo, hi in byte_slices(batch.column(1), 1 << 20):
                keys = batch.column(0).slice(lo, hi - lo).to_numpy()
                flat, sizes = _flat(batch.column(1).slice(lo, hi - lo))
                if len(flat) > PIECE + length:
                    # one long text (or a few): pieces that share length - 1 bytes
                    for i, (a, whole) in enumerate(zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True)):
                        for p in range(0, max(1, whole - length + 1), PIECE):
                            part = flat[a + p : a + min(whole, p + PIECE + length - 1)]
                            add(part, np.array([len(part)]), keys[i : i + 1], p)
                            if rows >= flush:
                                yield from out()
                else:
                    add(flat, sizes, keys)
                if rows >= flush:
                    yield from out()
        yield from out()

    return texts.select("key", "text").mapInArrow(releasing(run), _CELL_SCHEMA)


def _united(key: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> pa.RecordBatch:
    """Repeated cells as ranges of windows."""
    order = np.lexsort((s0, key))
    key, s0, s1 = key[order], s0[order], s1[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (s0[1:] != s1[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1 if len(key) else first
    key, s0, s1 = key[first], s0[first], s1[last]
    return _cell_rows(DUP, mixed(key.astype(np.uint64) + s0.astype(np.uint64) * _FINE[2]), np.zeros(len(key), np.int64), key, s0, s1, np.ones(len(key), bool))


def _met(found: DataFrame) -> DataFrame:
    """``found`` sorted by kind and h: the cells whose anchors occur again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the last row, while it is alone
        before: int | None = None  # the last row's anchor
        for batch in batches:
            kind = batch.column(0)
            yield from _in_parts(batch.filter(pc.not_equal(kind, CELL)))
            batch = batch.filter(pc.equal(kind, CELL))
            if not batch.num_rows:
                continue
            h = batch.column(1).to_numpy()
            again = np.zeros(len(h), bool)
            again[1:] = h[1:] == h[:-1]
            again[0] = before is not None and h[0] == before
            if again[0] and last is not None:
                yield last
            meets = again.copy()
            meets[:-1] |= again[1:]
            last = None if meets[-1] else _as_check(batch.slice(len(h) - 1))
            before = int(h[-1])
            yield from _in_parts(_as_check(batch.filter(pa.array(meets))))

    return found.mapInArrow(releasing(run), _CELL_SCHEMA)


def _as_check(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.set_column(0, "kind", pa.array(np.full(batch.num_rows, CHECK, np.int8)))


_CONTEXTS = ["h", "g", "key", "s0", "many", "body"]
_CONTEXT_SCHEMA = "h long, g long, key long, s0 long, many boolean, body binary"


def _contexts(texts: DataFrame, checks: DataFrame, length: int) -> DataFrame:
    """The bytes of cells or windows. A document's are gathered in parts, so a
    text of very many does not make one long list."""
    per = checks.groupBy(F.col("key").alias("of"), F.floor(F.col("s0") / PIECE).alias("part")).agg(F.collect_list(F.struct("h", "g", "s0", "s1", "many")).alias("cells"))
    joined = texts.join(per, F.col("key") == F.col("of")).select("key", "text", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = (batch.column(1)[i].as_py() or "").encode()
                c = batch.column(2)[i].values
                h, g, s0, s1, many = (c.field(f) for f in range(5))
                for lo in range(0, len(c), 4096):
                    part = slice(lo, lo + 4096)
                    body = [data[a : b + length] for a, b in zip(s0[part].to_pylist(), s1[part].to_pylist(), strict=True)]
                    key = pa.array(np.full(len(body), batch.column(0)[i].as_py()), pa.int64())
                    yield pa.RecordBatch.from_arrays([h[part], g[part], key, s0[part], many[part], pa.array(body, pa.binary())], _CONTEXTS)

    return joined.mapInArrow(releasing(run), _CONTEXT_SCHEMA)


def _collapsed(t: pa.Table, length: int) -> tuple[pa.RecordBatch, pa.Table]:
    """The windows of all contents that occur twice, and one row of each
    content, which is ``many`` where its own windows are settled."""
    coded = t["body"].combine_chunks().dictionary_encode()
    at = coded.indices.to_numpy()
    many = t["many"].to_numpy()
    weight = np.bincount(at, 1 + many, len(coded.dictionary))
    twice = weight[at] > 1
    s0 = t["s0"].to_numpy()
    stop = s0 + pc.binary_length(coded.dictionary).to_numpy()[at] - length
    settled = _united(t["key"].to_numpy()[twice], s0[twice], stop[twice])
    first = np.unique(at, return_index=True)[1]
    first.sort()
    one = t.take(pa.array(first))
    return settled, one.set_column(4, "many", pa.array(weight[at[first]] > 1))


def _decided(contexts: DataFrame, length: int, index_bytes: int) -> DataFrame:
    """Ranges of repeated windows in the contexts (sorted by h, g), as DUP rows;
    windows of anchors with more distinct contents than ``index_bytes`` as
    WINDOW rows."""

    def index(t: pa.Table) -> Iterator[pa.RecordBatch]:
        settled, t = _collapsed(t, length)
        yield from _in_parts(settled)
        # equal windows have equal anchors: one whose contents are all settled has nothing to decide
        settled_by, h = t["many"].to_numpy(), t["h"].to_numpy()
        t = t.filter(pa.array(np.isin(h, h[~settled_by])))
        if not t.num_rows:
            return
        flat, sizes = _flat(t["body"].combine_chunks())
        marked = repeated_windows(flat, sizes, length)
        starts = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        hit = np.flatnonzero(marked & ~t["many"].to_numpy()[of])
        s = t["s0"].to_numpy()[of[hit]] + hit - starts[of[hit]]
        yield from _in_parts(_united(t["key"].to_numpy()[of[hit]], s, s))

    def windows(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in t.to_batches(max_chunksize=256):
            flat, sizes = _flat(b.column(5))
            at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            of = np.repeat(np.arange(len(sizes)), sizes)
            good = np.flatnonzero(at + length <= sizes[of])
            g = substring_hashes(flat, good, good + length)
            s = b.column(3).to_numpy()[of[good]] + at[good]
            many = b.column(4).to_numpy(zero_copy_only=False)[of[good]]
            yield from _in_parts(_cell_rows(WINDOW, b.column(0).to_numpy()[of[good]], g, b.column(2).to_numpy()[of[good]], s, s, many))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, hot = [], 0, None
        for batch in batches:
            h = batch.column(0).to_numpy()
            if hot is not None:
                stop = int(np.searchsorted(h, hot, side="right")) if h[0] <= hot else 0
                if stop:
                    settled, one = _collapsed(pa.Table.from_batches([batch.slice(0, stop)]), length)
                    yield from _in_parts(settled)
                    yield from windows(one)
                    batch, h = batch.slice(stop), h[stop:]
                if not batch.num_rows:
                    continue
                hot = None
            held.append(batch)
            size += batch.nbytes
            if size < index_bytes:
                continue
            t = pa.Table.from_batches(held)
            h = t["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield from index(t.slice(0, cut))
                t = t.slice(cut).combine_chunks()
            if t.nbytes >= index_bytes:
                settled, t = _collapsed(t, length)
                yield from _in_parts(settled)
                t = t.combine_chunks()
            if t.nbytes >= index_bytes:
                hot = int(h[-1])
                yield from windows(t)
                t = t.slice(t.num_rows)
            held = t.to_batches()
            size = sum(x.nbytes for x in held)
        if held:
            t = pa.Table.from_batches(held)
            if t.num_rows:
                yield from index(t)

    return contexts.mapInArrow(releasing(run), _CELL_SCHEMA)


def marks(texts: DataFrame, length: int = 200, flush: int = 1 << 18, index_bytes: int = 1 << 20) -> DataFrame:
    """``key``, ``s0``, ``s1``: ranges of windows that also start elsewhere."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    tasks = tasks_for(texts)
    dealt = lambda c: c.repartition(tasks, "h", "g").sortWithinPartitions("h", "g")
    scanned = _scan(texts, length, flush).repartition(tasks, "h").sortWithinPartitions("kind", "h")
    met = written(_met(scanned), "cells")
    contexts = _contexts(texts, met.where(F.col("kind") == CHECK), length)
    decided = written(_decided(contexts.repartition(tasks, "h").sortWithinPartitions("h", "g"), length, index_bytes), "decided")
    plain = [x.where(F.col("kind") == DUP).select("key", "s0", "s1") for x in (met, decided)]
    out = plain[0].unionByName(plain[1])
    rows = decided.where(F.col("kind") == WINDOW)
    if rows.isEmpty():
        return out
    # a settled content's windows are there for the others to meet, once
    n = F.count(F.lit(1))
    twice = rows.groupBy("h", "g").agg(n.alias("n"), F.count_if(~F.col("many")).alias("open")).where("n > 1 AND open > 0").select(F.col("h").alias("h2"), F.col("g").alias("g2"))
    hot = rows.join(twice, (F.col("h") == F.col("h2")) & (F.col("g") == F.col("g2"))).select(*_CELLS)
    last = _decided(dealt(_contexts(texts, hot.withColumn("many", F.lit(False)), length)), length, 1 << 40)
    return out.unionByName(written(last, "hot-windows").select("key", "s0", "s1"))


def _keyed(docs: DataFrame, id_col: str, name: str) -> DataFrame:
    """``docs`` with the column ``name``, a number of each row's own: its id, or
    if ids are missing or repeated one from a copy, so that every pass sees the same."""
    unique = unique_ids(docs, id_col)
    out = docs.withColumn(name, F.col(id_col).cast("long") if unique else F.monotonically_increasing_id())
    return out if unique else written(out, "keyed")


def kept(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False, names: tuple[str, ...] = ("kept", "n_bytes", "n_removed", "n_spans"), **how) -> DataFrame:
    """All columns of ``docs``, ``kept`` (the remaining bytes; or as text,
    without the characters that were cut in two), ``n_bytes``, ``n_removed``
    and ``n_spans``, or these by other ``names``. Such columns are replaced."""
    docs = docs.drop(*names)
    own, of, body, ranges = (unused(docs.columns, x) for x in ("key", "of", "body", "ranges"))
    keyed = _keyed(docs, id_col, own)
    texts = keyed.select(F.col(own).alias("key"), F.col(text_col).cast("string").alias("text"))
    found = _ranges(marks(texts, length, **how)).groupBy(F.col("key").alias(of)).agg(F.collect_list(F.struct("s0", "s1")).alias(ranges))
    joined = keyed.join(found, F.col(own) == F.col(of), "left").select(*docs.columns, F.col(text_col).cast("string").alias(body), ranges)
    at = len(docs.columns)
    schema = StructType([*docs.schema.fields])
    for name, kind in zip(names, ("string" if as_text else "binary", "long", "long", "long"), strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch.column(at), 4 << 20):
                part = batch.slice(lo, hi - lo)
                body, size, gone, spans = [], [], [], []
                for text, ranges in zip(part.column(at), part.column(at + 1), strict=True):
                    data = (text.as_py() or "").encode()
                    cut = []
                    if ranges.is_valid:
                        pairs = np.stack([ranges.values.field(0).to_numpy(), ranges.values.field(1).to_numpy() + length], axis=1)
                        cut = _spans(pairs)
                    left, end = [], 0
                    for a, b in cut:
                        left.append(data[end:a])
                        end = b
                    left.append(data[end:])
                    body.append(b"".join(left))
                    size.append(len(data))
                    gone.append(len(data) - len(body[-1]))
                    spans.append(len(cut))
                if as_text:
                    body = [None if t is None else b.decode("utf-8", "ignore") for b, t in zip(body, part.column(at).to_pylist(), strict=True)]
                arrays = [pa.array(body, pa.string() if as_text else pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *arrays], [*docs_columns, *names])

    docs_columns = docs.columns
    return joined.mapInArrow(releasing(run), schema)


def _ranges(marked: DataFrame) -> DataFrame:
    """Marked ranges, united within a task: overlapping and touching ones of a
    document become one before they are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            nonlocal held, rows
            key, s0, s1 = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((s0, key))
            key, s0, s1 = key[order], s0[order], s1[order]
            # the furthest end so far of the same document
            turn = np.ones(len(key), bool)
            turn[1:] = key[1:] != key[:-1]
            base = (np.cumsum(turn) - 1) << 40
            far = np.maximum.accumulate(s1 + base) - base
            new = turn.copy()
            new[1:] |= s0[1:] > far[:-1] + 1
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(key)) - 1
            held, rows = [], 0
            return pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(s0[first]), pa.array(far[last])], ["key", "s0", "s1"])

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
            rows += batch.num_rows
            if rows >= 1 << 20:
                yield from _in_parts(out())
        if held:
            yield from _in_parts(out())

    return marked.select("key", "s0", "s1").mapInArrow(releasing(run), "key long, s0 long, s1 long")


def _spans(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the half-open ranges; touching ones are one run."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pairs)) - 1
    return list(zip(pairs[first, 0].tolist(), reach[last].tolist(), strict=True))


def removal_digests(docs: DataFrame, length: int = 200, **how) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``."""
    out = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, **how)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = 200, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the remaining text; characters cut in two are dropped."""
    names = tuple(unused(docs.columns, x) for x in ("kept", "n_bytes", "n_removed", "n_spans"))
    out = kept(docs, length, text_col=text_col, as_text=True, names=names, **how)
    return out.select(*[F.col(names[0]).alias(c) if c == text_col else F.col(c) for c in docs.columns])
