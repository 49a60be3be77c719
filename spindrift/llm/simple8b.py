"""Token-id files in Simple-8b words.

A word has 64 bits: a selector in the top four and ids of equal width below.
Selectors 0 to 13 pack 60 x 1 bit down to 1 x 60 bits, 14 stands for 120 zeros,
and 15 escapes: the next word is one raw 64-bit value. Ids are packed in blocks
of ``BLOCK``; a file keeps each block's first word. Decoding starts every block
at its own offset: all blocks of a request step through their words at the same
time, escapes are taken where a block's cursor meets them, and what a block
fills must end where the next one starts. A slice of the ids reads its own
blocks only.

A file: magic, words, block offsets, document ids, their validity, their
lengths, then six counts and the magic again (all little endian). A writer
task gets a range of ids in order, closes a file at a number of ids that
bounds its memory, and reports it; only files that a finished task has
reported are read, so lost or repeated attempts leave no trace in the result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import file_folder, file_system, tasks_for, written
from .word_bpe import WordEncoder, byte_slices

MAGIC = b"S8BIDS01"
BLOCK = 1024
#: Ids and bits of selectors 0 to 13.
PACKS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ZEROS, ESCAPE, NOTHING = 14, 15, 255


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block (with the end as the last)."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    # by block: the narrowest pack that each value alone fits, then the widest
    # of them in each pack's reach; what passes a block's end fits nothing
    own = np.full(-(-n // block) * block, NOTHING, np.uint8)
    own[:n] = _narrowest(values)
    own = own.reshape(-1, block)
    choice = np.full(own.shape, ESCAPE, np.uint8)
    most, reach = own, 1
    for selector in range(13, -1, -1):
        count = PACKS[selector][0]
        most, reach = _within(most, reach, count), count
        np.copyto(choice, np.uint8(selector), where=most <= selector)
    zero = np.full(own.size, NOTHING, np.uint8)
    zero[:n] = values != 0
    if int((zero == 0).sum()) >= 120:
        np.copyto(choice, np.uint8(ZEROS), where=_within(zero.reshape(own.shape), 1, 120) == 0)
    choice = choice.reshape(-1)[:n]
    sizes = np.array([c for c, _ in PACKS] + [120, 1])
    # every block steps through its ids at the same time
    at = np.arange(0, n, block)
    stop = np.minimum(at + block, n)
    owner, starts = [], []
    live = np.arange(len(at))
    while len(live):
        starts.append(at[live])
        owner.append(live)
        at[live] += sizes[choice[at[live]]]
        live = live[at[live] < stop[live]]
    starts = np.concatenate(starts)
    order = np.argsort(starts, kind="stable")
    starts, owner = starts[order], np.concatenate(owner)[order]
    chosen = choice[starts]
    width = 1 + (chosen == ESCAPE)
    place = np.cumsum(width) - width
    words = np.zeros(int(place[-1] + width[-1]), np.uint64)
    words[place] = chosen.astype(np.uint64) << np.uint64(60)
    for selector, (count, bits) in enumerate(PACKS):
        mine = chosen == selector
        if mine.any():
            first, total = starts[mine], np.zeros(int(mine.sum()), np.uint64)
            for i in range(count):
                total |= values[first + i] << np.uint64(i * bits)
            words[place[mine]] |= total
    raw = chosen == ESCAPE
    words[place[raw] + 1] = values[starts[raw]]
    per_block = np.bincount(owner, weights=width, minlength=len(stop)).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(per_block)])


def _narrowest(values: np.ndarray) -> np.ndarray:
    limits = np.array([1 << bits for _, bits in PACKS], np.uint64)
    if int(values.max()) < 1 << 16:
        return np.searchsorted(limits, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)[values.astype(np.uint16)]
    return np.searchsorted(limits, values, side="right").astype(np.uint8)


def _within(most: np.ndarray, reach: int, count: int) -> np.ndarray:
    """Largest of ``count`` entries from each on in its row, given those of ``reach``."""
    while reach < count:
        step = min(reach, count - reach)
        wider = np.full_like(most, NOTHING)
        if step < most.shape[1]:
            np.maximum(most[:, :-step], most[:, step:], out=wider[:, :-step])
        most, reach = wider, reach + step
    return most


#: Ids of a word by its selector.
_SIZES = np.array([c for c, _ in PACKS] + [120, 1])


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Values ``start`` to ``stop`` of the ``n``, from the blocks that hold them."""
    stop = n if stop is None else min(stop, n)
    if stop <= start:
        return np.zeros(0, np.uint64)
    lo, hi = start // block, -(-stop // block)
    cursor, end = offsets[lo:hi].copy(), offsets[lo + 1 : hi + 1]
    room = np.minimum(block, n - np.arange(lo, hi) * block)
    filled, live = np.zeros(hi - lo, np.int64), np.arange(hi - lo)
    heads, chosen, places = [], [], []
    while len(live):
        at = cursor[live]
        if (at >= end[live]).any():
            raise ValueError("a block ends before its ids")
        selector = (words[at] >> np.uint64(60)).astype(np.int64)
        heads.append(at)
        chosen.append(selector)
        places.append(live * block + filled[live])
        filled[live] += _SIZES[selector]
        cursor[live] = at + 1 + (selector == ESCAPE)
        live = live[filled[live] < room[live]]
    if (cursor != end).any() or (filled != room).any():
        raise ValueError("a block does not end where the next one starts")
    heads, chosen, places = np.concatenate(heads), np.concatenate(chosen), np.concatenate(places)
    out = np.zeros(int(room.sum()), np.uint64)
    for s, (count, bits) in enumerate(PACKS):
        mine = chosen == s
        if mine.any():
            w, at, mask = words[heads[mine]], places[mine], np.uint64((1 << bits) - 1)
            for i in range(count):
                out[at + i] = (w >> np.uint64(i * bits)) & mask
    mine = chosen == ESCAPE
    out[places[mine]] = words[heads[mine] + 1]
    return out[start - lo * block : stop - lo * block]


def file_bytes(ids: np.ndarray, doc_ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray) -> bytes:
    words, offsets = pack(ids)
    counts = np.array([len(words), len(offsets), len(doc_ids), len(ids), BLOCK, 1], "<u8")
    parts = [words.astype("<u8"), offsets.astype("<u8"), doc_ids.astype("<i8"), valid.astype("u1"), lengths.astype("<i8"), counts]
    return MAGIC + b"".join(x.tobytes() for x in parts) + MAGIC


def _sections(data: bytes) -> tuple[list[np.ndarray], int, int]:
    """Words, offsets, document ids, validity and lengths of a file; ids in it, ids of a block."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a token-id file, or cut short")
    n_words, n_offsets, n_docs, n_ids, block, version = np.frombuffer(data, "<u8", 6, len(data) - 56).astype(np.int64).tolist()
    if version != 1:
        raise ValueError(f"version {version} is unknown")
    at, out = 8, []
    for count, kind in ((n_words, "<u8"), (n_offsets, "<u8"), (n_docs, "<i8"), (n_docs, "u1"), (n_docs, "<i8")):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    out[1] = out[1].astype(np.int64)
    return out, n_ids, block


def file_content(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, document ids, their validity and lengths of a file."""
    (words, offsets, doc_ids, valid, lengths), n_ids, block = _sections(data)
    return unpack(words, offsets, n_ids, block), doc_ids, valid.astype(bool), lengths


def file_slice(data: bytes, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a file, without decoding the others."""
    (words, offsets, *_), n_ids, block = _sections(data)
    return unpack(words, offsets, n_ids, block, start, stop)


def write_ids(
    docs: DataFrame,
    encoder: Callable[[], Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]],
    end_id: int | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_ids: int = 2 << 20,
    task_bytes: int = 64 << 20,
) -> DataFrame:
    """Writes the ids of all documents in ascending id order (null ids first,
    equal ids by text hash) and returns the written files: ``path``, ``n_ids``,
    ``n_docs`` and ``base``, the number of ids in all files before.

    ``encoder()`` is called once a task and returns a function from an Arrow
    array of texts (null: empty) to all ids and each text's number of ids.
    A text's ids are in memory at once, a file's are at most ``file_ids`` and
    one text's more. An empty table gives no files. Repeated rows are written
    each; columns other than the key and the text are not read.
    """
    spark = docs.sparkSession
    folder = file_folder(spark, "token-ids")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tasks = tasks_for(source, task_bytes)
    order = source.withColumn("h", F.xxhash64("text")).repartitionByRange(tasks, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        task = TaskContext.get().partitionId()
        encode, held, number = None, [], 0

        def close() -> pa.RecordBatch:
            nonlocal held, number
            ids, keys, valid, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            path = f"{root}/{task:07d}-{number:05d}-{uuid.uuid4().hex}.s8b"
            with fs.open_output_stream(path) as f:
                f.write(file_bytes(ids, keys, valid, lengths))
            out = [[task], [number], [path], [len(ids)], [len(keys)]]
            held, number = [], number + 1
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["task", "number", "path", "n_ids", "n_docs"])

        n = 0
        for batch in batches:
            encode = encode or encoder()
            for lo, hi in byte_slices(batch.column(1), 8 << 20):
                keys = batch.column(0).slice(lo, hi - lo)
                ids, lengths = encode(batch.column(1).slice(lo, hi - lo))
                if end_id is not None:
                    ids, lengths = np.insert(ids, np.cumsum(lengths), end_id), lengths + 1
                held.append((ids.astype(np.uint32), keys.fill_null(0).to_numpy(), keys.is_valid().to_numpy(zero_copy_only=False), lengths))
                n += len(ids)
                if n >= file_ids:
                    yield close()
                    n = 0
        if held:
            yield close()

    files = written(order.select("doc_id", "text").mapInArrow(run, "task long, number long, path string, n_ids long, n_docs long"), "token-files")
    before = W.orderBy("task", "number").rowsBetween(W.unboundedPreceding, -1)
    return files.select("path", "n_ids", "n_docs", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"), F.lit(folder).alias("folder"))


def _read(fs, path: str):
    with fs.open_input_stream(path) as f:
        return file_content(f.read())


def read_ids(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` and ``ids`` (array of long) of every document."""

    def per_file(ids, keys, lengths, base):
        ends = np.cumsum(lengths)
        flat = pa.array(ids.astype(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), flat)
        return [keys, pa.array(base + ends - lengths), lists]

    return _per_document(files, per_file, "doc_id long, start long, ids array<long>")


def read_digests(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` from the files."""

    def per_file(ids, keys, lengths, base):
        ends = np.cumsum(lengths)
        data = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        return [keys, pa.array(base + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]

    return _per_document(files, per_file, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _per_document(files: DataFrame, per_file, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    tasks = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = None
        for batch in batches:
            for path, base, folder in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs = fs or file_system(folder)[0]
                ids, doc_ids, valid, lengths = _read(fs, path)
                arrays = per_file(ids, pa.array(doc_ids, mask=~valid), lengths, base)
                out = pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in arrays], names)
                for lo in range(0, out.num_rows, 4096):
                    yield out.slice(lo, 4096)

    return files.select("path", "base", "folder").repartition(tasks).mapInArrow(run, schema)


def word_encoder(path: str) -> Callable[[], Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]]:
    """An ``encoder`` for ``write_ids`` over a file of the tokenizers library."""
    return lambda: WordEncoder(path).ids
