"""N-gram Jaccard join of whole texts, exact, and its components.

1. Every text becomes the set of its n-word shingles (64-bit hashes). Equal
   sets within a task collapse to one node.
2. Candidates, without loss: two sets whose similarity reaches the threshold
   differ in at most H elements, H following from their sizes. The hash range
   is dealt into m > H buckets, and each set is keyed by its buckets' contents,
   per size band; with b buckets in use, such sets share r = b - H keys at
   least. (Small sets, and those with no more than H buckets in use, are keyed
   by their elements as well: a pair is safe if either of its sets has r > 0,
   and meets by elements if neither has.) So each set may leave out the r - 1 of
   its keys that most sets hold, as in prefix filtering: keys of shared passages
   fall away, and a set with fewer than r shared keys is done. Star links join
   what is left of each key.
3. Linked candidates form groups of texts that must be compared. A group is
   compared in size-banded tiles: bit counts of hashed bitmap signatures bound
   the overlap from above, pairs that can still reach the threshold are decided
   by the exact intersection of sorted arrays, and pairs that are connected
   already are passed over. A group beyond ``tile_shingles`` is dealt into
   several tiles: each is compared by itself, then one text of each component
   so found with those of the other tiles, and last the texts outside the
   group's largest component with all texts of other components. Near copies
   of one text thus meet tile by tile, not in every pair of tiles.
4. Components of the confirmed links.

No group is collected into one task beyond a tile pair, nothing is broadcast
but tables that the optimizer has measured, nothing is sent to the driver, and
every text takes part whole.

Null or empty texts have no shingles and link with nothing; texts shorter than
n words have one shingle. Rows with a null id come back with a null component.
Rows that repeat an id are one node (their links join). A text's words and
shingles are in memory at once, with those of one slice or tile. An empty table
gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import Forest, components, stars
from .shared import KEEP_FEW, release, releasing, settings, tasks_for, unused, written
from .word_bpe import byte_slices

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_U = np.uint64
#: Sets up to this size are always keyed by their elements.
SMALL = 32
#: A tag holds a number of keys and a band.
_BANDS = 128


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    lists = pc.ascii_split_whitespace(pc.cast(pc.fill_null(texts, ""), pa.large_string()))
    words = lists.flatten()
    sizes = np.diff(lists.offsets.to_numpy())
    keep = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), sizes)[keep]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    first = int(bounds[0]) if len(bounds) else 0
    data = data[first : int(bounds[-1])] if len(bounds) else data
    bounds = bounds - first
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=sums[1:])
    word = mixed((sums[bounds[1:]] - sums[bounds[:-1]]) * _powers(_INVERSE, len(data) + 1)[bounds[:-1]])[keep]
    counts = np.bincount(doc, minlength=len(texts))
    starts = np.cumsum(counts) - counts
    gram = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for i in range(n):
        gram += word[i : len(word) - n + 1 + i] * _GRAM[i] if len(gram) else _U(0)
    gram = mixed(gram)
    out = []
    for s, c in zip(starts.tolist(), counts.tolist(), strict=True):
        if c >= n:
            out.append(np.unique(gram[s : s + c - n + 1]))
        elif c:
            out.append(mixed((word[s : s + c] * _GRAM[:c]).sum(dtype=np.uint64, keepdims=True) + _U(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Bands:
    """Size bands with the bucket counts that the threshold asks for."""

    def __init__(self, percent: int, largest: int = 1 << 40):
        self.percent = percent
        edges = [1]
        while edges[-1] <= largest:
            edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
        self.edges = np.array(edges)
        self.buckets = [self.differ(2 * (e - 1)) * 5 // 4 + 3 for e in edges[1:]]

    def differ(self, both: int) -> int:
        """Most elements in which two sets of ``both`` elements together differ."""
        return both * (100 - self.percent) // (100 + self.percent)

    def of(self, size: int) -> Iterator[int]:
        """The bands in which a set meets partners at least as large, or its own."""
        k = int(np.searchsorted(self.edges, size, side="right")) - 1
        while self.percent * int(self.edges[k]) <= 100 * size:
            yield k
            k += 1


def keys(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate keys of all sets, the set of each, and its tag: the number of
    keys that a partner shares at least, and the band."""
    found, owner, tag = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    wide: dict[int, list[int]] = {}
    by_element: set[int] = set()
    for i, s in enumerate(sets):
        n = len(s)
        if not n:
            continue
        if n <= SMALL:
            by_element.add(i)
        for k in bands.of(n):
            # bands that hold small sets only are covered by the elements
            if int(bands.edges[k + 1]) - 1 > SMALL:
                wide.setdefault(k, []).append(i)
    for k, members in wide.items():
        m = bands.buckets[k]
        size = np.array([len(sets[i]) for i in members])
        flat = np.concatenate([sets[i] for i in members])
        of = np.repeat(np.arange(len(members)), size)
        cell = of * m + ((flat >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        total, count = np.zeros(len(members) * m, np.uint64), np.bincount(cell, minlength=len(members) * m)
        np.add.at(total, cell, mixed(flat))
        full = np.flatnonzero(count)
        bucket = (full % m).astype(np.uint64)
        found.append(mixed(total[full] + bucket * _GRAM[40] + _GRAM[41] * np.full(1, k, np.uint64)))
        mine = full // m
        owner.append(np.array(members)[mine])
        partner = np.minimum(int(bands.edges[k + 1]) - 1, 100 * size // bands.percent)
        differ = (size + partner) * (100 - bands.percent) // (100 + bands.percent)
        used = np.bincount(mine, minlength=len(members))
        by_element.update(np.array(members)[used <= differ].tolist())
        tag.append(np.maximum(1, used - differ)[mine] * _BANDS + k)
    for i in sorted(by_element):
        n = len(sets[i])
        found.append(mixed(sets[i] + _U(1)))
        owner.append(np.full(n, i))
        tag.append(np.full(n, -(-bands.percent * n // 100) * _BANDS + _BANDS - 1))
    return np.concatenate(found), np.concatenate(owner), np.concatenate(tag)


#: Kinds of rows of the first pass: keys, links of equal sets, shared keys, set sizes.
KEY, EQUAL, SHARED, SIZE = 0, 1, 2, 3
#: A key that so many sets hold counts as held by this many.
_MANY = 1_000_000
_ROWS = ["kind", "key", "a", "b"]


def _rows(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(key.view(np.int64)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], _ROWS)


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _pass(texts: DataFrame, n: int, bands: Bands) -> DataFrame:
    """The first and only pass over all texts: ``kind``, ``key``, ``a``, ``b``,
    ``held``. SIZE: id and set size; EQUAL: two ids; SHARED: a key that ``held``
    sets hold, one of their ids and its tag."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[tuple[int, int], int] = {}
        for batch in batches:
            for lo, hi in byte_slices(batch.column(1), 2 << 20):
                ids = batch.column(0).slice(lo, hi - lo)
                valid = ids.is_valid().to_numpy(zero_copy_only=False)
                sets = shingle_sets(batch.column(1).slice(lo, hi - lo), n)
                anywhere = pa.array(mixed(np.arange(len(ids), dtype=np.uint64) + _U(len(nodes) + 1)).view(np.int64))
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), SIZE, np.int8)), anywhere, ids, sizes], _ROWS)
                ids = ids.fill_null(0).to_numpy()
                fresh, of, equal = [], [], []
                for i, s in enumerate(sets):
                    if valid[i] and len(s):
                        # an exact set: two independent sums and the size
                        mark = (int(mixed(s).sum(dtype=np.uint64)), int((s * _GRAM[50]).sum(dtype=np.uint64)) ^ len(s))
                        first = nodes.setdefault(mark, int(ids[i]))
                        if first == int(ids[i]):
                            fresh.append(s)
                            of.append(first)
                        else:
                            equal.append((int(ids[i]), first))
                if equal:
                    a, b = np.ascontiguousarray(np.array(equal, np.int64).T)
                    yield _rows(EQUAL, mixed(a.view(np.uint64)), a, b)
                key, owner, tag = keys(fresh, bands)
                node = np.array(of, np.int64)[owner] if len(of) else owner
                for start in range(0, len(key), 50_000):
                    part = slice(start, start + 50_000)
                    yield _rows(KEY, key[part], node[part], tag[part])
                if len(nodes) > _MANY:
                    nodes = {}

    names = [*_ROWS, "held"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        rows, many = 0, None

        def counted(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key = t["key"].to_numpy()
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            size = np.diff(np.append(np.flatnonzero(head), len(key)))
            held = np.repeat(size, size)
            held[held >= _MANY] = _MANY
            if many is not None:
                held[key == many] = _MANY
            shared = np.flatnonzero(held > 1)
            for start in range(0, len(shared), 50_000):
                part = shared[start : start + 50_000]
                arrays = [np.full(len(part), SHARED, np.int8), key[part], t["a"].to_numpy()[part], t["b"].to_numpy()[part], held[part]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names)

        for batch in batches:
            rest = batch.filter(pc.not_equal(batch.column(0), KEY))
            if rest.num_rows:
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(np.zeros(rest.num_rows, np.int64))], names)
            batch = batch.filter(pc.equal(batch.column(0), KEY))
            if not batch.num_rows:
                continue
            left.append(batch)
            rows += batch.num_rows
            if rows < 200_000:
                continue
            t = pa.Table.from_batches(left)
            key = t["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if not cut and rows >= _MANY:
                many, cut = int(key[-1]), rows
            if cut:
                yield from counted(t.slice(0, cut))
                left = t.slice(cut).combine_chunks().to_batches()
                rows = t.num_rows - cut
        if left:
            yield from counted(pa.Table.from_batches(left))

    passed = texts.mapInArrow(releasing(scan), "kind byte, key long, a long, b long").repartition(tasks_for(texts), "key").sortWithinPartitions("kind", "key")
    return written(passed.mapInArrow(releasing(meet), "kind byte, key long, a long, b long, held long"), "ngram-pass")


def _candidates(passed: DataFrame, task_rows: int = 500_000) -> DataFrame:
    """Links (``a``, ``b``) of the keys that sets cannot leave out: spanning
    stars of what each task sees. Tasks follow the number of shared keys."""
    shared = passed.where(F.col("kind") == SHARED).select("key", F.col("a").alias("node"), "b", "held", (F.col("b") % _BANDS).alias("band"))
    least = int(passed.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4
    tasks = max(1, least, -(-shared.count() // task_rows))
    own = W.partitionBy("node", "band")
    kept = (
        shared.withColumn("place", F.row_number().over(own.orderBy("held", "key")))
        .withColumn("n", F.count(F.lit(1)).over(own))
        .where(F.col("place") <= F.col("n") - F.floor(F.col("b") / _BANDS) + 1)
    )

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_node = None, 0
        a, b, held = [], [], 0

        def out() -> pa.RecordBatch:
            x, y = _unique_pairs(np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b]))
            forest = Forest()
            for one, other in zip(x.tolist(), y.tolist(), strict=True):
                forest.union(one, other)
            return stars(forest)

        for batch in batches:
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            least = node[head]
            if len(key) and key[0] == last_key:
                least = least.copy()
                least[0] = last_node
            least = least[np.cumsum(head) - 1]
            if len(key):
                last_key, last_node = key[-1], least[-1]
            far = least != node
            a.append(node[far])
            b.append(least[far])
            held += int(far.sum())
            if held > _MANY:
                yield out()
                a, b, held = [], [], 0
        yield out()

    return kept.select("key", "node").repartition(tasks, "key").sortWithinPartitions("key", "node").mapInArrow(releasing(star), "a long, b long")


def _compare(sets: list[np.ndarray], ids: list[int], side: list[int] | None, percent: int, forest: Forest) -> None:
    """Unites the ids of all pairs that reach the threshold. ``side``: with
    both sides given, only pairs across them are compared."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    if len(order) < 2:
        return
    bits = 64
    while bits < 8 * int(sizes[-1]) and bits < 1 << 14:
        bits *= 2
    maps = np.zeros((len(order), bits // 64), np.uint64)
    for r, i in enumerate(order):
        at = (sets[i] >> _U(20)) & _U(bits - 1)
        np.bitwise_or.at(maps[r], (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
    sides = np.array([side[i] for i in order]) if side else None
    roots = np.array([forest.root(ids[i]) for i in order])
    for r in range(len(order) - 1):
        n = int(sizes[r])
        end = int(np.searchsorted(sizes, 100 * n // percent, side="right"))
        rows = np.arange(r + 1, end)
        rows = rows[roots[rows] != roots[r]]
        if sides is not None:
            rows = rows[sides[rows] != sides[r]]
        if len(rows):
            most = (n + sizes[rows]) * (100 - percent) // (100 + percent)
            rows = rows[np.bitwise_count(maps[rows] ^ maps[r]).sum(axis=1) <= most]
        for s in rows.tolist():
            if roots[s] == roots[r]:
                continue
            x, y = sets[order[r]], sets[order[s]]
            both = int(np.count_nonzero(_contained(x, y)))
            if 100 * both >= percent * (n + len(y) - both):
                forest.union(ids[order[r]], ids[order[s]])
                new = min(roots[r], roots[s])
                roots[(roots == roots[r]) | (roots == roots[s])] = new


def _contained(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return y[at] == x


def _confirmed(grouped: DataFrame, n: int, percent: int) -> DataFrame:
    """Links of the cells that reach the threshold, as stars per block of cells.
    ``label``: the component that a text is known to be in, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def work(table: pa.Table) -> pa.RecordBatch:
            forest = Forest()
            cell, ids, side = table["cell"].to_numpy(), table["doc_id"].to_pylist(), table["side"].to_pylist()
            for one, label in zip(ids, table["label"].to_pylist(), strict=True):
                if label is not None:
                    forest.union(one, label)
            texts = table["text"].combine_chunks()
            sets = []
            for lo, hi in byte_slices(texts, 4 << 20):
                sets.extend(shingle_sets(texts.slice(lo, hi - lo), n))
            ends = np.flatnonzero(cell[1:] != cell[:-1]) + 1 if len(cell) else []
            for lo, hi in zip([0, *ends], [*ends, len(cell)], strict=True):
                mine = side[lo:hi]
                _compare(sets[lo:hi], ids[lo:hi], mine if max(mine, default=0) else None, percent, forest)
            return stars(forest)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= 16 << 20:
                table = pa.Table.from_batches(held)
                cell = table["cell"].to_numpy()
                last = int(np.searchsorted(cell, cell[-1]))
                if last:  # whole cells only: the last may go on
                    yield work(table.slice(0, last))
                    held = table.slice(last).combine_chunks().to_batches()
                    size = sum(x.nbytes for x in held)
        if held:
            yield work(pa.Table.from_batches(held))

    return grouped.mapInArrow(releasing(run), "a long, b long")


_CELL = "struct<cell:bigint,side:int>"


def _cell(*parts: Column | str, side: int = 0) -> Column:
    return F.struct(F.xxhash64(*parts).alias("cell"), F.lit(side).alias("side")).cast(_CELL)


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _tiles(members: DataFrame, percent: int, tile_shingles: int, kind: Column | None = None) -> DataFrame:
    """``members`` (doc_id, component, n_shingles, ...) with their size ``band``
    and, for groups beyond a tile, ``tiles`` (a map: number of tiles by band, or
    by band and ``kind``) and ``t``, the text's tile; both null for the others."""
    # neighbouring bands cover every pair of compatible sizes
    band = F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(100.0 / min(percent, 99))) + F.lit(1e-9)).cast("int")
    members = members.withColumn("band", band).withColumn("place", F.col("band") if kind is None else F.col("band") * 2 + kind.cast("int"))
    bands = members.groupBy("component", "place").agg(F.sum("n_shingles").alias("n"))
    tiles = F.map_from_entries(F.collect_list(F.struct("place", F.ceil(F.col("n") * 2 / tile_shingles).cast("int"))))
    large = bands.groupBy("component").agg(F.sum("n").alias("total"), tiles.alias("tiles")).where(F.col("total") > tile_shingles)
    large = written(large.drop("total"), "ngram-large")
    t = F.pmod(F.xxhash64("doc_id"), F.element_at("tiles", F.col("place"))).cast("int")
    return members.join(large, "component", "left").withColumn("t", t)


def _tiled(members: DataFrame) -> DataFrame:
    """Cells that hold all pairs of a group: ``members`` of ``_tiles``."""
    b, t = F.col("band"), F.col("t")
    tiles_of = lambda k: F.coalesce(F.element_at("tiles", k), F.lit(0))
    within = F.transform(
        _upto(tiles_of(b)),
        lambda j: F.when(j == t, _cell("component", b, j, b, j)).when(j < t, _cell("component", b, j, b, t, side=2)).otherwise(_cell("component", b, t, b, j, side=1)),
    )
    above = F.transform(_upto(tiles_of(b + 1)), lambda j: _cell("component", b, t, b + 1, j, side=1))
    below = F.transform(_upto(tiles_of(b - 1)), lambda j: _cell("component", b - 1, j, b, t, side=2))
    cells = F.when(F.col("tiles").isNull(), F.array(_cell("component"))).otherwise(F.concat(within, above, below))
    return members.withColumn("c", F.explode(cells)).select("doc_id", "label", "c.cell", "c.side")


def _crossed(members: DataFrame) -> DataFrame:
    """Cells that hold all pairs of a group but those inside its largest
    component: ``members`` of ``_tiles`` by the kind ``minor`` (boolean)."""
    b, t, minor = F.col("band"), F.col("t"), F.col("minor")
    tiles_of = lambda k, kind: F.coalesce(F.element_at("tiles", k * 2 + kind), F.lit(0))
    steps = [F.lit(-1), F.lit(0), F.lit(1)]
    mixed_cells = lambda kind, make: F.concat(*[F.transform(_upto(tiles_of(b + d, kind)), lambda j, d=d: make(d, j)) for d in steps])
    others = mixed_cells(0, lambda d, j: _cell("component", F.lit(1), b, t, b + d, j, side=1))
    to_minor = mixed_cells(1, lambda d, j: _cell("component", F.lit(1), b + d, j, b, t, side=2))
    within = F.transform(
        _upto(tiles_of(b, 1)),
        lambda j: F.when(j == t, _cell("component", F.lit(2), b, j, b, j)).when(j < t, _cell("component", F.lit(2), b, j, b, t, side=2)).otherwise(_cell("component", F.lit(2), b, t, b, j, side=1)),
    )
    above = F.transform(_upto(tiles_of(b + 1, 1)), lambda j: _cell("component", F.lit(2), b, t, b + 1, j, side=1))
    below = F.transform(_upto(tiles_of(b - 1, 1)), lambda j: _cell("component", F.lit(2), b - 1, j, b, t, side=2))
    cells = F.when(F.col("tiles").isNull(), F.array(_cell("component"))).when(minor, F.concat(others, within, above, below)).otherwise(to_minor)
    return members.withColumn("c", F.explode(cells)).select("doc_id", "label", "c.cell", "c.side")


def _links(texts: DataFrame, members: DataFrame, n: int, percent: int, tile_shingles: int) -> DataFrame:
    """Links of all groups (``members``: doc_id, component, n_shingles)."""
    tasks = tasks_for(texts)

    def compared(cells: DataFrame) -> DataFrame:
        # the comparison always holds: it tells the optimizer that the cells select some of the texts
        chosen = written(cells, "ngram-cells").where(F.col("doc_id") >= F.lit(-(1 << 63)))
        grouped = texts.join(chosen, "doc_id").select("cell", "side", "label", "doc_id", "text").repartition(tasks, "cell").sortWithinPartitions("cell")
        return _confirmed(grouped, n, percent)

    tiled = written(_tiles(members, percent, tile_shingles), "ngram-members")
    own = _cell("component", F.coalesce("band", F.lit(0)), "t")
    alone = _cell("component")
    cells = tiled.withColumn("c", F.when(F.col("t").isNull(), alone).otherwise(own))
    first = compared(cells.select("doc_id", F.lit(None).cast("long").alias("label"), "c.cell", "c.side"))
    large = tiled.where("t is not null").select("doc_id", "component", "n_shingles")
    if large.isEmpty():
        return first

    def labelled(links: DataFrame) -> DataFrame:
        found = components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
        return written(large.join(found, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")), "ngram-labels")

    first = written(first, "ngram-first")
    known = labelled(first)
    heads = known.where(F.col("doc_id") == F.col("label"))
    second = written(compared(_tiled(_tiles(heads, percent, tile_shingles))).unionByName(first), "ngram-second")
    release(first)
    known = labelled(second)
    sizes = known.groupBy("component", "label").agg(F.sum("n_shingles").alias("n"))
    largest = sizes.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    apart = known.join(written(largest, "ngram-largest"), "component").withColumn("minor", F.col("label") != F.col("major"))
    apart = written(apart.select("doc_id", "component", "n_shingles", "label", "minor"), "ngram-apart")
    return compared(_crossed(_tiles(apart, percent, tile_shingles, F.col("minor")))).unionByName(second)


def join(
    docs: DataFrame,
    n: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    tile_shingles: int = 1 << 21,
) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` of every row: texts link
    when 100 * intersection >= percent * union of their shingle sets."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    passed = _pass(texts, n, Bands(percent))
    sizes = passed.where(F.col("kind") == SIZE).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    groups = components(_candidates(passed))
    members = groups.join(sizes.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), F.col("node") == F.col("doc_id"))
    links = _links(texts, members.select("doc_id", "component", "n_shingles"), n, percent, tile_shingles)
    links = links.unionByName(passed.where(F.col("kind") == EQUAL).select("a", "b"))
    with settings(texts.sparkSession, **KEEP_FEW):
        found = components(links)
    found = found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    out = sizes.join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component: that of its smallest id, and of rows that
    repeat this id the one of the smallest text hash. Rows with a null id link
    with nothing and stay; so do rows without a text, each a group of its own,
    unless they repeat an id."""
    found = join(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **how)
    own, taken = F.col(id_col).cast("long"), docs.columns
    gone, again, row = (unused(taken, x) for x in ("gone", "again", "row"))
    lost = written(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone)).distinct(), "ngram-gone")
    left = docs.join(lost, own == F.col(gone), "left_anti")
    repeated = found.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where(F.col(id_col).isNotNull() & (F.col("n") > 1))
    repeated = written(repeated.select(F.col(id_col).alias(again)), "ngram-again")
    if repeated.isEmpty():
        return left
    marked = left.join(repeated, own == F.col(again), "left")
    single = marked.where(F.col(again).isNull()).select(*taken)
    # aggregated by task before the shuffle, so an id with very many rows is no hot key
    first = F.min_by(F.struct(*taken), F.struct(F.xxhash64(text_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    one = marked.where(F.col(again).isNotNull()).groupBy(again).agg(first.alias(row))
    return single.unionByName(one.select(f"{row}.*"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN md5(array_to_string(w, ' ')) ELSE md5(array_to_string(w[i:i + 3], ' ')) END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT l.a, l.b FROM l JOIN n x ON x.doc_id = l.a JOIN n y ON y.doc_id = l.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""
