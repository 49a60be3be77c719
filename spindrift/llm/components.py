"""Connected components of a link table, by alternating star operations.

Large-star links every larger neighbour of a node to the smallest node around
it, small-star does so for the smaller ones; a few rounds leave each node
linked to the smallest id it can reach (Kiveris et al., Connected Components
in MapReduce and Beyond, 2014). Each round pre-aggregates by node and joins,
so a node with very many links is summed before it is shuffled and its join
partition is split by adaptive execution. Rounds end in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, written


class Forest:
    """Union-find over arrays of ids, smallest id as the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, at = self.up, x
        while (y := up.get(at, at)) != at:
            at = y
        while (y := up.get(x, x)) != at:
            up[x], x = at, y
        return at

    def union(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def contracted(links: DataFrame) -> DataFrame:
    """Each task's links (``a``, ``b``) as its own spanning stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.union(a, b)
            if len(forest.up) > 1_000_000:
                yield stars(forest)
                forest = Forest()
        yield stars(forest)

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def stars(forest: Forest) -> pa.RecordBatch:
    nodes = list(forest.up)
    roots = [forest.root(x) for x in nodes]
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links``: distinct (u, v) with u > v."""
    both = links.select("u", "v")
    if large:
        both = both.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("w"))
    moved = joined.where("v > u") if large else joined
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        # the node itself joins its smallest neighbour as well
        out = out.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest id it can reach) of every id in
    ``links`` (``a``, ``b``: long, self-links and repeats allowed). Rounds go on
    until one changes nothing; a round's table is removed once the next stands.
    No links, no rows; nulls link nothing."""
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        print_of = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if print_of == seen:
            break
        seen, before = print_of, now
        now = written(_star(_star(now, True), False), "links")
        release(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
