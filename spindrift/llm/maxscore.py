"""Exact top-k inner products by MaxScore.

A dimension is a query term, the vectors that hold a nonzero component are its
postings, and a term's score bound in a shard is the query's component times
the largest component of its sign there. For a query and a shard the terms are
ordered by bound. Those whose bounds together stay below the k-th best score so
far are non-essential: a vector found in them alone cannot enter. The postings
of the essential terms are traversed (column by column, whole shards at a
time), the others are probed for the vectors that stay competitive, and only
those. Shards keep their own k best; a last step merges them.

Vectors are dealt into shards and queries into blocks of bounded size, and each
shard meets each block in one task: no task holds more than a shard and a
block, and nothing is broadcast or collected. Every row is scored exactly;
ties go to the smaller id.

Rows whose vector is null, or holds null or non-finite components, take no
part; shorter vectors count as zero beyond their end. Components whose scaled
value passes 64 bits count as the largest long; scores that could pass 64 bits
are summed in whole numbers of any size, and come out as the largest or least
long beyond it. Rows that repeat an id are candidates each (and never for their
own id's query); a repeated query id is answered once. An empty table gives no
rows; columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * x) of each component as long."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    return vectors.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


class Shard:
    """Postings of some vectors, by column, with the score bounds of its terms."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.top = _largest(rows)
        # sums stay exact: 24, 53 or 63 bits
        self.columns = np.ascontiguousarray(rows[order].T)
        self.high = self.columns.max(axis=1, initial=0) if len(ids) else np.zeros(len(self.columns), np.int64)
        self.low = self.columns.min(axis=1, initial=0) if len(ids) else np.zeros(len(self.columns), np.int64)
        n = min(32, len(ids))
        far = np.argpartition(-np.abs(self.columns.astype(np.float64)), n - 1, axis=1)[:, :n] if n else np.zeros((len(self.columns), 0), int)
        self.champions = far
        self._typed: dict[type, np.ndarray] = {}

    def _as(self, q: np.ndarray) -> np.ndarray:
        most = self.top * _largest(q) * max(1, len(q))
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        if kind not in self._typed:
            self._typed[kind] = self.columns.astype(kind)
        return self._typed[kind]

    def top_k(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those of id ``own``."""
        m = min(len(q), len(self.columns))
        q = q[:m]
        if self.top * _largest(q) * max(1, m) >= 1 << 62:
            return self._wide(own, q, k)
        bound = np.maximum(q * self.high[:m], q * self.low[:m])
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        columns = self._as(q)
        typed = q.astype(columns.dtype)

        def exact(at: np.ndarray) -> np.ndarray:
            return typed @ columns[:m, at]

        # first threshold: the largest postings of the strongest terms
        first = np.unique(self.champions[order[:8]].ravel())
        first = first[self.ids[first] != own]
        threshold = -np.inf
        if len(first) >= k:
            s = exact(first)
            threshold = float(np.partition(s, len(s) - k)[len(s) - k])
        # essential terms: what the rest can add stays below the threshold.
        # A row outside all postings scores 0, so at most 0 leaves all essential.
        rest = np.concatenate([np.cumsum(bound[::-1])[::-1][1:], [0]])
        essential = m if threshold <= 0 else int(np.searchsorted(-rest, -threshold, side="right")) + 1
        essential = min(essential, m)
        terms = order[:essential]
        score = typed[terms] @ columns[terms] if essential else np.zeros(columns.shape[1], columns.dtype)
        live = np.flatnonzero(self.ids != own)
        at = essential
        while True:
            left = rest[at - 1] if at else (rest[0] + bound[0] if m else 0)
            s = score[live]
            if len(live) > k:
                if at == m:
                    threshold = max(threshold, float(np.partition(s, len(s) - k)[len(s) - k]))
                keep = s + left >= threshold
                live, s = live[keep], s[keep]
            if at == m:
                break
            step = order[at : at + 8]
            score[live] = s + typed[step] @ columns[np.ix_(step, live)]
            at += len(step)
        s = score[live]
        best = np.lexsort((self.ids[live], -s))[:k]
        return self.ids[live][best], s[best].astype(np.int64)

    def _wide(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same by sums of any size, row by row."""
        live = np.flatnonzero(self.ids != own)
        score = [sum(a * b for a, b in zip(q.tolist(), self.columns[: len(q), r].tolist(), strict=True)) for r in live.tolist()]
        best = sorted(range(len(live)), key=lambda i: (-score[i], int(self.ids[live[i]])))[:k]
        top = (1 << 63) - 1
        return self.ids[live][best], np.array([min(max(score[i], -top - 1), top) for i in best], np.int64)


def _largest(values: np.ndarray) -> int:
    """The greatest magnitude, 1 at least."""
    return max(1, int(values.max(initial=0)), -int(values.min(initial=0)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0) if flat.num_chunks else pa.array([], column.type)
    sizes = flat.value_lengths().to_numpy(zero_copy_only=False)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 1 << 18, block_rows: int = 1 << 16, least_shards: int = 12) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of tables from ``quantised``."""
    n, m = candidates.count(), queries.count()
    shards = max(least_shards, -(-n // shard_rows))
    blocks = max(1, -(-m // block_rows))
    salt = F.xxhash64("vec_id", F.monotonically_increasing_id())
    left = candidates.withColumn("shard", F.pmod(salt, F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = (
        queries.dropDuplicates(["vec_id"])
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        query, vec, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if rows.num_rows and asked.num_rows:
            shard = Shard(rows["vec_id"].to_numpy(), _matrix(rows["v"]))
            for own, q in zip(asked["vec_id"].to_numpy(), _matrix(asked["v"]), strict=True):
                ids, s = shard.top_k(int(own), q, k)
                query.append(np.full(len(ids), own))
                vec.append(ids)
                score.append(s)
        return pa.table({"query_id": np.concatenate(query), "vec_id": np.concatenate(vec), "score": np.concatenate(score)})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rnk FROM s)
SELECT query_id, CAST(rnk AS INTEGER) AS rank, vec_id, score FROM r WHERE rnk <= 5
"""
