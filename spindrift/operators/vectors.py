"""Vector operators over array columns, in double precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """Length one; the zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    both = norm(a) * norm(b)
    return F.when(both == 0, 0.0).otherwise(dot(a, b) / both)


def _matrix(column) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    column = column.chunk(0) if hasattr(column, "chunks") and column.num_chunks else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(float))
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out, row = np.zeros((len(sizes), width)), np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, 1, size)


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, keep: Column | None = None, digits: int = 9, own: bool = False, shard_rows: int = 1 << 16, block_rows: int = 1 << 14) -> DataFrame:
    """Exact nearest vectors by cosine, the own id left out unless ``own``:
    ``query_vec``, ``vec_id``, ``score`` (rounded to ``digits``, by which they
    are ranked) and ``rank``; ties go to the smaller id, null vectors take no
    part, null components count as zero.

    Vectors are dealt into shards and queries into blocks; each shard meets each
    block in one task and keeps ``k`` rows a query, which a window merges."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if keep is not None:
        vectors = vectors.where(keep)
    vectors, queries = (x.where("vec_id is not null and embedding is not null").select("vec_id", "embedding") for x in (vectors, queries))
    n, least = vectors.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # each shard gives k rows a query: as many as its rows are worth, or as memory asks for
    shards, blocks = max(1, min(least, n // 1024), -(-n // shard_rows)), max(1, -(-queries.count() // block_rows))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("shard", deal(shards)).withColumn("block", every(blocks))
    right = queries.withColumn("block", deal(blocks)).withColumn("shard", every(shards))
    kind = dict(vectors.dtypes)["vec_id"]

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and asked.num_rows:
            rows = rows.take(pc.sort_indices(rows["vec_id"]))
            ids, names = rows["vec_id"].combine_chunks(), asked["vec_id"].combine_chunks()
            v, q = _unit(_matrix(rows["embedding"])), _unit(_matrix(asked["embedding"]))
            width = max(v.shape[1], q.shape[1])
            v, q = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (v, q))
            itself = pc.index_in(names, value_set=ids).fill_null(-1).to_numpy(zero_copy_only=False)
            for lo in range(0, len(q), 64):
                score = np.round(q[lo : lo + 64] @ v.T, digits) + 0.0
                if not own:
                    mine = itself[lo : lo + 64]
                    score[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -np.inf
                # the k best by score; of those that tie with the last, the first by id
                cut = np.sort(np.partition(-score, min(k, len(ids)) - 1, axis=1)[:, : min(k, len(ids))], axis=1)[:, -1:]
                at, hit = np.nonzero((-score <= cut) & np.isfinite(score))
                order = np.lexsort((hit, -score[at, hit], at))
                at, hit = at[order], hit[order]
                first = np.arange(len(at)) - np.searchsorted(at, at) < k
                at, hit = at[first], hit[first]
                out.append((names.take(pa.array(at + lo)), ids.take(pa.array(hit)), pa.array(score[at, hit])))
        schema = pa.schema([("query_vec", asked.schema.field("vec_id").type), ("vec_id", rows.schema.field("vec_id").type), ("score", pa.float64())])
        return pa.concat_tables([schema.empty_table(), *(pa.Table.from_arrays(list(x), schema=schema) for x in out)])

    scored = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, f"query_vec {kind}, vec_id {kind}, score double")
    w = W.partitionBy("query_vec").orderBy(F.desc("score"), F.asc("vec_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def average_pairwise(vectors: DataFrame, group: str) -> DataFrame:
    """Mean cosine over all pairs of a group's nonzero vectors. Summing unit
    vectors first needs no pairs: |sum|^2 holds each pair twice and n ones."""
    unit = vectors.where(norm(F.col("embedding")) > 0).select(group, normalised(F.col("embedding")).alias("v"))
    n = unit.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    sums = unit.select(group, F.posexplode("v").alias("i", "x")).groupBy(group, "i").agg(F.sum("x").alias("s")).groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    pairs = F.col("n") * (F.col("n") - 1)
    return n.join(sums, group).select(group, F.when(pairs > 0, F.round((F.col("square") - F.col("n")) / pairs, 6)).otherwise(0.0).alias("avg_sim"))


def similar_ids(vectors: DataFrame, one: int, others: DataFrame) -> DataFrame:
    """Similarity of one vector to those in ``others``; zero vectors are skipped."""
    q = vectors.where(F.col("vec_id") == one).select(F.col("embedding").alias("q")).limit(1)
    t = vectors.join(others.select("vec_id"), "vec_id", "left_semi")
    return t.crossJoin(F.broadcast(q)).where((norm(F.col("embedding")) > 0) & (norm(F.col("q")) > 0)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


#: Vectors in a block.
BLOCK = 512


def _blocks(vectors: DataFrame) -> DataFrame:
    """Normalised vectors as blocks: ``ids`` and ``rows`` in bytes."""
    import pyarrow as pa

    def pack(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                ids, rows = part.column(0).to_numpy(), part.column(1).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([rows.astype("<f8").tobytes()], pa.binary())], names=["ids", "rows"])

    v = vectors.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), normalised(F.col("embedding")).alias("v"))
    return v.mapInArrow(pack, "ids binary, rows binary")


def lsh_knn(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int = 6, tables: int = 12, seed: int = 11, probes: int = 8) -> DataFrame:
    """Approximate nearest vectors: signs of seeded random projections give a
    bucket per table. A query looks into the ``probes`` buckets of each table
    that are nearest to it, by the squared projections whose signs differ; only
    vectors found there are scored. Blocks of vectors meet blocks of queries,
    and each meeting gives ``k`` rows a query at most."""
    import pyarrow as pa

    masks = np.arange(1 << bits)
    flips = (masks[:, None] >> np.arange(bits) & 1).astype(float)

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, asked = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["asked"], "<i8")
                order = np.argsort(ids)
                ids = ids[order]
                v, q = np.frombuffer(row["rows"], "<f8").reshape(len(ids), -1)[order], np.frombuffer(row["q"], "<f8").reshape(len(asked), -1)
                planes = np.random.default_rng(seed).normal(size=(tables, bits, v.shape[1]))
                found = np.zeros((len(asked), len(ids)), bool)
                for plane in planes:
                    near = q @ plane.T
                    first = np.argsort(near**2 @ flips.T, axis=1, kind="stable")[:, :probes]
                    probed = np.zeros((len(asked), 1 << bits), bool)
                    np.put_along_axis(probed, ((near >= 0) @ (1 << np.arange(bits)))[:, None] ^ first, True, axis=1)
                    found |= probed[:, (v @ plane.T >= 0) @ (1 << np.arange(bits))]
                found &= asked[:, None] != ids
                score = np.where(found, np.round(q @ v.T, 9), -np.inf)
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                at, nth = np.nonzero(np.take_along_axis(found, best, axis=1))
                hit = best[at, nth]
                yield pa.RecordBatch.from_arrays([pa.array(asked[at]), pa.array(ids[hit]), pa.array(score[at, hit])], names=["query_vec", "vec_id", "score"])

    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = _blocks(queries).select(F.col("ids").alias("asked"), F.col("rows").alias("q")).repartition(max(1, n // 6))
    scored = _blocks(vectors).repartition(n).crossJoin(asked).mapInArrow(search, "query_vec long, vec_id long, score double")
    w = W.partitionBy("query_vec").orderBy(F.desc("score"), F.asc("vec_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
