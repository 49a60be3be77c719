"""Mixing sources to target weights.

Sizes are summed per source, repetition rates follow from the targets, and a
document is taken floor(rate) times plus one hash-seeded Bernoulli copy whose
probability is the rate's fraction. Reruns agree: the draw depends on the seed,
the document's id and its text alone.

Targets: sources ranked by code point (null is a source of its own, last) weigh
``weights`` in turn and share all words; a target stops at ``cap`` times its
source's size and the excess goes to the others by weight. In the order of
size over weight the capped sources are a prefix, so running sums find them
exactly, without iterating.

Null or empty texts have size 0 and take 0 words; a null id draws as the text
``null``, so rows without an id are told apart by their texts; rows that repeat
both are taken alike; further columns pass through ``mix`` untouched. An empty
table gives no rows; a text is in memory by itself. Only one row per source
meets in a task. The targets are a written table, so documents join it by its
measured size: broadcast below the optimizer's threshold, without moving a
text, else a shuffled join whose hot sources adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import unused, written

SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    flat = F.trim(F.regexp_replace(text, SPACE, " "))
    return F.coalesce(F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1), F.lit(0)).cast("long")


def targets(sized: DataFrame, source: str = "source", size: str = "size", weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``source``, ``source_size`` (long), ``target`` (double): one row per source."""
    per = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight.cast("long"))
    by_fill = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("rank"))
    before, everything = by_fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")  # noqa: E731  products of counts may pass 64 bits
    capped = wide("source_size", 19) * F.lit(cap) * wide("weight_left", 10) <= wide("weight", 5) * (wide("total", 19) - wide("size_before", 19) * F.lit(cap))
    per = per.withColumn("capped", capped)
    kept = F.col("total") - cap * F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(everything), F.lit(0))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    share = F.col("weight").cast("double") * F.col("kept").cast("double") / F.col("free").cast("double")
    return (
        per.withColumn("kept", kept)
        .withColumn("free", free)
        .select("source", "source_size", F.when(F.col("capped"), (F.col("source_size") * cap).cast("double")).otherwise(share).alias("target"))
    )


def _text_digest(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))


def _copies(id_col: str, digest: Column, seed: str, source_size: str = "source_size", target: str = "target") -> Column:
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(0.0)
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null")), digest))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **how) -> DataFrame:
    """One row per document: id, ``source``, ``size``, ``source_size``,
    ``target``, ``copies`` and ``taken`` (words, repeats counted)."""
    sized = written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), _text_digest(text_col).alias("digest")), "sizes"
    )
    return (
        sized.alias("d")
        .join(written(targets(sized, **how), "targets").alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("doc_id", F.col("d.source"), "size", "source_size", "target", "digest")
        .withColumn("copies", _copies("doc_id", F.col("digest"), seed))
        .drop("digest")
        .withColumn("taken", F.col("copies") * F.col("size"))
        .withColumnRenamed("doc_id", id_col)
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **how) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as it is taken."""
    names = [unused(docs.columns, x) for x in ("mix_source", "mix_size", "mix_target", "mix_copy")]
    sized = docs.select(F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"))
    t = written(targets(sized, **how), "targets").toDF(*names[:3])
    joined = docs.join(t, F.col(source_col).cast("string").eqNullSafe(F.col(names[0])))
    copies = _copies(id_col, _text_digest(text_col), seed, names[1], names[2]).cast("int")
    return joined.withColumn(names[3], F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM d GROUP BY source),
w AS (
  SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_before,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
  FROM w),
c AS (
  SELECT *, source_size * 3 * weight_left <= weight * (total - size_before * 3) AS capped FROM r),
f AS (
  SELECT *, total - 3 * coalesce(sum(source_size) FILTER (WHERE capped) OVER (), 0) AS kept, sum(weight) FILTER (WHERE NOT capped) OVER () AS free FROM c),
t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
    CASE WHEN capped THEN CAST(source_size * 3 AS DOUBLE) ELSE CAST(weight AS DOUBLE) * CAST(kept AS DOUBLE) / CAST(free AS DOUBLE) END AS target FROM f),
j AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM j
"""
