"""The eight list operators over a table of strings (``pos``, ``value``).

Each answers with ``key``, ``value`` and ``count`` as far as they apply and
takes a limit; order is by first appearance unless the operator sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lexical import small
from .lineage import cut


def extract_regex(inputs: DataFrame, pattern: str, limit: int = 100, group: int = 0) -> DataFrame:
    found = inputs.select("pos", F.posexplode(F.regexp_extract_all("value", F.lit(pattern), F.lit(group))).alias("at", "value"))
    return found.orderBy("pos", "at").limit(limit)


def unique(inputs: DataFrame, limit: int = 100) -> DataFrame:
    return inputs.groupBy("value").agg(F.min("pos").alias("pos")).orderBy("pos").limit(limit)


def sort(inputs: DataFrame, reverse: bool = False, limit: int = 100) -> DataFrame:
    order = [F.desc("value"), F.asc("pos")] if reverse else [F.asc("value"), F.asc("pos")]
    return inputs.orderBy(*order).limit(limit)


def group_by(inputs: DataFrame, key_pattern: str = "^([^/]+)", limit: int = 100) -> DataFrame:
    """Values by the pattern's group; those without a match under ``_other``."""
    key = F.when(F.col("value").rlike(key_pattern), F.regexp_extract("value", key_pattern, 1)).otherwise("_other")
    grouped = inputs.withColumn("key", key).groupBy("key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"), F.count(F.lit(1)).alias("count"), F.min("pos").alias("first")
    )
    return grouped.orderBy("first").limit(limit).drop("first")


def count(inputs: DataFrame, limit: int = 100) -> DataFrame:
    return inputs.groupBy("value").agg(F.count(F.lit(1)).alias("count"), F.min("pos").alias("first")).orderBy(F.desc("count"), "first").limit(limit).drop("first")


def top_k(inputs: DataFrame, k: int = 10, limit: int = 100) -> DataFrame:
    """JSON objects with ``value`` and ``score``; anything else scores 0."""
    score = F.coalesce(F.get_json_object("value", "$.score").cast("double"), F.lit(0.0))
    value = F.when(F.get_json_object("value", "$.score").isNotNull(), F.coalesce(F.get_json_object("value", "$.value"), F.col("value"))).otherwise(F.col("value"))
    scored = inputs.select("pos", value.alias("value"), score.alias("score"))
    return scored.orderBy(F.desc("score"), "pos").limit(min(k, limit)).select("pos", "value", (F.col("score") * 100).cast("int").alias("count"))


def join_on(inputs: DataFrame, separator: str = "\n", limit: int = 100) -> DataFrame:
    few = inputs.orderBy("pos").limit(limit)
    return few.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), separator).alias("value"))


def diff_sets(inputs: DataFrame, set_a: DataFrame, set_b: DataFrame) -> DataFrame:
    """``value`` and ``key``: only_a, only_b or both, for positions in two tables (``pos``)."""
    side = lambda s: inputs.join(s, "pos", "left_semi").select("value").distinct()
    a, b = side(set_a).withColumn("a", F.lit(1)), side(set_b).withColumn("b", F.lit(1))
    key = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("both")
    return a.join(b, "value", "full").select(key.alias("key"), "value")


OPERATIONS = {"extract_regex": extract_regex, "unique": unique, "sort": sort, "group_by": group_by, "count": count, "top_k": top_k, "join_on": join_on, "diff_sets": diff_sets}


def aggregate(op: str, inputs: DataFrame, **params) -> DataFrame:
    if op not in OPERATIONS:
        raise ValueError(f"unknown operation: {op}")
    return OPERATIONS[op](inputs, **params)


def running_total(items: DataFrame, value: Column, order: list[Column], by: str | None = None, out: str = "total") -> DataFrame:
    """``items`` and the running sum of a value in an order (of each ``by``),
    without a group or the table in one task: rows are dealt into ranges of the
    order, each range sums its own, and the ranges' sums are few rows."""
    key = [F.col(by)] if by else []
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = items.withColumn("_v", value).repartitionByRange(n, *key, *order).withColumn("_p", F.spark_partition_id())
    dealt = cut(dealt)  # a range keeps its number from here on
    ranges = dealt.groupBy("_p", *([by] if by else [])).agg(F.sum("_v").alias("_s"))
    before = (W.partitionBy(by) if by else W.partitionBy()).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("_p", *([F.col(by).alias("_by")] if by else []), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    on = [F.col("a._p") == F.col("r._p"), *([F.col(f"a.{by}").eqNullSafe(F.col("r._by"))] if by else [])]
    joined = dealt.alias("a").join(small(ranges).alias("r"), on)
    inside = W.partitionBy(F.col("a._p"), *key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return joined.withColumn(out, F.sum("_v").over(inside) + F.col("_before")).select(*[F.col(f"a.{c}") for c in items.columns], out)


def within_budget(items: DataFrame, tokens: str, order: list, budget: int, by: str | None = None, overhead: int = 2, each: int = 1) -> DataFrame:
    """Adds ``cum_tokens`` and ``kept``: the prefix of items whose tokens, with
    ``each`` more per item and ``overhead`` for all, stay within the budget."""
    summed = running_total(items, F.col(tokens) + each, order, by, "_total")
    return summed.withColumn("cum_tokens", F.col("_total") + overhead).withColumn("kept", F.col("cum_tokens") <= budget).drop("_total")


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of rows with the cursor of the next one (null at the end)."""
    more = not rows.orderBy(*order).offset(offset + limit).limit(1).isEmpty()
    cursor = F.lit(None).cast("string") if not more else F.base64(F.to_json(F.struct(F.lit(offset + limit).alias("offset"), F.lit(limit).alias("limit"))).cast("binary"))
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("next_cursor", cursor)
