"""Statistics of score lists: entropy, difficulty, divergence, gates, calibration.

Scores come as rows (group, score); every measure is an aggregation by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import any_of, query_complexity, token_estimate


def softmax(scores: DataFrame, by: str, score: str = "score", temperature: float = 1.0) -> DataFrame:
    """Adds ``p``: exp(score / temperature) over its group's sum, stably."""
    w = W.partitionBy(by)
    e = F.exp((F.col(score) - F.max(score).over(w)) / temperature)
    return scores.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def score_statistics(scores: DataFrame, by: str, score: str = "score", temperature: float = 1.0, top: int = 3) -> DataFrame:
    """Per group: ``entropy`` (nats), ``norm_entropy``, ``confidence``,
    ``score_gap``, ``concentration`` of the best ``top``, ``difficulty``."""
    p = softmax(scores.select(by, F.col(score).cast("double").alias("score")), by, "score", temperature)
    w = W.partitionBy(by).orderBy(F.desc("score"))
    p = p.withColumn("rn", F.row_number().over(w))
    part = F.when(F.col("p") > 1e-10, -F.col("p") * F.ln("p")).otherwise(0.0)
    g = p.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(part).alias("h"),
        F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("s1"),
        F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("s2"),
        F.sum(F.when(F.col("rn") <= top, F.col("p")).otherwise(0.0)).alias("mass"),
    )
    many = F.col("n") > 1
    norm = F.when(many, F.col("h") / F.ln("n")).otherwise(0.0)
    gap = F.when(~many, 1.0).when(F.col("s1") == 0, 0.0).otherwise((F.col("s1") - F.col("s2")) / F.col("s1"))
    return g.select(
        by,
        "n",
        F.round("h", 6).alias("entropy"),
        F.round(norm, 6).alias("norm_entropy"),
        F.round(1 - norm, 6).alias("confidence"),
        F.round(gap, 6).alias("score_gap"),
        F.round("mass", 6).alias("concentration"),
        F.round(0.4 * norm + 0.3 * (1 - gap) + 0.3 * (1 - F.col("mass")), 6).alias("difficulty"),
    )


def triggers(stats: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Whether a list is so even that retrieval should go on (3 scores at least)."""
    return stats.withColumn("trigger", (F.col("n") >= 3) & (F.col("norm_entropy") > threshold))


def divergence(scores: DataFrame, by: str, position: str, score: str, temperature: float = 1.0) -> DataFrame:
    """``a``, ``b``, ``cross_entropy`` and ``kl`` of all ordered pairs of groups,
    whose scores are matched by ``position``. Groups are few (types, modes)."""
    p = softmax(scores.select(by, position, F.col(score).cast("double").alias("score")), by, "score", temperature)
    a = p.select(F.col(by).alias("a"), position, F.col("p").alias("pa"))
    b = p.select(F.col(by).alias("b"), position, F.col("p").alias("pb"))
    both = a.join(b, position).where("a <> b")
    cross = F.sum(F.when(F.col("pa") > 1e-10, -F.col("pb") * F.ln("pa")).otherwise(0.0))
    kl = F.sum(F.when((F.col("pa") > 1e-10) & (F.col("pb") > 1e-10), F.col("pa") * F.ln(F.col("pa") / F.col("pb"))).otherwise(0.0))
    return both.groupBy("a", "b").agg(F.round(cross, 6).alias("cross_entropy"), F.round(kl, 6).alias("kl"))


def mode_gate(stats: DataFrame, queries: DataFrame, density: DataFrame) -> DataFrame:
    """``mode`` per query: 'rlm' above 0.5 of 0.4 entropy, 0.2 (1 - gap), 0.2
    query complexity and 0.2 (1 - contract density); with the reasons."""
    joined = queries.select("query_id", query_complexity(F.col("text")).alias("complexity")).join(stats, "query_id").join(density, "query_id", "left")
    dense = F.coalesce(F.col("contract_density"), F.lit(0.0))
    score = 0.4 * F.col("norm_entropy") + 0.2 * (1 - F.col("score_gap")) + 0.2 * F.col("complexity") + 0.2 * (1 - dense)
    said = F.concat_ws(
        ", ",
        F.when(F.col("norm_entropy") > 0.6, F.lit("high retrieval entropy")),
        F.when(F.col("score_gap") < 0.3, F.lit("similar scores across results")),
        F.when(F.col("complexity") > 0.5, F.lit("complex query structure")),
        F.when(dense < 0.2, F.lit("few contract definitions")),
    )
    rlm = F.round(score, 6) > 0.5
    return joined.select("query_id", F.round(score, 6).alias("rlm_score"), F.when(rlm, "rlm").otherwise("pack").alias("mode"), F.when(rlm, said).alias("reasons"))


# Words of prompts that ask for several steps.
MULTI_STEP = ["all", "every", "across", "throughout", "comprehensive", "trace", "follow", "dependency", "impact", "analyze"]


def prompt_gate(prompts: DataFrame) -> DataFrame:
    """``reasons`` and ``use_rlm`` (two of: entropy above 0.7, more than 500
    tokens, a multi-step word). ``prompts``: query_id, text, entropy."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("entropy") > 0.7, F.lit("HIGH_ENTROPY")),
            F.when(token_estimate(F.col("text")) > 500, F.lit("COMPLEX_PROMPT")),
            F.when(any_of(F.lower("text"), MULTI_STEP), F.lit("MULTI_STEP_KEYWORDS")),
        )
    )
    return prompts.select("query_id", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) >= 2).alias("use_rlm"))


def adaptive_threshold(feedback: DataFrame, start: float = 2.5, rate: float = 0.1) -> DataFrame:
    """``threshold`` per ``session`` after its ordered overrides (``seq``,
    ``mode``, ``override``, ``entropy``): a step toward the entropy, held in
    0.3..0.8. A fold over one session's short list."""
    rows = feedback.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", "mode", "override", "entropy"))).alias("events"))

    def step(t: Column, e: Column) -> Column:
        against = F.coalesce((e["override"] != e["mode"]), F.lit(False))
        moved = F.when(against, t + rate * (e["entropy"] - t)).otherwise(t)
        return F.when(e["override"].isNotNull(), F.greatest(F.lit(0.3), F.least(F.lit(0.8), moved))).otherwise(t)

    return rows.select("session", F.round(F.aggregate("events", F.lit(float(start)), step), 6).alias("threshold"))


def pack_confidence(packs: DataFrame) -> DataFrame:
    """0.5 mean of the five best scores, 0.3 (1 - entropy / 5), 0.2 budget use.
    ``packs``: query_id, scores (descending), entropy, used, budget."""
    best = F.slice("scores", 1, 5)
    mean = F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)
    use = F.when(F.col("budget") > 0, F.least(F.col("used") / F.col("budget"), F.lit(1.0))).otherwise(0.0)
    value = F.when(F.size("scores") == 0, 0.0).otherwise(F.round(F.least(0.5 * mean + 0.3 * F.greatest(F.lit(0.0), 1 - F.col("entropy") / 5) + 0.2 * use, F.lit(1.0)), 3))
    level = F.when(value >= 0.75, "high").when(value >= 0.5, "medium").otherwise("low")
    return packs.select("query_id", value.alias("confidence"), level.alias("level"))


def calibrated(samples: DataFrame, percentile: float = 0.75, least: int = 10, default: float = 2.5) -> DataFrame:
    """Threshold from the entropies of easy and hard queries (``entropy``,
    ``easy``): one row, with means, deviations, separation and confidence."""
    easy, hard = F.col("easy"), ~F.col("easy")
    g = samples.agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.expr(f"percentile(entropy, {percentile}) FILTER (WHERE easy)").alias("p"),
        F.avg(F.when(easy, F.col("entropy"))).alias("easy_mean"),
        F.stddev_pop(F.when(easy, F.col("entropy"))).alias("easy_std"),
        F.avg(F.when(hard, F.col("entropy"))).alias("hm"),
        F.stddev_pop(F.when(hard, F.col("entropy"))).alias("hs"),
    )
    hard_mean, hard_std = F.coalesce("hm", F.col("easy_mean") + 1), F.coalesce("hs", "easy_std")
    pooled = F.sqrt((F.col("easy_std") * F.col("easy_std") + hard_std * hard_std) / 2)
    separation = F.when(F.col("hm").isNull(), 0.0).otherwise((hard_mean - F.col("easy_mean")) / F.greatest(pooled, F.lit(0.001)))
    good = (F.col("num_samples") >= least) & F.col("easy_mean").isNotNull()
    return g.select(
        "num_samples",
        F.round(F.when(good, F.col("p")).otherwise(default), 6).alias("threshold"),
        F.round("easy_mean", 6).alias("easy_mean"),
        F.round(hard_mean, 6).alias("hard_mean"),
        F.round(F.when(good, separation).otherwise(0.0), 6).alias("separation"),
        F.round(F.when(good, F.least(F.lit(0.95), F.col("num_samples") / 100 * (1 + separation / 2))).otherwise(0.0), 6).alias("confidence"),
    )


def char_entropy(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Shannon entropy of the characters over 7 bits, 1 at most; empty: 0."""
    chars = texts.select(key, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "")).alias("c")).where("c <> ''")
    counts = chars.groupBy(key, "c").agg(F.count(F.lit(1)).alias("n"))
    # H = log2(total) - sum(n log2 n) / total
    sums = counts.groupBy(key).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("part"))
    h = sums.select(key, F.least(F.lit(1.0), (F.log2("total") - F.col("part") / F.col("total")) / 7).alias("h"))
    return texts.select(key).join(h, key, "left").select(key, F.round(F.coalesce("h", F.lit(0.0)), 6).alias("entropy"))
