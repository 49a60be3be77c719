"""Retrieval quality, telemetry and learning from feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exploration_waste(retrieved: DataFrame, by: list[str]) -> DataFrame:
    """Tokens retrieved and not used (``tokens``, ``selected``) per group."""
    used = F.sum(F.when(F.col("selected"), F.col("tokens")).otherwise(0))
    g = retrieved.groupBy(*by).agg(F.sum("tokens").alias("explored"), used.alias("used"), F.count(F.lit(1)).alias("chunks"))
    waste = F.when(F.col("explored") > 0, (F.col("explored") - F.col("used")) / F.col("explored")).otherwise(0.0)
    return g.select(*by, "explored", "used", "chunks", F.round(waste, 6).alias("ewr"))


def impact_miss(retrieved: DataFrame, impactful: DataFrame, by: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """Impactful items that were missed: ``imr``, ``precision``, ``recall``, ``f1``."""
    r = retrieved.select(by, item).distinct().withColumn("r", F.lit(1))
    i = impactful.select(by, item).distinct().withColumn("i", F.lit(1))
    g = r.join(i, [by, item], "full").groupBy(by).agg(F.count("r").alias("retrieved"), F.count("i").alias("impactful"), F.sum(F.coalesce(F.col("r") * F.col("i"), F.lit(0))).alias("hit"))
    miss = F.when(F.col("impactful") > 0, (F.col("impactful") - F.col("hit")) / F.col("impactful")).otherwise(0.0)
    precision = F.when(F.col("retrieved") > 0, F.col("hit") / F.col("retrieved")).otherwise(0.0)
    recall = 1 - miss
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return g.select(by, "retrieved", "impactful", "hit", F.round(miss, 6).alias("imr"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def ranking_quality(ranked: DataFrame, relevant: DataFrame, k: int = 10, by: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """``mrr``, ``ndcg``, ``recall`` and ``precision`` at k of each query that has
    relevant items (``ranked``: rank from 1)."""
    truth = relevant.select(by, item).distinct().withColumn("rel", F.lit(1.0))
    n = truth.groupBy(by).agg(F.count(F.lit(1)).alias("n_rel"))
    hits = ranked.where(F.col("rank") <= k).join(truth, [by, item]).groupBy(by).agg(F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.count(F.lit(1)).alias("hits"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_rel")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    j = n.join(hits, by, "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        by,
        F.round(z(1 / F.col("first")), 6).alias("mrr"),
        F.round(z(F.col("dcg")) / ideal, 6).alias("ndcg"),
        F.round(z(F.col("hits") / F.col("n_rel")), 6).alias("recall"),
        F.round(z(F.col("hits") / k), 6).alias("precision"),
    )


def likely_impactful(scored: DataFrame, threshold: float = 0.7, by: str = "query_id") -> DataFrame:
    """Items near the best score; contracts get 0.3 and pinned ones 0.4 more."""
    best = F.max("score").over(W.partitionBy(by))
    share = F.when(best == 0, F.col("score")).otherwise(F.col("score") / best)
    hit = (share >= threshold) | (F.col("is_contract") & (share + 0.3 >= threshold)) | (F.col("is_pinned") & (share + 0.4 >= threshold))
    return scored.withColumn("_hit", hit).where("_hit").drop("_hit")


def estimated_missed(words: Column, retrieved: Column, total: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(retrieved * (1 + F.least(F.lit(1.0), words / 10)) * (1 - F.least(F.lit(1.0), 10 * retrieved / F.greatest(total, F.lit(1)))) * 0.1)).cast("long")


def summary(points: DataFrame, by: list[str], value: str = "value", since: Column | None = None, ts: str = "ts") -> DataFrame:
    """Count, sum, mean, least, greatest and population deviation of the points
    since a time (all without one)."""
    points = points if since is None else points.where(F.col(ts) >= since)
    return points.groupBy(*by).agg(
        F.count(value).alias("n"), F.round(F.sum(value), 6).alias("total"), F.round(F.avg(value), 6).alias("mean"),
        F.round(F.min(value), 6).alias("least"), F.round(F.max(value), 6).alias("greatest"), F.round(F.stddev_pop(value), 6).alias("std"),
    )


def daily(points: DataFrame, before: Column | None = None, ts: str = "ts", name: str = "name") -> DataFrame:
    """Roll-up by day and name of the points before a time."""
    old = points if before is None else points.where(F.col(ts) < before)
    return summary(old.withColumn("day", F.to_date(ts).cast("string")), [name, "day"])


def outcomes(events: DataFrame, now: Column, session: str = "session", ts: str = "ts", tie: str = "event_id", quick: float = 30, timeout: float = 300) -> DataFrame:
    """``outcome`` of each event from the gap to the session's next: below
    ``quick`` seconds failure, below ``timeout`` unknown, else success; the
    last one is a success once it is older than ``timeout``."""
    seconds = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6
    following = F.lead(ts).over(W.partitionBy(session).orderBy(ts, tie))
    gap, age = seconds(F.col(ts), F.col("_next")), seconds(F.col(ts), now)
    last = F.col("_next").isNull()
    out = F.when(last & (age > timeout), "success").when(last, "unknown").when(gap < quick, "failure").when(gap < timeout, "unknown").otherwise("success")
    return events.withColumn("_next", following).withColumn("outcome", out).drop("_next")


def contrastive_pairs(events: DataFrame, most: int = 3) -> DataFrame:
    """Pairs of a used and an unused item (``retrieved``, ``selected`` arrays)
    of each labelled event; failures swap the two."""
    labelled = events.where(F.col("outcome").isin("success", "failure"))
    unused = F.slice(F.array_sort(F.array_except("retrieved", "selected")), 1, most)
    pairs = labelled.select("event_id", "outcome", F.explode(F.array_distinct("selected")).alias("s"), unused.alias("u")).select("event_id", "outcome", "s", F.explode("u").alias("u"))
    swap = F.col("outcome") == "failure"
    return pairs.select("event_id", F.when(swap, F.col("u")).otherwise(F.col("s")).alias("positive"), F.when(swap, F.col("s")).otherwise(F.col("u")).alias("negative"))


def learned_weights(pairs: DataFrame, rate: float = 0.01, model: str = "model", baseline: float = 1.0) -> DataFrame:
    """Ordered updates of feature weights from pairs of feature arrays
    (``seq``, ``positive``, ``negative``), one sequence per ``model``."""

    def learn(pdf):
        import math

        import pandas as pd

        w: dict[str, float] = {}
        for row in pdf.sort_values("seq").itertuples(index=False):
            margin = sum(w.get(f, 0.0) for f in row.positive) - sum(w.get(f, 0.0) for f in row.negative)
            step = rate / (1 + math.exp(min(margin, 10)))
            for f in row.positive:
                w[f] = w.get(f, 0.0) + step
            for f in row.negative:
                w[f] = w.get(f, 0.0) - step
        first = pdf[model].iloc[0]
        return pd.DataFrame([(first, f, round(x, 9)) for f, x in sorted(w.items())], columns=[model, "feature", "weight"])

    return pairs.groupBy(model).applyInPandas(learn, f"{model} {dict(pairs.dtypes)[model]}, feature string, weight double")


def adjusted(items: DataFrame, weights: DataFrame, baseline: float = 1.0) -> DataFrame:
    """``adjustment`` per item (``item``, ``features``): the logistic value of
    the baseline and its features' weights."""
    rows = items.select("item", F.explode_outer("features").alias("feature")).join(weights, "feature", "left")
    return rows.groupBy("item").agg(F.round(1 / (1 + F.exp(-(baseline + F.coalesce(F.sum("weight"), F.lit(0.0))))), 6).alias("adjustment"))


def latest(rows: DataFrame, n: int, order: list[Column], by: str | None = None) -> DataFrame:
    """The last ``n`` rows (of each group)."""
    if by is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def budget_states(iterations: DataFrame, most_iterations: int, tokens: int, by: str = "session", least_new: int = 2, low_entropy: float = 0.3) -> DataFrame:
    """After each round (``seq``, ``tokens``, ``entropy``, ``new_chunks``) whether
    to stop and why; the first reason that holds."""
    w = W.partitionBy(by).orderBy("seq")
    used = F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, 0))
    few, few_before = F.col("new_chunks") < least_new, F.lag("new_chunks").over(w) < least_new
    why = (
        F.when(F.row_number().over(w) >= most_iterations, "max_iterations")
        .when(used >= tokens, "token_budget")
        .when(F.col("entropy") < low_entropy, "low_entropy")
        .when(few & F.coalesce(few_before, F.lit(False)), "no_new_results")
    )
    return iterations.withColumn("tokens_used", used).withColumn("stop_reason", why)


def new_counts(found: DataFrame, by: str = "session", order: str = "seq", item: str = "chunk_id") -> DataFrame:
    """How many items each round (``by``, ``order``) brought that none before it had."""
    first = found.groupBy(by, item).agg(F.min(order).alias(order))
    new = first.groupBy(by, order).agg(F.count(F.lit(1)).alias("new_chunks"))
    return found.select(by, order).distinct().join(new, [by, order], "left").withColumn("new_chunks", F.coalesce("new_chunks", F.lit(0)))


# ---- sessions, trends, suggestions ---------------------------------------------


def trend(rows: DataFrame, value: str, by: str, order: str, window: int = 10) -> DataFrame:
    """The last ``window`` values of each group, newest first: ``by``, ``place``, ``value``."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))
    return rows.withColumn("place", place).where(F.col("place") <= window).select(by, "place", F.col(value).alias("value"))


def session_waste(queries: DataFrame, by: str, order: str = "seq") -> DataFrame:
    """Pooled waste of each session over its queries (``explored``, ``used``),
    and the mean, deviation, least and greatest of theirs, with those of the last
    three and of up to seven before."""
    own = F.when(F.col("explored") > 0, (F.col("explored") - F.col("used")) / F.col("explored")).otherwise(0.0)
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))
    rows = queries.withColumn("_e", own).withColumn("_p", place)
    pooled = F.when(F.sum("explored") > 0, (F.sum("explored") - F.sum("used")) / F.sum("explored")).otherwise(0.0)
    r = lambda c: F.round(c, 6)
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("queries"), r(pooled).alias("session_ewr"), r(F.avg("_e")).alias("mean_ewr"), r(F.stddev_pop("_e")).alias("std_ewr"), r(F.min("_e")).alias("min_ewr"), r(F.max("_e")).alias("max_ewr"),
        r(F.avg(F.when(F.col("_p") <= 3, F.col("_e")))).alias("recent"), r(F.avg(F.when((F.col("_p") > 3) & (F.col("_p") <= 10), F.col("_e")))).alias("older"),
    )


def suggestions(stats: DataFrame, by: str) -> DataFrame:
    """``by`` and ``advice`` (an array of codes) from ``session_waste``."""
    few = F.col("queries") < 5
    older = F.coalesce("older", "recent")
    rules = [
        (F.col("session_ewr") > 0.7, "retrieve_less"), (F.col("max_ewr") > 0.9, "review_queries"),
        ((F.col("queries") >= 3) & (F.col("recent") > older * 1.2), "waste_grows"), ((F.col("queries") >= 3) & (F.col("recent") < older * 0.8), "waste_falls"),
    ]
    said = F.filter(F.array(*[F.when(c, F.lit(x)) for c, x in rules]), lambda x: x.isNotNull())
    return stats.select(by, F.when(few, F.array(F.lit("more_data"))).when(F.size(said) == 0, F.array(F.lit("none"))).otherwise(said).alias("advice"))


def wasteful_kinds(retrieved: DataFrame, by: list[str], kind: str = "symbol_type", least: float = 0.9) -> DataFrame:
    """Kinds of chunks whose tokens are nearly all unused."""
    return exploration_waste(retrieved.withColumn(kind, F.coalesce(F.col(kind), F.lit("unknown"))), [*by, kind]).where(F.col("ewr") > least)


def session_misses(queries: DataFrame, by: str) -> DataFrame:
    """Pooled misses of each session over its queries (``retrieved``,
    ``impactful``, ``hit``: counts) and the mean and deviation of theirs."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    own = ratio(F.col("impactful") - F.col("hit"), F.col("impactful"))
    miss = ratio(F.sum("impactful") - F.sum("hit"), F.sum("impactful"))
    precision = ratio(F.sum("hit"), F.sum("retrieved"))
    f1 = F.when(precision + 1 - miss > 0, 2 * precision * (1 - miss) / (precision + 1 - miss)).otherwise(0.0)
    r = lambda c: F.round(c, 6)
    return queries.groupBy(by).agg(F.count(F.lit(1)).alias("queries"), r(miss).alias("imr"), r(precision).alias("precision"), r(1 - miss).alias("recall"), r(f1).alias("f1"), r(F.avg(own)).alias("mean_imr"), r(F.stddev_pop(own)).alias("std_imr"))


def miss_patterns(missed: DataFrame, pattern: str) -> DataFrame:
    """How often missed items show each pattern; unknown ones count as such."""
    return missed.groupBy(F.coalesce(F.col(pattern), F.lit("unknown")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def response_metrics(entries: DataFrame, responses: DataFrame, by: list[str]) -> DataFrame:
    """Length of each response and its ledger entries, in all and by type."""
    kinds = entries.groupBy(*by, "entry_type").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.sum("n").alias("entries"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "entry_type", F.col("n").cast("string")))), ";").alias("by_type"))
    return responses.select(*by, F.length("text").cast("long").alias("response_length")).join(kinds, by, "left").withColumns({"entries": F.coalesce("entries", F.lit(0)), "by_type": F.coalesce("by_type", F.lit(""))})


# ---- features, the learning job, synthetic queries --------------------------------


def chunk_features(chunks: DataFrame) -> DataFrame:
    """``chunk_id`` and its ``features``: symbol type, kind of file, contract."""
    path = F.lower("file_path")
    found = F.array(
        F.concat(F.lit("symbol_"), F.coalesce("symbol_type", F.lit("unknown"))), F.when(F.contains(path, F.lit("test")), F.lit("file_test")),
        F.when(F.contains(path, F.lit("config")), F.lit("file_config")), F.when(F.col("is_contract"), F.lit("is_contract")),
    )
    return chunks.select("chunk_id", F.filter(found, lambda x: x.isNotNull()).alias("features"))


def query_features(events: DataFrame) -> DataFrame:
    """``event_id``, the intent as a feature, and the query's number of words."""
    words = F.size(F.filter(F.split("query", "\\s+"), lambda w: w != ""))
    return events.select("event_id", F.concat(F.lit("intent_"), "query_intent").alias("intent"), words.cast("long").alias("query_length"))


def learn(events: DataFrame, chunks: DataFrame, now: Column, rate: float = 0.01, model: str = "model") -> DataFrame:
    """The learning job: outcomes from the sessions' gaps where none is given,
    pairs of used and unused chunks, and ordered updates of feature weights, per
    ``model``. ``events``: event_id, session_id, ts, retrieved, selected, outcome, model."""
    told = outcomes(events.withColumnRenamed("outcome", "_given"), now, session="session_id")
    told = told.withColumn("outcome", F.coalesce("_given", "outcome"))
    pairs = contrastive_pairs(told).join(events.select("event_id", model), "event_id")
    features = chunk_features(chunks).withColumn("chunk_id", F.col("chunk_id").cast(dict(pairs.dtypes)["positive"]))
    side = lambda c: features.select(F.col("chunk_id").alias(c), F.col("features").alias(f"{c}_features"))
    rows = pairs.join(side("positive"), "positive").join(side("negative"), "negative")
    seq = F.row_number().over(W.partitionBy(model).orderBy("event_id", "positive", "negative"))
    rows = rows.withColumn("seq", seq).select(model, "seq", F.col("positive_features").alias("positive"), F.col("negative_features").alias("negative"))
    return learned_weights(rows, rate, model)


# Questions about a symbol, by type.
TEMPLATES = {
    "definition": ["What is {}?", "{} class", "definition of {}", "{} interface"],
    "implementation": ["How does {} work?", "{} implementation", "{} function", "{} method"],
}


def synthetic_queries(symbols: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    """``n`` questions with known answers: symbols in the order of a seeded
    digest, the question's type by the symbol's, its form by the digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("chunk_id").cast("string")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    kind = F.lower(F.coalesce("symbol_type", F.lit("")))
    has = lambda *parts: kind.rlike("|".join(parts))
    query_type = F.when(has("class", "interface"), "definition").when(has("function", "method"), "implementation").when(number % 2 == 0, "definition").otherwise("implementation")
    forms = {k: F.element_at(F.array(*map(F.lit, v)), ((F.floor(number / 2) % len(v)) + 1).cast("int")) for k, v in TEMPLATES.items()}
    form = F.when(F.col("query_type") == "definition", forms["definition"]).otherwise(forms["implementation"])
    chosen = symbols.where("symbol_name is not null").withColumn("_d", digest).orderBy("_d", "chunk_id").limit(n).withColumn("query_type", query_type)
    return chosen.select(F.replace(form, F.lit("{}"), F.col("symbol_name")).alias("query"), F.col("chunk_id").alias("expected_chunk_id"), F.col("symbol_name").alias("expected_symbol"), "query_type")
