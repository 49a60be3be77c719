"""Query intents: rules as data, scored for a whole table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Intents in order of precedence, and rules (pattern, intent, weight).
INTENTS = ["definition", "implementation", "usage", "explanation", "debugging", "comparison", "example", "general"]
RULES = [
    ("^what\\s+is\\s+", "definition", 0.3), ("^define\\s+", "definition", 0.4), ("\\bclass\\s+\\w+\\b", "definition", 0.2),
    ("\\binterface\\s+\\w+\\b", "definition", 0.3), ("\\btype\\s+(of\\s+)?\\w+\\b", "definition", 0.2), ("\\bdefinition\\b", "definition", 0.3),
    ("^how\\s+(does|do|is|are|can)\\s+", "implementation", 0.3), ("\\bimplement(s|ed|ation)?\\b", "implementation", 0.3), ("\\balgorithm\\b", "implementation", 0.3),
    ("\\blogic\\b", "implementation", 0.2), ("\\bwork(s|ing)?\\b", "implementation", 0.1), ("\\bcode\\s+for\\b", "implementation", 0.2),
    ("^where\\s+(is|are|do|does)\\s+", "usage", 0.4), ("\\bused\\b", "usage", 0.2), ("\\bcall(s|ed|ing)?\\b", "usage", 0.2),
    ("\\breference(s|d)?\\b", "usage", 0.2), ("\\bcaller(s)?\\b", "usage", 0.3), ("\\bwho\\s+uses\\b", "usage", 0.3),
    ("^why\\s+(does|do|is|are)\\s+", "explanation", 0.4), ("\\bpurpose\\b", "explanation", 0.3), ("\\breason\\b", "explanation", 0.2),
    ("\\bdesign\\b", "explanation", 0.2), ("\\bexplain\\b", "explanation", 0.3),
    ("\\berror\\b", "debugging", 0.3), ("\\bbug\\b", "debugging", 0.3), ("\\bfail(s|ed|ing)?\\b", "debugging", 0.2), ("\\bfix\\b", "debugging", 0.2),
    ("\\bcrash(es|ed|ing)?\\b", "debugging", 0.3), ("\\bexception\\b", "debugging", 0.2), ("\\bnot\\s+working\\b", "debugging", 0.3),
    ("\\bdifference\\s+between\\b", "comparison", 0.4), ("\\bvs\\.?\\b", "comparison", 0.3), ("\\bcompare\\b", "comparison", 0.3),
    ("\\bversus\\b", "comparison", 0.3), ("\\bor\\b.*\\bwhich\\b", "comparison", 0.2),
    ("\\bexample\\b", "example", 0.4), ("\\bhow\\s+to\\s+use\\b", "example", 0.3), ("\\btutorial\\b", "example", 0.3), ("\\bsample\\b", "example", 0.2), ("\\bdemo\\b", "example", 0.2),
]
# Multipliers of the weights by intent: embedding, bm25, contract, recency.
MULTIPLIERS = {
    "definition": (0.6, 2.0, 3.0, 0.3), "implementation": (1.5, 1.2, 0.5, 0.8), "usage": (0.7, 1.5, 0.3, 1.5), "explanation": (1.3, 0.8, 1.2, 0.8),
    "debugging": (1.0, 1.2, 0.8, 1.5), "comparison": (1.1, 1.0, 1.3, 0.7), "example": (1.0, 1.1, 0.6, 1.0), "general": (1.0, 1.0, 1.0, 1.0),
}
# Intents whose results are expanded over the graph.
EXPANDED = ["implementation", "usage", "debugging", "example"]


def classified(queries: DataFrame) -> DataFrame:
    """``query_id``, ``intent``, ``confidence`` and ``secondary``: the weights of
    matching rules summed by intent, ties to the earlier intent."""
    low = F.trim(F.lower("text"))
    scores = [sum((F.when(low.rlike(p), w).otherwise(0.0) for p, i, w in RULES if i == intent), F.lit(0.0)) for intent in INTENTS]
    table = F.array(*[F.struct(F.round(s, 6).alias("score"), F.lit(-n).alias("order"), F.lit(i).alias("intent")) for n, (i, s) in enumerate(zip(INTENTS, scores, strict=True))])
    best = F.reverse(F.array_sort(table))
    total = F.aggregate(table, F.lit(0.0), lambda a, x: a + x["score"])
    q = queries.select("query_id", best.alias("best"), total.alias("total"))
    top, second = F.col("best")[0], F.col("best")[1]
    none = top["score"] == 0
    return q.select(
        "query_id",
        F.when(none, "general").otherwise(top["intent"]).alias("intent"),
        F.round(F.when(none, 0.5).otherwise(F.least(F.lit(0.95), top["score"] / F.greatest(F.col("total"), F.lit(0.1)) + 0.3)), 6).alias("confidence"),
        F.when(second["score"] > 0.1, second["intent"]).alias("secondary"),
    )


def multipliers(intents: DataFrame) -> DataFrame:
    """Weight multipliers and whether to expand over the graph, by query."""
    table = F.create_map(*[x for i, m in MULTIPLIERS.items() for x in (F.lit(i), F.array(*map(F.lit, m)))])
    m = F.element_at(table, F.col("intent"))
    return intents.select("query_id", "intent", *[m[i].alias(n) for i, n in enumerate(["embedding", "bm25", "contract", "recency"])], F.col("intent").isin(*EXPANDED).alias("expand"))
