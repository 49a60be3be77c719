"""Queries: list operators, statistics, gates, telemetry, feedback, quality, text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates, metrics, packing, statistics
from ..operators.lexical import bm25, small, spread
from ..operators.lineage import cut
from ..plans import correction, planner
from ..sources import files, stores
from ..streaming import jobs
from .base import BM25, TERMS, bm25_sql, chunks, flags, query, questions, table
from .retrieval import ASKED, CANDIDATES, asked, candidates, hits

# ---- list operators over nation and event names ----------------------------


def inputs(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("pos"), F.concat("event_type", F.lit("/"), F.col("user_id") % 7).alias("value"))


INPUTS = "inp AS (SELECT event_id AS pos, event_type || '/' || CAST(user_id % 7 AS VARCHAR) AS value FROM events)"


@query("agg_extract_regex", f"WITH {INPUTS} SELECT pos, regexp_extract(value, '[0-9]+') AS value FROM inp ORDER BY pos LIMIT 100")
def agg_extract_regex(spark, sf_dir):
    return aggregates.extract_regex(inputs(spark, sf_dir), "[0-9]+").select("pos", "value")


@query("agg_unique", f"WITH {INPUTS} SELECT value, min(pos) AS pos FROM inp GROUP BY value ORDER BY pos LIMIT 100")
def agg_unique(spark, sf_dir):
    return aggregates.unique(inputs(spark, sf_dir))


@query("agg_sort", f"WITH {INPUTS} SELECT pos, value FROM inp ORDER BY value DESC, pos LIMIT 100")
def agg_sort(spark, sf_dir):
    return aggregates.sort(inputs(spark, sf_dir), reverse=True)


@query("agg_group_by", f"WITH {INPUTS} SELECT regexp_extract(value, '^([^/]+)', 1) AS key, count(*) AS count, md5(string_agg(value, ',' ORDER BY pos)) AS digest FROM inp GROUP BY 1")
def agg_group_by(spark, sf_dir):
    return aggregates.group_by(inputs(spark, sf_dir)).select("key", "count", F.md5(F.array_join("values", ",")).alias("digest"))


@query("agg_count", f"WITH {INPUTS} SELECT value, count(*) AS count FROM inp GROUP BY value ORDER BY count DESC, min(pos) LIMIT 20")
def agg_count(spark, sf_dir):
    return aggregates.count(inputs(spark, sf_dir), limit=20)


@query("agg_top_k", """WITH i AS (SELECT event_id AS pos, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '{"value":"' || event_type || '","score":' || CAST(event_id % 97 AS VARCHAR) || '}' END AS value, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 97 END AS score, event_type FROM events)
SELECT pos, event_type AS value, CAST(score * 100 AS INTEGER) AS count FROM i ORDER BY score DESC, pos LIMIT 10""")
def agg_top_k(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    made = F.concat(F.lit('{"value":"'), "event_type", F.lit('","score":'), (F.col("event_id") % 97).cast("string"), F.lit("}"))
    return aggregates.top_k(e.select(F.col("event_id").alias("pos"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(made).alias("value")))


@query("agg_join_on", "SELECT string_agg(n_name, ' | ' ORDER BY n_nationkey) AS value FROM nation")
def agg_join_on(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return aggregates.join_on(n.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("value")), " | ")


@query("agg_diff_sets", f"""WITH {INPUTS}, a AS (SELECT DISTINCT value FROM inp WHERE pos < 40), b AS (SELECT DISTINCT value FROM inp WHERE pos BETWEEN 20 AND 60)
SELECT CASE WHEN b.value IS NULL THEN 'only_a' WHEN a.value IS NULL THEN 'only_b' ELSE 'both' END AS key, coalesce(a.value, b.value) AS value FROM a FULL JOIN b ON a.value = b.value""")
def agg_diff_sets(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return aggregates.diff_sets(i, i.where("pos < 40").select("pos"), i.where("pos BETWEEN 20 AND 60").select("pos"))


@query("budget_prefix", """WITH c AS (SELECT doc_id AS chunk_id, lang, length(coalesce(text, '')) // 4 AS tokens FROM documents)
SELECT chunk_id, cum_tokens, cum_tokens <= 20000 AS kept FROM (SELECT chunk_id, CAST(sum(tokens + 1) OVER (PARTITION BY lang ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) + 2 AS BIGINT) AS cum_tokens FROM c)""")
def budget_prefix(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return aggregates.within_budget(c, "tokens", [F.col("chunk_id")], 20000, by="language").select("chunk_id", "cum_tokens", "kept")


@query("pagination", """SELECT event_id, event_type, CAST(base64(CAST('{"offset":60,"limit":20}' AS BLOB)) AS VARCHAR) AS next_cursor FROM events ORDER BY event_id OFFSET 40 LIMIT 20""")
def pagination(spark, sf_dir):
    return aggregates.page(table(spark, sf_dir, "events").select("event_id", "event_type"), [F.col("event_id")], 40, 20)


@query("recent_topk", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def recent_topk(spark, sf_dir):
    return metrics.latest(table(spark, sf_dir, "events"), 5, [F.desc("ts"), F.desc("event_id")], by="user_id").select("user_id", "event_id", "event_type")


@query("ids_by_filter", "SELECT d.doc_id AS chunk_id FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1 AND d.lang IN ('en', 'de')")
def ids_by_filter(spark, sf_dir):
    return chunks(spark, sf_dir).join(flags(spark, sf_dir), "chunk_id").where("is_contract AND language IN ('en', 'de')").select("chunk_id")


@query("retrieve_by_ids", "SELECT i.pos, d.doc_id AS chunk_id FROM (SELECT unnest([7, 3, 99999999, 12, 5]) AS id, unnest([0, 1, 2, 3, 4]) AS pos) i JOIN documents d ON d.doc_id = i.id")
def retrieve_by_ids(spark, sf_dir):
    ids = spark.range(1).select(F.posexplode(F.array(*map(F.lit, [7, 3, 99999999, 12, 5]))).alias("pos", "chunk_id"))
    return stores.by_ids(chunks(spark, sf_dir), ids).select("pos", "chunk_id")


@query("store_stats", """SELECT 'chunks' AS metric, CAST(count(*) AS DOUBLE) AS value FROM documents UNION ALL SELECT 'contracts', CAST(count(*) FILTER (WHERE toxic = 1) AS DOUBLE) FROM labels
UNION ALL SELECT 'tokens', CAST(sum(length(coalesce(text, '')) // 4) AS DOUBLE) FROM documents UNION ALL SELECT 'language_' || lang, CAST(count(*) AS DOUBLE) FROM documents GROUP BY lang""")
def store_stats(spark, sf_dir):
    c = chunks(spark, sf_dir)
    one = c.agg(F.count(F.lit(1)).alias("chunks"), F.sum("tokens").alias("tokens"))
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in ("chunks", "tokens")])).alias("x")).select("x.*")
    contracts = flags(spark, sf_dir).agg(F.count_if("is_contract").cast("double").alias("value")).select(F.lit("contracts").alias("metric"), "value")
    langs = c.groupBy("language").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.concat(F.lit("language_"), "language").alias("metric"), "value")
    return rows.unionByName(contracts).unionByName(langs)


@query("candidate_union", f"WITH {BM25} SELECT chunk_id FROM hits UNION SELECT doc_id FROM labels WHERE toxic = 1")
def candidate_union(spark, sf_dir):
    return hits(spark, sf_dir).select("chunk_id").union(flags(spark, sf_dir).where("is_contract").select("chunk_id")).distinct()


@query("dedup_first", "SELECT text, min(doc_id) AS chunk_id FROM documents GROUP BY text")
def dedup_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("text").agg(F.min("doc_id").alias("chunk_id"))


@query("added_removed", "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'added' ELSE 'removed' END AS change FROM documents WHERE (doc_id % 3 = 0) <> (doc_id % 2 = 0)")
def added_removed(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return packing.changed(c.where("chunk_id % 3 = 0"), c.where("chunk_id % 2 = 0"))


@query("staleness_report", """WITH a AS (SELECT doc_id AS path, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id AS path, md5(CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'stale' ELSE 'fresh' END AS status FROM a FULL JOIN b ON a.path = b.path""")
def staleness_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    old = d.where("path % 5 <> 0").select("path", F.md5("text").alias("hash"))
    new = d.where("path % 11 <> 0").select("path", F.md5(F.when(F.col("path") % 7 == 0, "changed").otherwise(F.col("text"))).alias("hash"))
    return files.staleness(old, new)


# ---- statistics -------------------------------------------------------------

USER_STATS = """p0 AS (SELECT user_id, CAST(value AS DOUBLE) / 50 AS score FROM events),
p1 AS (SELECT user_id, score, exp(score - max(score) OVER (PARTITION BY user_id)) AS e, row_number() OVER (PARTITION BY user_id ORDER BY score DESC) AS rn FROM p0),
p2 AS (SELECT *, e / sum(e) OVER (PARTITION BY user_id) AS p FROM p1),
st AS (SELECT user_id, count(*) AS n, sum(CASE WHEN p > 1e-10 THEN -p * ln(p) ELSE 0e0 END) AS h, max(CASE WHEN rn = 1 THEN score END) AS s1, max(CASE WHEN rn = 2 THEN score END) AS s2, sum(CASE WHEN rn <= 3 THEN p ELSE 0e0 END) AS mass FROM p2 GROUP BY user_id),
su AS (SELECT *, CASE WHEN n > 1 THEN h / ln(n) ELSE 0e0 END AS norm, CASE WHEN n < 2 THEN 1e0 WHEN s1 = 0 THEN 0e0 ELSE (s1 - s2) / s1 END AS gap FROM st)"""


@query("softmax_statistics", f"""WITH {USER_STATS} SELECT user_id, n, round(h, 6) AS entropy, round(norm, 6) AS norm_entropy, round(1 - norm, 6) AS confidence, round(gap, 6) AS score_gap, round(mass, 6) AS concentration,
  round(0.4 * norm + 0.3 * (1 - gap) + 0.3 * (1 - mass), 6) AS difficulty FROM su""")
def softmax_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("value").cast("double") / 50).alias("score"))
    return statistics.score_statistics(e, "user_id")


@query("rlm_trigger", f"WITH {USER_STATS} SELECT user_id, n >= 3 AND round(norm, 6) > 0.9 AS trigger FROM su")
def rlm_trigger(spark, sf_dir):
    return statistics.triggers(softmax_statistics(spark, sf_dir), 0.9).select("user_id", "trigger")


@query("kl_divergence", """WITH n AS (SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS pos, ln(count(*)) AS s FROM events GROUP BY ALL),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY event_type)) AS e FROM n), p AS (SELECT event_type, pos, e / sum(e) OVER (PARTITION BY event_type) AS p FROM e)
SELECT a.event_type AS a, b.event_type AS b, round(sum(-b.p * ln(a.p)), 6) AS cross_entropy, round(sum(a.p * ln(a.p / b.p)), 6) AS kl FROM p a JOIN p b ON a.pos = b.pos AND a.event_type <> b.event_type GROUP BY ALL""")
def kl_divergence(spark, sf_dir):
    """The distributions of all events' values, in bins of ten, by type."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.col("value") / 10).cast("long").alias("pos")).agg(F.ln(F.count(F.lit(1))).alias("score"))
    return statistics.divergence(e, "event_type", "pos", "score")


HIT_STATS = f"""{BM25},
h1 AS (SELECT query_id, score, exp(score - max(score) OVER (PARTITION BY query_id)) AS e, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS rn FROM hits),
h2 AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS p FROM h1),
h3 AS (SELECT query_id, count(*) AS n, sum(CASE WHEN p > 1e-10 THEN -p * ln(p) ELSE 0e0 END) AS h, max(CASE WHEN rn = 1 THEN score END) AS s1, max(CASE WHEN rn = 2 THEN score END) AS s2 FROM h2 GROUP BY query_id),
hs AS (SELECT query_id, round(CASE WHEN n > 1 THEN h / ln(n) ELSE 0e0 END, 6) AS norm, round(CASE WHEN n < 2 THEN 1e0 WHEN s1 = 0 THEN 0e0 ELSE (s1 - s2) / s1 END, 6) AS gap FROM h3)"""
COMPLEXITY = """cx AS (SELECT query_id, least(1e0, CASE WHEN n > 10 THEN 0.3 WHEN n > 5 THEN 0.1 ELSE 0.0 END + CASE WHEN asks THEN 0.2 ELSE 0.0 END + CASE WHEN contains(low, ' and ') OR contains(low, ',') THEN 0.2 ELSE 0.0 END
  + CASE WHEN regexp_matches(low, 'implement|architecture|design|pattern|refactor|optimize|debug|trace|flow') THEN 0.2 ELSE 0.0 END + CASE WHEN contains(low, ' not ') OR contains(low, 'without') THEN 0.1 ELSE 0.0 END) AS complexity
  FROM (SELECT query_id, lower(text) AS low, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS n,
    list_has_any(regexp_split_to_array(lower(text), '\\s+'), ['how', 'why', 'what', 'when', 'where', 'which', 'explain']) AS asks FROM asked))"""


@query("mode_gate", f"""WITH {HIT_STATS}, {ASKED}, {COMPLEXITY}, dn AS (SELECT query_id, avg(CASE WHEN toxic = 1 THEN 1e0 ELSE 0e0 END) AS d FROM hits LEFT JOIN labels ON doc_id = chunk_id GROUP BY query_id),
g AS (SELECT query_id, round(0.4 * norm + 0.2 * (1 - gap) + 0.2 * complexity + 0.2 * (1 - d), 6) AS rlm_score FROM hs JOIN cx USING (query_id) JOIN dn USING (query_id))
SELECT query_id, rlm_score, CASE WHEN rlm_score > 0.5 THEN 'rlm' ELSE 'pack' END AS mode FROM g""")
def mode_gate(spark, sf_dir):
    h = hits(spark, sf_dir)
    stats = statistics.score_statistics(h, "query_id")
    contract = h.join(flags(spark, sf_dir), "chunk_id", "left").withColumn("c", F.coalesce(F.col("is_contract"), F.lit(False)).cast("double"))
    density = contract.groupBy("query_id").agg(F.avg("c").alias("contract_density"))
    return statistics.mode_gate(stats, asked(spark, sf_dir), density).select("query_id", "rlm_score", "mode")


@query("prompt_gate", """WITH p AS (SELECT item_id AS query_id, lower(text) AS low, (item_id % 10) / 10.0 AS entropy, length(text) // 4 AS tokens FROM benchmark),
r AS (SELECT query_id, list_filter([CASE WHEN entropy > 0.7 THEN 'HIGH_ENTROPY' END, CASE WHEN tokens > 500 THEN 'COMPLEX_PROMPT' END, CASE WHEN regexp_matches(low, 'all|every|across|throughout|comprehensive|trace|follow|dependency|impact|analyze') THEN 'MULTI_STEP_KEYWORDS' END], lambda x: x IS NOT NULL) AS r FROM p)
SELECT query_id, array_to_string(r, ',') AS reasons, len(r) >= 2 AS use_rlm FROM r""")
def prompt_gate(spark, sf_dir):
    return statistics.prompt_gate(questions(spark, sf_dir).withColumn("entropy", F.pmod("query_id", F.lit(10)) / 10.0))


@query("adaptive_gate", """WITH RECURSIVE e AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, CASE WHEN event_id % 2 = 0 THEN 'pack' ELSE 'rlm' END AS mode,
  CASE WHEN event_id % 3 = 0 THEN 'rlm' WHEN event_id % 3 = 1 THEN 'pack' END AS override, (event_id % 10) / 10e0 AS entropy FROM events),
f AS (SELECT session, 0 AS seq, 2.5e0 AS t FROM (SELECT DISTINCT session FROM e) UNION ALL
  SELECT f.session, f.seq + 1, CASE WHEN override IS NULL THEN t ELSE greatest(0.3, least(0.8, CASE WHEN override <> mode THEN t + 0.1 * (entropy - t) ELSE t END)) END FROM f JOIN e ON e.session = f.session AND e.seq = f.seq + 1)
SELECT session, round(t, 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS n FROM f) WHERE n = 1""")
def adaptive_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("user_id").alias("session"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("seq"), F.when(F.col("event_id") % 2 == 0, "pack").otherwise("rlm").alias("mode"),
        F.when(F.col("event_id") % 3 == 0, "rlm").when(F.col("event_id") % 3 == 1, "pack").alias("override"), (F.col("event_id") % 10 / 10.0).alias("entropy"),
    )
    return statistics.adaptive_threshold(rows)


@query("pack_confidence", f"""WITH {BM25}, s AS (SELECT query_id, avg(norm_score) FILTER (WHERE rank <= 5) AS m, count(*) AS n FROM hits GROUP BY query_id),
c AS (SELECT query_id, round(least(0.5 * m + 0.3 * (1 - 2.0 / 5) + 0.2 * least(n * 300 / 4000e0, 1), 1), 3) AS confidence FROM s)
SELECT query_id, confidence, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM c""")
def pack_confidence(spark, sf_dir):
    h = hits(spark, sf_dir).groupBy("query_id").agg(F.reverse(F.array_sort(F.collect_list("norm_score"))).alias("scores"), (F.count(F.lit(1)) * 300).alias("used"))
    return statistics.pack_confidence(h.withColumn("entropy", F.lit(2.0)).withColumn("budget", F.lit(4000)))


@query("entropy_calibration", """WITH s AS (SELECT CAST(value AS DOUBLE) / 100 AS entropy, event_type IN ('click', 'view') OR event_id % 3 = 0 AS easy FROM events),
g AS (SELECT count(*) AS n, quantile_cont(entropy, 0.75) FILTER (WHERE easy) AS p, avg(entropy) FILTER (WHERE easy) AS em, stddev_pop(entropy) FILTER (WHERE easy) AS es, avg(entropy) FILTER (WHERE NOT easy) AS hm, stddev_pop(entropy) FILTER (WHERE NOT easy) AS hs FROM s),
d AS (SELECT *, (hm - em) / greatest(sqrt((es * es + hs * hs) / 2), 0.001) AS sep FROM g)
SELECT n AS num_samples, round(p, 6) AS threshold, round(em, 6) AS easy_mean, round(hm, 6) AS hard_mean, round(sep, 6) AS separation, round(least(0.95, n / 100 * (1 + sep / 2)), 6) AS confidence FROM d""")
def entropy_calibration(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return statistics.calibrated(e.select((F.col("value").cast("double") / 100).alias("entropy"), (F.col("event_type").isin("click", "view") | (F.col("event_id") % 3 == 0)).alias("easy")))


@query("char_entropy", """WITH c AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), '')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS n FROM c WHERE c <> '' GROUP BY ALL),
h AS (SELECT doc_id, least(1e0, (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / 7) AS h FROM n GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(h, 0e0), 6) AS entropy FROM documents d LEFT JOIN h USING (doc_id)""")
def char_entropy(spark, sf_dir):
    return statistics.char_entropy(table(spark, sf_dir, "documents"), "doc_id", "text")


# ---- packing ----------------------------------------------------------------


def pack_items(spark, sf_dir: str, digits: int = 9) -> DataFrame:
    c = candidates(spark, sf_dir)
    items = c.select("query_id", "chunk_id", F.col("bm25_score").alias("score"), "tokens", "file_path", (F.col("contract_score") == 1).alias("is_contract"), (F.col("pinned_score") == 1).alias("is_pinned"))
    return packing.with_utility(items, digits=digits)


UTILITY = f"""{CANDIDATES}, ut AS (SELECT query_id, chunk_id, bm25_score AS score, tokens, file_path,
  round(0.6 * bm25_score / max(bm25_score) OVER (PARTITION BY query_id) + CASE WHEN contract_score = 1 THEN 0.2 ELSE 0.0 END + CASE WHEN pinned_score = 1 THEN 0.2 ELSE 0.0 END, 6) AS utility FROM cand)"""


@query("pack_utility", f"WITH {UTILITY} SELECT query_id, chunk_id, utility FROM ut")
def pack_utility(spark, sf_dir):
    return pack_items(spark, sf_dir, digits=6).select("query_id", "chunk_id", "utility")


@query("greedy_pack", f"WITH {UTILITY}, g AS (SELECT query_id, chunk_id, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_tokens FROM ut) SELECT * FROM g WHERE cum_tokens <= 4000")
def greedy_pack(spark, sf_dir):
    return packing.greedy(pack_items(spark, sf_dir), 4000).select("query_id", "chunk_id", "cum_tokens")


@query("pack_estimate", f"WITH {UTILITY} SELECT query_id, CAST(100 + sum(tokens) + 20 * count(*) AS BIGINT) AS pack_tokens FROM ut GROUP BY query_id")
def pack_estimate(spark, sf_dir):
    return packing.estimate(pack_items(spark, sf_dir))


@query("citations", f"WITH {UTILITY} SELECT query_id, chunk_id, '[' || row_number() OVER (PARTITION BY query_id ORDER BY file_path, 1, chunk_id) || ']' AS mark, file_path || ':1' AS source FROM ut")
def citations(spark, sf_dir):
    return packing.citations(pack_items(spark, sf_dir).withColumn("start_line", F.lit(1)).withColumn("symbol_name", F.lit(None).cast("string")))


@query("knapsack_pack")
def knapsack_pack(spark, sf_dir):
    return packing.knapsack(pack_items(spark, sf_dir), 4000)


@query("incremental_pack")
def incremental_pack(spark, sf_dir):
    return packing.incremental(pack_items(spark, sf_dir), "chunk_id", 2000)


@query("dac_pack")
def dac_pack(spark, sf_dir):
    items = cut(pack_items(spark, sf_dir))  # asked for by costs, bundles and neighbours
    chosen = items.select("chunk_id", "file_path").distinct()
    near = neighbours(chosen, 40)
    return packing.with_dependencies(items, near, 4000)


def neighbours(chosen: DataFrame, reach: int) -> DataFrame:
    """``chunk_id`` and the smaller ids of its file at most ``reach`` away
    (``needs``). Ids meet by bins of that width: only their neighbours' rows do."""
    place = F.floor(F.col("chunk_id") / reach)
    a = chosen.select("chunk_id", "file_path", F.explode(F.array(place - 1, place)).alias("bin"))
    b = chosen.select(F.col("chunk_id").alias("needs"), "file_path", place.alias("bin"))
    return a.join(b, ["file_path", "bin"]).where(F.col("chunk_id") - F.col("needs") <= reach).where("chunk_id > needs").select("chunk_id", "needs")


@query(
    "pack_markdown",
    f"""WITH {UTILITY}, r AS (SELECT u.query_id, u.chunk_id, u.file_path, d.text AS content, string_split(d.text, chr(10)) AS lines, CASE WHEN contract_score = 1 THEN 'contract' END AS c, CASE WHEN pinned_score = 1 THEN 'pinned' END AS p,
  row_number() OVER (PARTITION BY u.query_id ORDER BY u.file_path, u.chunk_id) AS n FROM ut u JOIN cand USING (query_id, chunk_id) JOIN documents d ON d.doc_id = u.chunk_id WHERE d.text IS NOT NULL),
m AS (SELECT query_id, file_path, n, concat_ws(' ', '[' || n || ']', 'L1-' || len(lines), CASE WHEN coalesce(c, p) IS NOT NULL THEN '[' || concat_ws(', ', c, p) || ']' END) || chr(10) || chr(10) || '```' || chr(10) || array_to_string(lines[1:100], chr(10)) || chr(10) || '```' || chr(10) AS part FROM r),
f AS (SELECT query_id, file_path, min(n) AS first, '## ' || file_path || chr(10) || chr(10) || string_agg(part, chr(10) ORDER BY n) AS text FROM m GROUP BY query_id, file_path)
SELECT query_id, md5(string_agg(text, chr(10) ORDER BY first)) AS digest FROM f GROUP BY query_id""",
)
def pack_markdown(spark, sf_dir):
    # lines are counted and cut once a chunk, not once for each pack that it is in
    lines = F.split("content", "\n")
    c = chunks(spark, sf_dir).where("content is not null").select("chunk_id", F.size(lines).alias("end_line"), F.array_join(F.slice(lines, 1, 100), "\n").alias("content"))
    full = pack_items(spark, sf_dir).join(c, "chunk_id")
    packs = packing.markdown(full.withColumn("start_line", F.lit(1)).withColumn("symbol_name", F.lit(None).cast("string")), most_lines=None)
    return packs.select("query_id", F.md5("pack_markdown").alias("digest"))


# ---- telemetry, feedback, quality --------------------------------------------


@query("telemetry_summary", "SELECT event_type AS name, count(value) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS greatest, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def telemetry_summary(spark, sf_dir):
    return metrics.summary(table(spark, sf_dir, "events").withColumnRenamed("event_type", "name"), ["name"])


@query("telemetry_daily", "SELECT event_type AS name, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(value) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS greatest, round(stddev_pop(value), 6) AS std FROM events GROUP BY ALL")
def telemetry_daily(spark, sf_dir):
    return metrics.daily(table(spark, sf_dir, "events").withColumnRenamed("event_type", "name"))


@query("metric_query", "SELECT event_id, event_type, value FROM events WHERE event_type = 'click' AND value > 10 ORDER BY ts DESC, event_id LIMIT 100")
def metric_query(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'click' AND value > 10")
    return metrics.latest(e, 100, [F.desc("ts"), F.asc("event_id")]).select("event_id", "event_type", "value")


@query("feedback_outcomes", """WITH n AS (SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 - epoch_us(ts) / 1e6 AS gap, epoch_us(TIMESTAMP '2030-01-01') / 1e6 - epoch_us(ts) / 1e6 AS age FROM events)
SELECT event_id, CASE WHEN gap IS NULL AND age > 300 THEN 'success' WHEN gap IS NULL THEN 'unknown' WHEN gap < 30 THEN 'failure' WHEN gap < 300 THEN 'unknown' ELSE 'success' END AS outcome FROM n""")
def feedback_outcomes(spark, sf_dir):
    return metrics.outcomes(table(spark, sf_dir, "events"), F.lit("2030-01-01").cast("timestamp"), session="user_id").select("event_id", "outcome")


def retrieval_events(spark, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir).join(flags(spark, sf_dir), "chunk_id", "left").withColumn("s", F.coalesce(F.col("selected"), F.lit(False)))
    g = h.groupBy("query_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("retrieved"), F.array_sort(F.collect_list(F.when(F.col("s"), F.col("chunk_id")))).alias("selected"))
    return g.select(F.col("query_id").alias("event_id"), "retrieved", "selected", F.when(F.col("query_id") % 3 == 0, "failure").otherwise("success").alias("outcome"))


@query("contrastive_pairs", f"""WITH {BM25}, h AS (SELECT query_id, chunk_id, coalesce(quality, 0) = 1 AS s FROM hits LEFT JOIN labels ON doc_id = chunk_id),
u AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS n FROM h WHERE NOT s) WHERE n <= 3)
SELECT p.query_id AS event_id, CASE WHEN p.query_id % 3 = 0 THEN u.chunk_id ELSE p.chunk_id END AS positive, CASE WHEN p.query_id % 3 = 0 THEN p.chunk_id ELSE u.chunk_id END AS negative FROM h p JOIN u ON u.query_id = p.query_id WHERE p.s""")
def contrastive_pairs(spark, sf_dir):
    return metrics.contrastive_pairs(retrieval_events(spark, sf_dir))


@query("sgd_update")
def sgd_update(spark, sf_dir):
    p = metrics.contrastive_pairs(retrieval_events(spark, sf_dir))
    feature = lambda c: F.array(F.concat(F.lit("kind_"), (F.col(c) % 5).cast("string")))
    seq = F.row_number().over(W.partitionBy("model").orderBy("event_id", "positive", "negative"))
    rows = p.withColumn("model", F.col("event_id") % 4).withColumn("seq", seq)
    return metrics.learned_weights(rows.select("model", "seq", feature("positive").alias("positive"), feature("negative").alias("negative")))


@query("ewr", f"""WITH {CANDIDATES} SELECT c.query_id, CAST(sum(tokens) AS BIGINT) AS explored, CAST(sum(CASE WHEN coalesce(quality, 0) = 1 THEN tokens ELSE 0 END) AS BIGINT) AS used, count(*) AS chunks,
  round(CASE WHEN sum(tokens) > 0 THEN (sum(tokens) - sum(CASE WHEN coalesce(quality, 0) = 1 THEN tokens ELSE 0 END)) / sum(tokens) ELSE 0 END, 6) AS ewr FROM cand c LEFT JOIN labels l ON l.doc_id = c.chunk_id GROUP BY c.query_id""")
def ewr(spark, sf_dir):
    c = candidates(spark, sf_dir).select("query_id", "chunk_id", "tokens").join(flags(spark, sf_dir), "chunk_id", "left")
    return metrics.exploration_waste(c.withColumn("selected", F.coalesce(F.col("selected"), F.lit(False))), ["query_id"])


TRUTH = "truth AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def truth(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage whole. Two of a passage's words
    are its key; pairs of a document's words meet the keys, broadcast once
    counted, and the passages so found are looked for in the text."""
    q = questions(spark, sf_dir)
    pair = lambda a, b: F.concat_ws(" ", a, b)
    asked = q.select("query_id", T.terms(F.col("text")).alias("w")).select("query_id", pair(F.get("w", F.lit(1)), F.get("w", F.lit(2))).alias("key"))
    c = spread(chunks(spark, sf_dir).select("chunk_id", "content"), "chunk_id")
    words = c.select("chunk_id", F.coalesce(T.terms(F.col("content")), F.array().cast("array<string>")).alias("w"))
    pairs = words.select("chunk_id", F.explode(F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), pair)).alias("key"))
    near = pairs.join(small(asked), "key").select("query_id", "chunk_id").distinct()
    both = c.join(near, "chunk_id").join(small(q), "query_id")
    return both.where(F.contains("content", F.col("text"))).select("query_id", "chunk_id")


@query("planted_truth", f"WITH {TRUTH} SELECT query_id, chunk_id FROM truth")
def planted_truth(spark, sf_dir):
    return truth(spark, sf_dir)


@query("imr", f"""WITH {BM25}, {TRUTH}, j AS (SELECT coalesce(h.query_id, t.query_id) AS query_id, h.chunk_id AS r, t.chunk_id AS i FROM hits h FULL JOIN truth t ON h.query_id = t.query_id AND h.chunk_id = t.chunk_id),
g AS (SELECT query_id, count(r) AS retrieved, count(i) AS impactful, count(*) FILTER (WHERE r IS NOT NULL AND i IS NOT NULL) AS hit FROM j GROUP BY query_id),
m AS (SELECT *, CASE WHEN impactful > 0 THEN (impactful - hit) / impactful ELSE 0e0 END AS miss, CASE WHEN retrieved > 0 THEN hit / retrieved ELSE 0e0 END AS p FROM g)
SELECT query_id, retrieved, impactful, hit, round(miss, 6) AS imr, round(p, 6) AS precision, round(1 - miss, 6) AS recall, round(CASE WHEN p + 1 - miss > 0 THEN 2 * p * (1 - miss) / (p + 1 - miss) ELSE 0e0 END, 6) AS f1 FROM m""")
def imr(spark, sf_dir):
    return metrics.impact_miss(hits(spark, sf_dir), truth(spark, sf_dir))


@query("ranking_quality", f"""WITH {BM25}, {TRUTH}, n AS (SELECT query_id, count(*) AS n FROM truth GROUP BY query_id),
h AS (SELECT query_id, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg, count(*) AS hits FROM hits JOIN truth USING (query_id, chunk_id) GROUP BY query_id)
SELECT query_id, round(coalesce(1 / first, 0e0), 6) AS mrr, round(coalesce(dcg, 0e0) / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg, round(coalesce(hits / n, 0e0), 6) AS recall, round(coalesce(hits / 10, 0e0), 6) AS precision FROM n LEFT JOIN h USING (query_id)""")
def ranking_quality(spark, sf_dir):
    return metrics.ranking_quality(hits(spark, sf_dir), truth(spark, sf_dir))


@query("impact_heuristic", f"""WITH {CANDIDATES}, s AS (SELECT *, bm25_score / max(bm25_score) OVER (PARTITION BY query_id) AS n FROM cand)
SELECT query_id, chunk_id FROM s WHERE n >= 0.7 OR (contract_score = 1 AND n + 0.3 >= 0.7) OR (pinned_score = 1 AND n + 0.4 >= 0.7)""")
def impact_heuristic(spark, sf_dir):
    return metrics.likely_impactful(pack_items(spark, sf_dir)).select("query_id", "chunk_id")


@query("budget_tracker", """WITH e AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, CAST(floor(value) AS BIGINT) AS tokens, (event_id % 20) / 20e0 AS entropy, event_id % 5 AS new_chunks FROM events),
w AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY session ORDER BY seq) AS BIGINT) AS tokens_used, lag(new_chunks) OVER (PARTITION BY session ORDER BY seq) AS before FROM e)
SELECT session, seq, tokens_used, CASE WHEN seq >= 40 THEN 'max_iterations' WHEN tokens_used >= 1500 THEN 'token_budget' WHEN entropy < 0.3 THEN 'low_entropy' WHEN new_chunks < 2 AND before < 2 THEN 'no_new_results' END AS stop_reason FROM w""")
def budget_tracker(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long")
    rows = e.select(F.col("user_id").alias("session"), seq.alias("seq"), F.floor("value").cast("long").alias("tokens"), (F.col("event_id") % 20 / 20.0).alias("entropy"), (F.col("event_id") % 5).alias("new_chunks"))
    return metrics.budget_states(rows, 40, 1500).select("session", "seq", "tokens_used", "stop_reason")


# ---- sessions and streams -----------------------------------------------------


@query("session_gaps", """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
u AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS unit FROM g)
SELECT user_id, unit, CAST(min(ts) AS VARCHAR) AS start, CAST(max(ts) AS VARCHAR) AS "end", count(*) AS n FROM u GROUP BY user_id, unit""")
def session_gaps(spark, sf_dir):
    u = jobs.work_units(table(spark, sf_dir, "events"))
    return u.select("user_id", "unit", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "n")


@query("debounce_sessions", """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
u AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS unit FROM g)
SELECT user_id, CAST(min(ts) AS VARCHAR) AS start, count(*) AS n FROM u GROUP BY user_id, unit""")
def debounce_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("op"))
    return jobs.debounced(e, "600 seconds", by="user_id").select("user_id", F.col("start").cast("string").alias("start"), "n")


@query("session_state", """SELECT conv_id AS session_id, count(*) AS queries, md5(string_agg(text, '|' ORDER BY turn)) AS digest, arg_max(role, turn) AS focus FROM conversations GROUP BY conv_id""")
def session_state(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    s = jobs.sessions(c.select(F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("query"), F.array("role").alias("chunks"), F.col("role").alias("focus")))
    return s.select("session_id", F.size("queries").cast("long").alias("queries"), F.md5(F.array_join("queries", "|")).alias("digest"), "focus")


STREAM = "SELECT event_type AS name, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(value) AS n, round(sum(value), 6) AS total, round(min(value), 6) AS least, round(max(value), 6) AS greatest FROM events GROUP BY ALL"


@query("stream_rollup", STREAM)
def stream_rollup(spark, sf_dir):
    import uuid

    path = f"{sf_dir}/events.parquet"
    # a stream reads folders: the table's own file is picked by name
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    rows = stream.select(F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("ts"), "value")
    out = jobs.collected(jobs.rolled_up(rows), "rollup_" + uuid.uuid4().hex)
    return out.select("name", F.to_date("start").cast("string").alias("day"), "n", F.round("total", 6).alias("total"), F.round("least", 6).alias("least"), F.round("greatest", 6).alias("greatest"))


def _is_folder(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


# ---- text rules ---------------------------------------------------------------


def coded(spark, sf_dir: str) -> DataFrame:
    """Documents with a line of code in front, by their id."""
    d = table(spark, sf_dir, "documents")
    heads = ["class A{i}(ABC):\n", "class P{i}(Protocol, object):\n", "@dataclass\n", "typedef\n", "", "an interface of ", "class S{i}(BaseModel):\n"]
    head = F.element_at(F.array(*map(F.lit, heads)), (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))
    return d.select(F.col("doc_id").alias("chunk_id"), F.concat(F.replace(head, F.lit("{i}"), F.col("doc_id").cast("string")), F.col("text")).alias("content"))


CODED = "coded AS (SELECT doc_id AS chunk_id, replace((['class A{i}(ABC):' || chr(10), 'class P{i}(Protocol, object):' || chr(10), '@dataclass' || chr(10), 'typedef' || chr(10), '', 'an interface of ', 'class S{i}(BaseModel):' || chr(10)])[doc_id % 7 + 1], '{i}', CAST(doc_id AS VARCHAR)) || text AS content FROM documents)"


@query("contract_detect", f"""WITH {CODED} SELECT chunk_id, CASE WHEN regexp_matches(content, 'class\\s+\\w+\\s*\\([^)]*ABC[^)]*\\)|@abstractmethod|from\\s+abc\\s+import') THEN 'abstract_class'
  WHEN regexp_matches(content, 'class\\s+\\w+\\s*\\([^)]*Protocol[^)]*\\)|typing\\.Protocol|typing_extensions\\.Protocol') THEN 'protocol' WHEN regexp_matches(content, '@dataclass|@dataclasses\\.dataclass') THEN 'dataclass'
  WHEN regexp_matches(content, 'class\\s+\\w+\\s*\\([^)]*(BaseModel|Schema)[^)]*\\)|@schema') THEN 'schema'
  WHEN regexp_matches(lower(content), 'interface|abstract|protocol|trait|contract|schema|typedef|@api|@public|@export') THEN 'unknown' END AS contract_type FROM coded""")
def contract_detect(spark, sf_dir):
    found = T.contract_matches(F.col("content"), F.lit("python"))
    return coded(spark, sf_dir).select("chunk_id", F.when(F.size(found) > 0, F.get(found, F.lit(0))["contract_type"]).alias("contract_type"))


@query("contract_deps", f"""WITH {CODED}, m AS (SELECT chunk_id, regexp_extract_all(content, 'class\\s+\\w+\\s*\\(([^)]+)\\)', 1) AS m FROM coded)
SELECT chunk_id, array_to_string(list_filter(list_transform(string_split(array_to_string(m, ','), ','), lambda x: trim(x)), lambda x: x <> '' AND x <> 'object'), ',') AS deps FROM m""")
def contract_deps(spark, sf_dir):
    return coded(spark, sf_dir).select("chunk_id", F.array_join(T.contract_dependencies(F.col("content"), F.lit("python")), ",").alias("deps"))


HEADS = ["DECISION: use {w}", "- [ ] write {w}\n- [x] done", "TODO: check {w}\nQUESTION: why {w}", "", "Ledger:\n- Decisions: [take {w}, none]\n- Todos: [see {w}]\n- Open questions: [how {w}]\n- Files touched: [a/{w}.py]\n"]


@query("ledger_extract", r"""WITH c AS (SELECT conv_id, turn, turn % 5 AS k, regexp_extract(lower(text), '[a-z]+') AS w, text FROM conversations),
t AS (SELECT conv_id, turn, k, w, replace((['DECISION: use {w}', '- [ ] write {w}' || chr(10) || '- [x] done', 'TODO: check {w}' || chr(10) || 'QUESTION: why {w}', '', ''])[k + 1], '{w}', w) || chr(10) || text || chr(10) || 'TODO: end ' || w AS text FROM c),
l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM t)
SELECT conv_id, turn, 'todo' AS entry_type, trim(regexp_extract(line, '^[-*][ 	]*\[ \][ 	]*(\S.*)$', 1)) AS content, 0.9e0 AS confidence FROM l WHERE regexp_matches(line, '^[-*][ 	]*\[ \][ 	]*\S')
UNION ALL SELECT conv_id, turn, lower(regexp_extract(line, '^(DECISION|TODO|QUESTION):', 1)), trim(regexp_extract(line, '^[A-Z]+:[ 	]*(\S.*)$', 1)), 0.95e0 FROM l WHERE regexp_matches(line, '^(DECISION|TODO|QUESTION):[ 	]*\S')
UNION ALL SELECT conv_id, turn, v.t, v.c || w || v.d, 1e0 FROM t, (VALUES ('decision', 'take ', ''), ('todo', 'see ', ''), ('question', 'how ', ''), ('file', 'a/', '.py')) v(t, c, d) WHERE k = 4""")
def ledger_extract(spark, sf_dir):
    """Entries in front of, inside and behind the turns' own texts."""
    c = table(spark, sf_dir, "conversations").withColumn("word", F.regexp_extract(F.lower("text"), "[a-z]+", 0))
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.pmod("turn", F.lit(len(HEADS))) + 1).cast("int"))
    text = F.concat_ws("\n", F.replace(head, F.lit("{w}"), F.col("word")), "text", F.concat(F.lit("TODO: end "), "word"))
    found = c.select("conv_id", "turn", F.explode(T.ledger_entries(text)).alias("e"))
    return found.select("conv_id", "turn", "e.entry_type", "e.content", "e.confidence")


@query("page_links", """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages""")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))


@query("node_types", """WITH p AS (SELECT page_id, lower(regexp_replace(url, '^https?://|[?#].*$', '', 'g')) AS path FROM pages), s AS (SELECT page_id, string_split(path, '/') AS s FROM p), n AS (SELECT page_id, s, s[-1] AS name FROM s)
SELECT page_id, CASE WHEN regexp_matches(name, 'test|spec') OR list_has_any(s, ['tests', '__tests__']) THEN 'test' WHEN list_has_any(s, ['components', 'pages', 'views', 'screens']) THEN 'fe_component' WHEN contains(name, 'client') OR list_contains(s, 'api') THEN 'fe_client'
  WHEN list_has_any(s, ['handlers', 'controllers', 'routes']) THEN 'be_handler' WHEN regexp_matches(name, 'contract|interface') OR list_contains(s, 'types') THEN 'contract' WHEN list_has_any(s, ['shared', 'common']) THEN 'shared_type' WHEN regexp_matches(name, 'endpoint|route') THEN 'endpoint' ELSE 'file' END AS node_type FROM n""")
def node_types(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.node_type(F.regexp_replace("url", "^https?://|[?#].*$", "")).alias("node_type"))


@query("project_map_counts", """WITH p AS (SELECT string_split(regexp_replace(url, '^https?://|[?#].*$', '', 'g'), '/') AS s, length(html) AS size FROM pages),
e AS (SELECT s[1:i] AS p, size FROM (SELECT s, size, unnest(range(1, least(len(s), 3) + 1)) AS i FROM p))
SELECT array_to_string(p, '/') AS path, array_to_string(p[1:len(p) - 1], '/') AS parent, CAST(len(p) AS INTEGER) AS depth, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM e GROUP BY ALL""")
def project_map_counts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return files.tree(p.select(F.regexp_replace("url", "^https?://|[?#].*$", "").alias("file_path"), F.length("html").alias("size")))


@query("peek_lines", """WITH l AS (SELECT source AS f, doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS file_path, CAST(n AS INTEGER) AS line, lpad(CAST(n AS VARCHAR), 6, ' ') || '  ' || t AS numbered, false AS truncated FROM l WHERE n BETWEEN 2 AND 4""")
def peek_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return files.lines(d.select(F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content")), 2, 4)


#: Questions with a name in each of its forms.
FORMS = ["DataStore", "load_file", '"big tree"', "src/main.py", "{w}"]
ABOUT = ["how does {} work", "where is {} found", "implementation of {}", "tests for {} defined in spec", "what calls {}", "{}", "where is {} used"]


def named(spark, sf_dir: str) -> DataFrame:
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod("query_id", F.lit(len(xs))) + 1).cast("int"))
    word = F.element_at(T.terms(F.col("text")), 1)
    return questions(spark, sf_dir).select("query_id", F.replace(pick(ABOUT), F.lit("{}"), F.replace(pick(FORMS), F.lit("{w}"), word)).alias("text"))


_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
NAMED = f"""q AS (SELECT item_id AS query_id, item_id % {len(FORMS)} AS form, {_list(FORMS)}[item_id % {len(FORMS)} + 1] AS e, {_list(ABOUT)}[item_id % {len(ABOUT)} + 1] AS about, {TERMS.format('text')}[1] AS w FROM benchmark),
named AS (SELECT query_id, form, replace(about, '{{}}', replace(e, '{{w}}', w)) AS text, CASE WHEN form < 4 THEN replace(e, '"', '') END AS e FROM q)"""


PLAN = f"""{NAMED}, f AS (SELECT query_id AS "of", text, e, CAST(e IS NOT NULL AS INT) AS n, CAST(regexp_matches(lower(text), 'implement|defined') AS INT) AS i, CAST(regexp_matches(lower(text), 'use|using|called|calls|caller') AS INT) AS u,
  CAST(regexp_matches(lower(text), 'test|spec') AS INT) AS t, CAST(starts_with(lower(text), 'how') AS INT) AS h, CAST(starts_with(lower(text), 'where') AS INT) AS w FROM named),
p AS (SELECT *, 10 - n - n * i - n * u - t AS p FROM f),
r AS (SELECT "of", 0 AS step, 'definition of ' || e AS text, 'definition' AS query_type, 10 AS priority FROM p WHERE n = 1 UNION ALL SELECT "of", 1, 'implementation of ' || e, 'implementation', 9 FROM p WHERE n = 1 AND i = 1
  UNION ALL SELECT "of", 2, 'usages of ' || e, 'usage', 9 - i FROM p WHERE n = 1 AND u = 1 UNION ALL SELECT "of", 3, 'tests for ' || text, 'test', 10 - n - n * i - n * u FROM p WHERE t = 1
  UNION ALL SELECT "of", 4, 'interfaces and types related to ' || text, 'contract', p - 5 FROM p UNION ALL SELECT "of", 5, replace(text, 'how', 'implementation'), 'implementation', p FROM p WHERE h = 1 AND i = 0
  UNION ALL SELECT "of", 6, replace(text, 'where', 'files containing'), 'usage', p FROM p WHERE w = 1 AND u = 0 UNION ALL SELECT "of", 7, text, 'related', 1 FROM p),
plan AS (SELECT "of" * 10 + row_number() OVER (PARTITION BY "of" ORDER BY priority DESC, step) - 1 AS query_id, "of", text, query_type, CAST(priority AS INT) AS priority FROM r)"""


@query("subquery_plan", f"WITH {PLAN} SELECT * FROM plan")
def subquery_plan(spark, sf_dir):
    return planner.planned(named(spark, sf_dir))


@query("query_rewrites", f"""WITH {NAMED}, o AS (SELECT query_id, text, lower(text) AS low, CASE WHEN form < 2 THEN e END AS n, trim(trim(regexp_replace(lower(text), '^(?:how|what|where|when)\\s+(?:does|do|is|are)\\s+', ''), '?')) AS k FROM named),
l AS (SELECT query_id, list_concat(CASE WHEN n IS NOT NULL THEN [n || ' implementation', n] ELSE [] END, list_concat(CASE WHEN regexp_matches(low, '^(how|what|where|when)') THEN [k] ELSE [] END, CASE WHEN contains(low, 'test') AND n IS NOT NULL THEN ['test ' || n] ELSE [] END))[1:3] AS l FROM o)
SELECT query_id, array_to_string(l, ' | ') AS rewrites FROM l""")
def query_rewrites(spark, sf_dir):
    return named(spark, sf_dir).select("query_id", F.array_join(correction.rewrites(F.col("text")), " | ").alias("rewrites"))


@query(
    "planned_retrieval",
    f"""WITH {PLAN}, {bm25_sql(20, asks="plan")}, l AS (SELECT p."of" AS query_id, chunk_id, p.query_type AS list, score FROM hits h JOIN plan p ON p.query_id = h.query_id)
SELECT query_id, chunk_id, round(max(score) + CASE WHEN count(*) > 1 THEN 0.2 * log2(count(*)) ELSE 0.0 END + 0.1 * (count(DISTINCT list) - 1), 6) AS score, count(*) AS n_scores FROM l GROUP BY query_id, chunk_id""",
)
def planned_retrieval(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return planner.planned_retrieval(planner.planned(named(spark, sf_dir)), lambda q: bm25(c, q, k=20))


#: Questions that go back to something, one for each pattern, and some that do not.
BACK = ["fix that function we wrote", "the class from before", "what was the {}", "continue with {}", "back to the {}", "as we discussed {}", "remember when {}", "like we mentioned {}", "the thing we were working on", "earlier we saw {}", "the same {}", "{}", "where is {}"]


@query("continuations", f"""WITH b AS (SELECT item_id AS query_id, replace({_list(BACK)}[item_id % {len(BACK)} + 1], '{{}}', lower(text)) AS text FROM benchmark)
SELECT query_id, regexp_matches(text, '{"|".join(T.CONTINUATIONS)}') AS hit FROM b""")
def continuations(spark, sf_dir):
    shape = F.element_at(F.array(*map(F.lit, BACK)), (F.pmod("query_id", F.lit(len(BACK))) + 1).cast("int"))
    return questions(spark, sf_dir).select("query_id", T.is_continuation(F.replace(shape, F.lit("{}"), F.lower("text"))).alias("hit"))
