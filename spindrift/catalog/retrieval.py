"""Queries: lexical and vector retrieval, ranking, fusion, intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import embedding, lexical, ranking, vectors
from ..plans import correction, hybrid, intent
from .base import BM25, TERMS, bm25_sql, chunks, flags, query, questions, table


def hits(spark, sf_dir: str, k: int = 10) -> DataFrame:
    return lexical.bm25(chunks(spark, sf_dir), questions(spark, sf_dir), k=k)


@query("bm25_topk", f"WITH {BM25} SELECT query_id, chunk_id, round(score, 6) AS score, round(norm_score, 6) AS norm_score, rank FROM hits")
def bm25_topk(spark, sf_dir):
    return hits(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.round("norm_score", 6).alias("norm_score"), "rank")


@query(
    "bm25_all_terms",
    f"""WITH {BM25}, want AS (SELECT query_id, count(*) AS wanted FROM ask GROUP BY query_id),
r AS (SELECT s.query_id, chunk_id, score, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, chunk_id) AS rank FROM scored s JOIN want w ON s.query_id = w.query_id AND matched = wanted)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
)
def bm25_all_terms(spark, sf_dir):
    found = lexical.bm25(chunks(spark, sf_dir), questions(spark, sf_dir), k=10, match="all")
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("corpus_stats", f"SELECT count(*) AS n_docs, round(avg(len({TERMS.format('text')})), 6) AS avgdl FROM documents")
def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(chunks(spark, sf_dir)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("term_df", f"WITH {BM25} SELECT term, df, round(greatest(1e-6, ln((n_docs - df + 0.5) / (df + 0.5))), 6) AS idf FROM dfs, stat")
def term_df(spark, sf_dir):
    return lexical.corpus_frequencies(chunks(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_stemmed")
def bm25_stemmed(spark, sf_dir):
    """No stemmer in SQL here: the tests compare with stemmed texts."""
    found = lexical.bm25(chunks(spark, sf_dir), questions(spark, sf_dir), k=10, stem=True)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(
    "snippet_window",
    f"""WITH {BM25}, b AS (SELECT h.query_id, h.chunk_id, t.words, list_distinct({TERMS.format('q.text')}) AS wanted FROM hits h JOIN tok t USING (chunk_id) JOIN benchmark q ON q.item_id = h.query_id),
s AS (SELECT query_id, chunk_id, words, wanted, unnest(range(1, len(words) + 1)) AS p FROM b),
n AS (SELECT query_id, chunk_id, p, len(list_intersect(words[p:p + 31], wanted)) AS n FROM s WHERE list_contains(wanted, words[p])),
f AS (SELECT query_id, chunk_id, arg_min(p, struct_pack(a := -n, b := p)) AS p FROM n GROUP BY query_id, chunk_id)
SELECT query_id, chunk_id, array_to_string(list_transform(words[coalesce(p, 1):coalesce(p, 1) + 31], lambda w: CASE WHEN list_contains(wanted, w) THEN '<b>' || w || '</b>' ELSE w END), ' ') AS snippet FROM b LEFT JOIN f USING (query_id, chunk_id)""",
)
def snippet_window(spark, sf_dir):
    return lexical.snippets(chunks(spark, sf_dir), questions(spark, sf_dir), hits(spark, sf_dir))


#: Questions with the characters that full-text search takes for operators.
OPERATORS = ["*{}:", 'a:b* "{}"', "({} & x) | y?", "  {}  ::", "{}"]


@query(
    "query_sanitised",
    f"""WITH q AS (SELECT item_id AS query_id, replace(([{', '.join(repr(x) for x in OPERATORS)}])[item_id % {len(OPERATORS)} + 1], '{{}}', text) AS text FROM benchmark)
SELECT query_id, trim(regexp_replace(regexp_replace(replace(translate(text, '?()&|', '     '), '"', '""'), '^[*:]+|[*:]+$', '', 'g'), '\\s+', ' ', 'g')) AS clean FROM q""",
)
def query_sanitised(spark, sf_dir):
    shape = F.element_at(F.array(*map(F.lit, OPERATORS)), (F.pmod("query_id", F.lit(len(OPERATORS))) + 1).cast("int"))
    text = F.replace(shape, F.lit("{}"), F.col("text"))
    return questions(spark, sf_dir).select("query_id", T.sanitised_query(text).alias("clean"))


@query(
    "text_search_score",
    """WITH f AS (SELECT doc_id AS chunk_id, lower(text) AS low, text FROM documents),
m AS (SELECT chunk_id, (length(low) - length(replace(low, 'and', ''))) // 3 AS match_count, instr(low, 'and') AS p, text FROM f WHERE contains(low, 'and'))
SELECT chunk_id, match_count, round(least(1e0, match_count * 0.1 + 0.3), 6) AS score,
  length(substring(text, 1, p - 1)) - length(replace(substring(text, 1, p - 1), chr(10), '')) + 1 AS start_line
FROM m ORDER BY score DESC, chunk_id LIMIT 50""",
)
def text_search_score(spark, sf_dir):
    return lexical.text_search(chunks(spark, sf_dir), "and", k=50).select("chunk_id", "match_count", "score", "start_line")


@query(
    "text_search_regex",
    r"""WITH m AS (SELECT doc_id AS chunk_id, len(regexp_extract_all(text, '(?i)[a-z]+tion[ .,;]')) AS match_count FROM documents)
SELECT chunk_id, match_count, round(least(1e0, match_count * 0.1 + 0.3), 6) AS score FROM m WHERE match_count > 0 ORDER BY score DESC, chunk_id LIMIT 50""",
)
def text_search_regex(spark, sf_dir):
    return lexical.text_search(chunks(spark, sf_dir), "[a-z]+tion[ .,;]", k=50, regex=True).select("chunk_id", "match_count", "score")


@query(
    "word_overlap_score",
    r"""WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text || ' src ' || (item_id % 3)), '\s+'), lambda w: w <> '')) AS w FROM benchmark),
d AS (SELECT d.doc_id AS chunk_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '')[1:1000]) AS w,
  list_distinct(list_filter(regexp_split_to_array(lower('src/' || (d.doc_id % 3)), '[/_-]+|\s+'), lambda w: w <> '')) AS pw, 0.1 * greatest(0e0, 1 - (d.doc_id % 400) / 168e0) + CASE WHEN coalesce(toxic, 0) = 1 THEN 0.2 ELSE 0e0 END AS base
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
h AS (SELECT query_id, chunk_id, count(*) AS shared FROM (SELECT query_id, unnest(w) AS t FROM q) JOIN (SELECT chunk_id, unnest(w) AS t FROM d) USING (t) GROUP BY ALL),
p AS (SELECT query_id, chunk_id, count(*) AS in_path FROM (SELECT query_id, unnest(w) AS t FROM q) JOIN (SELECT chunk_id, unnest(pw) AS t FROM d) USING (t) GROUP BY ALL),
s AS (SELECT q.query_id, d.chunk_id, round(least(1.0, 0.3 * coalesce(in_path, 0) / greatest(len(q.w), 1) + 0.5 * coalesce(shared, 0) / greatest(len(q.w), 1) + base), 6) AS score, coalesce(in_path, shared) IS NOT NULL OR base > 0 AS hit
  FROM q CROSS JOIN d LEFT JOIN h ON h.query_id = q.query_id AND h.chunk_id = d.chunk_id LEFT JOIN p ON p.query_id = q.query_id AND p.chunk_id = d.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE hit)
SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 10""",
)
def word_overlap_score(spark, sf_dir):
    pins = lexical.small(flags(spark, sf_dir).select("chunk_id", F.col("is_contract").alias("pin")))  # else texts are moved to their labels
    c = chunks(spark, sf_dir).join(pins, "chunk_id", "left")
    c = c.select("chunk_id", F.coalesce("content", F.lit("")).alias("content"), F.concat(F.lit("src/"), (F.col("chunk_id") % 3).cast("string")).alias("file_path"), (F.col("chunk_id") % 400).alias("age"), F.coalesce("pin", F.lit(False)).alias("pin"))
    asked = questions(spark, sf_dir).select("query_id", F.concat("text", F.lit(" src "), (F.col("query_id") % 3).cast("string")).alias("text"))
    return lexical.word_overlap(c, asked, k=10, hours="age", pinned="pin").select("query_id", "chunk_id", "score", "rank")


KNN = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
s AS (SELECT q.vec_id AS query_vec, c.vec_id, c.label, q.label AS query_label,
  round(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] / q.n) * (c.e[i] / c.n))), 6) AS score FROM u q JOIN u c ON q.vec_id % {mod} = 0 AND q.vec_id <> c.vec_id {more})"""


@query(
    "knn_cosine_topk",
    f"""WITH {KNN.format(mod=20, more='')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_vec ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_vec, vec_id, score, rank FROM r WHERE rank <= 10""",
)
def knn_cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return vectors.knn(v, v.where("vec_id % 20 = 0"), k=10, digits=6)


@query(
    "knn_filtered",
    f"""WITH {KNN.format(mod=20, more='AND c.label = 3')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_vec ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_vec, vec_id, score, rank FROM r WHERE rank <= 5""",
)
def knn_filtered(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return vectors.knn(v, v.where("vec_id % 20 = 0"), k=5, keep=F.col("label") == 3, digits=6)


@query(
    "pairwise_avg_similarity",
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT a.label, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, round(avg(sim), 6) AS avg_sim FROM s GROUP BY label""",
)
def pairwise_avg_similarity(spark, sf_dir):
    return vectors.average_pairwise(table(spark, sf_dir, "embeddings"), "label")


@query(
    "similarity_to_set",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT b.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id = 0""",
)
def similarity_to_set(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return vectors.similar_ids(v, 0, v)


@query("lsh_knn")
def lsh_knn(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return vectors.lsh_knn(v, v.where("vec_id % 20 = 0"), k=5)


def _hashed_sql(source: str, key: str, width: int) -> str:
    """Signed feature hashing by a word's md5 digest, length one."""
    return f"""w AS (SELECT {key}, unnest({TERMS.format('text')}) AS w FROM {source}),
c AS (SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {width} AS i, sum(CASE WHEN CAST('0x' || substr(md5(w), 9, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS x FROM w GROUP BY ALL),
v AS (SELECT {key}, list(round(coalesce(x / n, 0e0), 6) ORDER BY i) AS embedding FROM (SELECT {key}, unnest(range({width})) AS i FROM {source}) LEFT JOIN c USING ({key}, i)
  LEFT JOIN (SELECT {key}, sqrt(sum(x * x)) AS n FROM c GROUP BY {key} HAVING sum(x * x) > 0) USING ({key}) GROUP BY {key})"""


def four_digits(x: Column) -> Column:
    """A double below 1000 as printf gives it: by its exact value, halves to even.
    ``format_string`` goes by the shortest digits; ``format_number`` is exact but
    where no digit is left (0.00005 lies above its half)."""
    return F.when(F.abs(x) < 0.0001, F.format_string("%.4f", x)).otherwise(F.format_number(x, 4))


@query("hashed_embeddings", f"WITH {_hashed_sql('benchmark', 'item_id', 32)} SELECT item_id AS query_id, md5(array_to_string(list_transform(embedding, lambda x: printf('%.4f', x + 0.0)), ',')) AS digest, list_sum(embedding) AS total FROM v")
def hashed_embeddings(spark, sf_dir):
    e = embedding.embedded(questions(spark, sf_dir), "text", dimension=32)
    rounded = F.transform("embedding", lambda x: F.round(x, 6))
    digest = F.md5(F.array_join(F.transform(rounded, lambda x: four_digits(x + 0.0)), ","))
    return e.select("query_id", digest.alias("digest"), F.aggregate(rounded, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("vector_stats", "SELECT count(embedding) AS vectors, CAST(max(len(embedding)) AS BIGINT) AS dimension, CAST(sum(len(embedding)) * 4 AS BIGINT) AS bytes FROM embeddings")
def vector_stats(spark, sf_dir):
    return embedding.statistics(table(spark, sf_dir, "embeddings"))


@query("vector_fetch", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def vector_fetch(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return embedding.fetched(v, flags(spark, sf_dir).where("is_contract").select(F.col("chunk_id").alias("vec_id")), "vec_id").select("vec_id", "label")


@query("mean_pooling", """WITH h AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS p, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS e, vec_id % 3 > 0 AS m FROM embeddings)
SELECT label, round(sum(CASE WHEN m THEN e[1] ELSE 0e0 END) / greatest(count(*) FILTER (WHERE m), 1e-9), 6) AS first, round(sum(CASE WHEN m THEN e[4] ELSE 0e0 END) / greatest(count(*) FILTER (WHERE m), 1e-9), 6) AS last FROM h WHERE p <= 50 GROUP BY label""")
def mean_pooling(spark, sf_dir):
    """Fifty token states of four numbers a label, as a model would give them."""
    from pyspark.sql import Window as W

    v = table(spark, sf_dir, "embeddings").withColumn("p", F.row_number().over(W.partitionBy("label").orderBy("vec_id"))).where("p <= 50")
    held = v.groupBy("label").agg(F.collect_list(F.struct(F.slice("embedding", 1, 4).alias("e"), (F.col("vec_id") % 3 > 0).cast("int").alias("m"))).alias("s"))
    pooled = embedding.mean_pooled(F.transform("s", lambda x: x["e"]), F.transform("s", lambda x: x["m"]))
    return held.select("label", F.round(pooled[0], 6).alias("first"), F.round(pooled[3], 6).alias("last"))


@query("prefixed_texts", "SELECT item_id AS query_id, 'search_query: ' || text AS asked, 'search_document: ' || text AS stored FROM benchmark")
def prefixed_texts(spark, sf_dir):
    text = F.col("text")
    return questions(spark, sf_dir).select("query_id", embedding.prefixed(text, "query").alias("asked"), embedding.prefixed(text, "document").alias("stored"))


def described(spark, sf_dir: str) -> DataFrame:
    """Chunks with the time of the event of their number and their flags."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("chunk_id"), F.col("ts").cast("timestamp").alias("updated_at"))
    c = chunks(spark, sf_dir).join(e, "chunk_id", "left").join(flags(spark, sf_dir), "chunk_id", "left")
    return c.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in ("is_contract", "is_pinned")})


def stored_vectors(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def question_vectors(spark, sf_dir: str) -> DataFrame:
    """The vector of a question: the table's one of its number."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return v.join(questions(spark, sf_dir).select("query_id"), "query_id", "left_semi")


def near_hits(spark, sf_dir: str, k: int = 100) -> DataFrame:
    return hybrid.semantic_hits(stored_vectors(spark, sf_dir), question_vectors(spark, sf_dir), k)


def candidates(spark, sf_dir: str) -> DataFrame:
    """The union of 100 hits by words, 100 by vectors, and the pinned chunks,
    with all score parts: age from the events' times, labels as contracts."""
    c = described(spark, sf_dir)
    pool = hybrid.pooled(hits(spark, sf_dir, 100), near_hits(spark, sf_dir), questions(spark, sf_dir), c.where("is_pinned").select("chunk_id"))
    now = table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("_now"))
    c = c.drop("content", "language", "selected").crossJoin(F.broadcast(now))  # one row
    return hybrid.scored(pool, c, F.col("_now"), ["src1"]).drop("_now")


NEAR = """u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)),
sim AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] / q.n) * (c.e[i] / c.n))), 9) AS embedding_score FROM u q JOIN benchmark b ON b.item_id = q.vec_id CROSS JOIN u c),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY embedding_score DESC, chunk_id) AS n FROM sim) WHERE n <= 100)"""
CANDIDATES = f"""{bm25_sql(100)}, {NEAR},
pool AS (SELECT query_id, chunk_id, max(bm25_score) AS bm25_score, max(embedding_score) AS embedding_score FROM (SELECT query_id, chunk_id, norm_score AS bm25_score, NULL AS embedding_score FROM hits
  UNION ALL SELECT query_id, chunk_id, NULL, embedding_score FROM near UNION ALL SELECT item_id, doc_id, NULL, NULL FROM benchmark, labels WHERE doc_id % 7 = 0) GROUP BY query_id, chunk_id),
cand AS (SELECT p.query_id, p.chunk_id, coalesce(bm25_score, 0e0) AS bm25_score, coalesce(embedding_score, 0e0) AS embedding_score, length(coalesce(text, '')) // 4 AS tokens, source AS file_path,
  coalesce(exp(-((SELECT epoch_us(max(ts)) FROM events) - epoch_us(e.ts)) / 86400e6 / 30), 0e0) AS recency_score, CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END AS contract_score, CASE WHEN contains(source, 'src1') THEN 1.0 ELSE 0.0 END AS focus_score,
  CASE WHEN l.doc_id IS NOT NULL AND p.chunk_id % 7 = 0 THEN 1.0 ELSE 0.0 END AS pinned_score
  FROM pool p JOIN documents d ON d.doc_id = p.chunk_id LEFT JOIN labels l ON l.doc_id = p.chunk_id LEFT JOIN events e ON e.event_id = p.chunk_id)"""
FINAL = "round(0.4 * {m[0]} * embedding_score + 0.3 * {m[1]} * bm25_score + 0.1 * {m[3]} * recency_score + 0.1 * {m[2]} * contract_score + 0.05 * focus_score + 0.05 * pinned_score, 6)"


@query("recency_score", "SELECT event_id, round(exp(-(epoch_us(TIMESTAMP '2030-01-01') - epoch_us(ts)) / 86400e6 / 30), 9) AS recency FROM events")
def recency_score(spark, sf_dir):
    now = F.lit("2030-01-01").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", F.round(ranking.recency(F.col("ts"), now), 9).alias("recency"))


@query(
    "hybrid_retrieve",
    f"""WITH {CANDIDATES}, f AS (SELECT query_id, chunk_id, {FINAL.format(m=[1, 1, 1, 1])} AS final FROM cand), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id) AS rank FROM f)
SELECT query_id, chunk_id, final, rank FROM r WHERE rank <= 20""",
)
def hybrid_retrieve(spark, sf_dir):
    return ranking.hybrid_score(candidates(spark, sf_dir), digits=6).where("rank <= 20").select("query_id", "chunk_id", "final", "rank")


@query(
    "hybrid_score",
    f"""WITH {CANDIDATES}, f AS (SELECT query_id, chunk_id, {FINAL.format(m=[1, 1, 1, 1])} AS final FROM cand)
SELECT query_id, chunk_id, final, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id) AS rank FROM f""",
)
def hybrid_score(spark, sf_dir):
    return ranking.hybrid_score(candidates(spark, sf_dir), digits=6).select("query_id", "chunk_id", "final", "rank")


def _intent_sql() -> str:
    sums = []
    for name in intent.INTENTS:
        rules = [f"CASE WHEN regexp_matches(low, '{p}') THEN {w} ELSE 0.0 END" for p, i, w in intent.RULES if i == name]
        sums.append(f"round({' + '.join(rules) or '0.0'}, 6)")
    rows = ", ".join(f"({n}, '{i}', s{n})" for n, i in enumerate(intent.INTENTS))
    cols = ", ".join(f"{s} AS s{n}" for n, s in enumerate(sums))
    return f"""intents AS (
  SELECT query_id, CASE WHEN top = 0 THEN 'general' ELSE first END AS intent, round(CASE WHEN top = 0 THEN 0.5 ELSE least(0.95, top / greatest(total, 0.1) + 0.3) END, 6) AS confidence,
    CASE WHEN second > 0.1 THEN other END AS secondary
  FROM (SELECT query_id, max(CASE WHEN rn = 1 THEN s END) AS top, max(CASE WHEN rn = 1 THEN i END) AS first, max(CASE WHEN rn = 2 THEN s END) AS second, max(CASE WHEN rn = 2 THEN i END) AS other, sum(s) AS total
    FROM (SELECT query_id, i, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, n) AS rn
      FROM (SELECT query_id, {cols} FROM (SELECT query_id, trim(lower(text)) AS low FROM asked)) x, LATERAL (VALUES {rows}) AS v(n, i, s))
    GROUP BY query_id))"""


#: Questions in words, one shape of query for each intent, over the words of the benchmark.
SHAPES = ["what is {}", "how does {} work", "where is {} used", "why does {} fail", "error in {} and crash", "difference between {} and x vs y", "example of {} tutorial", "{}"]


def asked(spark, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir)
    word = F.element_at(T.terms(F.col("text")), 1)
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.pmod("query_id", F.lit(len(SHAPES))) + 1).cast("int"))
    return q.select("query_id", F.replace(shape, F.lit("{}"), word).alias("text"))


ASKED = f"asked AS (SELECT item_id AS query_id, replace(([{', '.join(repr(s) for s in SHAPES)}])[item_id % {len(SHAPES)} + 1], '{{}}', {TERMS.format('text')}[1]) AS text FROM benchmark)"


@query("intent_classify", f"WITH {ASKED}, {_intent_sql()} SELECT query_id, intent, confidence, secondary FROM intents")
def intent_classify(spark, sf_dir):
    return intent.classified(asked(spark, sf_dir))


@query("query_routed", f"WITH {ASKED}, {_intent_sql()} SELECT query_id, intent, intent IN ('implementation', 'usage', 'debugging', 'example') AS expand FROM intents")
def query_routed(spark, sf_dir):
    return intent.multipliers(intent.classified(asked(spark, sf_dir))).select("query_id", "intent", "expand")


_M = [f"(CASE intent {' '.join(f'WHEN {i!r} THEN {m[k]}' for i, m in intent.MULTIPLIERS.items())} END)" for k in range(4)]


@query(
    "hybrid_routed",
    f"""WITH {CANDIDATES}, {ASKED}, {_intent_sql()}, f AS (SELECT query_id, chunk_id, intent, {FINAL.format(m=_M)} AS final FROM cand JOIN intents USING (query_id))
SELECT query_id, chunk_id, intent, final, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id) AS rank FROM f""",
)
def hybrid_routed(spark, sf_dir):
    m = intent.multipliers(intent.classified(asked(spark, sf_dir)))
    scored = ranking.hybrid_score(candidates(spark, sf_dir), multipliers=m, digits=6)
    return scored.join(m.select("query_id", "intent"), "query_id").select("query_id", "chunk_id", "intent", "final", "rank")


@query("query_complexity", f"""WITH {ASKED}, w AS (SELECT query_id, lower(text) AS low, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS n,
  list_has_any(regexp_split_to_array(lower(text), '\\s+'), ['how', 'why', 'what', 'when', 'where', 'which', 'explain']) AS asks FROM asked)
SELECT query_id, round(least(1e0, CASE WHEN n > 10 THEN 0.3 WHEN n > 5 THEN 0.1 ELSE 0.0 END + CASE WHEN asks THEN 0.2 ELSE 0.0 END + CASE WHEN contains(low, ' and ') OR contains(low, ',') THEN 0.2 ELSE 0.0 END
  + CASE WHEN regexp_matches(low, 'implement|architecture|design|pattern|refactor|optimize|debug|trace|flow') THEN 0.2 ELSE 0.0 END + CASE WHEN contains(low, ' not ') OR contains(low, 'without') THEN 0.1 ELSE 0.0 END), 6) AS complexity FROM w""")
def query_complexity(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", F.round(T.query_complexity(F.col("text")), 6).alias("complexity"))


def _relevance_sql(source: str = "hits") -> str:
    words = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'))"
    return f"""rel AS (SELECT h.query_id, h.chunk_id, h.rank, round(least(1.0, 0.3 * len(list_intersect({words.format('b.text')}, {words.format('d.text')})) / greatest(1, len({words.format('b.text')}))
    + 0.15 * len(list_intersect({words.format('b.text')}, {words.format('d.source')})) / greatest(1, len({words.format('b.text')}))
    + CASE WHEN length(d.text) > 50 AND length(d.text) < 2000 THEN 0.1 ELSE 0.0 END
    + CASE WHEN contains(d.text, '\"\"\"') OR contains(d.text, '''''''') OR contains(d.text, '/**') THEN 0.1 ELSE 0.0 END
    + CASE WHEN regexp_matches(lower(b.text), 'what|type') AND coalesce(l.toxic, 0) = 1 THEN 0.15 ELSE 0.0 END), 6) AS relevance
  FROM {source} h JOIN documents d ON d.doc_id = h.chunk_id JOIN benchmark b ON b.item_id = h.query_id LEFT JOIN labels l ON l.doc_id = h.chunk_id)"""


def evaluated(spark, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    found = hits(spark, sf_dir) if found is None else found
    c = lexical.among(chunks(spark, sf_dir), found, "content", "file_path")
    h = found.select("query_id", "chunk_id", "rank").join(c, "chunk_id").join(questions(spark, sf_dir), "query_id")
    return correction.relevance(h.join(flags(spark, sf_dir).select("chunk_id", "is_contract"), "chunk_id", "left"))


@query("crag_evaluate", f"WITH {BM25}, {_relevance_sql()} SELECT query_id, chunk_id, relevance FROM rel")
def crag_evaluate(spark, sf_dir):
    return evaluated(spark, sf_dir).select("query_id", "chunk_id", "relevance")


@query(
    "crag_verdict",
    f"""WITH {BM25}, {_relevance_sql()}, m AS (SELECT item_id AS query_id, (SELECT avg(relevance) FROM rel WHERE rel.query_id = item_id) AS m FROM benchmark)
SELECT query_id, round(m + 1e-9, 6) AS avg_relevance, CASE WHEN m >= 0.5 THEN 'correct' WHEN m IS NULL OR m <= 0.15 THEN 'incorrect' ELSE 'ambiguous' END AS quality,
  round(CASE WHEN m IS NULL THEN 0.0 WHEN m >= 0.5 THEN m WHEN m <= 0.15 THEN 1 - m ELSE 0.5 END + 1e-9, 6) AS confidence FROM m""",
)
def crag_verdict(spark, sf_dir):
    return correction.verdict(evaluated(spark, sf_dir), questions(spark, sf_dir))


def _judged_sql(n: str, asks: str) -> str:
    """Relevance and verdict of the hits of a BM25 block, as CTEs numbered ``n``."""
    words = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'))"
    q, c, f = words.format("q.text"), words.format("d.text"), words.format("d.source")
    size = f"greatest(1, len({q}))"
    return f"""rel{n} AS (SELECT h.query_id, round(least(1.0, 0.3 * len(list_intersect({q}, {c})) / {size} + 0.15 * len(list_intersect({q}, {f})) / {size} + CASE WHEN length(d.text) > 50 AND length(d.text) < 2000 THEN 0.1 ELSE 0.0 END
  + CASE WHEN contains(d.text, '\"\"\"') OR contains(d.text, '\'\'\'\'\'\'') OR contains(d.text, '/**') THEN 0.1 ELSE 0.0 END), 6) AS relevance FROM hits{n} h JOIN documents d ON d.doc_id = h.chunk_id JOIN {asks} q ON q.query_id = h.query_id),
ver{n} AS (SELECT q.query_id, m, CASE WHEN m >= 0.5 THEN 'correct' WHEN m IS NULL OR m <= 0.15 THEN 'incorrect' ELSE 'ambiguous' END AS quality, round(CASE WHEN m IS NULL THEN 0.0 WHEN m >= 0.5 THEN m WHEN m <= 0.15 THEN 1 - m ELSE 0.5 END + 1e-9, 6) AS confidence
  FROM {asks} q LEFT JOIN (SELECT query_id, avg(relevance) AS m FROM rel{n} GROUP BY query_id) r ON r.query_id = q.query_id)"""


def _numbered(sql: str, n: str) -> str:
    """A BM25 block with its CTEs renamed."""
    import re

    return re.sub(r"\b(tok|stat|post|ask|dfs|part|scored|ranked|hits)\b", rf"\g<1>{n}", sql)


_GENERAL = "[" + ", ".join(f"'{w}'" for w in sorted(correction.GENERAL_WORDS)) + "]"


@query(
    "crag_corrected",
    f"""WITH {ASKED}, {_numbered(bm25_sql(10, asks="asked"), "1")}, {_judged_sql("1", "asked")},
kw AS (SELECT a.query_id AS "of", a.query_id || '#0' AS query_id, trim(trim(regexp_replace(lower(text), '^(?:how|what|where|when)\\s+(?:does|do|is|are)\\s+', ''), '?')) AS text FROM asked a JOIN ver1 v ON v.query_id = a.query_id AND quality <> 'correct' WHERE regexp_matches(lower(text), '^(how|what|where|when)')),
again AS (SELECT * FROM kw WHERE NOT list_contains({_GENERAL}, text) AND text <> ''), {_numbered(bm25_sql(10, asks="again"), "2")}, {_judged_sql("2", "again")},
other AS (SELECT w."of" AS query_id, chunk_id, score FROM hits2 h JOIN again w ON w.query_id = h.query_id JOIN ver2 v ON v.query_id = h.query_id AND confidence > 0.15),
keep AS (SELECT h.query_id, chunk_id, score FROM hits1 h JOIN ver1 v ON v.query_id = h.query_id WHERE quality <> 'incorrect' OR h.query_id NOT IN (SELECT query_id FROM other)),
al AS (SELECT * FROM keep UNION ALL SELECT * FROM other o WHERE (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM keep))
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM al) WHERE rank <= 10""",
)
def crag_corrected(spark, sf_dir):
    c = chunks(spark, sf_dir)

    def judge(found: DataFrame, qs: DataFrame) -> DataFrame:
        return correction.verdict(correction.relevance(found.select("query_id", "chunk_id", "rank").join(lexical.among(c, found, "content", "file_path"), "chunk_id").join(qs.select("query_id", "text"), "query_id")), qs)

    found = correction.corrected(asked(spark, sf_dir), lambda qs: lexical.bm25(c, qs, k=10), judge, limit=10)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("mmr_select")
def mmr_select(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    near = vectors.knn(v, v.where("vec_id % 20 = 0"), k=50)
    listed = near.join(v.select("vec_id", F.col("embedding").alias("vector")), "vec_id")
    return ranking.mmr(listed.select(F.col("query_vec").alias("query_id"), F.col("vec_id").alias("chunk_id"), "score", "vector"), limit=10)


@query("minmax_norm", f"""WITH {BM25} SELECT query_id, chunk_id, round((score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE max(score) OVER w - min(score) OVER w END, 6) AS norm
FROM hits WINDOW w AS (PARTITION BY query_id)""")
def minmax_norm(spark, sf_dir):
    return ranking.min_max(hits(spark, sf_dir)).select("query_id", "chunk_id", F.round("norm", 6).alias("norm"))


@query("rerank_overlap", f"""WITH {BM25}, {_relevance_sql()} SELECT r.query_id, r.chunk_id, round(0.7 * relevance + 0.3 * norm_score + 1e-9, 6) AS score FROM rel r JOIN hits h ON h.query_id = r.query_id AND h.chunk_id = r.chunk_id""")
def rerank_overlap(spark, sf_dir):
    h = hits(spark, sf_dir)
    scores = h.select("query_id", "chunk_id", F.col("norm_score").alias("score"))
    found = ranking.rerank(scores.join(evaluated(spark, sf_dir, h).select("query_id", "chunk_id", "relevance"), ["query_id", "chunk_id"]), F.col("relevance"))
    return found.select("query_id", "chunk_id", F.round(F.col("score") + 1e-9, 6).alias("score"))


@query("type_diversity", """WITH c AS (SELECT source, lang AS kind, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM c)
SELECT source, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0.0 END, 6) AS diversity FROM p GROUP BY source""")
def type_diversity(spark, sf_dir):
    return ranking.type_diversity(table(spark, sf_dir, "documents"), "source", "lang")


def _paths(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://|[?#].*$", "").alias("path"))


FOLDERS = """p AS (SELECT page_id, string_split(regexp_replace(url, '^https?://|[?#].*$', '', 'g'), '/') AS s FROM pages),
f AS (SELECT DISTINCT page_id % 5 = 0 AS hit, array_to_string(s[1:i], '/') AS folder FROM (SELECT page_id, s, unnest(range(1, len(s))) AS i FROM p))"""


@query("dir_coverage", f"""WITH {FOLDERS}, n AS (SELECT count(DISTINCT folder) FILTER (WHERE hit) AS touched, count(DISTINCT folder) AS total FROM f WHERE folder <> '')
SELECT touched, total, round(CASE WHEN total = 0 THEN 0.0 ELSE touched / total END, 6) AS coverage FROM n""")
def dir_coverage(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return ranking.folder_coverage(p.where("page_id % 5 = 0"), p)


def lists(spark, sf_dir: str) -> DataFrame:
    """Two ranked lists a question: 100 hits by words and 100 by vectors."""
    a = hits(spark, sf_dir, 100).select("query_id", "chunk_id", F.lit("a").alias("list"), F.col("norm_score").alias("score"))
    b = near_hits(spark, sf_dir).select("query_id", "chunk_id", F.lit("b").alias("list"), F.col("embedding_score").alias("score"))
    from pyspark.sql import Window as W

    both = a.unionByName(b).withColumn("score", ranking.rounded(F.col("score"), 6))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "list").orderBy(F.desc("score"), "chunk_id")))


LISTS = f"""{bm25_sql(100)}, {NEAR},
a AS (SELECT query_id, chunk_id, 'a' AS list, round(norm_score, 6) AS score FROM hits), b AS (SELECT query_id, chunk_id, 'b' AS list, round(embedding_score, 6) AS score FROM near),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, chunk_id) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b))"""
FUSIONS = {
    "boosted": "max(score) + CASE WHEN count(*) > 1 THEN 0.2 * log2(count(*)) ELSE 0.0 END + 0.1 * (count(DISTINCT list) - 1)",
    "max": "max(score)",
    "mean": "avg(score)",
    "rrf": "sum(1.0 / (60 + rank))",
    "weighted": "sum(score * CASE list WHEN 'a' THEN 0.7 ELSE 0.3 END) / sum(CASE list WHEN 'a' THEN 0.7 ELSE 0.3 END)",
    "geometric": "coalesce(exp(avg(CASE WHEN score > 0 THEN ln(score) END)), 0e0)",
}
for _how, _sql in FUSIONS.items():

    @query(f"fuse_{_how}", f"WITH {LISTS} SELECT query_id, chunk_id, round({_sql}, 6) AS score, count(*) AS n_scores FROM l GROUP BY query_id, chunk_id")
    def _fuse(spark, sf_dir, how=_how):
        return ranking.fuse(lists(spark, sf_dir), how, weights={"a": 0.7, "b": 0.3} if how == "weighted" else None, by=("query_id",))


@query("fuse_incremental", f"""WITH {LISTS}, j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.score AS sa, b.score AS sb FROM a FULL JOIN b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
s AS (SELECT query_id, chunk_id, round(CASE WHEN sa IS NOT NULL AND sb IS NOT NULL THEN greatest(sa, sb) + 0.3 ELSE coalesce(sa, sb) END, 6) AS score FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM s)
SELECT query_id, chunk_id, score FROM r WHERE n <= 50""")
def fuse_incremental(spark, sf_dir):
    both = lists(spark, sf_dir)
    current = both.where("list = 'a'").select("query_id", "chunk_id", "score", F.array(F.col("list")).alias("sources"))
    batch = both.where("list = 'b'").select("query_id", "chunk_id", "score", F.col("list").alias("source"))
    return ranking.fuse_incremental(current, batch, by=("query_id",)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("merge_keep_first", f"""WITH {LISTS}, m AS (SELECT query_id, chunk_id, CASE WHEN bool_or(list = 'a') THEN max(CASE WHEN list = 'a' THEN score END) ELSE 0.5 END AS score FROM l GROUP BY query_id, chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 120""")
def merge_keep_first(spark, sf_dir):
    both = lists(spark, sf_dir).select("query_id", "chunk_id", "score", "list")
    out = ranking.merged(both.where("list = 'a'").drop("list"), both.where("list = 'b'").drop("list"), 120, second_score=0.5)
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("coverage_by_type", """WITH p AS (SELECT event_id AS sub_query, event_type AS query_type FROM events), a AS (SELECT event_id AS sub_query FROM events WHERE value > 50)
SELECT query_type, round(count(a.sub_query) / count(*), 6) AS coverage FROM p LEFT JOIN a USING (sub_query) GROUP BY query_type""")
def coverage_by_type(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("sub_query"), F.col("event_type").alias("query_type"), "value")
    return ranking.coverage(e.drop("value"), e.where("value > 50").select("sub_query"))


@query("adjacency_expand", """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, CAST(l_orderkey AS VARCHAR) AS file_path, l_linenumber * 4 AS start_line, l_linenumber * 4 + 2 AS end_line FROM lineitem),
s AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, CAST(l_orderkey AS VARCHAR) AS file_path, l_linenumber * 4 AS start_line, l_linenumber * 4 + 2 AS end_line FROM lineitem WHERE l_returnflag = 'R')
SELECT DISTINCT s.chunk_id AS "of", c.chunk_id FROM s JOIN c ON s.file_path = c.file_path AND s.chunk_id <> c.chunk_id AND (abs(c.start_line - s.end_line) <= 5 OR abs(s.start_line - c.end_line) <= 5)
WHERE c.chunk_id NOT IN (SELECT chunk_id FROM s)""")
def adjacency_expand(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    c = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_orderkey").cast("string").alias("file_path"), (F.col("l_linenumber") * 4).alias("start_line"), (F.col("l_linenumber") * 4 + 2).alias("end_line"), (F.col("l_returnflag") == "R").alias("chosen"))
    return ranking.adjacent(c.where("chosen"), c)


@query("interval_overlap", """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey AS f, l_linenumber * 4 AS s, l_linenumber * 4 + 6 AS e, CAST(l_partkey % 3 AS VARCHAR) AS name FROM lineitem),
n AS (SELECT o_orderkey AS node_id, o_orderkey AS f, 5 AS s, 12 AS e, CAST(o_custkey % 3 AS VARCHAR) AS name FROM orders),
h AS (SELECT node_id, chunk_id, c.name = n.name AS same_name, row_number() OVER (PARTITION BY node_id ORDER BY CASE WHEN c.name = n.name THEN 0 ELSE 1 END, chunk_id) AS rn FROM c JOIN n ON c.f = n.f AND c.s <= n.e AND c.e >= n.s)
SELECT node_id, chunk_id, same_name FROM h WHERE rn = 1""")
def interval_overlap(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")  # noqa: E741
    c = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_orderkey").alias("file_path"), (F.col("l_linenumber") * 4).alias("start_line"), (F.col("l_linenumber") * 4 + 6).alias("end_line"), (F.col("l_partkey") % 3).cast("string").alias("symbol_name"))
    n = o.select(F.col("o_orderkey").alias("node_id"), F.col("o_orderkey").alias("file_path"), F.lit(5).alias("start_line"), F.lit(12).alias("end_line"), (F.col("o_custkey") % 3).cast("string").alias("name"))
    return ranking.overlapping(c, n)
