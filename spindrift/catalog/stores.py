"""Queries: stores, telemetry, logs, sessions, text rules, retrieval in several steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code
from ..functions import text as T
from ..operators import graph, lexical, metrics, ranking, snapshots
from ..operators.lineage import cut
from ..plans import intent, iterative, planner
from ..sources import indexing, stores
from . import graphs
from .analytics import CODED, _list, coded
from .base import BM25, bm25_sql, chunks, flags, query, questions, table
from .retrieval import ASKED, LISTS, _intent_sql, asked, hits, lists

# ---- contracts -------------------------------------------------------------------


def code_chunks(spark, sf_dir: str) -> DataFrame:
    """Documents with a line of code in front, as chunks of Python files."""
    c = coded(spark, sf_dir).where("content is not null")
    name = F.when(F.col("chunk_id") % 3 == 0, F.concat(F.lit("Name"), F.col("chunk_id").cast("string")))
    c = c.select("chunk_id", "content", F.concat(F.lit("d"), (F.col("chunk_id") % 20).cast("string"), F.lit("/f"), F.col("chunk_id").cast("string"), F.lit(".py")).alias("file_path"), name.alias("symbol_name"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.lit("python").alias("language"))
    return c.withColumn("is_contract", F.col("chunk_id") % 7 != 4)


_TYPE = """CASE WHEN regexp_matches(content, 'class\\s+\\w+\\s*\\([^)]*ABC[^)]*\\)|@abstractmethod|from\\s+abc\\s+import') THEN 'abstract_class'
  WHEN regexp_matches(content, 'class\\s+\\w+\\s*\\([^)]*Protocol[^)]*\\)|typing\\.Protocol|typing_extensions\\.Protocol') THEN 'protocol' WHEN regexp_matches(content, '@dataclass|@dataclasses\\.dataclass') THEN 'dataclass'
  WHEN regexp_matches(content, 'class\\s+\\w+\\s*\\([^)]*(BaseModel|Schema)[^)]*\\)|@schema') THEN 'schema'
  WHEN regexp_matches(lower(content), 'interface|abstract|protocol|trait|contract|schema|typedef|@api|@public|@export') THEN 'unknown' END"""
RECORDS = f"""{CODED}, cc AS (SELECT chunk_id, content, 'd' || (chunk_id % 20) || '/f' || chunk_id || '.py' AS file_path, CASE WHEN chunk_id % 3 = 0 THEN 'Name' || chunk_id END AS symbol_name, chunk_id % 7 <> 4 AS is_contract, {_TYPE} AS t FROM coded WHERE content IS NOT NULL),
ci AS (SELECT *, substr(sha256(file_path || ':' || coalesce(symbol_name, '') || ':1'), 1, 16) AS contract_id, string_split(content, chr(10)) AS lines FROM cc WHERE is_contract AND t IS NOT NULL),
cs AS (SELECT *, list_position(list_transform(lines, lambda x: NOT regexp_matches(trim(x), '^\\s*($|#|//|/\\*|\\*)')), true) AS s FROM ci),
cr AS (SELECT *, lines[s:s + 5] AS rest FROM cs),
records AS (SELECT contract_id, chunk_id, coalesce(symbol_name, 'contract_' || substr(contract_id, 1, 8)) AS name, t AS contract_type, CASE WHEN t = 'unknown' THEN 0.6e0 ELSE 0.9e0 END AS confidence, content,
  CASE WHEN s > 0 THEN trim(array_to_string(rest[1:coalesce(nullif(list_position(list_transform(rest, lambda x: contains(x, '{{') OR regexp_matches(x, ':\\s*$')), true), 0), 6)], chr(10)), chr(10) || chr(9) || chr(13) || ' ') END AS signature FROM cr),
deps AS (SELECT DISTINCT contract_id, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS name FROM (SELECT contract_id, unnest(string_split(array_to_string(regexp_extract_all(content, 'class\\s+\\w+\\s*\\(([^)]+)\\)', 1), ','), ',')) AS x FROM records) WHERE trim(regexp_replace(x, '\\s+', ' ', 'g')) NOT IN ('', 'object')),
impl AS (SELECT r.contract_id, d.doc_id AS chunk_id FROM records r JOIN documents d ON d.doc_id = r.chunk_id + 1)"""


def contract_tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, what they depend on, and the next document as their implementor."""
    r = cut(stores.contract_records(code_chunks(spark, sf_dir)))  # read by each of the three, and by what joins them
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    made = r.select("contract_id", (F.col("chunk_id") + 1).alias("chunk_id")).join(d, "chunk_id", "left_semi")
    return r, r.select("contract_id", F.explode("dependencies").alias("name")), made


@query("contract_records", f"WITH {RECORDS} SELECT contract_id, chunk_id, name, contract_type, confidence, md5(signature) AS signature FROM records")
def contract_records(spark, sf_dir):
    return stores.contract_records(code_chunks(spark, sf_dir)).select("contract_id", "chunk_id", "name", "contract_type", "confidence", F.md5("signature").alias("signature"))


@query("contract_lookup", f"""WITH {RECORDS}, dd AS (SELECT contract_id, string_agg(name, ',' ORDER BY name) AS d FROM deps GROUP BY contract_id), ii AS (SELECT contract_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY CAST(chunk_id AS VARCHAR)) AS i FROM impl GROUP BY contract_id)
SELECT r.contract_id, r.name, coalesce(d, '') AS dependencies, coalesce(i, '') AS implementors FROM records r LEFT JOIN dd USING (contract_id) LEFT JOIN ii USING (contract_id) WHERE contract_type = 'schema'""")
def contract_lookup(spark, sf_dir):
    r, d, i = contract_tables(spark, sf_dir)
    out = stores.contracts(r, d, i, r.where("contract_type = 'schema'"))
    return out.select("contract_id", "name", *[F.array_join(c, ",").alias(c) for c in ("dependencies", "implementors")])


@query("contracts_named", f"WITH {RECORDS} SELECT contract_id, name, contains(lower(name), 'name1') AS fuzzy, name = 'Name12' AS exact FROM records WHERE contains(lower(name), 'name1') OR name = 'Name12'")
def contracts_named(spark, sf_dir):
    r = contract_tables(spark, sf_dir)[0]
    found = stores.contracts_named(r, "NAME1", fuzzy=True).select("contract_id", "name")
    exact = stores.contracts_named(r, "Name12").select("contract_id", F.lit(True).alias("e"))
    return found.join(exact, "contract_id", "left").select("contract_id", "name", F.lit(True).alias("fuzzy"), F.coalesce("e", F.lit(False)).alias("exact"))


@query("contract_chunk_ids", f"WITH {RECORDS} SELECT DISTINCT chunk_id FROM records")
def contract_chunk_ids(spark, sf_dir):
    return stores.contract_chunk_ids(contract_tables(spark, sf_dir)[0])


@query("contract_stats", f"WITH {RECORDS} SELECT 'contracts' AS metric, count(*) AS value FROM records UNION ALL SELECT 'type_' || contract_type, count(*) FROM records GROUP BY contract_type UNION ALL SELECT 'dependencies', count(*) FROM deps UNION ALL SELECT 'implementors', count(*) FROM impl")
def contract_stats(spark, sf_dir):
    return stores.contract_statistics(*contract_tables(spark, sf_dir))


@query("contract_boost", f"WITH {RECORDS} SELECT chunk_id, CASE WHEN NOT is_contract OR t IS NULL THEN 1e0 WHEN t = 'unknown' THEN 1.3e0 ELSE 1.45e0 END AS boost FROM cc")
def contract_boost(spark, sf_dir):
    return code_chunks(spark, sf_dir).select("chunk_id", F.round(code.contract_boost(F.col("content"), F.lit("python"), F.col("is_contract")), 6).alias("boost"))


@query("symbols_in_code", f"""WITH {CODED}, s AS (SELECT chunk_id, list_distinct(list_concat(list_concat(regexp_extract_all(content, '\\bclass\\s+(\\w+)', 1), regexp_extract_all(content, '\\b(?:type|interface)\\s+(\\w+)', 1)), list_concat(regexp_extract_all(content, '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1),
  list_concat(regexp_extract_all(content, '\\b(?:def|function|struct)\\s+(\\w+)', 1), regexp_extract_all(content, '\\basync\\s+(?:def|function)\\s+(\\w+)', 1))))) AS s FROM coded)
SELECT chunk_id, array_to_string(list_sort(s), ',') AS symbols FROM s WHERE len(s) > 0""")
def symbols_in_code(spark, sf_dir):
    s = coded(spark, sf_dir).select("chunk_id", code.symbols(F.col("content")).alias("s"))
    return s.where(F.size("s") > 0).select("chunk_id", F.array_join(F.array_sort("s"), ",").alias("symbols"))


# ---- chunks and files --------------------------------------------------------------


@query("chunks_by_file", "SELECT source AS file_path, doc_id AS chunk_id FROM documents WHERE source IN (SELECT source FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1)")
def chunks_by_file(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("start_line", F.lit(1))
    wanted = c.join(flags(spark, sf_dir).where("is_contract"), "chunk_id").select("file_path")
    return stores.chunks_by_file(c, wanted).select("file_path", "chunk_id")


@query("chunk_ids_filtered", "SELECT doc_id AS chunk_id FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr') AND coalesce(toxic, 0) = 0 AND starts_with(source, 's')")
def chunk_ids_filtered(spark, sf_dir):
    c = chunks(spark, sf_dir).join(flags(spark, sf_dir), "chunk_id", "left")
    return stores.chunk_ids(c, languages=["en", "fr"], contracts=False, path_prefix="s")


@query("chunk_ids_all", "SELECT doc_id AS chunk_id FROM documents")
def chunk_ids_all(spark, sf_dir):
    return stores.chunk_ids(chunks(spark, sf_dir))


@query("file_records", "SELECT page_id, url AS file_path, substr(sha256(html), 1, 16) AS content_hash, CAST(strlen(html) AS BIGINT) AS size FROM pages WHERE url IN (SELECT min(url) FROM pages GROUP BY regexp_extract(url, '^https?://([^/]+)', 1))")
def file_records(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "^https?://([^/]+)", 1))
    files = p.select("page_id", F.col("url").alias("file_path"), F.substring(F.sha2(F.col("html").cast("binary"), 256), 1, 16).alias("content_hash"), F.octet_length("html").cast("long").alias("size"))
    return stores.file_records(files, p.groupBy("host").agg(F.min("url").alias("file_path")))


@query("file_languages", """WITH f AS (SELECT event_id, 'a/b' || event_id || (['.py', '.TS', '.md', '.unknown', '', '.rs', '.jsx'])[event_id % 7 + 1] AS path FROM events)
SELECT event_id, coalesce(map {'py': 'python', 'ts': 'typescript', 'md': 'markdown', 'rs': 'rust', 'jsx': 'javascript'}[lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))], 'text') AS language FROM f""")
def file_languages(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ends = F.element_at(F.array(*map(F.lit, [".py", ".TS", ".md", ".unknown", "", ".rs", ".jsx"])), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select("event_id", T.language(F.concat(F.lit("a/b"), F.col("event_id").cast("string"), ends), "text").alias("language"))


@query("project_types", """WITH p AS (SELECT o_custkey AS folder, list_distinct(list((['package.json', 'pyproject.toml', 'Cargo.toml', 'go.mod', 'readme.md', 'a.py'])[o_orderkey % 6 + 1])) AS names FROM orders GROUP BY o_custkey)
SELECT folder, CASE WHEN list_contains(names, 'package.json') THEN 'Node.js' WHEN list_contains(names, 'pyproject.toml') THEN 'Python' WHEN list_contains(names, 'Cargo.toml') THEN 'Rust' WHEN list_contains(names, 'go.mod') THEN 'Go' END AS project_type FROM p""")
def project_types(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ["package.json", "pyproject.toml", "Cargo.toml", "go.mod", "readme.md", "a.py"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("folder")).agg(F.collect_set(name).alias("names"))
    return g.select("folder", code.project_type(F.col("names")).alias("project_type"))


@query("index_freshness", """WITH u AS (SELECT user_id, max(ts) AS last, count(*) FILTER (WHERE event_type = 'click') % 3 AS changed, count(*) % 2 AS done FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, CASE WHEN changed > 0 AND done > 0 THEN 'reindexed' WHEN epoch_us(now) - epoch_us(last) > 86400e6 * 0.5 OR changed > 0 THEN 'stale' ELSE 'fresh' END AS status FROM u, n""")
def index_freshness(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u = e.groupBy("user_id").agg(F.max("ts").alias("at"), (F.count_if(F.col("event_type") == "click") % 3).alias("changed"), (F.count(F.lit(1)) % 2).alias("done"))
    return u.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).select("user_id", indexing.freshness(F.col("at"), F.col("now"), F.col("changed"), F.col("done"), 0.5).alias("status"))


# ---- memory entries ------------------------------------------------------------------


def ledger(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("entry_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("role").alias("category"), F.col("text").alias("content"), F.col("turn").alias("created_at"), (F.col("turn") % 2 == 0).alias("resolved"))


LEDGER = "led AS (SELECT conv_id * 1000 + turn AS entry_id, CAST(conv_id AS VARCHAR) AS session_id, role AS category, text AS content, turn AS created_at, turn % 2 = 0 AS resolved FROM conversations)"


@query("ledger_search", f"WITH {LEDGER}, {bm25_sql(10, '(SELECT entry_id AS chunk_id, content AS text FROM led WHERE category IN (' + repr('assistant') + ', ' + repr('user') + '))')} SELECT query_id, chunk_id AS entry_id, round(score, 6) AS score, rank FROM hits")
def ledger_search(spark, sf_dir):
    found = stores.search_entries(ledger(spark, sf_dir), questions(spark, sf_dir), ["assistant", "user"])
    return found.withColumn("score", F.round("score", 6))


@query("ledger_entries", f"WITH {LEDGER} SELECT entry_id, category FROM led WHERE category IN ('assistant', 'system') AND NOT resolved ORDER BY created_at DESC, entry_id LIMIT 40")
def ledger_entries(spark, sf_dir):
    return stores.entries(ledger(spark, sf_dir), categories=["assistant", "system"], open_only=True, limit=40).select("entry_id", "category")


@query("ledger_state", f"""WITH {LEDGER}, n AS (SELECT doc_id AS entry_id, 'new' AS category, lang AS content FROM documents), a AS (SELECT entry_id, category, content, resolved FROM led WHERE entry_id NOT IN (SELECT entry_id FROM n) UNION ALL SELECT entry_id, category, content, NULL FROM n)
SELECT entry_id, category, coalesce(entry_id IN (SELECT doc_id FROM labels WHERE quality = 1) OR resolved, false) AS resolved FROM a WHERE entry_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def ledger_state(spark, sf_dir):
    d, marked = table(spark, sf_dir, "documents"), flags(spark, sf_dir)
    new = d.select(F.col("doc_id").alias("entry_id"), F.lit("new").alias("category"), F.col("lang").alias("content"))
    now = stores.add_entries(ledger(spark, sf_dir), new)
    now = stores.resolve_entries(now, marked.where("selected").select(F.col("chunk_id").alias("entry_id")))
    return stores.remove_entries(now, marked.where("is_contract").select(F.col("chunk_id").alias("entry_id"))).select("entry_id", "category", F.coalesce("resolved", F.lit(False)).alias("resolved"))


# ---- telemetry -------------------------------------------------------------------------

NAMES = ["retrieval_latency_ms", "retrieval_entropy", "indexing_rate_cps", "pack_tokens", "error_count", "own_name"]
KINDS = ["retrieval", "retrieval", "indexing", "pack", "error", "custom"]
POINTS = f"pts AS (SELECT event_id, user_id, ts, ({_list(NAMES)})[event_id % {len(NAMES)} + 1] AS name, ({_list(KINDS)})[event_id % {len(NAMES)} + 1] AS metric_type, value FROM events WHERE value IS NOT NULL)"


def point_rows(spark, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % len(NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "events").withColumn("name", name)


@query("metric_points", f"WITH {POINTS} SELECT metric_type, name, count(*) AS n, round(sum(value), 6) AS total FROM pts GROUP BY ALL")
def metric_points(spark, sf_dir):
    p = stores.points(point_rows(spark, sf_dir), tags=F.create_map(F.lit("user"), F.col("user_id").cast("string")))
    return p.groupBy("metric_type", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("metric_flushes", "WITH r AS (SELECT event_id, user_id AS source, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 25) AS BIGINT) AS flush FROM events) SELECT source, flush, count(*) AS n, min(event_id) AS first FROM r GROUP BY ALL")
def metric_flushes(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "source")
    return stores.flushes(e, 25).groupBy("source", "flush").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


PRUNE = f"{POINTS}, lim AS (SELECT max(ts) - INTERVAL 5 DAY AS lim FROM events)"


def _pruned(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = stores.points(point_rows(spark, sf_dir))
    now = table(spark, sf_dir, "events").agg(F.max("ts").alias("_now"))
    raw, rolled = stores.pruned(p.crossJoin(F.broadcast(now)), F.col("_now"), days=5)
    return raw.drop("_now"), rolled


@query("metric_prune", f"WITH {PRUNE} SELECT metric_type, name, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean FROM pts, lim WHERE ts < lim GROUP BY ALL")
def metric_prune(spark, sf_dir):
    return _pruned(spark, sf_dir)[1].select("metric_type", "name", "day", "n", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"))


@query("metric_kept", f"WITH {PRUNE} SELECT name, count(*) AS n FROM pts, lim WHERE ts >= lim GROUP BY name")
def metric_kept(spark, sf_dir):
    return _pruned(spark, sf_dir)[0].groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("metric_names", f"WITH {POINTS} SELECT DISTINCT name FROM pts")
def metric_names(spark, sf_dir):
    return stores.metric_names(stores.points(point_rows(spark, sf_dir)))


@query("session_compactions", "SELECT user_id AS session_id, count(*) AS compactions, CAST(max(ts) AS VARCHAR) AS last FROM events WHERE event_type = 'click' GROUP BY user_id")
def session_compactions(spark, sf_dir):
    log = table(spark, sf_dir, "events").where("event_type = 'click'").withColumnRenamed("user_id", "session_id")
    return stores.compactions(log).withColumn("last", F.col("last").cast("string"))


# ---- retrieval log, feedback ------------------------------------------------------------


@query("retrieval_log", f"""WITH {BM25}, {ASKED}, {_intent_sql()}, h AS (SELECT query_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS retrieved FROM hits GROUP BY query_id)
SELECT a.query_id AS event_id, 's' || (a.query_id % 5) AS session_id, a.text AS query, i.intent AS query_intent, coalesce(retrieved, '') AS retrieved FROM asked a JOIN intents i USING (query_id) LEFT JOIN h USING (query_id)""")
def retrieval_log(spark, sf_dir):
    q = asked(spark, sf_dir)
    log = stores.logged(hits(spark, sf_dir), q, intent.classified(q), F.concat(F.lit("s"), (F.col("query_id") % 5).cast("string")), F.current_timestamp())
    return log.select("event_id", "session_id", "query", "query_intent", F.array_join("retrieved", ",").alias("retrieved"))


@query("session_outcomes", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'success' WHEN user_id % 3 = 1 THEN 'failure' WHEN event_type = 'view' THEN 'unknown' END AS outcome FROM events")
def session_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"), F.when(F.col("event_type") == "view", "unknown").alias("outcome"))
    given = e.where("session_id % 3 < 2").select("session_id", F.when(F.col("session_id") % 3 == 0, "success").otherwise("failure").alias("outcome"))
    return stores.labelled(e, given).select("event_id", "outcome")


@query("chunk_features", "SELECT d.doc_id AS chunk_id, array_to_string(list_filter(['symbol_' || lang, CASE WHEN contains(lower(source), 'test') THEN 'file_test' END, CASE WHEN contains(lower(source), 'config') THEN 'file_config' END, CASE WHEN toxic = 1 THEN 'is_contract' END], lambda x: x IS NOT NULL), ',') AS features FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def chunk_features(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("symbol_type", F.col("language")).join(flags(spark, sf_dir), "chunk_id", "left")
    return metrics.chunk_features(c).select("chunk_id", F.array_join("features", ",").alias("features"))


@query("query_features", f"WITH {ASKED}, {_intent_sql()} SELECT query_id AS event_id, 'intent_' || intent AS intent, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS query_length FROM asked JOIN intents USING (query_id)")
def query_features(spark, sf_dir):
    q = asked(spark, sf_dir)
    rows = q.join(intent.classified(q), "query_id").select(F.col("query_id").alias("event_id"), F.col("text").alias("query"), F.col("intent").alias("query_intent"))
    return metrics.query_features(rows)


@query("learning_job")
def learning_job(spark, sf_dir):
    """Sequential updates; the tests compare with a plain loop."""
    h = hits(spark, sf_dir).join(flags(spark, sf_dir), "chunk_id", "left")
    g = h.groupBy("query_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("retrieved"), F.array_sort(F.collect_list(F.when(F.col("selected"), F.col("chunk_id")))).alias("selected"))
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"), "ts")
    events = g.join(e, F.col("query_id") == F.col("event_id")).select("event_id", "session_id", "ts", "retrieved", "selected", F.lit(None).cast("string").alias("outcome"), (F.col("event_id") % 2).alias("model"))
    c = chunks(spark, sf_dir).withColumn("symbol_type", F.col("language")).join(flags(spark, sf_dir), "chunk_id", "left")
    return metrics.learn(events, c, F.lit("2030-01-01").cast("timestamp"))


_FORMS = {k: _list(v) for k, v in metrics.TEMPLATES.items()}


@query("synthetic_queries", f"""WITH s AS (SELECT p_partkey AS chunk_id, 'Part' || p_partkey AS name, (['class_definition', 'function_definition', 'text_block', NULL])[p_partkey % 4 + 1] AS kind, md5('7:' || p_partkey) AS d FROM part),
n AS (SELECT *, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS x FROM s ORDER BY d, chunk_id LIMIT 50), t AS (SELECT *, CASE WHEN contains(coalesce(kind, ''), 'class') THEN 'definition' WHEN contains(coalesce(kind, ''), 'function') THEN 'implementation' WHEN x % 2 = 0 THEN 'definition' ELSE 'implementation' END AS query_type FROM n)
SELECT replace(CASE query_type WHEN 'definition' THEN {_FORMS['definition']}[(x // 2) % 4 + 1] ELSE {_FORMS['implementation']}[(x // 2) % 4 + 1] END, '{{}}', name) AS query, chunk_id AS expected_chunk_id, name AS expected_symbol, query_type FROM t""")
def synthetic_queries(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("class_definition"), F.lit("function_definition"), F.lit("text_block"), F.lit(None)), (F.col("p_partkey") % 4 + 1).cast("int"))
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.concat(F.lit("Part"), F.col("p_partkey").cast("string")).alias("symbol_name"), kind.alias("symbol_type"))
    return metrics.synthetic_queries(s, 50, seed=7)


@query("score_adjustment", """WITH i AS (SELECT event_id AS item, unnest([event_type, 'user_' || (user_id % 4)]) AS feature FROM events), w AS (SELECT event_type AS feature, avg(value) / 100 AS weight FROM events GROUP BY event_type)
SELECT item, round(1 / (1 + exp(-(1 + coalesce(sum(weight), 0e0)))), 6) AS adjustment FROM i LEFT JOIN w USING (feature) GROUP BY item""")
def score_adjustment(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    items = e.select(F.col("event_id").alias("item"), F.array("event_type", F.concat(F.lit("user_"), (F.col("user_id") % 4).cast("string"))).alias("features"))
    return metrics.adjusted(items, e.groupBy(F.col("event_type").alias("feature")).agg((F.avg("value") / 100).alias("weight")))


# ---- sessions: waste, misses, responses ---------------------------------------------------

SPENT = "sp AS (SELECT user_id AS session, event_id AS seq, CAST(floor(value) + 1 AS BIGINT) AS explored, CASE WHEN event_id % 4 = 0 THEN CAST(floor(value) + 1 AS BIGINT) WHEN event_id % 4 = 1 THEN CAST(floor(value / 2) AS BIGINT) ELSE 0 END AS used FROM events)"


def spent(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    whole = (F.floor("value") + 1).cast("long")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), whole.alias("explored"), F.when(F.col("event_id") % 4 == 0, whole).when(F.col("event_id") % 4 == 1, F.floor(F.col("value") / 2).cast("long")).otherwise(0).alias("used"))


SESSION_EWR = f"""{SPENT}, ow AS (SELECT *, (explored - used) / explored AS e, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS p FROM sp),
se AS (SELECT session, count(*) AS queries, round((sum(explored) - sum(used)) / sum(explored), 6) AS session_ewr, round(avg(e), 6) AS mean_ewr, round(stddev_pop(e), 6) AS std_ewr, round(min(e), 6) AS min_ewr, round(max(e), 6) AS max_ewr,
  round(avg(e) FILTER (WHERE p <= 3), 6) AS recent, round(avg(e) FILTER (WHERE p > 3 AND p <= 10), 6) AS older FROM ow GROUP BY session)"""


@query("session_ewr", f"WITH {SESSION_EWR} SELECT * FROM se")
def session_ewr(spark, sf_dir):
    return metrics.session_waste(spent(spark, sf_dir), "session")


@query("ewr_trend", f"WITH {SESSION_EWR} SELECT session, p AS place, round(e, 6) AS value FROM ow WHERE p <= 10")
def ewr_trend(spark, sf_dir):
    s = spent(spark, sf_dir).withColumn("e", F.round((F.col("explored") - F.col("used")) / F.col("explored"), 6))
    return metrics.trend(s, "e", "session", "seq").withColumn("place", F.col("place").cast("long"))


@query("ewr_suggestions", f"""WITH {SESSION_EWR}, a AS (SELECT session, queries, list_filter([CASE WHEN session_ewr > 0.7 THEN 'retrieve_less' END, CASE WHEN max_ewr > 0.9 THEN 'review_queries' END, CASE WHEN queries >= 3 AND recent > coalesce(older, recent) * 1.2 THEN 'waste_grows' END,
  CASE WHEN queries >= 3 AND recent < coalesce(older, recent) * 0.8 THEN 'waste_falls' END], lambda x: x IS NOT NULL) AS l FROM se)
SELECT session, array_to_string(CASE WHEN queries < 5 THEN ['more_data'] WHEN len(l) = 0 THEN ['none'] ELSE l END, ',') AS advice FROM a""")
def ewr_suggestions(spark, sf_dir):
    return metrics.suggestions(session_ewr(spark, sf_dir), "session").withColumn("advice", F.array_join("advice", ","))


@query("wasteful_kinds", "WITH r AS (SELECT lang AS symbol_type, length(coalesce(text, '')) // 4 AS tokens, coalesce(toxic, 0) = 1 AS s, source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), g AS (SELECT source, coalesce(symbol_type, 'unknown') AS symbol_type, sum(tokens) AS t, sum(CASE WHEN s THEN tokens ELSE 0 END) AS u FROM r GROUP BY ALL) SELECT source, symbol_type, round((t - u) / t, 6) AS ewr FROM g WHERE t > 0 AND round((t - u) / t, 6) > 0.9")
def wasteful_kinds(spark, sf_dir):
    c = chunks(spark, sf_dir).join(flags(spark, sf_dir), "chunk_id", "left")
    rows = c.select(F.col("file_path").alias("source"), F.col("language").alias("symbol_type"), "tokens", F.coalesce("is_contract", F.lit(False)).alias("selected"))
    return metrics.wasteful_kinds(rows, ["source"]).select("source", "symbol_type", "ewr")


COUNTS = "mc AS (SELECT user_id AS session, event_id % 9 + 1 AS retrieved, event_id % 5 AS impactful, least(event_id % 3, event_id % 5, event_id % 9 + 1) AS hit, event_type, event_id FROM events)"


def miss_counts(spark, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(F.col("user_id").alias("session"), (i % 9 + 1).alias("retrieved"), (i % 5).alias("impactful"), F.least(i % 3, i % 5, i % 9 + 1).alias("hit"), "event_type", "event_id")


@query("session_imr", f"""WITH {COUNTS}, g AS (SELECT session, count(*) AS queries, sum(retrieved) AS r, sum(impactful) AS i, sum(hit) AS h, avg(CASE WHEN impactful > 0 THEN (impactful - hit) / impactful ELSE 0e0 END) AS m, stddev_pop(CASE WHEN impactful > 0 THEN (impactful - hit) / impactful ELSE 0e0 END) AS s FROM mc GROUP BY session),
x AS (SELECT *, CASE WHEN i > 0 THEN (i - h) / i ELSE 0e0 END AS miss, CASE WHEN r > 0 THEN h / r ELSE 0e0 END AS p FROM g)
SELECT session, queries, round(miss, 6) AS imr, round(p, 6) AS precision, round(1 - miss, 6) AS recall, round(CASE WHEN p + 1 - miss > 0 THEN 2 * p * (1 - miss) / (p + 1 - miss) ELSE 0e0 END, 6) AS f1, round(m, 6) AS mean_imr, round(s, 6) AS std_imr FROM x""")
def session_imr(spark, sf_dir):
    return metrics.session_misses(miss_counts(spark, sf_dir), "session")


@query("miss_patterns", f"WITH {COUNTS} SELECT coalesce(CASE WHEN event_id % 4 > 0 THEN event_type END, 'unknown') AS pattern, count(*) AS n FROM mc WHERE impactful > hit GROUP BY 1")
def miss_patterns(spark, sf_dir):
    missed = miss_counts(spark, sf_dir).where("impactful > hit").withColumn("pattern", F.when(F.col("event_id") % 4 > 0, F.col("event_type")))
    return metrics.miss_patterns(missed, "pattern")


@query("missed_estimate", "SELECT event_id, CAST(greatest(0, floor((event_id % 40) * (1 + least(1e0, (event_id % 13) / 10)) * (1 - least(1e0, 10 * (event_id % 40) / greatest(event_id % 900, 1))) * 0.1)) AS BIGINT) AS missed FROM events")
def missed_estimate(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", metrics.estimated_missed(i % 13, i % 40, i % 900).alias("missed"))


@query("response_metrics", """WITH e AS (SELECT conv_id, turn, unnest(regexp_extract_all('TODO: a' || chr(10) || CASE WHEN turn % 2 = 0 THEN 'QUESTION: b' || chr(10) ELSE '' END, '(TODO|QUESTION):', 1)) AS t FROM conversations WHERE turn % 3 <> 0),
k AS (SELECT conv_id, turn, lower(t) AS t, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT conv_id, turn, sum(n) AS entries, string_agg(t || '=' || n, ';' ORDER BY t) AS by_type FROM k GROUP BY ALL)
SELECT c.conv_id, c.turn, length(text) AS response_length, CAST(coalesce(entries, 0) AS BIGINT) AS entries, coalesce(by_type, '') AS by_type FROM conversations c LEFT JOIN g USING (conv_id, turn)""")
def response_metrics(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    head = F.concat(F.lit("TODO: a\n"), F.when(F.col("turn") % 2 == 0, "QUESTION: b\n").otherwise(""))
    found = c.where("turn % 3 <> 0").select("conv_id", "turn", F.explode(T.ledger_entries(head)).alias("e")).select("conv_id", "turn", "e.entry_type")
    return metrics.response_metrics(found, c, ["conv_id", "turn"])


# ---- text rules --------------------------------------------------------------------------

TASK = ["find all uses of {w} across modules", "trace the impact of {w}", "compare {w} with the other one", "summarize {w}", "show {w} in a comprehensive way", "{w}"]


def tasks(spark, sf_dir: str) -> DataFrame:
    form = F.element_at(F.array(*map(F.lit, TASK)), (F.pmod("query_id", F.lit(len(TASK))) + 1).cast("int"))
    return questions(spark, sf_dir).select("query_id", F.replace(form, F.lit("{w}"), F.regexp_replace("text", "[^ -~]", "")).alias("text"))


TASKS = f"tasks AS (SELECT item_id AS query_id, replace({_list(TASK)}[item_id % {len(TASK)} + 1], '{{w}}', regexp_replace(text, '[^ -~]', '', 'g')) AS text FROM benchmark)"


@query("task_analysis", f"""WITH {TASKS}, t AS (SELECT *, lower(text) AS low, length(text) // 4 AS n FROM tasks)
SELECT query_id, CASE WHEN regexp_matches(low, 'find all|list all|every|across') THEN 'aggregation' WHEN regexp_matches(low, 'impact|affect|dependency|trace') THEN 'impact' WHEN regexp_matches(low, 'compare|diff|difference') THEN 'comparison' WHEN regexp_matches(low, 'summarize|overview|understand') THEN 'summarization' ELSE 'exploration' END AS task_type,
  array_to_string(list_filter(regexp_extract_all(text, '\\b[a-zA-Z][a-zA-Z_]+\\b'), lambda w: NOT list_contains({_list(code.STOP_WORDS)}, lower(w)))[1:10], ' ') AS keywords, CASE WHEN n > 200 OR contains(low, 'comprehensive') THEN 'high' WHEN n > 50 THEN 'medium' ELSE 'low' END AS complexity, n AS task_tokens FROM t""")
def task_analysis(spark, sf_dir):
    # words of ASCII letters only: both sides see the same word bounds
    plain = F.regexp_replace("text", "[^\\x00-\\x7f]", "_") if False else F.col("text")
    a = tasks(spark, sf_dir).select("query_id", code.task_analysis(plain).alias("a"))
    return a.select("query_id", "a.task_type", F.array_join("a.keywords", " ").alias("keywords"), "a.complexity", "a.task_tokens")


@query("audit_gate", f"""WITH {TASKS}, g AS (SELECT query_id, lower(text) AS low, (query_id % 50) / 10e0 AS e, CASE WHEN query_id % 9 = 0 THEN 'pack' WHEN query_id % 9 = 1 THEN 'auto' END AS x FROM tasks)
SELECT query_id, CASE WHEN x = 'pack' THEN 'pack' WHEN regexp_matches(low, '{'|'.join(code.AUDITS)}') OR e >= 2.5 THEN 'rlm' ELSE 'pack' END AS mode, CASE WHEN x = 'pack' THEN 'explicit' WHEN regexp_matches(low, '{'|'.join(code.AUDITS)}') THEN 'audit' WHEN e >= 2.5 THEN 'high_entropy' ELSE 'low_entropy' END AS reason,
  round(CASE WHEN x = 'pack' THEN 1e0 WHEN regexp_matches(low, '{'|'.join(code.AUDITS)}') THEN 0.9e0 ELSE least(1e0, abs(e - 2.5) / 2.5 + 0.5) END, 6) AS confidence, regexp_matches(low, '{'|'.join(code.INTERFACES)}') AS contract_touch FROM g""")
def audit_gate(spark, sf_dir):
    n = F.col("query_id")
    g = tasks(spark, sf_dir).select("query_id", code.audit_gate(F.col("text"), n % 50 / 10.0, F.when(n % 9 == 0, "pack").when(n % 9 == 1, "auto")).alias("g"), code.touches_contract(F.col("text")).alias("contract_touch"))
    return g.select("query_id", "g.mode", "g.reason", F.round("g.confidence", 6).alias("confidence"), "contract_touch")


@query("truncated_texts", "SELECT doc_id, length(text) // 4 > 500 AS cut, md5(CASE WHEN length(text) // 4 > 500 THEN substr(text, 1, 1984) || chr(10) || '... [truncated]' ELSE text END) AS digest FROM documents WHERE text IS NOT NULL")
def truncated_texts(spark, sf_dir):
    t = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", code.truncated(F.col("text"), 500).alias("t"))
    return t.select("doc_id", "t.cut", F.md5("t.text").alias("digest"))


@query("response_budget", """WITH g AS (SELECT user_id, list(event_type || repeat('x', event_id % 60) ORDER BY event_id) AS a, list('v' || event_id ORDER BY event_id) AS b FROM events GROUP BY user_id), n AS (SELECT *, list_transform(a, lambda x: length(x) // 4) AS na, list_transform(b, lambda x: length(x) // 4) AS nb FROM g),
s AS (SELECT *, CAST(list_sum(na) AS BIGINT) AS ta, CAST(list_sum(nb) AS BIGINT) AS tb FROM n)
SELECT user_id, CAST(CASE WHEN ta + tb > 900 THEN least(len(a), 5) WHEN ta + tb > 300 THEN len(list_filter(range(1, len(a) + 1), lambda i: list_sum(na[1:i]) <= 300)) ELSE len(a) END AS INT) AS first, CAST(CASE WHEN ta + tb > 900 THEN least(len(b), 5) WHEN ta + tb > 300 THEN len(list_filter(range(1, len(b) + 1), lambda i: ta + list_sum(nb[1:i]) <= 300)) ELSE len(b) END AS INT) AS second FROM s""")
def response_budget(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("event_id", c.alias("c")))), lambda x: x["c"])
    g = e.groupBy("user_id").agg(listed(F.concat("event_type", F.repeat(F.lit("x"), (F.col("event_id") % 60).cast("int")))).alias("a"), listed(F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("b"))
    cut = code.within_tokens({"first": F.col("a"), "second": F.col("b")}, soft=300, hard=900)
    return g.select("user_id", *[F.size(c).alias(n) for n, c in cut.items()])


@query("readable_sizes", """WITH s AS (SELECT event_id, event_id * event_id * event_id % 5000000000000 AS n, event_id % 9000 + 0.5e0 AS sec FROM events)
SELECT event_id, CASE WHEN n < 1024 THEN printf('%.1f B', n / 1) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824) ELSE printf('%.1f TB', n / 1099511627776) END AS size,
  CASE WHEN sec < 60 THEN printf('%.1fs', sec) WHEN sec < 3600 THEN printf('%dm %.1fs', CAST(floor(sec / 60) AS BIGINT), sec - 60 * floor(sec / 60)) ELSE printf('%dh %dm', CAST(floor(sec / 3600) AS BIGINT), CAST(floor(sec / 60) AS BIGINT) % 60) END AS duration FROM s""")
def readable_sizes(spark, sf_dir):
    i, most = F.col("event_id"), 5000000000000
    # the cube of an id passes 64 bits from 2 097 152 on: remainders are multiplied, as decimals
    rest = (i % most).cast("decimal(13,0)")
    cube = (rest * rest % most).cast("decimal(13,0)") * rest % most
    e = table(spark, sf_dir, "events").select("event_id", cube.cast("long").alias("n"), (i % 9000 + 0.5).cast("double").alias("sec"))
    return e.select("event_id", code.readable_size(F.col("n").cast("double")).alias("size"), code.readable_duration(F.col("sec")).alias("duration"))


@query("escaped_texts", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS digest FROM pages")
def escaped_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.escaped_xml(F.col("html"))).alias("digest"))


@query("command_types", """WITH c AS (SELECT event_id, (['unit-test', 'build', 'eslint', 'prettier', 'dev', 'deploy', 'compile'])[event_id % 7 + 1] AS name FROM events)
SELECT event_id, CASE WHEN regexp_matches(name, 'test|spec|jest|pytest') THEN 'test' WHEN regexp_matches(name, 'build|compile|bundle') THEN 'build' WHEN regexp_matches(name, 'lint|eslint|check') THEN 'lint' WHEN regexp_matches(name, 'format|prettier|fmt') THEN 'format' WHEN regexp_matches(name, 'start|dev|serve|run') THEN 'run' ELSE 'other' END AS command_type FROM c""")
def command_types(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ["unit-test", "build", "eslint", "prettier", "dev", "deploy", "compile"])), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", T.command_type(name).alias("command_type"))


@query("file_imports", """WITH f AS (SELECT doc_id, 'import os.path' || chr(10) || 'from a.b' || (doc_id % 9) || ' import x' || chr(10) || text AS content FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(content, '(?m)^(?:from|import)\\s+([\\w.]+)', 1), lambda x: replace(x, '.', '/') || '.py'), ',') AS imports FROM f""")
def file_imports(spark, sf_dir):
    head = F.concat(F.lit("import os.path\nfrom a.b"), (F.col("doc_id") % 9).cast("string"), F.lit(" import x\n"), F.col("text"))
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.array_join(T.imports(head, F.lit("python")), ",").alias("imports"))


@query("query_entities", """WITH q AS (SELECT item_id AS query_id, 'Where does DataStore call load_file, `run it` or "the end" of 'DATASTORE' ' || item_id AS text FROM benchmark) SELECT query_id, 'DataStore,load_file,run it,the end' AS entities FROM q""".replace("'DATASTORE' ' ||", "''DATASTORE'' ' ||"))
def query_entities(spark, sf_dir):
    text = F.concat(F.lit("Where does DataStore call load_file, `run it` or \"the end\" of 'DATASTORE' "), F.col("query_id").cast("string"))
    return questions(spark, sf_dir).select("query_id", F.array_join(T.entities(text), ",").alias("entities"))


# ---- retrieval in several steps -------------------------------------------------------------


def graph_nodes(spark, sf_dir: str) -> DataFrame:
    """Customers are the nodes of the documents of their number (those of odd
    numbers by file and name only), suppliers of those a thousand up."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    key, own = F.col("c_custkey"), F.col("c_custkey") % 2 == 0
    a = c.select(F.concat(F.lit("c"), key.cast("string")).alias("node_id"), F.lit("function").alias("node_type"), F.concat(F.lit("N"), key.cast("string")).alias("name"), F.lit("f").alias("file_path"), F.when(own, key).alias("chunk_id"))
    b = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"), F.lit("class").alias("node_type"), F.col("s_name").alias("name"), F.lit("g").alias("file_path"), (F.col("s_suppkey") + 500).alias("chunk_id"))
    n = table(spark, sf_dir, "nation")
    d = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.lit("interface").alias("node_type"), F.col("n_name").alias("name"), F.lit("h").alias("file_path"), (F.col("n_nationkey") + 900).cast("long").alias("chunk_id"))
    return a.unionByName(b).unionByName(d)


def named_chunks(spark, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return c.select("chunk_id", "content", F.lit("f").alias("file_path"), F.concat(F.lit("N"), F.col("chunk_id").cast("string")).alias("symbol_name"), "language", F.col("language").alias("symbol_type"))


NODES = """nodes AS (SELECT 'c' || c_custkey AS node_id, 'function' AS node_type, 'N' || c_custkey AS name, 'f' AS file_path, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS chunk_id FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'class', s_name, 'g', s_suppkey + 500 FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'interface', n_name, 'h', n_nationkey + 900 FROM nation),
own AS (SELECT chunk_id, min(node_id) AS node FROM nodes WHERE chunk_id IS NOT NULL GROUP BY chunk_id), nam AS (SELECT file_path, name, min(node_id) AS node FROM nodes GROUP BY ALL),
cn AS (SELECT * FROM (SELECT doc_id AS chunk_id, coalesce(o.node, m.node) AS node FROM documents d LEFT JOIN own o ON o.chunk_id = d.doc_id LEFT JOIN nam m ON m.file_path = 'f' AND m.name = 'N' || d.doc_id) WHERE node IS NOT NULL)"""


@query("nodes_for_chunks", f"WITH {NODES} SELECT chunk_id, node FROM cn")
def nodes_for_chunks(spark, sf_dir):
    return iterative.nodes_for_chunks(named_chunks(spark, sf_dir), graph_nodes(spark, sf_dir))


@query("chunks_for_nodes", f"WITH {NODES} SELECT 1 AS query_id, n.chunk_id, max(c.c_acctbal) AS score FROM customer c JOIN nodes n ON n.node_id = 'n' || c.c_nationkey GROUP BY n.chunk_id")
def chunks_for_nodes(spark, sf_dir):
    found = table(spark, sf_dir, "customer").select(F.lit(1).alias("query_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("node"), F.col("c_acctbal").alias("score"))
    return iterative.chunks_for_nodes(found, graph_nodes(spark, sf_dir))


@query("related_interfaces", f"WITH {NODES} SELECT DISTINCT 's' || s_suppkey AS node, node_id AS interface, node_type, name FROM supplier JOIN nodes ON node_id = 'n' || s_nationkey")
def related_interfaces(spark, sf_dir):
    e = graphs.edges(spark, sf_dir).withColumn("edge_type", F.when(F.col("edge_type") == "IMPORTS", "USES_TYPE").otherwise(F.col("edge_type")))
    starts = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return iterative.related_interfaces(e, starts, graph_nodes(spark, sf_dir))


def _hops_sql() -> str:
    """The traversal of every strategy, unrolled."""
    out, ends = "", []
    for name, hops in graph.STRATEGIES.items():
        out += f",\n{name}_0 AS (SELECT query_id, node, max(score) AS score FROM placed WHERE strategy = '{name}' GROUP BY ALL)"
        front, seen = f"{name}_0", [f"SELECT query_id, node FROM {name}_0"]
        for i, hop in enumerate(hops, 1):
            kinds = ", ".join(f"'{t}'" for t in hop.edge_types)
            ahead, back = (f"SELECT {a} AS a, {b} AS b FROM edges WHERE edge_type IN ({kinds})" for a, b in (("src", "dst"), ("dst", "src")))
            steps = {"forward": ahead, "backward": back, "both": f"{ahead} UNION {back}"}[hop.direction]
            out += f""",
{name}_t{i} AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS n FROM (SELECT DISTINCT * FROM ({steps}))) WHERE n <= {hop.most}),
{name}_{i} AS (SELECT query_id, b AS node, max(score * {hop.decay}) AS score FROM {front} JOIN {name}_t{i} ON a = node WHERE score >= 0.1 GROUP BY ALL),
{name}_f{i} AS (SELECT * FROM {name}_{i} WHERE (query_id, node) NOT IN ({' UNION ALL '.join(seen)}))"""
            front = f"{name}_f{i}"
            seen.append(f"SELECT query_id, node FROM {name}_{i}")
        union = " UNION ALL ".join(f"SELECT * FROM {name}_{i}" for i in range(1, len(hops) + 1))
        ends.append(f"SELECT query_id, node, round(max(score), 6) AS score FROM ({union}) WHERE (query_id, node) NOT IN (SELECT query_id, node FROM {name}_0) GROUP BY ALL")
    return out + ",\naround AS (" + " UNION ALL ".join(ends) + ")"


def _multi_hop_sql(pick: str) -> str:
    return f"""{BM25}, {graphs.EDGES}, {NODES}, {ASKED}, {_intent_sql()}, sd AS (SELECT query_id, chunk_id, norm_score AS score FROM hits JOIN intents USING (query_id) WHERE {pick}),
placed AS (SELECT s.query_id, cn.node, s.score, CASE WHEN intent IN ({', '.join(repr(s) for s in graph.STRATEGIES)}) THEN intent ELSE 'default' END AS strategy FROM sd s JOIN cn USING (chunk_id) JOIN intents USING (query_id)){_hops_sql()},
wide AS (SELECT query_id, chunk_id, max(a.score) AS score FROM around a JOIN nodes n ON n.node_id = a.node WHERE chunk_id IS NOT NULL GROUP BY ALL),
both_ AS (SELECT * FROM sd UNION ALL SELECT * FROM wide w WHERE (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM sd)),
mh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM both_) WHERE rank <= 20)"""


def seeds(spark, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("query_id", "chunk_id", F.col("norm_score").alias("score"), "rank")


@query("multi_hop_retrieve", f"WITH {_multi_hop_sql('true')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM mh")
def multi_hop_retrieve(spark, sf_dir):
    found = iterative.multi_hop_retrieve(seeds(spark, sf_dir), intent.classified(asked(spark, sf_dir)), named_chunks(spark, sf_dir), graph_nodes(spark, sf_dir), graphs.edges(spark, sf_dir))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_WIDE = f"intent IN ({', '.join(repr(i) for i in intent.EXPANDED)})"


@query("enhanced_retrieve", f"""WITH {_multi_hop_sql(_WIDE)}, al AS (SELECT query_id, chunk_id, score, rank FROM mh UNION ALL SELECT query_id, chunk_id, norm_score, rank FROM hits JOIN intents USING (query_id) WHERE NOT {_WIDE}),
p1 AS (SELECT *, exp(score - max(score) OVER (PARTITION BY query_id)) AS ex FROM al), p2 AS (SELECT *, ex / sum(ex) OVER (PARTITION BY query_id) AS p FROM p1), st AS (SELECT query_id, round(CASE WHEN count(*) > 1 THEN sum(CASE WHEN p > 1e-10 THEN -p * ln(p) ELSE 0e0 END) / ln(count(*)) ELSE 0e0 END, 6) AS entropy FROM p2 GROUP BY query_id)
SELECT query_id, chunk_id, rank, intent, {_WIDE} AS expanded, entropy, entropy >= 0.8 AS unsure FROM al JOIN intents USING (query_id) JOIN st USING (query_id)""")
def enhanced_retrieve(spark, sf_dir):
    out = iterative.enhanced(asked(spark, sf_dir), seeds(spark, sf_dir), named_chunks(spark, sf_dir), graph_nodes(spark, sf_dir), graphs.edges(spark, sf_dir), threshold=0.8)
    return out.select("query_id", "chunk_id", "rank", "intent", "expanded", F.round("entropy", 6).alias("entropy"), "unsure")


@query("iterative_retrieve")
def iterative_retrieve(spark, sf_dir):
    """Rounds that depend on the results before; the tests compare with a plain loop."""
    c, q = chunks(spark, sf_dir), asked(spark, sf_dir)
    first = lexical.bm25(c, q, k=20).select("query_id", "chunk_id", F.col("norm_score").alias("score"))
    again = lambda sub: lexical.bm25(c, sub, k=20).select("query_id", "chunk_id", F.col("norm_score").alias("score"), "rank")
    return iterative.iterate(q, first, planner.planned(q), again, rounds=2)


SYMBOLIC = f"sy AS (SELECT item_id AS query_id, replace({_list(['How does DataStore work', 'trace load_file and DataStore', '{w}', 'what is the flow of {w}'])}[item_id % 4 + 1], '{{w}}', lower(text)) AS text FROM benchmark)"


@query("query_programs", f"""WITH {SYMBOLIC}, f AS (SELECT *, list_filter(regexp_extract_all(text, '\\b([A-Z][a-zA-Z0-9]+|[a-z]+_[a-z_]+)\\b', 1), lambda s: s NOT IN ('How', 'What', 'Where', 'When', 'Why')) AS s FROM sy)
SELECT query_id, 'op1' AS op_id, 'semantic_search' AS op_type, text AS query, '' AS depends_on FROM f UNION ALL SELECT query_id, 'op_symbol_' || (i - 1), 'symbol_lookup', s[i], '' FROM (SELECT *, unnest(range(1, least(len(s), 2) + 1)) AS i FROM f)
UNION ALL SELECT query_id, 'op_graph', 'graph_traverse', s[1], 'op_symbol_0' FROM f WHERE len(s) > 0 UNION ALL SELECT query_id, 'op_expand', 'expand_context', text, 'op1' FROM f WHERE regexp_matches(lower(text), 'how does|trace|flow')""")
def query_programs(spark, sf_dir):
    form = F.element_at(F.array(*map(F.lit, ["How does DataStore work", "trace load_file and DataStore", "{w}", "what is the flow of {w}"])), (F.pmod("query_id", F.lit(4)) + 1).cast("int"))
    q = questions(spark, sf_dir).select("query_id", F.replace(form, F.lit("{w}"), F.lower("text")).alias("text"))
    return iterative.programs(q).withColumn("depends_on", F.array_join("depends_on", ","))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"


@query("results_judged", f"""WITH {BM25}, r AS (SELECT h.query_id, avg(len(list_intersect({_WORDS.format('b.text')}, {_WORDS.format('d.text')})) / greatest(1, len({_WORDS.format('b.text')}))) AS m FROM hits h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.chunk_id GROUP BY h.query_id)
SELECT item_id AS query_id, round(coalesce(m, 0e0), 6) AS relevance, CASE WHEN coalesce(m, 0e0) >= 0.6 THEN 'continue' WHEN coalesce(m, 0e0) >= 0.3 THEN 'refine' ELSE 'retry' END AS decision FROM benchmark LEFT JOIN r ON r.query_id = item_id""")
def results_judged(spark, sf_dir):
    return iterative.judged(questions(spark, sf_dir), hits(spark, sf_dir), chunks(spark, sf_dir)).drop("empty")


@query("quality_rounds")
def quality_rounds(spark, sf_dir):
    c, q = named_chunks(spark, sf_dir), asked(spark, sf_dir)
    return iterative.quality_loop(q, lexical.bm25(c, q, k=10), c, lambda sub: lexical.bm25(c, sub, k=10))


@query("scores_by_place", f"WITH {BM25} SELECT query_id, chunk_id, round(1 / rank, 6) AS score FROM hits")
def scores_by_place(spark, sf_dir):
    return iterative.by_place(hits(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("preferred_types", f"""WITH {BM25}, p AS (SELECT query_id, chunk_id, lang IN ('de', 'fr') AS pref, CASE WHEN lang IN ('de', 'fr') THEN norm_score * 1.5 ELSE norm_score END AS score FROM hits JOIN documents ON doc_id = chunk_id)
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(pref, false) DESC, score DESC, chunk_id) AS rank FROM p""")
def preferred_types(spark, sf_dir):
    h = seeds(spark, sf_dir).join(chunks(spark, sf_dir).select("chunk_id", F.col("language").alias("symbol_type")), "chunk_id")
    return iterative.prefer_types(h, ["de", "fr"]).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("focus_folders", f"""WITH {BM25}, f AS (SELECT query_id, 'd' || (chunk_id % 4) || '/' || source AS folder, count(*) AS n FROM hits JOIN documents ON doc_id = chunk_id GROUP BY ALL)
SELECT query_id, folder, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, folder) AS rank FROM f) WHERE rank <= 3""")
def focus_folders(spark, sf_dir):
    c = chunks(spark, sf_dir).select("chunk_id", F.concat(F.lit("d"), (F.col("chunk_id") % 4).cast("string"), F.lit("/"), F.col("file_path"), F.lit("/f.py")).alias("file_path"))
    return iterative.focus_folders(hits(spark, sf_dir), c)


@query("fused_filters", f"""WITH {LISTS}, f AS (SELECT query_id, chunk_id, round(max(score) + CASE WHEN count(*) > 1 THEN 0.2 * log2(count(*)) ELSE 0.0 END + 0.1 * (count(DISTINCT list) - 1), 6) AS score, count(*) AS n_scores FROM l GROUP BY query_id, chunk_id)
SELECT query_id, chunk_id, score >= 0.5 AS scoring, n_scores >= 2 AS several, chunk_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS contract FROM f WHERE score >= 0.5 OR n_scores >= 2 OR chunk_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def fused_filters(spark, sf_dir):
    fused = ranking.fuse(lists(spark, sf_dir), by=("query_id",))
    key = ["query_id", "chunk_id"]
    parts = {"scoring": iterative.scoring(fused, 0.5), "several": iterative.from_sources(fused, 2), "contract": iterative.contracts_only(fused, flags(spark, sf_dir))}
    out = fused.select(*key)
    for name, part in parts.items():
        out = out.join(part.select(*key, F.lit(True).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.where("scoring OR several OR contract")


@query("symbol_lookups", f"WITH {BM25} SELECT query_id, chunk_id FROM hits WHERE contains('N' || chunk_id, 'N' || (query_id % 10))")
def symbol_lookups(spark, sf_dir):
    names = questions(spark, sf_dir).select("query_id", F.concat(F.lit("N"), (F.col("query_id") % 10).cast("string")).alias("name"))
    return iterative.named_like(hits(spark, sf_dir).select("query_id", "chunk_id"), names, named_chunks(spark, sf_dir)).select("query_id", "chunk_id")


# ---- sessions as they are kept ------------------------------------------------------------


def transcript(spark, sf_dir: str) -> DataFrame:
    """Turns with lines of every kind in front of their texts, and tool calls."""
    c = table(spark, sf_dir, "conversations").withColumn("w", F.regexp_extract(F.lower("text"), "[a-z]+", 0))
    heads = F.array(*[F.format_string(x, *([F.col("w")] * x.count("%s"))) for x in ("We'll take %s for this\nAdded the file src/%s.py here", "should we keep the %s as it is?\nTODO: look at %s again", "plain %s", "```python\nclass Box_%s:\n    pass\n```\nDecided on %s for all")])
    k = F.pmod("turn", F.lit(4))
    said = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.lit("text").alias("type"), "role", F.concat(F.element_at(heads, (k + 1).cast("int")), F.lit("\n"), F.regexp_replace("text", "[^a-z \n]", " ")).alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("map<string,string>").alias("input"), F.lit(None).cast("array<struct<content:string,status:string>>").alias("todos"))
    tool = F.element_at(F.array(*map(F.lit, ["Edit", "Read", "Grep", "TodoWrite"])), (k + 1).cast("int"))
    made = F.create_map(F.lit("file_path"), F.concat(F.lit("lib/"), "w", F.lit(".py")), F.lit("new_string"), F.concat(F.lit("def new_"), "w", F.lit("(): pass")))
    todos = F.array(F.struct(F.concat(F.lit("do "), "w").alias("content"), F.lit("pending").alias("status")), F.struct(F.lit("done one").alias("content"), F.lit("completed").alias("status")))
    calls = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.lit("tool_use").alias("type"), "role", F.lit(None).cast("string").alias("text"), tool.alias("name"), F.when(k < 3, made).alias("input"), F.when(k == 3, todos).alias("todos"))
    return said.unionByName(calls)


@query("transcript_extract", r"""WITH c AS (SELECT conv_id, turn, role, turn % 4 AS k, regexp_extract(lower(text), '[a-z]+') AS w, regexp_replace(text, '[^a-z \n]', ' ', 'g') AS rest FROM conversations),
b AS (SELECT conv_id, turn, unnest(string_split(rest, chr(10))) AS line FROM c WHERE role = 'assistant'),
x AS (SELECT conv_id, turn, 'file' AS kind, 'lib/' || w || '.py' AS content, CASE k WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS weight FROM c WHERE k < 3 UNION ALL SELECT conv_id, turn, 'symbol', 'new_' || w, 0 FROM c WHERE k = 0 UNION ALL SELECT conv_id, turn, 'todo', 'do ' || w, 0 FROM c WHERE k = 3
UNION ALL SELECT conv_id, turn, 'file', 'src/' || w || '.py', 1 FROM c WHERE role = 'assistant' AND k = 0 UNION ALL SELECT conv_id, turn, 'decision', 'We''ll take ' || w || ' for this', 0 FROM c WHERE role = 'assistant' AND k = 0 UNION ALL SELECT conv_id, turn, 'activity', 'Added the file src/' || w || '.py here', 0 FROM c WHERE role = 'assistant' AND k = 0
UNION ALL SELECT conv_id, turn, 'question', 'should we keep the ' || w || ' as it is?', 0 FROM c WHERE role = 'assistant' AND k = 1 UNION ALL SELECT conv_id, turn, 'question', 'look at ' || w || ' again', 0 FROM c WHERE role = 'assistant' AND k = 1
UNION ALL SELECT conv_id, turn, 'symbol', 'Box_' || w, 0 FROM c WHERE role = 'assistant' AND k = 3 UNION ALL SELECT conv_id, turn, 'decision', 'Decided on ' || w || ' for all', 0 FROM c WHERE role = 'assistant' AND k = 3
UNION ALL SELECT conv_id, turn, 'decision', trim(line), 0 FROM b WHERE regexp_matches(trim(line), '^(decided|the approach|using|implemented|chose|selected|opted for|going with|the plan is|will use)') AND length(trim(line)) > 10 AND length(trim(line)) < 200
UNION ALL SELECT conv_id, turn, 'activity', trim(line), 0 FROM b WHERE regexp_matches(trim(line), '^(added|created|fixed|updated|refactored|implemented|removed|changed)') AND length(trim(line)) > 10 AND length(trim(line)) < 100)
SELECT conv_id AS session_id, turn AS seq, kind, content, CAST(weight AS INT) AS weight FROM x""")
def transcript_extract(spark, sf_dir):
    return snapshots.extracted(transcript(spark, sf_dir))


@query("session_snapshots")
def session_snapshots(spark, sf_dir):
    """Sessions' snapshots; the tests trim by hand."""
    items = snapshots.kept(snapshots.extracted(transcript(spark, sf_dir)))
    pinned = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.concat(F.lit("keep "), (F.col("conv_id") % 3).cast("string")).alias("content"))
    budget = snapshots.snapshot_budget(F.pmod("session_id", F.lit(3)) * 900)
    out = snapshots.snapshots(items, pinned, budget)
    return out.select("session_id", "tokens", F.md5(snapshots.snapshot_markdown(out)).alias("digest"))


@query("context_packs", f"""WITH {BM25}, h AS (SELECT query_id, string_agg('doc ' || chunk_id, chr(10) || '- ' ORDER BY rank) AS priors FROM hits WHERE rank <= 5 GROUP BY query_id),
p AS (SELECT item_id AS query_id, '## Invariants' || chr(10) || '- keep order' || chr(10) || '- no copies' || coalesce(chr(10) || chr(10) || '## Related' || chr(10) || '- ' || priors, '') || chr(10) || chr(10) || '## Environment' || chr(10) || 'Project type: Python' AS pack_markdown FROM benchmark LEFT JOIN h ON h.query_id = item_id)
SELECT query_id, pack_markdown, length(pack_markdown) // 4 AS tokens_used FROM p""")
def context_packs(spark, sf_dir):
    h = hits(spark, sf_dir).select("query_id", "rank", F.concat(F.lit("doc "), F.col("chunk_id").cast("string")).alias("content"))
    pinned = spark.createDataFrame([("no copies",), ("keep order",), ("no copies",)], "content string")
    return snapshots.context_packs(questions(spark, sf_dir), h, pinned, code.project_type(F.array(F.lit("pyproject.toml"), F.lit("x"))))


@query("simple_edges", f"WITH {graphs.EDGES} SELECT src, dst, max(edge_type) AS edge_type FROM edges GROUP BY src, dst")
def simple_edges(spark, sf_dir):
    return indexing.simple_edges(graphs.edges(spark, sf_dir))


# ---- forms of packs, rounds, summaries -----------------------------------------------------


def pack_rows(spark, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir).join(chunks(spark, sf_dir), "chunk_id").join(flags(spark, sf_dir), "chunk_id", "left")
    marks = {f: F.coalesce(F.col(f), F.lit(False)) for f in ("is_contract", "is_pinned")}
    return h.withColumns(marks | {"start_line": F.lit(1), "end_line": F.size(F.split("content", "\n")), "symbol_name": F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("S<"), F.col("chunk_id").cast("string")))})


PACK_ROWS = f"""{BM25}, pr AS (SELECT h.query_id, h.chunk_id, h.rank, d.text AS content, d.source AS file_path, len(string_split(d.text, chr(10))) AS last, CASE WHEN h.chunk_id % 2 = 0 THEN 'S<' || h.chunk_id END AS symbol, coalesce(toxic, 0) = 1 AS contract, l.doc_id IS NOT NULL AND h.chunk_id % 7 = 0 AS pinned,
  row_number() OVER (PARTITION BY h.query_id ORDER BY d.source, h.chunk_id) AS n FROM hits h JOIN documents d ON d.doc_id = h.chunk_id LEFT JOIN labels l ON l.doc_id = h.chunk_id)"""


@query("pack_xml", f"""WITH {PACK_ROWS}, p AS (SELECT *, '<chunk id="' || n || '" lines="1-' || last || '"' || coalesce(' symbol="S&lt;' || chunk_id || '"', '') || CASE WHEN contract THEN ' contract="true"' ELSE '' END || CASE WHEN pinned THEN ' pinned="true"' ELSE '' END || '><![CDATA[' || replace(content, ']]>', ']]]]><![CDATA[>') || ']]></chunk>' AS part FROM (SELECT * REPLACE (CASE WHEN symbol IS NOT NULL THEN chunk_id END AS chunk_id) FROM pr)),
f AS (SELECT query_id, file_path, min(n) AS first, '<file path="' || file_path || '">' || chr(10) || string_agg(part, chr(10) ORDER BY n) || chr(10) || '</file>' AS text FROM p GROUP BY query_id, file_path)
SELECT query_id, md5('<context>' || chr(10) || string_agg(text, chr(10) ORDER BY first) || chr(10) || '</context>') AS digest FROM f GROUP BY query_id""")
def pack_xml(spark, sf_dir):
    from ..operators import packing

    return packing.xml(pack_rows(spark, sf_dir)).select("query_id", F.md5("pack_xml").alias("digest"))


@query("pack_compact", f"""WITH {PACK_ROWS} SELECT query_id, string_agg('[' || n || '] ' || file_path || ':1' || coalesce(' ' || symbol, '') || ' | ' || substr(trim(regexp_extract(content, '^\\s*([^\\n]*)', 1)), 1, 80), chr(10) ORDER BY n) AS pack_text FROM pr GROUP BY query_id""")
def pack_compact(spark, sf_dir):
    from ..operators import packing

    return packing.compact(pack_rows(spark, sf_dir))


@query("pack_diff", f"""WITH {PACK_ROWS}, a AS (SELECT * FROM pr WHERE rank <= 6), b AS (SELECT * FROM pr WHERE rank >= 3), x AS (SELECT query_id, '+ ' AS mark, file_path || ':1' AS place, chunk_id FROM a WHERE rank < 3 UNION ALL SELECT query_id, '- ', file_path || ':1', chunk_id FROM b WHERE rank > 6)
SELECT query_id, string_agg(mark || place, chr(10) ORDER BY mark, place, chunk_id) AS diff FROM x GROUP BY query_id""")
def pack_diff(spark, sf_dir):
    from ..operators import packing

    p = pack_rows(spark, sf_dir)
    return packing.diff_text(p.where("rank <= 6"), p.where("rank >= 3"))


@query("new_chunk_counts", """WITH r AS (SELECT user_id AS session, CAST(floor(event_id / 200) AS BIGINT) AS seq, event_id % 37 AS chunk_id FROM events), f AS (SELECT session, chunk_id, min(seq) AS seq FROM r GROUP BY ALL), n AS (SELECT session, seq, count(*) AS n FROM f GROUP BY ALL)
SELECT DISTINCT r.session, r.seq, coalesce(n, 0) AS new_chunks FROM r LEFT JOIN n ON n.session = r.session AND n.seq = r.seq""")
def new_chunk_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return metrics.new_counts(e.select(F.col("user_id").alias("session"), F.floor(F.col("event_id") / 200).cast("long").alias("seq"), (F.col("event_id") % 37).alias("chunk_id")))


@query("recent_summary", "SELECT event_type AS name, count(value) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS greatest, round(stddev_pop(value), 6) AS std FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 72 HOUR FROM events) GROUP BY event_type")
def recent_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "name")
    last = e.agg((F.max("ts") - F.expr("INTERVAL '72' HOUR")).alias("_since"))
    return metrics.summary(e.crossJoin(F.broadcast(last)), ["name"], since=F.col("_since"))


@query("files_matching", """WITH f AS (SELECT page_id, (['src/a', 'src/dist/b', 'docs/c', 'test/d'])[page_id % 4 + 1] || page_id || (['.py', '.md'])[page_id % 2 + 1] AS p FROM pages) SELECT page_id FROM f WHERE (starts_with(p, 'src/') OR ends_with(p, '.md')) AND NOT contains(p, '/dist/')""")
def files_matching(spark, sf_dir):
    from ..sources import files

    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("page_id") % n + 1).cast("int"))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(pick(["src/a", "src/dist/b", "docs/c", "test/d"], 4), F.col("page_id").cast("string"), pick([".py", ".md"], 2)).alias("file_path"))
    return files.matching(p, ["src/*", "*.md"], ["dist"]).select("page_id")
