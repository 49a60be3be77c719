"""Queries: graph operators over the keys of the order tables, and parsed code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..sources import chunking
from .base import chunks, query, table


def edges(spark, sf_dir: str) -> DataFrame:
    """Customers call nations, suppliers import nations, nations are contained in regions, suppliers inherit from customers of the same number."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    parts = [
        c.select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst"), F.lit("CALLS").alias("edge_type")),
        s.select(key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst"), F.lit("IMPORTS").alias("edge_type")),
        n.select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"), F.lit("CONTAINS").alias("edge_type")),
        s.select(key("s", "s_suppkey").alias("src"), key("c", "s_suppkey").alias("dst"), F.lit("INHERITS").alias("edge_type")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EDGES = """edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'CALLS' AS edge_type FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'IMPORTS' FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'CONTAINS' FROM nation UNION ALL SELECT 's' || s_suppkey, 'c' || s_suppkey, 'INHERITS' FROM supplier)"""


def nodes(spark, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


@query("graph_neighbors", f"WITH {EDGES} SELECT DISTINCT 'n3' AS node, CASE WHEN src = 'n3' THEN dst ELSE src END AS neighbour FROM edges WHERE 'n3' IN (src, dst)")
def graph_neighbors(spark, sf_dir):
    return graph.neighbours(edges(spark, sf_dir), nodes(spark, "n3"))


@query("graph_bfs", f"""WITH RECURSIVE {EDGES}, r AS (SELECT 's1' AS node, 0 AS depth UNION SELECT e.dst, depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE depth < 3)
SELECT 's1' AS seed, node, min(depth) AS depth FROM r GROUP BY node""")
def graph_bfs(spark, sf_dir):
    return graph.reach(edges(spark, sf_dir), nodes(spark, "s1"), 3, "forward")


@query("graph_impact", f"""WITH RECURSIVE {EDGES}, r AS (SELECT 'n5' AS node, 0 AS depth UNION SELECT e.src, depth + 1 FROM r JOIN edges e ON e.dst = r.node AND e.edge_type IN ('CALLS', 'IMPORTS', 'USES_TYPE') WHERE depth < 3)
SELECT 'n5' AS seed, node, min(depth) AS depth FROM r WHERE node <> 'n5' GROUP BY node""")
def graph_impact(spark, sf_dir):
    return graph.impact(edges(spark, sf_dir), nodes(spark, "n5"))


@query("graph_paths", f"""WITH RECURSIVE {EDGES}, p AS (SELECT ['s1'] AS path UNION ALL SELECT list_append(path, e.dst) FROM p JOIN edges e ON e.src = path[-1] WHERE len(path) <= 3 AND NOT list_contains(path, e.dst))
SELECT DISTINCT array_to_string(path, '>') AS path FROM p WHERE len(path) > 1""")
def graph_paths(spark, sf_dir):
    return graph.paths(edges(spark, sf_dir), nodes(spark, "s1"), 3).select(F.array_join("path", ">").alias("path"))


@query("graph_multihop", f"""WITH {EDGES}, b AS (SELECT dst AS a, src AS b, edge_type FROM edges), s0 AS (SELECT 1 AS query_id, 'n3' AS node, 1e0 AS score UNION ALL SELECT 1, 'n4', 0.5e0),
t1 AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS n FROM (SELECT DISTINCT a, b FROM b WHERE edge_type = 'CALLS')) WHERE n <= 10),
h1 AS (SELECT query_id, b AS node, max(score * 0.8) AS score FROM s0 JOIN t1 ON a = node WHERE score >= 0.1 GROUP BY ALL),
f1 AS (SELECT h1.* FROM h1 LEFT JOIN s0 USING (query_id, node) WHERE s0.score IS NULL),
t2 AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS n FROM (SELECT DISTINCT a, b FROM b WHERE edge_type = 'CALLS')) WHERE n <= 5),
h2 AS (SELECT query_id, b AS node, max(score * 0.6) AS score FROM f1 JOIN t2 ON a = node WHERE score >= 0.1 GROUP BY ALL),
al AS (SELECT query_id, node, max(score) AS score FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL)
SELECT query_id, node, round(score, 6) AS score FROM al WHERE node NOT IN (SELECT node FROM s0)""")
def graph_multihop(spark, sf_dir):
    seeds = spark.createDataFrame([(1, "n3", 1.0), (1, "n4", 0.5)], "query_id int, node string, score double")
    return graph.multi_hop(edges(spark, sf_dir), seeds, graph.STRATEGIES["usage"])


def _pagerank_sql(rounds: int) -> str:
    out = f"""WITH {EDGES}, st AS (SELECT DISTINCT src AS a, dst AS b FROM edges), nd AS (SELECT a AS node FROM st UNION SELECT b FROM st), ex AS (SELECT a, count(*) AS exits FROM st GROUP BY a),
c AS (SELECT count(*) AS n FROM nd), r0 AS (SELECT node, exits, 1e0 / n AS rank FROM nd LEFT JOIN ex ON a = node, c)"""
    for i in range(rounds):
        out += f""",
r{i + 1} AS (SELECT r.node, r.exits, 0.15 / n + 0.85 * (coalesce(got, 0e0) + idle / n) AS rank FROM r{i} r LEFT JOIN (SELECT b AS node, sum(rank / exits) AS got FROM st JOIN r{i} ON node = a GROUP BY b) g ON g.node = r.node,
  (SELECT coalesce(sum(rank), 0e0) AS idle FROM r{i} WHERE exits IS NULL), c)"""
    return out + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@query("pagerank_10iter", _pagerank_sql(10))
def pagerank_10iter(spark, sf_dir):
    return graph.pagerank(edges(spark, sf_dir))


@query("components", f"""WITH RECURSIVE {EDGES}, e AS (SELECT DISTINCT src AS a, dst AS b FROM edges WHERE edge_type IN ('CONTAINS', 'IMPORTS') UNION SELECT dst, src FROM edges WHERE edge_type IN ('CONTAINS', 'IMPORTS')),
r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT node, min(other) AS component FROM r GROUP BY node""")
def components(spark, sf_dir):
    return graph.components(edges(spark, sf_dir).where("edge_type IN ('CONTAINS', 'IMPORTS')"))


def _communities_sql(rounds: int) -> str:
    out = f"WITH {EDGES}, u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), l0 AS (SELECT DISTINCT a AS node, a AS label FROM u)"
    for i in range(rounds):
        out += f""",
v{i} AS (SELECT u.a, l.label, count(*) AS n FROM u JOIN l{i} l ON l.node = u.b GROUP BY ALL), l{i + 1} AS (SELECT a AS node, label FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, label) AS r FROM v{i}) WHERE r = 1)"""
    return out + f" SELECT node, label FROM l{rounds}"


@query("communities", _communities_sql(5))
def communities(spark, sf_dir):
    return graph.communities(edges(spark, sf_dir))


IMPLEMENTORS = """i AS (SELECT 'n' || c_nationkey AS contract_id, c_custkey AS chunk_id FROM customer UNION SELECT 'm' || c_mktsegment, c_custkey FROM customer)"""


def implementors(spark, sf_dir: str) -> DataFrame:
    """A customer implements the contracts of its nation and of its market."""
    c = table(spark, sf_dir, "customer")
    parts = [c.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("contract_id"), F.col("c_custkey").alias("chunk_id")) for p, k in (("n", "c_nationkey"), ("m", "c_mktsegment"))]
    return parts[0].unionByName(parts[1])


@query("related_contracts", f"""WITH {IMPLEMENTORS}, st AS (SELECT DISTINCT a.contract_id AS a, b.contract_id AS b FROM i a JOIN i b USING (chunk_id)), d1 AS (SELECT DISTINCT chunk_id AS start, contract_id FROM i), d2 AS (SELECT DISTINCT start, b AS contract_id FROM d1 JOIN st ON a = contract_id)
SELECT start, contract_id, 1 AS depth FROM d1 UNION ALL SELECT start, contract_id, 2 FROM (SELECT * FROM d2 EXCEPT SELECT * FROM d1)""")
def related_contracts(spark, sf_dir):
    i = implementors(spark, sf_dir)
    return graph.related_contracts(i, i.select("chunk_id"))


@query("components_chain", """WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier WHERE s_suppkey % 40 <> 0), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS other FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.other) SELECT node, min(other) AS component FROM r GROUP BY node""")
def components_chain(spark, sf_dir):
    """Chains of forty, where labels that move one step a round would need as many rounds."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 40 <> 0")
    return graph.components(s.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 1).alias("dst")))


@query("chunk_lines")
def chunk_lines(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return chunking.chunks(c.select(F.concat("file_path", F.lit("/"), F.col("chunk_id").cast("string"), F.lit(".txt")).alias("file_path"), "content", F.lit("text").alias("language")))


def code_files(spark, sf_dir: str) -> DataFrame:
    """A Python file for every document: a class that inherits from another
    one's, a method that calls another one's function, an import, a call at the
    top, and the whole text as comments."""
    n, text = F.col("doc_id"), F.concat(F.lit("# "), F.regexp_replace(F.coalesce("text", F.lit("")), "[\\r\\n\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]", "\n# "))
    put = lambda form, **of: _filled(F.lit(form), of)
    content = put(
        "from mod import Base{c}\n\nclass Base{i}(Base{b}):\n    def area(self):\n        return make{a}()\n\ndef make{i}():\n    return 1\n\nmake{b}()\n",
        i=n, a=F.floor(n * 7 / 10).cast("long"), b=F.floor(n / 2).cast("long"), c=F.floor(n / 3).cast("long"),
    )
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("app/f"), n.cast("string"), F.lit(".py")).alias("file_path"), F.concat(content, text, F.lit("\n")).alias("content"), F.lit("python").alias("language"))


def _filled(form, of: dict):
    for k, v in of.items():
        form = F.replace(form, F.lit(f"{{{k}}}"), v.cast("string"))
    return form


CODE_EDGES = """d AS (SELECT doc_id AS i, CAST(floor(doc_id * 7 / 10) AS BIGINT) AS a, CAST(floor(doc_id / 2) AS BIGINT) AS b, CAST(floor(doc_id / 3) AS BIGINT) AS c FROM documents),
k AS (SELECT *, 'file:app/f' || i || '.py' AS f, 'class:app/f' || i || '.py:Base' || i AS k, 'method:app/f' || i || '.py:Base' || i || '.area' AS m, 'function:app/f' || i || '.py:make' || i AS g FROM d),
ce AS (SELECT f AS src, k AS dst, 'CONTAINS' AS edge_type FROM k UNION ALL SELECT k, m, 'CONTAINS' FROM k UNION ALL SELECT f, g, 'CONTAINS' FROM k UNION ALL SELECT x.f, y.k, 'IMPORTS' FROM k x JOIN k y ON y.i = x.c
  UNION ALL SELECT x.k, y.k, 'INHERITS' FROM k x JOIN k y ON y.i = x.b AND y.i <> x.i UNION ALL SELECT x.m, y.g, 'CALLS' FROM k x JOIN k y ON y.i = x.a UNION ALL SELECT x.f, y.g, 'CALLS' FROM k x JOIN k y ON y.i = x.b)"""


@query("code_graph", f"WITH {CODE_EDGES} SELECT src, dst, edge_type FROM ce")
def code_graph(spark, sf_dir):
    return chunking.graph(code_files(spark, sf_dir))[1]


@query("code_nodes", f"""WITH {CODE_EDGES} SELECT node_type, count(*) AS n, min(start_line) AS first, max(start_line) AS last FROM (SELECT 'file' AS node_type, 1 AS start_line FROM k UNION ALL SELECT 'class', 3 FROM k UNION ALL SELECT 'method', 4 FROM k UNION ALL SELECT 'function', 7 FROM k) GROUP BY node_type""")
def code_nodes(spark, sf_dir):
    n = chunking.graph(code_files(spark, sf_dir))[0]
    return n.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.min("start_line").alias("first"), F.max("start_line").alias("last"))


@query("code_symbols", """WITH s AS (SELECT 'app/f' || doc_id || '.py' AS file_path, 'Base' || doc_id AS name, 3 AS line, 'class' AS symbol_type FROM documents UNION ALL SELECT 'app/f' || doc_id || '.py', 'area', 4, 'function' FROM documents UNION ALL SELECT 'app/f' || doc_id || '.py', 'make' || doc_id, 7, 'function' FROM documents),
r AS (SELECT *, CASE WHEN lower(name) = 'base1' THEN 1e0 WHEN starts_with(lower(name), 'base1') THEN 0.9e0 WHEN contains(lower(name), 'base1') THEN 0.7e0 END AS score FROM s) SELECT file_path, name, line, symbol_type, score FROM r WHERE score IS NOT NULL ORDER BY score DESC, file_path, line LIMIT 30""")
def code_symbols(spark, sf_dir):
    from ..operators.lexical import symbol_search

    return symbol_search(code_files(spark, sf_dir), "base1").select("file_path", "name", "line", "symbol_type", "score")
