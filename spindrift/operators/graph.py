"""Operators over a typed graph: ``edges`` (src, dst, edge_type)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut


@dataclass(frozen=True)
class Hop:
    edge_types: tuple[str, ...]
    direction: str  # forward, backward or both
    most: int
    decay: float


# Hops by query intent.
STRATEGIES = {
    "definition": [Hop(("CONTAINS",), "backward", 5, 0.8), Hop(("INHERITS", "IMPLEMENTS"), "forward", 3, 0.6)],
    "implementation": [Hop(("CALLS", "IMPORTS"), "forward", 8, 0.7), Hop(("CONTAINS", "CALLS"), "forward", 5, 0.5)],
    "usage": [Hop(("CALLS",), "backward", 10, 0.8), Hop(("CALLS",), "backward", 5, 0.6), Hop(("REFERENCES", "IMPORTS"), "backward", 5, 0.4)],
    "impact": [Hop(("CALLS", "IMPORTS", "REFERENCES"), "backward", 15, 0.8), Hop(("CALLS", "IMPORTS"), "backward", 10, 0.6), Hop(("CALLS",), "backward", 5, 0.4)],
    "dependencies": [Hop(("IMPORTS", "CALLS", "USES_TYPE"), "forward", 10, 0.8), Hop(("IMPORTS", "INHERITS"), "forward", 8, 0.6), Hop(("IMPORTS",), "forward", 5, 0.4)],
    "default": [Hop(("CALLS", "CONTAINS", "IMPORTS"), "both", 8, 0.7), Hop(("CALLS", "INHERITS"), "both", 5, 0.5)],
}


def directed(edges: DataFrame, direction: str, edge_types: tuple[str, ...] | None = None) -> DataFrame:
    """``a`` -> ``b`` steps of the edges in a direction."""
    if edge_types:
        edges = edges.where(F.col("edge_type").isin(*edge_types))
    ahead = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "edge_type")
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "edge_type")
    return {"forward": ahead, "backward": back}.get(direction) if direction != "both" else ahead.unionByName(back)


def neighbours(edges: DataFrame, nodes: DataFrame, edge_types: tuple[str, ...] | None = None) -> DataFrame:
    """Distinct neighbours (``node``, ``neighbour``), in either direction."""
    steps = directed(edges, "both", edge_types).join(nodes.select(F.col("node").alias("a")), "a", "left_semi")
    return steps.select(F.col("a").alias("node"), F.col("b").alias("neighbour")).where("node <> neighbour").distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 3, direction: str = "backward", edge_types: tuple[str, ...] | None = None) -> DataFrame:
    """``seed``, ``node`` and least ``depth`` of what a seed reaches: unrolled
    joins, each hop from the nodes that the one before has found."""
    steps = directed(edges, direction, edge_types).select("a", "b").distinct()
    found = seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("depth", F.lit(0))
    frontier = found
    for d in range(1, depth + 1):
        step = frontier.join(steps, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct()
        frontier = step.join(found, ["seed", "node"], "left_anti").withColumn("depth", F.lit(d))
        found = found.unionByName(frontier)
    return found


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """What depends on the seeds, with the hops between."""
    return reach(edges, seeds, depth, "backward", ("CALLS", "IMPORTS", "USES_TYPE")).where("depth > 0")


def multi_hop(edges: DataFrame, seeds: DataFrame, strategy: list[Hop], least: float = 0.1) -> DataFrame:
    """``query_id``, ``node``, ``score`` of nodes around scored seeds: each hop
    takes at most ``most`` smallest neighbours of a node and passes the score
    on with its decay; the best score of a node counts."""
    found = seeds.select("query_id", "node", F.col("score").cast("double").alias("score"))
    frontier = found
    for hop in strategy:
        steps = directed(edges, hop.direction, hop.edge_types).select("a", "b").distinct()
        steps = steps.withColumn("n", F.row_number().over(W.partitionBy("a").orderBy("b"))).where(F.col("n") <= hop.most)
        live = frontier.where(F.col("score") >= least)
        near = live.join(steps, F.col("node") == F.col("a")).groupBy("query_id", F.col("b").alias("node")).agg(F.max(F.col("score") * hop.decay).alias("score"))
        frontier = near.join(found, ["query_id", "node"], "left_anti")
        found = found.unionByName(near).groupBy("query_id", "node").agg(F.max("score").alias("score"))
    return found.join(seeds.select("query_id", "node"), ["query_id", "node"], "left_anti").select("query_id", "node", F.round("score", 6).alias("score"))


def paths(edges: DataFrame, starts: DataFrame, depth: int = 3, direction: str = "forward", edge_types: tuple[str, ...] | None = None) -> DataFrame:
    """All simple paths of 1 to ``depth`` steps from the starts, as arrays."""
    steps = directed(edges, direction, edge_types).select("a", "b").distinct()
    now = starts.select(F.array("node").alias("path"))
    out = None
    for _ in range(depth):
        now = now.join(steps, F.element_at("path", -1) == F.col("a")).where(~F.array_contains("path", F.col("b"))).select(F.array_append("path", F.col("b")).alias("path"))
        out = now if out is None else out.unionByName(now)
    return out


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 10, cut_every: int = 5) -> DataFrame:
    """``node``, ``rank`` after a fixed number of rounds: parallel edges count
    once, the mass of nodes without exits is spread evenly. Lineage is cut in
    the checkpoint folder every few rounds."""
    steps = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    nodes = steps.select(F.col("a").alias("node")).union(steps.select("b")).distinct()
    exits = steps.groupBy("a").agg(F.count(F.lit(1)).alias("exits"))
    n = nodes.count()
    base = nodes.join(exits, F.col("node") == F.col("a"), "left").select("node", "exits")
    rank = base.withColumn("rank", F.lit(1.0 / max(n, 1)))
    weighted = steps.join(exits, "a")
    for i in range(rounds):
        got = weighted.join(rank.select(F.col("node").alias("a"), "rank"), "a").groupBy(F.col("b").alias("node")).agg(F.sum(F.col("rank") / F.col("exits")).alias("got"))
        idle = rank.where("exits is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("idle"))
        rank = base.join(got, "node", "left").crossJoin(F.broadcast(idle))  # one row
        rank = rank.select("node", "exits", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("idle") / n)).alias("rank"))
        if (i + 1) % cut_every == 0:
            rank = cut(rank)
    return rank.select("node", F.round("rank", 9).alias("rank"))


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """One star step over links ``u`` > ``v``: every larger (or smaller)
    neighbour of a node is linked to the least node around it."""
    both = links.select("u", "v")
    if larger:
        both = both.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
    moved = both.join(least, F.col("u") == F.col("of"))
    out = moved.where("v > u") if larger else moved
    out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        out = out.unionByName(least.select(F.col("of").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``: the smallest node connected to it. Large and
    small star steps alternate (Kiveris et al., 2014) until a round changes
    nothing, so chains of any length come out whole."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct()
    now = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    seen = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen, now = mark, cut(_star(_star(now, True), False))
    return nodes.join(now, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Label propagation with fixed rounds: the commonest label around a node
    (ties: the smallest); deterministic, unlike modularity with random order."""
    both = directed(edges, "both").select("a", "b").distinct()
    label = both.select(F.col("a").alias("node")).union(both.select("b")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(label, F.col("b") == F.col("node")).groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("a").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("new"))
        label = label.join(best, F.col("node") == F.col("a"), "left").select("node", F.coalesce("new", "label").alias("label"))
    return label


def resolved(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbol references (``src``, ``file_path``, ``name``) to nodes: a symbol
    of the same file first, else the latest of that name."""
    here = symbols.groupBy("file_path", "name").agg(F.max_by("node_id", F.struct("start_line", "node_id")).alias("local"))
    anywhere = symbols.groupBy("name").agg(F.max_by("node_id", F.struct("file_path", "start_line", "node_id")).alias("globally"))
    joined = references.join(here, ["file_path", "name"], "left").join(anywhere, "name", "left")
    return joined.withColumn("dst", F.coalesce("local", "globally")).where("dst is not null").drop("local", "globally")


def related_contracts(implementors: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """Contracts within ``depth`` steps of a chunk over the table of contracts
    (``contract_id``) and the chunks that implement them (``chunk_id``). Steps
    go from contract to contract, which are few, not over all chunks between."""
    links = implementors.select("contract_id", "chunk_id").distinct()
    steps = links.join(links.select(F.col("contract_id").alias("next"), "chunk_id"), "chunk_id").where("contract_id <> next").select("contract_id", "next").distinct()
    found = starts.select("chunk_id").distinct().join(links, "chunk_id").select(F.col("chunk_id").alias("start"), "contract_id").withColumn("depth", F.lit(1))
    frontier = found
    for d in range(2, depth + 1):
        step = frontier.join(steps, "contract_id").select("start", F.col("next").alias("contract_id")).distinct()
        frontier = step.join(found, ["start", "contract_id"], "left_anti").withColumn("depth", F.lit(d))
        found = found.unionByName(frontier)
    return found
