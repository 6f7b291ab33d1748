"""Relation paths between pairs of nodes: level-synchronous bidirectional expansion and a meet join.

All pairs are searched at once. A partial path is a row (pair_id, node, path, nodes, depth): ``path`` the alternating
codes ``node prop node ...``, ``nodes`` its nodes. The left side grows ceil(L/2) levels from the start, the right side
floor(L/2) from the end (its paths already point to the end); both include depth 0, so every simple path of at most L
edges has a node where the halves meet. Neither side grows past the opposite endpoint. A level is one join with the
edges (a table, or a stored graph, where a frontier of a few nodes reads only the files that hold them); the frontier is
broadcast if it is counted to be small, and duplicates (repeated edges) go after the join.

Defined results: a path never repeats a node; a pair whose ends are equal has no path; nulls in pairs or edges match
nothing; equal paths are given once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..session import cut, together
from ..sources.tables import small
from .graph import Stored, degree, toggle, with_inverse

#: Nodes of a frontier that are looked up in a stored graph as constants, so that files and row groups are pruned.
FEW = 10
#: Rows of a frontier that may be broadcast: about 100 bytes of nodes each.
BROADCAST_ROWS = 50_000

PARTIAL = ("pair_id", "node", "path", "nodes", "depth", "stop")


def _seed(pairs: DataFrame, at: str, stop: str) -> DataFrame:
    return pairs.select("pair_id", F.col(at).alias("node"), F.array(at).alias("path"), F.array(at).alias("nodes"), F.lit(0).alias("depth"), F.col(stop).alias("stop")).where("node is not null and stop is not null")


def _edges(edges: DataFrame | Stored, cfg: SearchConfig) -> DataFrame | Stored:
    e = edges
    if cfg.ignored_properties:
        e = e.where(~F.col("p").isin(*cfg.ignored_properties))
    if cfg.ignored_nodes:
        e = e.where(~F.col("s").isin(*cfg.ignored_nodes) & ~F.col("o").isin(*cfg.ignored_nodes))
    return e


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end among ``nodes`` (distinct, small): two probes per edge in one scan, before directions are unfolded."""
    at = lambda c: F.broadcast(nodes.select(F.col("node").alias(c), F.lit(True).alias(f"__{c}")))
    return edges.join(at("s"), "s", "left").join(at("o"), "o", "left").where("__s is not null or __o is not null").select("s", "p", "o")


def expand(partial: DataFrame, n_rows: int, edges: DataFrame | Stored, side: str, cfg: SearchConfig, domain: DataFrame | None = None, first: bool = False, classed: DataFrame | None = None) -> DataFrame:
    """One level: every partial path with every edge of its node that leads to a new node. With ``classed`` (one column
    node) both ends of the edge need a class."""
    grow = partial.where(F.col("node") != F.col("stop"))
    if classed is not None:
        grow = grow.join(small(classed.select("node").distinct()), "node", "left_semi")
    tiny = n_rows <= BROADCAST_ROWS
    if isinstance(edges, Stored) and n_rows <= FEW:
        adj = edges.around([r["node"] for r in grow.select("node").distinct().collect()])  # at most FEW
    else:
        plain = edges.by_subject if isinstance(edges, Stored) else edges
        adj = with_inverse(touching(plain, grow.select("node").distinct()) if tiny else plain)
    if cfg.max_links is not None and not first:
        hubs = degree(adj.distinct()).where(F.col("n") >= cfg.max_links).select("node")
        grow = grow.join(hubs, "node", "left_anti")
    if cfg.max_rows is not None:
        size = grow.groupBy("node").agg(F.count(F.lit(1)).alias("k")).join(degree(adj), "node").agg(F.sum(F.col("k") * F.col("n"))).first()[0] or 0
        if size > cfg.max_rows:
            raise ValueError(f"the next level would have up to {size} rows, more than {cfg.max_rows}")
    for gate in (domain, classed):
        if gate is not None:
            adj = adj.join(small(gate.select(F.col("node").alias("o")).distinct()), "o", "left_semi")
    e = adj.select(F.col("s").alias("node"), "p", "o")
    joined = e.join(F.broadcast(grow), "node") if tiny else e.join(grow, "node")
    new = joined.where(~F.array_contains("nodes", F.col("o")))
    path = F.concat("path", F.array("p", "o")) if side == "L" else F.concat(F.array(F.col("o"), toggle(F.col("p"))), "path")
    return new.select("pair_id", F.col("o").alias("node"), path.alias("path"), F.concat("nodes", F.array("o")).alias("nodes"), (F.col("depth") + 1).alias("depth"), "stop").dropDuplicates(["pair_id", "path"])


def one_side(pairs: DataFrame, edges: DataFrame | Stored, side: str, levels: int, cfg: SearchConfig, domain: DataFrame | None = None, classed: DataFrame | None = None) -> DataFrame:
    """Partial paths of depth 0 to ``levels`` from the start (L) or to the end (R)."""
    edges = _edges(edges, cfg)
    level = _seed(pairs, "start", "end") if side == "L" else _seed(pairs, "end", "start")
    out, n = level, level.count() if levels else 0
    for k in range(levels):
        level = expand(level, n, edges, side, cfg, domain, first=k == 0, classed=classed)
        if k < levels - 1:
            level = cut(level)
            n = level.count()
        out = out.unionByName(level)
    return out


def find_paths(pairs: DataFrame, edges: DataFrame | Stored, cfg: SearchConfig = SearchConfig(), domain: DataFrame | None = None, classed: DataFrame | None = None) -> DataFrame:
    """(pair_id, path array, len) of all simple paths of 1 to ``cfg.length`` edges. ``pairs``: pair_id, start, end.

    ``domain``: nodes that may be entered; ``classed``: nodes that have a class, needed at both ends of every edge taken.
    """
    left, right = together(*[lambda side=side, n=n: one_side(pairs, edges, side, n, cfg, domain, classed) for side, n in (("L", cfg.left), ("R", cfg.right))])
    r = right.select("pair_id", "node", F.col("path").alias("rpath"), F.col("nodes").alias("rnodes"), F.col("depth").alias("rdepth"))
    met = left.join(r, ["pair_id", "node"]).where((F.size(F.array_intersect("nodes", "rnodes")) == 1) & (F.col("depth") + F.col("rdepth")).between(1, cfg.length))
    return met.select("pair_id", F.expr("concat(path, slice(rpath, 2, size(rpath)))").alias("path"), (F.col("depth") + F.col("rdepth")).alias("len")).distinct()


def meet_nodes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes of a pair reached from both sides."""
    return left.select("pair_id", "node").join(right.select("pair_id", "node"), ["pair_id", "node"], "left_semi").distinct()


def last_round(pairs: DataFrame, edges: DataFrame | Stored, cfg: SearchConfig = SearchConfig(), domain: DataFrame | None = None) -> DataFrame:
    """(pair_id, node, round): meet nodes by the round that finds them first. Round 1: at the last level but not before it;
    round 2: the whole last frontier of both sides is extended once more, and the sides meet at a node that they had not.

    Paths through nodes of round 2 are longer than ``cfg.length``, so ``find_paths`` has no more paths for it.
    """
    deep = dict(zip("LR", together(*[lambda side=side, n=n: one_side(pairs, edges, side, n + 1, cfg, domain) for side, n in (("L", cfg.left), ("R", cfg.right))])))
    met = [meet_nodes(*[deep[s].where(F.col("depth") <= n + k) for s, n in (("L", cfg.left), ("R", cfg.right))]) for k in (-1, 0, 1)]
    return new_nodes(met[1], met[0]).withColumn("round", F.lit(1)).unionByName(new_nodes(met[2], met[1]).withColumn("round", F.lit(2)))


def new_nodes(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    return nodes.join(seen.select(nodes.columns), nodes.columns, "left_anti").distinct()


def pairs_of(spark, ends: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in ends], "pair_id string, start string, end string")
