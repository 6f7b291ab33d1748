"""Canonical text of a path graph and of its pattern.

``graph_text``: depth-first from the start, arrows of a node in the order of (property, node), each node expanded once,
``s,p,o,`` per arrow. ``pattern_text``: the same with nodes numbered by first visit and arrows ordered by property;
arrows with the same property are ordered by the walk of property labels that follows them, lengthened until walks
differ, and at last by node code, so the result never depends on input order. It ends in ``@`` and the number of the end.

The graph of a group is the union of a few paths between two endpoints; groups are mapped with applyInPandas.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame


def _adjacent(arrows) -> dict[str, list[tuple[str, str]]]:
    out = defaultdict(set)
    for s, p, o in arrows:
        out[s].add((p, o))
    return {s: sorted(x) for s, x in out.items()}


def graph_text(arrows, start: str) -> str:
    adj, seen, out = _adjacent(arrows), set(), []
    stack = [iter([(None, None, start)])]
    while stack:
        for s, p, o in stack[-1]:
            if s is not None:
                out.append(f"{s},{p},{o},")
            if o not in seen:
                seen.add(o)
                stack.append(iter([(o, q, x) for q, x in adj.get(o, [])]))
                break
        else:
            stack.pop()
    return "".join(out)


def _walk(adj, node: str, depth: int) -> tuple:
    """Sorted property labels of the walks of ``depth`` arrows from ``node``, level by level."""
    level, out = {node}, []
    for _ in range(depth):
        out.append(tuple(sorted(p for n in level for p, _ in adj.get(n, []))))
        level = {o for n in level for _, o in adj.get(n, [])}
    return tuple(out)


def _ordered(adj, node: str) -> list[tuple[str, str]]:
    arrows = adj.get(node, [])
    most = len(adj) + 1

    def rank(group: list[tuple[str, str]]) -> list[tuple[str, str]]:
        if len(group) < 2:
            return group
        depth = 1
        while depth < most and len({_walk(adj, o, depth) for _, o in group}) < len(group):
            depth += 1
        return sorted(group, key=lambda a: (_walk(adj, a[1], depth), a[1]))

    by: dict[str, list] = defaultdict(list)
    for p, o in arrows:
        by[p].append((p, o))
    return [a for p in sorted(by) for a in rank(by[p])]


def pattern_text(arrows, start: str, end: str) -> tuple[str, dict[str, int]]:
    """(canonical text, variable number of each node)."""
    adj, number, out = _adjacent(arrows), {start: 1}, []
    expanded = {start}
    stack = [iter(_ordered(adj, start))]
    nodes = [start]
    while stack:
        s = nodes[-1]
        for p, o in stack[-1]:
            number.setdefault(o, len(number) + 1)
            out.append(f"{number[s]},{p},{number[o]},")
            if o not in expanded:
                expanded.add(o)
                nodes.append(o)
                stack.append(iter(_ordered(adj, o)))
                break
        else:
            stack.pop()
            nodes.pop()
    return "".join(out) + f"@{number.get(end, 0)}", number


def canonical(path_edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, graph, pattern) of the union of each pair's paths. ``path_edges``: pair_id, s, p, o; ``pairs``: pair_id, start, end."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        arrows = list(zip(f["s"], f["p"], f["o"]))
        start, end = f["start"].iloc[0], f["end"].iloc[0]
        return pd.DataFrame({"pair_id": [key[0]], "graph": [graph_text(arrows, start)], "pattern": [pattern_text(arrows, start, end)[0]]})

    e = path_edges.select("pair_id", "s", "p", "o").distinct().join(pairs, "pair_id")
    return e.groupBy("pair_id").applyInPandas(run, "pair_id string, graph string, pattern string")


def variables(path_edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, variable, node): the node that each variable of the canonical pattern stands for."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        number = pattern_text(list(zip(f["s"], f["p"], f["o"])), f["start"].iloc[0], f["end"].iloc[0])[1]
        return pd.DataFrame({"pair_id": key[0], "variable": list(number.values()), "node": list(number)})

    e = path_edges.select("pair_id", "s", "p", "o").distinct().join(pairs, "pair_id")
    return e.groupBy("pair_id").applyInPandas(run, "pair_id string, variable int, node string")
