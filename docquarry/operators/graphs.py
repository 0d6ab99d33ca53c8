"""Flows, matchings, covers and schedules, one graph or job list a group."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Flow:
    """A network of paired edges; max_flow runs blocking flows over level graphs."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.out: dict = defaultdict(list)

    def add(self, u, v, capacity: int) -> None:
        if capacity < 0:
            raise ValueError("capacities must not be negative")
        for a, b, c in ((u, v, capacity), (v, u, 0)):
            self.out[a].append(len(self.to))
            self.to.append(b)
            self.room.append(int(c))

    def levels(self, source) -> dict:
        level, waiting = {source: 0}, deque([source])
        while waiting:
            u = waiting.popleft()
            for e in self.out[u]:
                if self.room[e] and self.to[e] not in level:
                    level[self.to[e]] = level[u] + 1
                    waiting.append(self.to[e])
        return level

    def max_flow(self, source, sink) -> int:
        if source == sink:
            return 0
        total = 0
        while sink in (level := self.levels(source)):
            at = dict.fromkeys(self.out, 0)
            path: list[int] = []
            u = source
            while True:
                if u == sink:
                    least = min(self.room[e] for e in path)
                    total += least
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    path, u = [], source
                    continue
                edges = self.out[u]
                while at[u] < len(edges) and not (self.room[edges[at[u]]] and level.get(self.to[edges[at[u]]]) == level[u] + 1):
                    at[u] += 1
                if at[u] < len(edges):
                    path.append(edges[at[u]])
                    u = self.to[path[-1]]
                elif path:
                    e = path.pop()
                    u = self.to[e ^ 1]
                    at[u] += 1
                else:
                    break
        return total

    def source_side(self, source) -> set:
        return set(self.levels(source))


def max_flows(edges: DataFrame, graph: str, u: str, v: str, capacity: str, source, sink) -> DataFrame:
    """(graph, max_flow, source_side): the flow value and the sorted nodes on the source's side of a minimum cut, per graph."""
    of, node = (edges.select(F.col(c).alias("x")).dtypes[0][1] for c in (graph, u))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        net = Flow()
        for a, b, c in zip(rows["u"], rows["v"], rows["c"], strict=True):
            net.add(a, b, c)
        value = net.max_flow(source, sink)
        return pd.DataFrame({"graph": [rows["graph"].iloc[0]], "max_flow": [value], "source_side": [sorted(net.source_side(source))]})

    named = edges.select(F.col(graph).alias("graph"), F.col(u).alias("u"), F.col(v).alias("v"), F.col(capacity).cast("long").alias("c"))
    return named.groupBy("graph").applyInPandas(run, f"graph {of}, max_flow bigint, source_side array<{node}>")


def cut_edges(edges: DataFrame, flows: DataFrame, graph: str, u: str, v: str) -> DataFrame:
    """Edges that cross from the source's side to the other: the bottleneck."""
    sides = flows.select(F.col("graph").alias(graph), "source_side")
    return edges.join(sides, graph).where(F.array_contains("source_side", F.col(u)) & ~F.array_contains("source_side", F.col(v))).drop("source_side")


def matching(pairs: Sequence[tuple]) -> dict:
    """A largest matching, right to left, by shortest augmenting paths; left nodes in order of their first edge."""
    near: dict = defaultdict(list)
    for a, b in pairs:
        near[a].append(b)
    right: dict = {}
    left: dict = {}
    for start in near:
        back, waiting, end = {}, deque([start]), None
        while waiting and end is None:
            a = waiting.popleft()
            for b in near[a]:
                if b not in back:
                    back[b] = a
                    if b not in right:
                        end = b
                        break
                    waiting.append(right[b])
        while end is not None:
            a = back[end]
            end_before = left.get(a)
            right[end], left[a] = a, end
            end = end_before
    return right


def matchings(edges: DataFrame, graph: str, left: str, right: str) -> DataFrame:
    """(graph, left, right): a largest bipartite matching of each graph."""
    of, a, b = (edges.select(F.col(c).alias("x")).dtypes[0][1] for c in (graph, left, right))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["l", "r"])
        held = matching(list(zip(rows["l"], rows["r"], strict=True)))
        return pd.DataFrame([(rows["graph"].iloc[0], x, y) for y, x in held.items()], columns=["graph", "left", "right"])

    named = edges.select(F.col(graph).alias("graph"), F.col(left).alias("l"), F.col(right).alias("r"))
    return named.groupBy("graph").applyInPandas(run, f"graph {of}, left {a}, right {b}")


def vertex_cover(edges: Sequence[tuple]) -> set:
    """Both ends of every edge that isn't covered yet, in order: at most twice the least cover. A self-loop adds its node."""
    cover: set = set()
    for a, b in edges:
        if a not in cover and b not in cover:
            cover |= {a, b}
    return cover


def least_cover(edges: Sequence[tuple], most: int = 20) -> set:
    """The smallest cover, by branching on an uncovered edge; for small graphs."""
    if len({x for e in edges for x in e}) > most:
        raise ValueError(f"exact covers are for at most {most} nodes")
    best = vertex_cover(edges)

    def branch(left: list[tuple], chosen: set) -> None:
        nonlocal best
        left = [e for e in left if not chosen & set(e)]
        if not left:
            best = chosen if len(chosen) < len(best) else best
        elif len(chosen) + 1 < len(best):
            for x in sorted(set(left[0])):
                branch(left, chosen | {x})

    branch(list(edges), set())
    return best


def uncovered(edges: DataFrame, cover: DataFrame, u: str, v: str, node: str) -> DataFrame:
    """Edges of which neither end is in the cover; none for a cover."""
    a, b = cover.select(F.col(node).alias("_a")), cover.select(F.col(node).alias("_b"))
    return edges.join(a, F.col(u) == F.col("_a"), "left_anti").join(b, F.col(v) == F.col("_b"), "left_anti")


def covers(edges: DataFrame, graph: str, u: str, v: str) -> DataFrame:
    """(graph, node): the twofold cover of each graph, edges in order."""
    of, node = (edges.select(F.col(c).alias("x")).dtypes[0][1] for c in (graph, u))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["u", "v"])
        return pd.DataFrame([(rows["graph"].iloc[0], x) for x in sorted(vertex_cover(list(zip(rows["u"], rows["v"], strict=True))))], columns=["graph", "node"])

    named = edges.select(F.col(graph).alias("graph"), F.col(u).alias("u"), F.col(v).alias("v"))
    return named.groupBy("graph").applyInPandas(run, f"graph {of}, node {node}")


def schedule(lengths: Sequence[int], machines: int, longest_first: bool = False) -> int:
    """Finish of list scheduling: each job to the least loaded machine, the first of them on ties."""
    loads = [(0, k) for k in range(machines)]
    for n in sorted(lengths, reverse=True) if longest_first else lengths:
        load, k = heapq.heappop(loads)
        heapq.heappush(loads, (load + n, k))
    return max(load for load, _ in loads)


def makespan_bound(total: Column, longest: Column, machines: int) -> Column:
    return F.greatest(F.ceil(total / F.lit(machines)), longest)


def makespans(jobs: DataFrame, group: str, order: str, length: str, machines: int) -> DataFrame:
    """(group, listed, longest_first, bound) finish times of each group's jobs."""
    of = jobs.select(F.col(group).alias("x")).dtypes[0][1]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows.sort_values("o")["n"].tolist()
        return pd.DataFrame({"group": [rows["group"].iloc[0]], "listed": [schedule(n, machines)], "longest_first": [schedule(n, machines, True)], "bound": [max(-(-sum(n) // machines), max(n))]})

    named = jobs.select(F.col(group).alias("group"), F.col(order).alias("o"), F.col(length).cast("long").alias("n"))
    return named.groupBy("group").applyInPandas(run, f"group {of}, listed bigint, longest_first bigint, bound bigint")
