"""One-to-one matching of overlapping label pairs with the largest total weight."""

from __future__ import annotations

from collections.abc import Iterable
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .graph import graph_components


def _ranked(edges: DataFrame, keys, side: str, other: str) -> DataFrame:
    """Per label of one side: its best edge, and the largest weight among its other edges."""
    best = edges.groupBy(*keys, side).agg(F.max(F.struct("w", (-F.col(other)).alias("q"))).alias("_b"))
    best = best.select(*keys, side, (-F.col("_b.q")).alias(f"{side}_best"))
    second = F.max(F.when(F.col(other) != F.col(f"{side}_best"), F.col("w")))
    return (edges.join(best, [*keys, side]).groupBy(*keys, side)
            .agg(F.first(f"{side}_best").alias(f"{side}_best"), F.coalesce(second, F.lit(0.0)).alias(f"{side}_second")))


def settle(edges: DataFrame, keys) -> DataFrame:
    """Edges that belong to some best matching for sure.

    An edge that is the best at both ends and weighs at least as much as the two best alternatives at its ends together
    can replace whatever a matching holds there without loss, so taking it keeps the optimum.
    """
    return (edges.join(_ranked(edges, keys, "t", "p"), [*keys, "t"]).join(_ranked(edges, keys, "p", "t"), [*keys, "p"])
            .filter((F.col("p") == F.col("t_best")) & (F.col("t") == F.col("p_best"))
                    & (F.col("w") >= F.col("t_second") + F.col("p_second")))
            .select(*keys, "t", "p"))


SCALE = 2.0 ** 80  # a weight of 2^-28 or more times this is a whole number, so that prices are exact


def assign(edges: Iterable[tuple[int, int, int]], n_left: int, n_right: int) -> tuple[list[int], list[int], list[int]]:
    """Maximum-weight matching of a sparse bipartite graph with whole-number weights > 0.

    Returns the right partner of every left node (-1: none) and prices u, v of the nodes. All prices are >= 0, u + v >= weight on
    every edge, equal on matched ones, and 0 at free nodes; so the sum of the prices is the sum of the matched weights, which
    proves it the largest. Left nodes enter one by one: a shortest path search over the slacks, no wider than the newcomer's
    price, ends at a free right node or at a left node that gives way.
    """
    near: list[list[tuple[int, int]]] = [[] for _ in range(n_left)]
    for a, b, w in edges:
        near[a].append((b, w))
    right, left = [-1] * n_left, [-1] * n_right
    u, v = [0] * n_left, [0] * n_right
    for start in range(n_left):
        u[start] = max((w - v[b] for b, w in near[start]), default=0)
        if u[start] <= 0:
            u[start] = 0
            continue
        reached_left, reached_right, came = {start: 0}, {}, {}
        best, give, free = u[start], start, -1
        heap, node, base = [], start, 0
        while True:
            for b, w in near[node]:
                d = base + u[node] + v[b] - w
                if b not in reached_right and d < best and d < came.get(b, (best,))[0]:
                    came[b] = (d, node)
                    heappush(heap, (d, b))
            while heap and heap[0][1] in reached_right:
                heappop(heap)
            if not heap or heap[0][0] >= best:
                break
            base, b = heappop(heap)
            reached_right[b] = base
            if left[b] < 0:
                best, give, free = base, -1, b
                break
            node = left[b]
            reached_left[node] = base
            if base + u[node] < best:
                best, give = base + u[node], node
        for a, d in reached_left.items():
            u[a] -= best - min(d, best)
        for b, d in reached_right.items():
            v[b] += best - min(d, best)
        b = free if give < 0 else right[give]
        if give >= 0:
            right[give] = -1
        while b >= 0 and give != start:
            a = came[b][1]
            b_next, right[a], left[b] = right[a], b, a
            if a == start:
                break
            b = b_next
    return right, u, v


def _assign_component(pdf: pd.DataFrame) -> pd.DataFrame:
    t, ti = np.unique(pdf["t"].to_numpy(), return_inverse=True)
    p, pi = np.unique(pdf["p"].to_numpy(), return_inverse=True)
    weight = [int(w) for w in pdf["w"].to_numpy(float) * SCALE]
    partner, _, _ = assign(zip(ti.tolist(), pi.tolist(), weight, strict=True), len(t), len(p))
    keep = np.array(partner)[ti] == pi
    return pdf[keep].drop(columns=["w", "root"])


def best_assignment(edges: DataFrame, keys=("image_id",)) -> DataFrame:
    """(keys, t, p): the one-to-one matching with the largest summed weight over edges (keys, t, p, w > 0).

    Rounds of `settle` are joins and aggregates over all pairs at once and take out nearly everything. What is left falls
    into connected groups of instances that compete with each other; each is solved exactly in one task. Such a group is
    a chain of mutually overlapping, near-equal candidates inside one image, not a whole image.
    """
    edges = stage(edges.filter("w > 0").select(*keys, "t", "p", "w"))
    chosen = None
    while True:
        sure = stage(settle(edges, keys))
        if sure.isEmpty():
            break
        chosen = sure if chosen is None else chosen.union(sure)
        edges = stage(edges.join(sure.select(*keys, "t"), [*keys, "t"], "left_anti")
                      .join(sure.select(*keys, "p"), [*keys, "p"], "left_anti"))
    if not edges.isEmpty():
        t_node, p_node = F.col("t").cast("long") * 2, F.col("p").cast("long") * 2 + 1
        roots = graph_components(edges.select(*keys, t_node.alias("a"), p_node.alias("b")), keys)
        part = edges.join(roots.withColumnRenamed("node", "_n"), [edges[k] == roots[k] for k in keys] + [t_node == F.col("_n")])
        part = part.select(*[edges[k] for k in keys], "t", "p", "w", "root")
        schema = edges.select(*keys, "t", "p").schema
        rest = part.groupBy(*keys, "root").applyInPandas(_assign_component, schema)
        chosen = rest if chosen is None else chosen.union(rest)
    return chosen if chosen is not None else edges.select(*keys, "t", "p")
